"""Line dedup with a log-template tree, in DataFrame operations only.

A line is parsed to a fixed depth: token count, then the two leading tokens.
In a leaf, fields that vary are generalised: tokens with digits, addresses and
links become ``<*>``, and each third of the remaining tokens may be one
wildcard, so lines that differ in one part share a template. A template recurs
if it is found in many unrelated documents; its lines are dropped from all.

Copies of a document repeat every line of it, and are left to document dedup:
texts are clustered by pairs of minhashes of their word 3-shingles, which near
copies share and unrelated texts do not, however few words a language has. A
template needs ``LEAST`` clusters, however many texts each of them holds, so a
larger corpus can only add to its count. Texts that share nothing but a common
line are in one cluster if both hashes of a pair fall into that line.

Defined cases: a null text stays null; empty lines and lines of fewer than
three tokens are kept; a text that loses all lines is empty; rows that repeat
key and text are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm.common import discard, landed
from busline.llm.components import components

LEAST = 8  # unrelated documents
TOKENS = 3  # shorter lines have no template
WILD_TOKENS = 8  # shorter lines have no wildcard part
PARTS = 3
SHINGLE = 3  # words
SKETCH = 32  # least shingle hashes of a text
BANDS = 6  # pairs of minhashes of the sketch
SALTS = 32
_BLANK = r"[ \t\r\f\x0B]+"
_FIELD = r"[^ ]*(?:[0-9@]|://)[^ ]*"


def _cleaned(line: Column) -> Column:
    """Single blanks, and ``<*>`` for tokens with digits, addresses and links."""
    uneven = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\x0b")
    one = F.trim(F.when(uneven, F.regexp_replace(line, _BLANK, " ")).otherwise(line))
    return F.when(one.rlike("[0-9@]|://"), F.regexp_replace(one, _FIELD, "<*>")).otherwise(one)


def _templates(clean: Column, n: Column) -> Column:
    """Hashes of the templates of a line of ``n`` tokens: tree path, and the rest with one part or none left open."""
    whole = F.array(F.xxhash64(F.lit(PARTS), n, clean))
    cut = lambda j: F.floor((n - 2) * F.lit(j) / F.lit(PARTS)).cast("int") + 2
    part = lambda j: F.xxhash64(F.lit(j), n, F.call_function("substring_index", clean, F.lit(" "), cut(j)), F.call_function("substring_index", clean, F.lit(" "), cut(j + 1) - n))
    return F.when(n >= WILD_TOKENS, F.concat(whole, F.array(*[part(j) for j in range(PARTS)]))).otherwise(whole)


def clusters(texts: DataFrame) -> DataFrame:
    """(b, kin) of texts that share a pair of minhashes with another one. ``texts``: b, t."""
    words = texts.select("b", F.explode(F.array(F.split(F.trim(F.col("t")), r"[ \t\r\n\f\x0B]+"))).alias("w"))
    hashed = F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    sketch = F.slice(F.sort_array(F.slice(hashed, 1, F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0)))), 1, SKETCH)
    d = words.filter(F.size("w") >= SHINGLE).select("b", F.explode(F.array(sketch)).alias("s"))
    least = lambda j: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(j))))
    bands = landed(d.select("b", F.array(*[F.xxhash64(F.lit(j), least(2 * j), least(2 * j + 1)) for j in range(BANDS)]).alias("bands")), "line-bands")
    rows = bands.select("b", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("b").alias("root"), F.max("b").alias("top")).filter("root < top").select("band", "root")
    # a band may be that of a third of all texts
    shared = shared.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    edges = rows.withColumn("salt", F.pmod("b", F.lit(SALTS)).cast("int")).join(shared, ["band", "salt"])
    labels = components(edges.select(F.col("b").alias("u"), F.col("root").alias("v")))
    discard(bands)
    return labels.select(F.col("node").alias("b"), F.col("label").alias("kin"))


def recurring_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, bad): hash pair of each document with recurring lines, and the hashes of these lines."""
    ids = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(key).alias("a"), F.xxhash64(text).alias("b"), F.col(text).alias("t"))
    d = ids.select("a", "b", F.explode(F.array_distinct(F.split("t", "\n"))).alias("line"))
    lines = d.select("a", "b", F.xxhash64("line").alias("line"), F.explode(F.array(_cleaned(F.col("line")))).alias("clean"))
    tokens = F.length("clean") - F.length(F.replace("clean", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", tokens).filter(F.col("n") >= TOKENS)
    lines = landed(lines.select("a", "b", "line", _templates(F.col("clean"), F.col("n")).alias("templates")), "line-hashes")
    often = lines.select(F.explode("templates").alias("template")).groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("template")
    rows = lines.select("a", "b", "line", F.explode("templates").alias("template"))
    found = landed(rows.join(often, "template", "left_semi"), "line-templates")
    discard(lines)
    chosen = unrelated(found, clusters(ids.select("b", "t")))
    # a template may be in a third of all lines: its rows are dealt out
    salt = F.pmod(F.col("b"), F.lit(SALTS)).cast("int")
    salted = chosen.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hit = found.withColumn("salt", salt).join(salted, ["template", "salt"], "left_semi")
    return hit.groupBy("a", "b").agg(F.collect_set("line").alias("bad"))


def unrelated(found: DataFrame, kin: DataFrame) -> DataFrame:
    """Templates of enough clusters of texts. ``found``: template, b; ``kin``: b, kin of texts that are not alone."""
    named = found.select("template", "b").distinct().join(kin, "b", "left").select("template", F.coalesce("kin", "b").alias("kin"))
    return named.distinct().groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("template")


def drop_recurring(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """All rows and columns of ``docs`` with recurring lines removed from ``text``, and two counts."""
    bad = recurring_lines(docs, key=key, text=text).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("bad").alias("__bad"))
    d = docs.withColumn("__a", F.xxhash64(key)).withColumn("__b", F.xxhash64(text)).join(bad, ["__a", "__b"], "left")
    d = d.withColumn("__lines", F.split(text, "\n"))
    kept = F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("__bad", F.xxhash64(x))))
    d = d.withColumn("__kept", F.explode(F.array(kept)))
    return d.select(
        *[F.col(c) if c != text else F.array_join("__kept", "\n").alias(text) for c in docs.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias(lines),
        F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long").alias(dropped),
    )

