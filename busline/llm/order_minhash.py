"""Order MinHash fingerprints, in DataFrame operations only.

A text is the sequence of its words. Its k-mers are runs of ``K`` words, each
numbered by how often the same run came before, so that repeats count. One
hash per numbered k-mer cuts them into ``BINS`` bins, each with two sides. The
minimal k-mer of either side of a bin is selected, the two are put in the order
of the text, and hashed as a tuple. Texts that are close in edit distance keep
both k-mers and their order; texts with the same runs in another order do not.
The likeness is the share of equal tuples among the bins that either text fills
(one hash cut into bins stands for one permutation per tuple: the selection
then is two ``min`` aggregates, and short texts need no padding).

Defined cases: a null text is an empty one; a text of fewer than ``K`` words is
one k-mer; equal texts have equal fingerprints; rows that repeat key and text
follow each other (each is next to its copy); a null key sorts first; the only
document is its own next one; an empty table gives an empty result. Positions
beyond 2^24 words count as the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline.llm.common import landed

K = 3  # words of a k-mer
BINS = 64
DIGITS = 5  # hex digits of a tuple hash
EMPTY = "-" * DIGITS
CHARS_PER_TASK = 4_000_000  # code points in a task; their k-mers then sort in memory
MOST_TASKS = 100_000  # beyond that, tasks grow and sorts spill
_POSITION = (1 << 24) - 1


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint) of each row; ``keys`` identify a row.

    If ``texts`` is already partitioned by some of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.split(text, r"\s+").alias("_w"))
    # exploding an array of one keeps the word hashes from being worked out again for every run
    hashed = words.select(*keys, F.explode(F.array(F.transform("_w", lambda w: F.xxhash64(w)))).alias("_h"))
    more = lambda i: [F.get(F.col("_h"), i + j) for j in range(1, K)]
    runs = hashed.select(*keys, F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, *more(i))), 1, F.greatest(F.size("_h") - (K - 1), F.lit(1))).alias("_r"))
    flat = runs.select(*keys, F.posexplode("_r").alias("_pos", "_run"))
    # the run comes first, as it tells rows apart at once when they are sorted
    seen = Window.partitionBy("_run", *keys).orderBy("_pos")
    numbered = flat.select(*keys, F.least(F.col("_pos"), F.lit(_POSITION)).cast("long").alias("_pos"), F.xxhash64("_run", F.row_number().over(seen)).alias("_v"))
    # seven leading bits of the hash are bin and side, the next ones the rank, the rest the place in the text
    cell = F.shiftrightunsigned("_v", 57)
    ranked = F.col("_v").bitwiseAND(F.lit((1 << 57) - 1 - _POSITION)).bitwiseOR(F.col("_pos"))
    placed = numbered.select(*keys, F.shiftright(cell, 1).cast("int").alias("_bin"), cell.bitwiseAND(F.lit(1)).alias("_side"), ranked.alias("_p"))
    least = [F.min(F.when(F.col("_side") == s, F.col("_p"))).alias(f"_m{s}") for s in (0, 1)]
    chosen = placed.groupBy(*keys, "_bin").agg(*least).select(*keys, "_bin", _tuple_hash(F.col("_m0"), F.col("_m1")).alias("_t"))
    wide = chosen.groupBy(*keys).agg(*[F.max(F.when(F.col("_bin") == i, F.col("_t"))).alias(f"_t{i}") for i in range(BINS)])
    shown = [F.coalesce(F.lower(F.lpad(F.hex(F.col(f"_t{i}")), DIGITS, "0")), F.lit(EMPTY)) for i in range(BINS)]
    return wide.select(*keys, F.concat(*shown).alias("fingerprint"))


def _tuple_hash(a: Column, b: Column) -> Column:
    """Hash of two selected k-mers in the order of the text; one of them may be missing."""
    mer = lambda c: c.bitwiseAND(F.lit(~_POSITION))
    at = lambda c: c.bitwiseAND(F.lit(_POSITION))
    h = F.xxhash64(F.coalesce(mer(a), F.lit(-1)), F.coalesce(mer(b), F.lit(-1)), F.coalesce(at(a) <= at(b), F.lit(True)))
    return h.bitwiseAND(F.lit(16**DIGITS - 1))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either fingerprint fills, 0 to 1."""
    part = lambda c, i: F.substring(c, 1 + DIGITS * i, DIGITS)
    same = [((part(a, i) == part(b, i)) & (part(a, i) != EMPTY)).cast("int") for i in range(BINS)]
    none = [((part(a, i) == part(b, i)) & (part(a, i) == EMPTY)).cast("int") for i in range(BINS)]
    return sum(same[1:], same[0]) / (F.lit(float(BINS)) - sum(none[1:], none[0]))


def with_next(ids: DataFrame, order: list[str], rows_per_span: int = 16_384) -> DataFrame:
    """Add next_<column> of the following row by ``order`` (unique); the first follows the last.

    The leading column is cut into spans of equal width, so windows are small;
    one row per span goes through one window to link the spans.
    """
    lead = order[0]
    low, high, n = ids.agg(F.min(lead), F.max(lead), F.count("*")).first()
    width = min(1 << 62, max(1, ((high - low) if n else 0) * rows_per_span // max(n, 1)))
    d = ids.withColumn("_span", F.floor(F.col(lead) / F.lit(width)).cast("long"))
    key = F.struct(*order)
    heads = d.groupBy("_span").agg(F.min(key).alias("_head"))
    every = Window.orderBy("_span")
    following = F.coalesce(F.lead("_head").over(every), F.first("_head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("_span", following.alias("_carry"))
    d = d.withColumn("_next", F.lead(key).over(Window.partitionBy("_span").orderBy(*order))).join(heads, "_span")
    d = d.withColumn("_next", F.coalesce("_next", "_carry"))
    return d.select(*ids.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in order])


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; see ``op6`` for the columns.

    The texts are shuffled once; the part of a text that replaces the end of
    the one before is shuffled on its own, already cut to length.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.agg(F.min(F.col(key).cast("long"))).first()[0] or 0
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(first - 1)).alias("kd"), t.alias("text"), F.xxhash64(t).alias("h"))
    ids = d.groupBy("kd", "h").agg(F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"), F.first(F.length("text").cast("long")).alias("n"))
    ids = landed(with_next(landed(ids, "omh-ids"), ["kd", "h"]), "omh-next")
    chars, most = ids.agg(F.sum("n"), F.max("copies")).first()
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars or 0) // CHARS_PER_TASK))
    texts = d.select("kd", "h", "text").repartition(tasks, "kd", "h")
    if (most or 1) > 1:
        texts = texts.dropDuplicates(["kd", "h"])
    half = F.floor(F.col("n") / 2).cast("int")
    asked = ids.select(F.col("kd").alias("to_kd"), F.col("h").alias("to_h"), F.col("next_kd").alias("kd"), F.col("next_h").alias("h"), half.alias("half"))
    ends = texts.join(asked, ["kd", "h"]).select(F.col("to_kd").alias("kd"), F.col("to_h").alias("h"), F.expr("substring(text, 1, half)").alias("end"))
    both = texts.join(ids.select("kd", "h", "n", "copies"), ["kd", "h"]).join(ends, ["kd", "h"])
    start = F.expr("substring(text, 1, cast(n - floor(n / 2) as int))")
    kinds = [(0, F.col("text")), (1, F.concat(start, F.col("end")))]
    if (most or 1) > 1:  # a copy that is followed by another copy of itself
        kinds.append((2, F.when(F.col("copies") > 1, F.concat(start, F.expr("substring(text, 1, cast(floor(n / 2) as int))")))))
    digests = both.select("kd", "h", *[F.sha2(c, 256).alias(f"sha{k}") for k, c in kinds if k])
    variants = both.select("kd", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds])).alias("v"))
    variants = variants.select("kd", "h", "v.kind", "v.text").filter(F.col("text").isNotNull())
    prints = fingerprints(variants, ["kd", "h", "kind"])
    wide = prints.groupBy("kd", "h").agg(*[F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(f"fp{k}") for k, _ in kinds])
    wide = landed(wide.join(digests, ["kd", "h"]), "omh-prints")
    nxt = wide.select(F.col("kd").alias("next_kd"), F.col("h").alias("next_h"), F.col("fp0").alias("fp_next"))
    rows = ids.join(wide, ["kd", "h"]).join(nxt, ["next_kd", "next_h"])
    out = lambda fp, sha, near: [
        "doc_id", F.col("n").alias("n_chars"), F.col(sha).alias("edited_sha256"), F.col("fp0").alias("fingerprint"), F.col(fp).alias("edited_fingerprint"),
        likeness(F.col("fp0"), F.col(fp)).alias("near_edited"), near.alias("near_next"),
    ]
    result = rows.select(*out("fp1", "sha1", likeness(F.col("fp0"), F.col("fp_next"))))
    if (most or 1) > 1:
        again = rows.filter(F.col("copies") > 1).withColumn("_c", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"))))
        result = result.unionByName(again.select(*out("fp2", "sha2", F.lit(1.0))))
    return result
