"""Keyed sampling, splitting and assembly of training sets.

Ranks inside a class come from hashed keys cut into key ranges, so a class
that holds most of the rows is still ranked by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.functions.keyed import KEY_RANGE, draw_key, draw_unit
from busline.operators import ordered as O
from busline.schema import SPAN
from busline.session import discard, landed

CLASSES = (1, 2, 3, 4)
_RANGE = 1 << 22  # key range ranked by one task: 1024 ranges over all keys


def keyed_rank(d: DataFrame, by: list[str], seed, key: str, stream="draw", out="rank") -> DataFrame:
    """1-based rank per group in hashed order; ties of the hash go by ``key``."""
    d = d.withColumn("_k", draw_key(seed, stream, F.col(key)))
    return O.ranked(d, by, ["_k", key], F.floor(F.col("_k") / _RANGE), out).drop("_k")


def first_ranks(d: DataFrame, by: list[str], quota: DataFrame | int, seed, key: str, stream="draw", out="rank") -> DataFrame:
    """The rows that ``keyed_rank`` puts at ``quota`` or before, with their rank, without ranking the rest.

    ``quota`` is a number, or a table with one row per group and a column
    ``quota``; groups without a row there are left out. The keys of a group are
    even over their range, so few beyond those wanted lie under quota / size
    and a margin of six standard deviations. Only these rows are shuffled. A
    group that keeps too few of them is ranked whole.
    """
    d = d.withColumn("_k", draw_key(seed, stream, F.col(key)))
    if by:
        sizes = d.groupBy(*by).agg(F.count("*").alias("_size"))
        want = sizes.withColumn("quota", F.lit(quota)) if isinstance(quota, int) else sizes.join(quota, [c for c in by if c in quota.columns])
    else:
        want = d.agg(F.count("*").alias("_size")).withColumn("quota", F.lit(quota))
    q = F.col("quota").cast("double")
    share = F.least(F.lit(1.0), (q + 6 * F.sqrt(q) + 20) / F.greatest(F.col("_size"), F.lit(1)))
    want = landed(want.where("quota > 0").select(*by, "quota", "_size", (share * KEY_RANGE).alias("_upto")), "quotas")

    def under(limits: DataFrame) -> DataFrame:
        if by:
            return d.join(limits, by).where(F.col("_k") <= F.col("_upto"))
        one = limits.first()
        return d.limit(0).withColumn("quota", F.lit(0)) if one is None else d.where(F.col("_k") <= one["_upto"]).withColumn("quota", F.lit(one["quota"]))

    kept = under(want).groupBy(*by).agg(F.count("*").alias("_kept"))
    kept = want.join(kept, by, "left") if by else want.withColumn("_kept", kept.select("_kept").scalar())
    short = F.coalesce("_kept", F.lit(0)) < F.least("quota", "_size")
    limits = landed(kept.withColumn("_upto", F.when(short, F.lit(float(KEY_RANGE))).otherwise(F.col("_upto"))).select(*by, "quota", "_upto"), "quotas")
    near = under(limits).select(*d.columns, F.col("quota").alias("_quota"))
    return O.ranked(near, by, ["_k", key], F.floor(F.col("_k") / _RANGE), out).where(F.col(out) <= F.col("_quota")).drop("_k", "_quota")


def _quota_table(spark, cls: str, kind, want: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(list(want.items()), "c long, quota long").select(F.col("c").cast(kind).alias(cls), "quota")


def quotas(total: int, classes=CLASSES) -> dict[int, int]:
    """Equal shares; the first classes take the remainder."""
    share, rest = divmod(total, len(classes))
    return {c: share + (i < rest) for i, c in enumerate(classes)}


def _per_class(values: dict[int, int], cls: str) -> Column:
    return F.coalesce(*[F.when(F.col(cls) == c, F.lit(n)) for c, n in values.items()], F.lit(0)).cast("long")


def class_sizes(d: DataFrame, cls: str, classes=CLASSES) -> dict[int, int]:
    """Rows per listed class: one small row per class reaches the driver."""
    rows = d.where(F.col(cls).isin(*classes)).groupBy(cls).agg(F.count("*").alias("n")).collect()
    have = {r[0]: r[1] for r in rows}
    return {c: have.get(c, 0) for c in classes}


def sample_balanced(d: DataFrame, total: int, seed, key: str, cls="y_attack_type", classes=CLASSES) -> DataFrame:
    """Balanced draw; a class with too few rows is drawn with replacement."""
    want, have = quotas(total, classes), class_sizes(d, cls, classes)
    short = [c for c in classes if want[c] > have[c]]
    # a short class is ranked whole, as each of its rows can be drawn
    table = _quota_table(d.sparkSession, cls, d.schema[cls].dataType, {c: max(want[c], have[c]) if c in short else want[c] for c in classes})
    r = first_ranks(d, [cls], table, seed, key)
    out = r.where(~F.col(cls).isin(*short)).withColumn("draw", F.col("rank"))
    for c in short:
        if have[c] == 0:
            raise ValueError(f"class {c} has no rows to draw from")
        n = d.sparkSession.range(1, want[c] + 1).withColumnRenamed("id", "draw")
        n = n.withColumn("rank", F.floor(draw_unit(seed, "again", c, F.col("draw")) * have[c]) + 1)
        out = out.unionByName(n.join(r.where(F.col(cls) == c), "rank"))
    return out.drop("rank")


def sample_strict(d: DataFrame, total: int, seed, key: str, cls="y_attack_type", classes=CLASSES) -> tuple[DataFrame, DataFrame]:
    """Balanced draw without replacement; a short class is an error. Also an audit per class."""
    want, have = quotas(total, classes), class_sizes(d, cls, classes)
    short = {c: (want[c], have[c]) for c in classes if want[c] > have[c]}
    if short:
        raise ValueError("capacity exceeded: " + ", ".join(f"class {c} wants {w}, has {h}" for c, (w, h) in short.items()))
    table = _quota_table(d.sparkSession, cls, d.schema[cls].dataType, want)
    drawn = first_ranks(d, [cls], table, seed, key).withColumnRenamed("rank", "draw")
    audit = drawn.groupBy(cls).agg(F.count("*").alias("drawn"), F.count_distinct(key).alias("unique_rows"))
    audit = audit.select(
        cls, _per_class(have, cls).alias("available"), _per_class(want, cls).alias("requested"), "drawn", "unique_rows",
        (F.col("drawn") - F.col("unique_rows")).alias("repeated"),
    )
    return drawn, audit


def capacity(d: DataFrame, n="n", ratio="ratio", classes=CLASSES) -> DataFrame:
    """Pool rows needed in total, per class, and at least in every class."""
    total = F.bround(F.col(n) * F.col(ratio)).cast("long")
    k = len(classes)
    d = d.withColumn("requested", total)
    per = [(F.floor(F.col("requested") / k) + (F.lit(i) < F.col("requested") % k).cast("long")).alias(f"class_{c}") for i, c in enumerate(classes)]
    return d.select("*", *per, F.ceil(F.col("requested") / k).alias("min_per_class"))


def require_capacity(d: DataFrame, available: str) -> DataFrame:
    """Raise where a pool offers fewer rows per class than needed."""
    short = F.col(available) < F.col("min_per_class")
    msg = F.concat(F.lit("pool too small, needs "), F.col("min_per_class").cast("string"))
    return d.withColumn("min_per_class", F.when(short, F.raise_error(msg).cast("long")).otherwise(F.col("min_per_class")))


def half_even(x: float) -> int:
    return round(x)


def augment(train: DataFrame, pool: DataFrame, ratio: float, seed: int, key: str, cls="y_attack_type") -> DataFrame:
    """Training rows plus round(n*ratio) balanced pool rows; ``origin`` tells them apart."""
    n = half_even(train.count() * ratio)
    drawn = sample_balanced(pool, n, seed + int(ratio * 1000), key, cls)
    return train.withColumn("origin", F.lit("real")).unionByName(drawn.withColumn("origin", F.lit("pool")), allowMissingColumns=True)


def oversample(train: DataFrame, ratio: float, seed: int, key: str, cls="y_attack_type") -> DataFrame:
    """The same budget drawn from the real attacks."""
    return augment(train, train.where(F.col(cls) > 0), ratio, seed, key, cls)


def cap_rows(d: DataFrame, n: int, seed, key: str) -> DataFrame:
    """At most ``n`` rows, uniform and without replacement."""
    return first_ranks(d, [], n, seed, key).drop("rank")


def stratified_cap(d: DataFrame, cap: int, seed, key: str, y="y") -> DataFrame:
    """Half attacks, half normals; normals fill up when attacks are scarce."""
    have = class_sizes(d, y, (0, 1))
    if cap <= 0 or have[0] + have[1] <= cap:
        return d
    attacks = min(have[1], cap // 2)
    normals = min(have[0], cap - attacks)
    table = _quota_table(d.sparkSession, y, d.schema[y].dataType, {0: normals, 1: attacks})
    return first_ranks(d, [y], table, seed, key).drop("rank")


def stratified_fraction(d: DataFrame, f: float, seed, key: str, cls: str) -> DataFrame:
    """max(1, round(n*f)) rows per class."""
    n = d.groupBy(cls).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(f))).cast("long").alias("quota"))
    return first_ranks(d, [cls], n, seed, key).drop("rank")


def aligned(w: DataFrame, size=128, start="start_index") -> DataFrame:
    """Windows whose start is a multiple of the window size: they share no frame."""
    return w.where(F.col(start) % size == 0)


def next_starts(nodes: DataFrame, by: list[str], start: str, end: str, span: int = SPAN) -> DataFrame:
    """(by, at, to): for each window the start of the first one after its end; windows without one are left out.

    Starts and ends lie on one line; walking down it, the last start passed is
    the next one. The walk goes span by span, so a segment is many tasks.
    """
    place = F.greatest(start, end)  # a window with its end before its start still moves on
    starts = nodes.select(*by, (F.col(start) * -2).alias("_o"), F.col(start).alias("_at"), F.lit(None).cast("long").alias("_from"))
    ends = nodes.select(*by, (place * -2 - 1).alias("_o"), F.lit(None).cast("long").alias("_at"), F.col(start).alias("_from"))
    line = O.carry_last(starts.unionAll(ends), by, "_o", F.col("_at"), "_to", 2 * span)
    return line.where(F.col("_from").isNotNull() & F.col("_to").isNotNull()).select(*by, F.col("_from").alias("at"), F.col("_to").alias("to"))


def reached(jumps: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """All (by, at) that the jumps lead to from the roots, in a number of rounds that is logarithmic in the longest way.

    A round starts with the first 4^r windows of each way and jumps of that many
    steps. It takes one and two jumps from what it has, and puts four jumps
    together by equi joins. Each round is written, and the one before deleted.
    """
    roots, jumps = landed(roots, "reached"), landed(jumps, "jumps")
    while True:
        hop = lambda d, j: d.join(j, [*by, "at"]).select(*by, F.col("to").alias("at"))
        chain = lambda j, k: j.withColumnRenamed("at", "_a").withColumnRenamed("to", "at").join(k, [*by, "at"]).select(*by, F.col("_a").alias("at"), "to")
        double = chain(jumps, jumps)
        once = roots.unionAll(hop(roots, jumps))
        more = landed(hop(once, double).unionAll(hop(roots, jumps)), "reached-new")
        if more.isEmpty():
            discard(more, jumps)
            return roots
        new_roots = landed(roots.unionAll(more), "reached")
        new_jumps = landed(chain(double, double), "jumps")
        discard(more, roots, jumps)
        roots, jumps = new_roots, new_jumps


def greedy_disjoint(w: DataFrame, by: list[str], start="start_index", end="end_index", span: int = SPAN) -> DataFrame:
    """Per segment keep the next window that starts after the last kept end.

    Which window follows a kept one depends on that one alone. So every window
    points to its successor, the pointers are doubled, and what the first
    window of the segment reaches is kept. Of windows with equal starts the
    shortest counts, once; rows with a null key, start or end are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, start, end]])
    kinds = {f.name: f.dataType for f in w.schema}
    nodes = w.where(known).groupBy(*by, F.col(start).cast("long").alias(start)).agg(F.min(F.col(end).cast("long")).alias(end))
    nodes = landed(nodes, "greedy-windows")
    kept = reached(next_starts(nodes, by, start, end, span), nodes.groupBy(*by).agg(F.min(start).alias("at")), by)
    return nodes.join(kept.withColumnRenamed("at", start), [*by, start], "left_semi").select(
        *by, F.col(start).cast(kinds[start]).alias(start), F.col(end).cast(kinds[end]).alias(end)
    )


def partition_blocks(w: DataFrame, size: int, blocks: int, seed, key: str) -> DataFrame:
    """Keyed permutation cut into ``blocks`` consecutive blocks of ``size`` rows."""
    d = first_ranks(w, [], size * blocks, seed, key).withColumn("block", F.floor((F.col("rank") - 1) / size) + 1)
    return d.where(F.col("block") <= blocks).drop("rank")


def purged_split(w: DataFrame, block: int, seed, by: list[str], cls="y_attack_type", test_share=0.3) -> DataFrame:
    """Group windows by raw-frame block, drop those that cross an edge, split groups 70/30 per class."""
    b = F.floor(F.col("start_index") / block)
    d = w.where((F.col(cls) > 0) & (b == F.floor(F.col("end_index") / block)))
    d = d.withColumn("group", F.concat_ws("|", *by, b.cast("string")))
    groups = d.select(cls, "group").distinct()
    n = groups.groupBy(cls).agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") < 2, F.raise_error(F.lit("a class has fewer than two groups")).cast("long")).otherwise(F.col("_n"))
    n = n.select(cls, enough.alias("_n"))
    test = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(test_share)).cast("long")))
    g = keyed_rank(groups, [cls], seed, "group", "purge").join(n, cls)
    g = g.select(cls, "group", F.when(F.col("rank") <= test, "test").otherwise("train").alias("part"))
    return d.join(g, [cls, "group"])


def match_domains(real: DataFrame, syn: DataFrame, seed, key: str, cls="y_attack_type", part="part") -> DataFrame:
    """Equal real and synthetic counts in every (class, part): the smallest count of the part."""
    both = real.withColumn("domain", F.lit("real")).unionByName(syn.withColumn("domain", F.lit("synthetic")), allowMissingColumns=True)
    c = both.groupBy("domain", cls, part).agg(F.count("*").alias("_n"))
    least = c.groupBy(part).agg(F.min("_n").alias("quota"))
    return first_ranks(both, ["domain", cls, part], least, seed, key).drop("rank")


# Which tables each training arm adds to the real source windows.
ARMS = {
    "source_real": (),
    "source_rule30": ("rule",),
    "target_normal": ("target_normal",),
    "target_synth_only": ("target_synth",),
    "target_normal_target_synth": ("target_normal", "target_synth"),
    "target_normal_source_rule30": ("rule", "target_normal"),
    "target_normal_real_attack_oracle": ("target_normal", "oracle"),
}


def build_arm(arm: str, tables: dict[str, DataFrame], seed: int, key: str, ratio=0.3, cls="y_attack_type") -> DataFrame:
    """One named training set; synthetic parts are balanced draws of round(n*ratio) windows."""
    parts = [tables["source"].withColumn("origin", F.lit("source"))]
    n = half_even(tables["source"].count() * ratio) if set(ARMS[arm]) & {"rule", "target_synth"} else 0
    for name in ARMS[arm]:
        t = tables[name]
        if name == "rule":
            t = sample_balanced(t, n, seed + int(ratio * 1000), key, cls)
        elif name == "target_synth":
            t = sample_balanced(t, n, seed + 600, key, cls)
        elif name == "target_normal":
            t = t.withColumn(cls, F.lit(0))
        parts.append(t.withColumn("origin", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def calibration_windows(w: DataFrame, files: DataFrame, cap: int, seed, key: str, unit="source_file", oracle=False) -> DataFrame:
    """Capped normal windows of the calibration files, and all their attacks if wanted."""
    cal = w.join(files.where("role = 'calibration'").select(unit), unit, "left_semi")
    normal = cap_rows(cal.where("y_binary = 0"), cap, seed, key)
    return normal.unionByName(cal.where("y_binary = 1")) if oracle else normal


def class_weights(d: DataFrame, cls="y_attack_type") -> DataFrame:
    """Weight n / (classes * class count) on every row."""
    c = d.groupBy(cls).agg(F.count("*").alias("_n"))
    facts = c.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k")).alias("f")).scalar()
    w = c.withColumn("_f", facts).select(cls, (F.col("_f.n") / (F.col("_f.k") * F.col("_n"))).alias("weight"))
    return d.join(w, cls)
