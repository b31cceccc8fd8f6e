"""Summaries over seeds and paired statistics on result tables.

A result table has one row per cell of an experiment (setting, seed, unit ...):
it is the output of the aggregations in ``metrics`` and small beside the
windows. All operators stay distributed all the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.functions.keyed import draw_key, draw_unit
from busline.functions.student import normal_two_sided, t_ppf, t_two_sided
from busline.operators import ordered as O
from busline.operators import sampling as S
from busline.session import landed


def _sd(c) -> Column:
    """Sample SD, 0 for a single value."""
    return F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0)


def _list(c) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ";")


def summarize_seeds(d: DataFrame, by: list[str], metrics: list[str], seed="seed") -> DataFrame:
    """Mean and sample SD of each metric over the seeds, with the seed list."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), _sd(m).alias(f"{m}_std"))]
    return d.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), _list(seed).alias("seeds"), *aggs)


def recall_delta(d: DataFrame, by: list[str], arm: str, baseline, recalls: list[str]) -> DataFrame:
    """Recall columns to rows, averaged over seeds, with the difference to the baseline arm."""
    long = d.unpivot([*by, arm], recalls, "measure", "value").groupBy(*by, arm, "measure").agg(F.avg("value").alias("mean"), _sd("value").alias("std"))
    base = long.where(F.col(arm) == baseline).select(*by, "measure", F.col("mean").alias("_b"))
    return long.join(base, [*by, "measure"], "left").withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")


def condition_gap(d: DataFrame, by: list[str], condition: str, a, b, metrics: list[str]) -> DataFrame:
    """Mean of each metric under two conditions and their difference; rows without both are dropped."""
    pick = lambda m, v: F.avg(F.when(F.col(condition) == v, F.col(m)))
    g = d.groupBy(*by).agg(*[x for m in metrics for x in (pick(m, a).alias(f"{m}_{a}"), pick(m, b).alias(f"{m}_{b}"))])
    g = g.select("*", *[(F.col(f"{m}_{a}") - F.col(f"{m}_{b}")).alias(f"{m}_drop") for m in metrics])
    return g.where(reduce(lambda x, y: x & y, [F.col(f"{m}_drop").isNotNull() for m in metrics]))


def degradation(d: DataFrame, by: list[str], arm: str, baseline, metrics: list[str], own: DataFrame) -> DataFrame:
    """Baseline minus arm per cell, and the gap of the arm to its own in-domain test."""
    base = d.where(F.col(arm) == baseline).select(*by, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    ref = own.select(*by, arm, *[F.col(m).alias(f"_o_{m}") for m in metrics])
    j = d.where(F.col(arm) != baseline).join(base, by, "left").join(ref, [*by, arm], "left")
    return j.select(
        *by, arm, *[(F.col(f"_b_{m}") - F.col(m)).alias(f"{m}_degradation") for m in metrics],
        *[(F.col(f"_o_{m}") - F.col(m)).alias(f"{m}_gap") for m in metrics],
    )


def _pearson(x: str, y: str) -> Column:
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    ok = (F.count("*") >= 3) & (sx > 1e-12) & (sy > 1e-12)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), sx * sy))


def with_rank(d: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """Average rank of equal values, from counts of distinct values; rows with a null value or key go."""
    d = landed(d, "rank-rows")  # read for the counts and for the join
    return O.join_ties(d, O.average_ranks(d, by, col, out), [*by, col])


def correlations(d: DataFrame, by: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson and Spearman per pair; NULL with fewer than three rows or a constant side."""
    rows = []
    for x, y in pairs:
        p = d.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        p = with_rank(with_rank(p, by, "x", "rx"), by, "y", "ry")
        g = p.groupBy(*by).agg(F.count("*").alias("n"), _pearson("x", "y").alias("pearson"), _pearson("rx", "ry").alias("spearman"))
        rows.append(g.select(*by, F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "pearson", "spearman"))
    return reduce(lambda a, b: a.unionAll(b), rows)


def burst_mismatch(a: DataFrame, b: DataFrame, cls: str, count: str) -> DataFrame:
    """|mean injections| between two tables, per class and on average."""
    m = lambda d, n: d.groupBy(cls).agg(F.avg(count).alias(n))
    j = m(a, "a_mean").join(m(b, "b_mean"), cls).withColumn("mismatch", F.abs(F.col("a_mean") - F.col("b_mean")))
    return j.withColumn(cls, F.col(cls).cast("string")).unionByName(
        j.agg(F.lit("all").alias(cls), F.avg("a_mean").alias("a_mean"), F.avg("b_mean").alias("b_mean"), F.avg("mismatch").alias("mismatch")))


def t_interval(d: DataFrame, by: list[str], value: str, conf=0.95) -> DataFrame:
    """Mean, SD, extremes, t interval, sign counts, t and p; equal values are marked as degenerate.

    A degenerate group has a point interval and p = 1 for bookkeeping.  ``conf``
    may map name suffixes to levels for several intervals in one pass.
    """
    v = F.col(value)
    g = d.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(v).alias("mean"), _sd(value).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"),
    )
    flat = (F.col("min") == F.col("max")) | (F.col("n") < 2)
    df = F.greatest(F.col("n") - 1, F.lit(1))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    levels = conf if isinstance(conf, dict) else {"": conf}
    names = g.columns
    g = g.select("*", *[t_ppf(F.lit(0.5 + level / 2), df).alias(f"_q{s}") for s, level in levels.items()])
    ends = []
    for suffix in levels:
        half = F.when(flat, 0.0).otherwise(F.col(f"_q{suffix}") * se)
        ends += [(F.col("mean") - half).alias(f"ci_low{suffix}"), (F.col("mean") + half).alias(f"ci_high{suffix}")]
    t = F.when(~flat, F.try_divide(F.col("mean"), se))
    return g.select(
        *names, *ends, t.alias("t"),
        F.when(flat, 1.0).otherwise(t_two_sided(t, df)).alias("p"), flat.alias("degenerate"),
        F.when(flat, "degenerate_variance").otherwise("complete").alias("status"),
    )


def paired_values(d: DataFrame, by: list[str], arm: str, a, b, value: str, seed="seed") -> DataFrame:
    """One row per pair: values of both arms at the same seed and their difference."""
    side = lambda v, n: d.where(F.col(arm) == v).select(*by, seed, F.col(value).alias(n))
    return side(a, "value_a").join(side(b, "value_b"), [*by, seed]).withColumn("delta", F.col("value_a") - F.col("value_b"))


def paired_contrast(d: DataFrame, by: list[str], arm: str, a, b, value: str, seed="seed", conf=0.95) -> DataFrame:
    """Paired difference of two arms over seeds with interval, signs and decision."""
    p = paired_values(d, by, arm, a, b, value, seed)
    g = p.groupBy(*by).agg(F.avg("value_a").alias("mean_a"), _sd("value_a").alias("sd_a"), F.avg("value_b").alias("mean_b"), _sd("value_b").alias("sd_b"), _list(seed).alias("seeds"))
    s = t_interval(p, by, "delta", conf)
    decision = F.when(F.col("ci_low") > 0, "positive_effect_supported").when(F.col("ci_high") < 0, "negative_effect_supported").otherwise("inconclusive_not_equivalent")
    same = F.concat(F.greatest("positive", "negative", "zero").cast("string"), F.lit("/"), F.col("n").cast("string"))
    return g.join(s, by).select("*", decision.alias("decision"), same.alias("sign_consistency"))


def paired_settings(d: DataFrame, by: list[str], setting: str, a, b, metrics: list[str], seed="seed") -> DataFrame:
    """Augmented minus baseline inside each seed, for several rates, one row per group and rate."""
    long = d.unpivot([*by, setting, seed], metrics, "metric", "value")
    return t_interval(paired_values(long, [*by, "metric"], setting, a, b, "value", seed), [*by, "metric"], "delta")


def arm_contrast_summary(d: DataFrame, by: list[str], arm: str, value: str, contrasts: dict[str, tuple], seed="seed") -> DataFrame:
    """Arm rows and named contrasts in one table; contrasts carry a flag for all-positive seeds."""
    arms = d.groupBy(*by, F.col(arm).alias("name")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), _sd(value).alias("sd"))
    out = arms.select(*by, F.lit("arm").alias("row_type"), "name", "n", "mean", "sd", F.lit(None).cast("boolean").alias("all_positive"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for n, (a, b) in contrasts.items()])
    e = d.select(*by, seed, F.col(arm).alias("_arm"), F.col(value).alias("_v"), F.inline(table)).where((F.col("_arm") == F.col("_a")) | (F.col("_arm") == F.col("_b")))
    side = lambda c: F.max(F.when(F.col("_arm") == F.col(c), F.col("_v")))
    p = e.groupBy(*by, "name", seed).agg((side("_a") - side("_b")).alias("delta")).where(F.col("delta").isNotNull())
    c = p.groupBy(*by, "name").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), _sd("delta").alias("sd"), F.bool_and(F.col("delta") > 0).alias("all_positive"))
    return out.unionByName(c.select(*by, F.lit("contrast").alias("row_type"), "name", "n", "mean", "sd", "all_positive"))


def wilson_hw(k: Column, n: Column, z=1.96) -> Column:
    """Half width of the Wilson interval; NULL without trials."""
    p = F.try_divide(k, n)
    return F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), 1 + F.try_divide(F.lit(z * z), n))


EXACT_PAIRS = 2000  # differences up to which the distribution of the rank sum is built


def _rank_sum_p(ranks: np.ndarray, w: int) -> float:
    """Two-sided p of a sum ``w`` of doubled ranks, each of which is in the sum or not with equal chance.

    The product of the factors (1 + z^r) / 2 is built up to the nearer tail
    alone; the distribution is symmetric.
    """
    unit = int(np.gcd.reduce(ranks))
    ranks, w = np.sort(ranks // unit), w // unit
    top = int(min(w, ranks.sum() - w))
    ways, reach, halved = np.zeros(top + 1), 0, 0
    ways[0] = 1.0
    for n, r in enumerate(ranks.tolist(), 1):
        reach = min(top, reach + r)
        if r <= top:
            ways[r : reach + 1] += ways[: reach + 1 - r].copy()
        if n % 500 == 0:  # a power of two, so nothing is rounded
            ways, halved = ways * 2.0**-500, n
    return min(1.0, 2 * float(ways.sum()) * 2.0 ** (halved - len(ranks)))


@F.pandas_udf(T.DoubleType())
def _exact_p(ranks: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([_rank_sum_p(np.asarray(r, np.int64), int(x)) for r, x in zip(ranks, w)], dtype="float64")


def wilcoxon(pairs: DataFrame, by: list[str], delta="delta") -> DataFrame:
    """Two-sided signed-rank p; zero and undefined differences are dropped, p = 1 if none is left.

    Exact with up to ``EXACT_PAIRS`` differences in a group, tied ranks
    included. Beyond, where the distribution no longer fits a task, from the
    normal distribution with the variance of the given ranks; no group's ranks
    are gathered for that.
    """
    if not by:
        return wilcoxon(pairs.withColumn("_all", F.lit(0)), ["_all"], delta).drop("_all")
    d = pairs.where(_finite(delta) & (F.col(delta) != 0)).select(*by, F.abs(F.col(delta).cast("double")).alias("_abs"), (F.col(delta) > 0).alias("_up"))
    d = landed(with_rank(d, by, "_abs", "_r").select(*by, "_up", F.round(F.col("_r") * 2).cast("long").alias("_r2")), "signed-ranks")
    whole = F.col("_r2").cast("decimal(38,0)")
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_used"), F.coalesce(F.sum(F.when(F.col("_up"), whole)), F.lit(0)).cast("double").alias("_w"),
        F.sum(whole).cast("double").alias("_s"), F.sum(F.col("_r2").cast("double") ** 2).alias("_q"),
    )
    few = F.col("n_used") <= EXACT_PAIRS
    small = g.where(few).select(*by, F.col("_w").cast("long").alias("_sum"))
    exact = d.join(small, by).groupBy(*by).agg(F.collect_list("_r2").alias("_rs"), F.first("_sum").alias("_sum"))
    exact = exact.select(*by, _exact_p("_rs", "_sum").alias("_p"))
    z = (F.abs(F.col("_w") - F.col("_s") / 2) - 1) / F.sqrt(F.col("_q") / 4)  # of doubled ranks, half a step is 1
    p = F.coalesce("_p", F.least(F.lit(1.0), normal_two_sided(F.greatest(z, F.lit(0.0)))))
    r = g.join(exact, by, "left").select(*by, "n_used", (F.col("_w") / 2).alias("w_plus"), p.alias("p"))
    every = pairs.select(*by).distinct().join(r, by, "left")
    return every.select(*by, F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("p", F.lit(1.0)).alias("p"))


def t_from_summary(d: DataFrame, mean="mean", sd="sd", n="n") -> DataFrame:
    """t and two-sided p from mean, SD and n; rows with n < 2 or no spread raise."""
    ok = (F.col(n) >= 2) & (F.col(sd) > 0)
    t = F.when(ok, F.col(mean) / (F.col(sd) / F.sqrt(F.col(n).cast("double")))).otherwise(F.raise_error(F.lit("t test needs n >= 2 and spread")).cast("double"))
    return d.withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col(n) - 1))


def holm(d: DataFrame, family: list[str], p="p", tie="name", out="holm_p") -> DataFrame:
    """Step-down adjusted p within each family; equal p are ordered by ``tie``."""
    w = W.partitionBy(*family).orderBy(p, tie)
    m = F.count("*").over(W.partitionBy(*family))
    d = d.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return d.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


def _finite(value: str):
    x = F.col(value).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


GROUP_UNITS = 1 << 16  # units of a group that are held as one array
RESAMPLES = 50  # resamples of one row


def _units(d: DataFrame, own: list[str], value: str, key: str) -> DataFrame:
    return d.where(_finite(value)).select(*own, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))


def _drawn_in_arrays(u: DataFrame, own: list[str], b: int, seed) -> DataFrame:
    """(own, _b, _sum, _n) of each resample: the units of a group lie in an array, draws index it.

    Rows are (group, some resamples), dealt out to all tasks.
    """
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in own]) if own else F.lit("")
    unit = F.struct(draw_key(seed, "boot", F.col("_key")).alias("k"), "_key", "_v")
    g = u.groupBy(*own).agg(F.sort_array(F.collect_list(unit))["_v"].alias("_vals"), F.count("*").alias("_n"))
    parts = int(u.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(RESAMPLES)))
    g = g.select(*own, label.alias("_label"), "_vals", "_n", first.alias("_b0")).repartition(parts, *own, "_b0")
    pick = lambda i, slot: F.floor(draw_unit(seed, F.col("_label"), i, slot) * F.col("_n")).cast("int")
    total = lambda i: F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda s, slot: s + F.get("_vals", pick(i, slot)))
    numbers = F.sequence(F.col("_b0"), F.least(F.col("_b0") + RESAMPLES, F.lit(b)) - 1)
    sums = F.transform(numbers, lambda i: F.struct(i.alias("_b"), total(i).alias("_sum")))
    return g.select(*own, "_n", F.inline(sums))


def _drawn_by_rank(u: DataFrame, own: list[str], b: int, seed) -> DataFrame:
    """The same for groups of any size: every slot draws a rank, and an equi join finds its unit."""
    r = S.keyed_rank(u, own, seed, "_key", "boot", "_rank")
    n = r.groupBy(*own).agg(F.count("*").alias("_n"))
    slots = r.select(*own, F.col("_rank").alias("_slot"))
    slots = slots.join(n, own) if own else slots.withColumn("_n", n.select("_n").scalar())
    slots = slots.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in own]) if own else F.lit("")
    slots = slots.withColumn("_rank", F.floor(draw_unit(seed, label, F.col("_b"), F.col("_slot")) * F.col("_n")) + 1)
    drawn = slots.join(r.select(*own, "_rank", "_v"), [*own, "_rank"])
    return drawn.groupBy(*own, "_b").agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum")).select(*own, "_n", "_b", "_sum")


def bootstrap_means(d: DataFrame, by: list[str], value: str, key: str, b: int, seed, stratum: list[str] = ()) -> DataFrame:
    """Mean of each of ``b`` keyed resamples per group.

    Every unit slot draws a unit of its own (group, stratum) by a hashed key, so
    both ways of looking it up give the same draws: arrays for groups of up to
    ``GROUP_UNITS`` units, ranks for larger ones.
    """
    own = [*by, *stratum]
    u = landed(_units(d, own, value, key), "boot-units")
    sizes = u.groupBy(*own).agg(F.count("*").alias("_size"))
    large = landed(sizes.where(F.col("_size") > GROUP_UNITS).select(*own, F.lit(True).alias("_large")), "boot-large")
    if large.isEmpty():
        drawn = _drawn_in_arrays(u, own, b, seed)
    elif not own:
        drawn = _drawn_by_rank(u, own, b, seed)
    else:
        drawn = _drawn_in_arrays(u.join(large, own, "left_anti"), own, b, seed).unionByName(_drawn_by_rank(u.join(large, own, "left_semi"), own, b, seed))
    return drawn.groupBy(*by, "_b").agg((F.sum("_sum") / F.sum("_n")).alias("boot_mean"))


def bootstrap_ci(d: DataFrame, by: list[str], value: str, key: str, b=2000, seed=1, conf=0.95, stratum: list[str] = ()) -> DataFrame:
    """Percentile interval of the mean; undefined (NULL or not finite) units are counted and left out.

    A single unit gives itself. With ``stratum`` units are redrawn inside their
    stratum and pooled, and fewer than two units give no interval.
    """
    m = bootstrap_means(d, by, value, key, b, seed, stratum)
    lo, hi = (1 - conf) / 2, (1 + conf) / 2
    q = m.groupBy(*by).agg(F.percentile("boot_mean", F.lit(lo)).alias("ci_low"), F.percentile("boot_mean", F.lit(hi)).alias("ci_high"))
    used = F.when(_finite(value), F.col(value).cast("double"))
    base = d.groupBy(*by).agg(F.count(used).alias("units"), F.count_if(~_finite(value)).alias("undefined"), F.avg(used).alias("mean"))
    out = base.join(q, by, "left") if by else base.select("*", q.select("ci_low").scalar().alias("ci_low"), q.select("ci_high").scalar().alias("ci_high"))
    if stratum:
        for c in ("ci_low", "ci_high"):
            out = out.withColumn(c, F.when(F.col("units") >= 2, F.col(c)))
    return out


def nested_summary(d: DataFrame, by: list[str], seed: str, block: str, value: str) -> DataFrame:
    """Mean over blocks inside each seed, then seeds as units; the block spread is only described."""
    per_seed = d.groupBy(*by, seed).agg(F.avg(value).alias("_v"), _sd(value).alias("_bsd"))
    blocks = d.groupBy(*by).agg(F.count_distinct(block).alias("blocks"))
    bsd = per_seed.groupBy(*by).agg(F.avg("_bsd").alias("mean_block_sd"))
    return t_interval(per_seed, by, "_v").join(blocks, by).join(bsd, by)


def paired_blocks(d: DataFrame, by: list[str], seed: str, block: str, arm: str, treat, ref, value: str) -> DataFrame:
    """Treatment minus reference per (seed, block); an incomplete pair raises."""
    g = d.where(F.col(arm).isin(treat, ref)).groupBy(*by, seed, block).agg(
        F.max(F.when(F.col(arm) == treat, F.col(value))).alias("treatment"), F.max(F.when(F.col(arm) == ref, F.col(value))).alias("reference"), F.count("*").alias("_n"))
    whole = (F.col("_n") == 2) & F.col("treatment").isNotNull() & F.col("reference").isNotNull()
    delta = F.when(whole, F.col("treatment") - F.col("reference")).otherwise(F.raise_error(F.lit("pair grid is incomplete")).cast("double"))
    return g.withColumn("delta", delta).drop("_n")


def ablation_delta(d: DataFrame, by: list[str], variant: str, original, metrics: list[str]) -> DataFrame:
    """Variant minus original of the seed means, per setting."""
    m = d.groupBy(*by, variant).agg(*[F.avg(c).alias(c) for c in metrics])
    o = m.where(F.col(variant) == original).select(*by, *[F.col(c).alias(f"_o_{c}") for c in metrics])
    j = m.where(F.col(variant) != original).join(o, by)
    return j.select(*by, variant, *metrics, *[(F.col(c) - F.col(f"_o_{c}")).alias(f"{c}_delta") for c in metrics])


def ladder(rungs: list[tuple[str, DataFrame]], by: list[str], mean="mean", sd="sd") -> DataFrame:
    """One row per setting and rung; cells of a rung are averaged, their SDs by root mean square."""
    parts = []
    for i, (name, t) in enumerate(rungs):
        g = t.groupBy(*by).agg(F.avg(mean).alias("mean"), F.sqrt(F.avg(F.col(sd) * F.col(sd))).alias("sd"), F.count("*").alias("cells"))
        parts.append(g.select(*by, F.lit(i).alias("level"), F.lit(name).alias("rung"), "mean", "sd", "cells"))
    return reduce(lambda a, b: a.unionAll(b), parts)


def select_cells(d: DataFrame, where: dict[str, list], labels: dict[str, str], name: str) -> DataFrame:
    """Rows of the named cells with display labels."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isin(v) for c, v in where.items()])
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return d.where(cond).withColumn("label", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.col(name)))


def merge_selections(tables: dict[str, DataFrame], spec: list[dict], key: list[str]) -> DataFrame:
    """Named slices of several result tables with role and lineage; a doubly selected cell raises."""
    parts = []
    for s in spec:
        t = tables[s["table"]].where(s["where"])
        parts.append(t.withColumn("role", F.lit(s["role"])).withColumn("lineage", F.lit(s["table"])))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    n = F.count("*").over(W.partitionBy(*key, "role"))
    u = u.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("a cell is selected twice")).cast("long")).otherwise(n))
    return u.where("_n = 1").drop("_n")
