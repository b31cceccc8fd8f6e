"""Ordered computations that never put a whole group into one task.

A window function over ``PARTITION BY source`` sends one source to one task,
and a single long capture may hold a large share of all rows.  Every operator
here cuts a group into spans by a column that rises with the order, works
inside the spans, and carries totals from span to span through a summary that
has one row per (group, span).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from busline.schema import SPAN
from busline.session import landed

_B = "_span"


def span_of(order: str, span: int = SPAN) -> Column:
    """Span number of a numeric order column."""
    return F.floor(F.col(order) / span)


def value_splits(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    """At most ``parts`` cut points that spread the values of ``col`` evenly.

    By default there are as many spans as shuffle partitions, 64 at least.
    This is the only value that goes through the driver: a set number of
    doubles, fixed before the plan that uses them is built, so that a
    recomputed task sees the same spans.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(col, [i / parts for i in range(1, parts)], min(0.005, 0.25 / parts))
    return sorted({c for c in cuts if not math.isnan(c) and not math.isinf(c)})


def with_value_span(df: DataFrame, col: str, splits: list[float] | None) -> DataFrame:
    if splits is None:
        splits = value_splits(df, col)
    if not splits:
        return df.withColumn(_B, F.lit(0.0))
    edges = [-math.inf, *splits, math.inf]
    named = df.withColumn("_v", F.col(col).cast("double"))
    return Bucketizer(splits=edges, inputCol="_v", outputCol=_B, handleInvalid="keep").transform(named).drop("_v")


def _sorted(cols, descending):
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str],
    span: str = _B,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running totals ``{out: column}`` plus ``<out>_total`` per group.

    ``span`` must rise with ``order``.
    """
    head = df.groupBy(*keys, span).agg(*[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()])
    before = W.partitionBy(*keys).orderBy(*_sorted([span], descending)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    head = head.select(
        *keys,
        span,
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in sums],
    )
    inside = W.partitionBy(*keys, span).orderBy(*_sorted(order, descending))
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.select("*", *[F.sum(src).over(inside).alias(f"_l_{out}") for out, src in sums.items()])
    out = local.join(head, [*keys, span])
    return out.select(
        *df.columns,
        *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums],
        *[f"{o}_total" for o in sums],
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], span: Column, out: str = "rank") -> DataFrame:
    """1-based row number per group; ``span`` is an expression rising with the order."""
    d = df.withColumn(_B, span).withColumn("_one", F.lit(1))
    return prefix_sums(d, keys, order, {out: "_one"}).drop(_B, "_one", f"{out}_total")


def ranged(df: DataFrame, order: list[str], name: str = "ranged", parts: int | None = None) -> DataFrame:
    """``df`` with a span number that rises with ``order``, in spans of about equal size.

    Cut points are taken from a sample of the whole order, so groups of any
    scale and values that most rows share are cut too: list the groups first
    and what tells ties apart last. Rows equal in all of that are told apart by
    ``_row``. The result is written, so every reader sees the same spans.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_row", F.monotonically_increasing_id())
    d = d.repartitionByRange(parts, *order, "_row").withColumn(_B, F.spark_partition_id())
    return landed(d, name)


def ranked_by_value(df, keys, value, ties, out="rank") -> DataFrame:
    """1-based row number by ``value`` (nulls last) then the ``ties`` columns, and ``<out>_total`` rows per group."""
    d = df.withColumn("_none", F.col(value).isNull()).withColumn("_one", F.lit(1))
    order = ["_none", value, *ties]
    return prefix_sums(ranged(d, [*keys, *order]), keys, [*order, "_row"], {out: "_one"}).drop(_B, "_one", "_row", "_none")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, ``_n``, rank): the mean rank of each distinct value, without nulls."""
    t = ranged(tie_table(df, keys, value, {"_n": F.lit(1)}), [*keys, value])
    t = prefix_sums(t, keys, [value], {"_c": "_n"})
    return t.select(*keys, value, "_n", (F.col("_c") - (F.col("_n") - 1) / 2).alias(out))


def join_ties(df: DataFrame, table: DataFrame, on: list[str], count: str = "_n") -> DataFrame:
    """Join a table of distinct values back to the rows it counts, with no task for one value.

    Values with more than a ``parts``-th of all rows, fewer than ``parts`` in
    number, are sent to every task; the rest meet by a shuffle. Rows without a
    match go, null keys included.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = landed(table, "ties")
    total = table.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * parts > total
    hot = table.where(often).drop(count)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    rows = df.where(known)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(~often).drop(count), on))


def previous(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], span: int = SPAN
) -> DataFrame:
    """Values ``{out: column}`` of the preceding row in each group (exact ``lag``)."""
    d = df.withColumn(_B, span_of(order, span))
    row = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
    inside = W.partitionBy(*keys, _B).orderBy(order)
    tails = d.groupBy(*keys, _B).agg(F.max_by(row, F.col(order)).alias("_tail"))
    tails = tails.select(*keys, _B, F.lag("_tail").over(W.partitionBy(*keys).orderBy(_B)).alias("_carry"))
    local = d.select("*", F.lag(row).over(inside).alias("_prev"))
    out = local.join(tails, [*keys, _B])
    prev = F.coalesce("_prev", "_carry")
    return out.select(*df.columns, *[prev[o].alias(o) for o in cols])


def running_count(df, keys, order, flag: Column, out: str, span: int = SPAN) -> DataFrame:
    """Running count of rows where ``flag`` holds, inclusive of the row."""
    d = df.withColumn(_B, span_of(order, span)).withColumn("_f", flag.cast("long"))
    return prefix_sums(d, keys, [order], {out: "_f"}).drop(_B, "_f", f"{out}_total")


def carry_last(df, keys, order, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Last non-null ``value`` at or before each row (forward fill)."""
    d = df.withColumn(_B, span_of(order, span)).withColumn("_val", value)
    tails = d.groupBy(*keys, _B).agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(order))).alias("_tail")
    )
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select(*keys, _B, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, _B).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = d.select("*", F.last("_val", ignorenulls=True).over(inside).alias("_seen"))
    out_df = local.join(tails, [*keys, _B])
    return out_df.select(*df.columns, F.coalesce("_seen", "_carry").alias(out))


def islands(
    df: DataFrame, keys: list[str], order: str, value: str, starts, out: str, pos: str, span: int = SPAN
) -> DataFrame:
    """Number the runs of each group and the rows inside each run, both from 0.

    ``starts(previous, current)`` says whether a row opens a run.  Runs are cut
    inside the spans; whether the first row of a span opens one, and how many
    rows and runs lie before it, comes from the span summary.
    """
    d = df.withColumn(_B, span_of(order, span))
    by_span = W.partitionBy(*keys, _B).orderBy(order)
    running = by_span.rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.select("*", F.lag(value).over(by_span).alias("_pv"), F.row_number().over(by_span).alias("_rn"))
    opens = F.when(F.col("_rn") > 1, starts(F.col("_pv"), F.col(value))).otherwise(F.lit(False))
    d = d.withColumn("_new", opens)
    d = d.select(
        "*",
        F.sum(F.col("_new").cast("long")).over(running).alias("_run"),
        F.max(F.when(F.col("_new"), F.col("_rn"))).over(running).alias("_at"),
    )
    s = d.groupBy(*keys, _B).agg(
        F.min_by(value, order).alias("_first"),
        F.max_by(value, order).alias("_last"),
        F.max("_run").alias("_runs"),
        F.max("_at").alias("_tail_at"),
        F.count("*").alias("_rows"),
    )
    over = W.partitionBy(*keys).orderBy(_B)
    before = over.rowsBetween(W.unboundedPreceding, -1)
    upto = over.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.select("*", F.lag("_last").over(over).alias("_pl"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ro"))
    s = s.withColumn("_head", F.when(F.col("_pl").isNull(), True).otherwise(starts(F.col("_pl"), F.col("_first"))))
    head_at = F.when(F.col("_head"), F.col("_ro") + 1)
    tail = F.coalesce(F.col("_ro") + F.col("_tail_at"), head_at)
    s = s.select(
        *keys,
        _B,
        "_ro",
        (F.sum(F.col("_head").cast("long")).over(upto) + F.coalesce(F.sum("_runs").over(before), F.lit(0)) - 1).alias("_off"),
        F.coalesce(head_at, F.last(tail, ignorenulls=True).over(before)).alias("_start"),
    )
    j = d.join(s, [*keys, _B])
    start = F.coalesce(F.col("_at") + F.col("_ro"), F.col("_start"))
    return j.select(
        *df.columns, (F.col("_run") + F.col("_off")).alias(out), (F.col("_rn") + F.col("_ro") - start).alias(pos)
    )


def tie_table(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per distinct value: partial aggregation shrinks ties before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[F.sum(e).alias(o) for o, e in sums.items()]
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    splits: list[float] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group without gathering a group.

    ``percentile`` keeps all distinct values of a group in one buffer; here the
    distinct values stay spread over spans and only the rows that hold the
    wanted ranks survive the last aggregation. Spans follow the order of
    (keys, value), so groups may differ in scale; ``splits`` are for tables
    whose spans are known beforehand.
    """
    t = tie_table(df, keys, value, {"_n": F.lit(1) if weight is None else weight})
    t = ranged(t, [*keys, value], "quantiles") if splits is None else with_value_span(t, value, splits)
    t = prefix_sums(t, keys, [value], {"_cum": "_n"})
    first = F.col("_cum") - F.col("_n")
    picks = []
    for i, p in enumerate(probs.values()):
        pos = (F.col("_cum_total") - 1) * F.lit(float(p))
        for side, r in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            picks.append(F.max(F.when((first <= r) & (r < F.col("_cum")), F.col(value))).alias(f"_{side}{i}"))
    g = t.groupBy(*keys).agg(F.max("_cum_total").alias("_t"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("_t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return g.select(*keys, *out)


def with_facts(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per group to the rows of the groups.

    The facts are written first, so Spark knows their size and sends a small
    table to the rows. Sized while the join runs, it would shuffle the rows by
    the group alone, and leave all later steps of a group to that one task.
    """
    return df.join(landed(facts, "facts"), list(keys), how)


def one_value(df: DataFrame, expr) -> Column:
    """Scalar subquery: a one-row fact used as a column, without a join."""
    return df.select(expr).scalar()
