"""Operators on frames in source order: gaps, segments, episodes and splits."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from busline.functions.text import payload_matches
from busline.operators import ordered as O
from busline.schema import EPISODE_GAP, SPAN, SPLIT_RATIOS
from busline.session import landed

SRC = ["source_file"]
ROW = "row_in_source"


def with_delta_t(df, by=SRC, order=ROW, ts="timestamp", out="delta_t", span=SPAN) -> DataFrame:
    """Seconds since the preceding frame; backward steps count as 0, the first frame as 0."""
    d = O.previous(df, list(by), order, {"_pt": ts}, span)
    return d.withColumn(out, F.coalesce(F.greatest(F.col(ts) - F.col("_pt"), F.lit(0.0)), F.lit(0.0))).drop("_pt")


def with_elapsed(df, by=SRC, order=ROW, ts="timestamp") -> DataFrame:
    """Seconds since the first frame in file order; one row per source carries the start."""
    first = df.groupBy(*by).agg(F.min_by(ts, order).alias("_t0"))
    return O.with_facts(df, first, by).withColumn("elapsed", F.col(ts) - F.col("_t0")).drop("_t0")


def with_segments(df, by=SRC, order=ROW, ts="timestamp", span=SPAN) -> DataFrame:
    """Segment number (a clock step back starts a new one) and row index inside it."""
    return O.islands(df, list(by), order, ts, lambda prev, cur: cur < prev, "segment_id", "row_in_segment", span)


def segment_summary(seg, by=SRC, order=ROW) -> DataFrame:
    """Rows, last line and end reason of each segment."""
    g = seg.groupBy(*by, "segment_id").agg(F.count("*").alias("rows"), F.max(order).alias("last_row"), F.min(order).alias("_s"))
    follower = F.lead("_s").over(W.partitionBy(*by).orderBy("segment_id"))
    g = g.withColumn("_f", follower)
    reason = F.when(F.col("_f").isNotNull(), "timestamp_decrease").otherwise("file_end")
    end = F.coalesce(F.col("_f") - 1, F.col("last_row"))
    return g.select(*by, "segment_id", "rows", end.alias("end_row"), reason.alias("end_reason"))


def attack_episodes(df, gap=EPISODE_GAP, by=SRC, order=ROW, ts="timestamp", span=SPAN) -> DataFrame:
    """Runs of attack frames; more than ``gap`` seconds of silence starts a new run."""
    a = df.where(F.col("binary_label_id") == 1).select(*by, order, ts)
    a = O.islands(a, list(by), order, ts, lambda prev, cur: cur - prev > gap, "episode_index", "_p", span)
    return (
        a.groupBy(*by, "episode_index")
        .agg(
            F.min(order).alias("start_row"),
            F.max(order).alias("end_row"),
            F.min_by(ts, order).alias("start_timestamp"),
            F.max_by(ts, order).alias("end_timestamp"),
            F.count("*").alias("attack_rows"),
        )
    )


def split_episodes(ep, ratios=SPLIT_RATIOS, by=SRC) -> DataFrame:
    """Chronological split by episode number: int(n*a) train, up to int(n*(a+b)) val, rest test."""
    n = ep.groupBy(*by).agg(F.count("*").alias("_n"))
    d = ep.join(n, list(by))
    return d.withColumn("split", _by_share(F.col("episode_index"), F.col("_n"), ratios)).drop("_n")


def _by_share(i: Column, n: Column, ratios) -> Column:
    a, b = ratios[0], ratios[0] + ratios[1]
    return F.when(i < F.floor(n * F.lit(a)), "train").when(i < F.floor(n * F.lit(b)), "val").otherwise("test")


def assign_split_asof(frames, ep, by=SRC, order=ROW, span=SPAN) -> DataFrame:
    """Each frame takes the split of the last episode that starts at or before it.

    Frames before the first episode take the first one; sources without
    episodes get NULL.  The as-of join is an equi join that puts each start on
    its own row, then a forward fill by spans: no broadcast, no range join.
    """
    starts = ep.select(*by, F.col("start_row").alias(order), F.col("split").alias("_s"))
    d = frames.join(starts, [*by, order], "left")
    d = O.carry_last(d, list(by), order, F.col("_s"), "split", span)
    first = ep.groupBy(*by).agg(F.min_by("split", "start_row").alias("_first"))
    d = O.with_facts(d, first, by, "left")
    return d.withColumn("split", F.coalesce("split", "_first")).drop("_s", "_first")


def assign_split_fraction(frames, ratios=SPLIT_RATIOS, by=SRC, order=ROW) -> DataFrame:
    """Split by line number over the row count of the source."""
    total = frames.groupBy(*by).agg(F.count("*").alias("_n"))
    share = F.col(order) / F.col("_n")
    split = (
        F.when(share < ratios[0], "train").when(share < F.lit(ratios[0] + ratios[1]), "val").otherwise("test")
    )
    return O.with_facts(frames, total, by).withColumn("split", split).drop("_n")


def split_frames(frames, gap=EPISODE_GAP, ratios=SPLIT_RATIOS, by=SRC, order=ROW, span=SPAN) -> DataFrame:
    """Episode split where a source has attacks, fraction split elsewhere."""
    ep = landed(split_episodes(attack_episodes(frames, gap, by, order, span=span), ratios, by), "episodes")
    d = assign_split_asof(frames, ep, by, order, span).withColumnRenamed("split", "_ep")
    d = assign_split_fraction(d, ratios, by, order)
    return d.withColumn("split", F.coalesce("_ep", "split")).drop("_ep")


def split_stats(df) -> DataFrame:
    """Row, normal and attack counts with the type mix, per split and per (split, source)."""
    sizes = df.groupBy("split", "source_file", "attack_type_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("binary_label_id") == 0).alias("_nor"),
        F.count_if(F.col("binary_label_id") == 1).alias("_att"),
    )
    per = sizes.groupingSets(
        [("split", "attack_type_id"), ("split", "source_file", "attack_type_id")],
        "split",
        "source_file",
        "attack_type_id",
    ).agg(F.sum("n").alias("n"), F.sum("_nor").alias("_nor"), F.sum("_att").alias("_att"))
    item = F.concat_ws(":", F.col("attack_type_id").cast("string"), F.col("n").cast("string"))
    mix = F.array_join(F.array_sort(F.collect_list(item)), ";")
    return per.groupBy("split", F.coalesce("source_file", F.lit("ALL")).alias("source_file")).agg(
        F.sum("n").alias("rows"),
        F.sum("_nor").alias("normal_rows"),
        F.sum("_att").alias("attack_rows"),
        mix.alias("type_mix"),
    )


def label_by_interval(frames, meta) -> DataFrame:
    """Attack where elapsed lies in the injection interval and id and payload agree.

    ``meta`` has one row per capture: capture, injection_id, interval ends, pattern.
    """
    d = frames.join(meta, "capture", "left")
    inside = F.col("elapsed").between(F.col("lo"), F.col("hi"))
    any_id = F.col("injection_id").isNull() | (F.col("injection_id") == "XXX")
    same_id = any_id | (F.col("can_id") == F.conv(F.when(~any_id, F.col("injection_id")), 16, 10).cast("long"))
    pattern = F.coalesce("pattern", F.lit("X" * 16))
    hit = inside & same_id & payload_matches("padded", pattern)
    return d.withColumn("attack", F.coalesce(hit, F.lit(False)).cast("int"))


def split_files(meta, k=5, path="path") -> DataFrame:
    """Every k-th file of the sorted list is calibration; the list is ranked by ranges of the paths themselves."""
    d = O.ranked_by_value(meta, [], path, [], "_r")
    role = F.when((F.col("_r") - 1) % k == 0, "calibration").otherwise("evaluation")
    return d.withColumn("role", role).drop("_r", "_r_total")


def timing_profile(frames, max_gap=10.0, by=SRC, order=ROW, ts="timestamp", span=SPAN) -> DataFrame:
    """Median gap per id over normal frames, gaps taken within (source, id)."""
    n = frames.where(F.col("binary_label_id") == 0).select(*by, "can_id", order, ts)
    n = O.previous(n, [*by, "can_id"], order, {"_pt": ts}, span).withColumn("gap", F.col(ts) - F.col("_pt"))
    ids = n.groupBy("can_id").agg(F.count("*").alias("frames"))
    gaps = n.where((F.col("gap") > 0) & (F.col("gap") < max_gap))
    med = O.exact_quantiles(gaps, ["can_id"], "gap", {"median_gap": 0.5})
    return ids.join(med, "can_id", "left")
