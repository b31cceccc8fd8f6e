"""Queries for operators in source order (section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import timeline as TL
from busline.plans.q_sources import _payload_hex, files
from busline.plans.registry import query
from busline.plans.views import CTES, GAP, Tables

CTES["seg"] = """
SELECT *, row_number() OVER (PARTITION BY source_file, segment_id ORDER BY row_in_source) - 1 AS row_in_segment FROM (
SELECT *, sum(brk) OVER (PARTITION BY source_file ORDER BY row_in_source)::BIGINT AS segment_id FROM (
SELECT *, coalesce((clock < lag(clock) OVER (PARTITION BY source_file ORDER BY row_in_source))::INT, 0) AS brk FROM lab))"""
CTES["ep"] = f"""
SELECT source_file, e - 1 AS episode_index, min(row_in_source) AS start_row, max(row_in_source) AS end_row,
 min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS attack_rows FROM (
SELECT *, sum(new) OVER (PARTITION BY source_file ORDER BY row_in_source)::BIGINT AS e FROM (
SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY source_file ORDER BY row_in_source) <= {GAP} THEN 0 ELSE 1 END AS new
FROM lab WHERE binary_label_id = 1)) GROUP BY source_file, e"""
CTES["eps"] = """
SELECT *, CASE WHEN episode_index < floor(count(*) OVER (PARTITION BY source_file) * 0.6::DOUBLE) THEN 'train'
 WHEN episode_index < floor(count(*) OVER (PARTITION BY source_file) * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ep"""
CTES["asf"] = """
SELECT f.*, coalesce(e.split, g.split) AS split FROM fr f
ASOF LEFT JOIN eps e ON f.source_file = e.source_file AND f.row_in_source >= e.start_row
LEFT JOIN (SELECT source_file, split FROM eps WHERE episode_index = 0) g ON f.source_file = g.source_file"""
CTES["spl"] = """
SELECT * EXCLUDE (split), coalesce(split, CASE WHEN row_in_source / n_src < 0.6 THEN 'train' WHEN row_in_source / n_src < 0.6::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END) AS split FROM asf"""


@query("c1_delta_t", "SELECT event_id, round(delta_t, 6) AS delta_t FROM fr")
def c1(t: Tables):
    return t.frames.select("event_id", F.round("delta_t", 6).alias("delta_t"))


@query("c2_elapsed", "SELECT event_id, round(timestamp - first_value(timestamp) OVER (PARTITION BY source_file ORDER BY row_in_source), 6) AS elapsed FROM lab")
def c2(t: Tables):
    return TL.with_elapsed(t.labelled).select("event_id", F.round("elapsed", 6).alias("elapsed"))


@query("c3_segments", "SELECT event_id, segment_id, row_in_segment FROM seg")
def c3(t: Tables):
    return TL.with_segments(t.labelled, ts="clock").select("event_id", "segment_id", "row_in_segment")


@query("c4_segment_summary", """
SELECT source_file, segment_id, count(*) AS rows, max(row_in_source) AS end_row,
 CASE WHEN segment_id < max(segment_id) OVER (PARTITION BY source_file) THEN 'timestamp_decrease' ELSE 'file_end' END AS end_reason
FROM seg GROUP BY source_file, segment_id""")
def c4(t: Tables):
    return TL.segment_summary(TL.with_segments(t.labelled, ts="clock"))


@query("c5_episodes", "SELECT source_file, episode_index, start_row, end_row, attack_rows, round(start_timestamp, 6) AS start_ts, round(end_timestamp, 6) AS end_ts FROM ep")
def c5(t: Tables):
    e = TL.attack_episodes(t.labelled, GAP)
    return e.select("source_file", "episode_index", "start_row", "end_row", "attack_rows",
                    F.round("start_timestamp", 6).alias("start_ts"), F.round("end_timestamp", 6).alias("end_ts"))


@query("c6_episode_split", "SELECT source_file, episode_index, split FROM eps")
def c6(t: Tables):
    return TL.split_episodes(TL.attack_episodes(t.labelled, GAP)).select("source_file", "episode_index", "split")


@query("c7_split_asof", "SELECT event_id, split FROM asf")
def c7(t: Tables):
    ep = TL.split_episodes(TL.attack_episodes(t.labelled, GAP))
    return TL.assign_split_asof(t.labelled, ep).select("event_id", "split")


@query("c8_split_fraction", "SELECT event_id, CASE WHEN row_in_source / n_src < 0.6 THEN 'train' WHEN row_in_source / n_src < 0.6::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM fr")
def c8(t: Tables):
    return TL.assign_split_fraction(t.labelled).select("event_id", "split")


@query("c9_split_stats", """
WITH c AS (SELECT split, source_file, attack_type_id, count(*) AS n, sum(binary_label_id)::BIGINT AS a FROM spl GROUP BY ALL),
u AS (SELECT * FROM c UNION ALL SELECT split, 'ALL', attack_type_id, sum(n)::BIGINT, sum(a)::BIGINT FROM c GROUP BY ALL)
SELECT split, source_file, sum(n)::BIGINT AS rows, sum(n - a)::BIGINT AS normal_rows, sum(a)::BIGINT AS attack_rows,
 string_agg(attack_type_id || ':' || n, ';' ORDER BY attack_type_id || ':' || n) AS type_mix FROM u GROUP BY split, source_file""")
def c9(t: Tables):
    return TL.split_stats(TL.split_frames(t.labelled, GAP))


@query("c10_interval_label", """
SELECT event_id, (elapsed BETWEEN 200000.0 * m.k AND 200000.0 * m.k + 900000.0 AND (m.k % 2 = 0 OR can_id = 17 + m.k)
  AND (m.k > 1 OR substr(upper(h), 1, 1) = 'A'))::BIGINT AS attack
FROM (SELECT *, timestamp - first_value(timestamp) OVER (PARTITION BY source_file ORDER BY row_in_source) AS elapsed FROM lab)
JOIN (SELECT DISTINCT source_file, event_id % 4 AS k FROM lab) m USING (source_file)""")
def c10(t: Tables):
    d = TL.with_elapsed(t.labelled).withColumnRenamed("source_file", "capture")
    d = d.withColumn("padded", F.rpad(F.upper(_payload_hex()), 16, "0"))
    k = F.substring("capture", 5, 1).cast("int")
    meta = t.labelled.select(F.col("source_file").alias("capture")).distinct().select(
        "capture",
        F.when(k % 2 == 0, "XXX").otherwise(F.hex((k + 17).cast("long"))).alias("injection_id"),
        (k * 200000.0).alias("lo"), (k * 200000.0 + 900000.0).alias("hi"),
        F.when(k <= 1, "A" + "X" * 15).alias("pattern"),
    )
    return TL.label_by_interval(d, meta).select("event_id", F.col("attack").cast("long").alias("attack"))


@query("c11_split_files", """
SELECT s_suppkey AS unit, CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 5 = 0 THEN 'calibration' ELSE 'evaluation' END AS role
FROM (SELECT s_suppkey, 'logs/set_' || (s_suppkey % 3) || '/' || CASE s_suppkey % 5 WHEN 0 THEN 'train_01' WHEN 1 THEN 'test_01_known_vehicle_known_attack'
 WHEN 2 THEN 'test_02_unknown_vehicle_known_attack' WHEN 3 THEN 'test_03_known_vehicle_unknown_attack' ELSE 'test_04_unknown_vehicle_unknown_attack' END || '/' ||
 CASE s_suppkey % 3 WHEN 0 THEN 'DoS' WHEN 1 THEN 'rpm-accessory' ELSE 'force-neutral' END || '-' || s_suppkey || '.csv' AS path FROM supplier)""")
def c11(t: Tables):
    return TL.split_files(files(t)).select("unit", "role")


CTES["prof"] = """
SELECT can_id, count(*) AS frames, quantile_cont(gap, 0.5) FILTER (gap > 0 AND gap < 400000) AS median_gap FROM (
SELECT can_id, timestamp - lag(timestamp) OVER (PARTITION BY source_file, can_id ORDER BY row_in_source) AS gap
FROM lab WHERE binary_label_id = 0) GROUP BY can_id"""


@query("c12_timing_profile", "SELECT can_id::BIGINT AS can_id, frames, round(median_gap, 5) AS median_gap FROM prof")
def c12(t: Tables):
    p = TL.timing_profile(t.labelled, max_gap=400000.0)
    return p.select(F.col("can_id").cast("long").alias("can_id"), "frames", F.round("median_gap", 5).alias("median_gap"))
