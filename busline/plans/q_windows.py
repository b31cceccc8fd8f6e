"""Queries for count windows and window features (section D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import windows as WN
from busline.plans.registry import query
from busline.plans.views import CTES, Tables
from busline.schema import CHANNELS

SRC = ["source_file"]


@query("d1_count_windows", """
SELECT source_file, start_index, count(*) AS frames, sum(can_id * (pos + 1))::BIGINT AS id_check, round(sum(delta_t * (pos + 1)), 3) AS dt_check FROM wf GROUP BY ALL""")
def d1(t: Tables):
    w = t.windows.select("source_file", "start_index", F.posexplode("frames").alias("pos", "f"))
    return w.groupBy("source_file", "start_index").agg(
        F.count("*").alias("frames"), F.sum(F.col("f.can_id") * (F.col("pos") + 1)).cast("long").alias("id_check"),
        F.round(F.sum(F.col("f.delta_t") * (F.col("pos") + 1)), 3).alias("dt_check"))


@query("d2_window_labels", "SELECT source_file, start_index, y_binary::BIGINT AS y_binary, y_attack_type::BIGINT AS y_attack_type FROM wl")
def d2(t: Tables):
    return t.labels_w.select("source_file", "start_index", F.col("y_binary").cast("long").alias("y_binary"), F.col("y_attack_type").cast("long").alias("y_attack_type"))


@query("d3_window_provenance", """
SELECT source_file, start_index, start_index + 127 AS end_index, round(min(timestamp), 6) AS start_ts, round(max(timestamp), 6) AS end_ts FROM wf GROUP BY ALL""")
def d3(t: Tables):
    return t.windows.select("source_file", "start_index", "end_index", F.round("start_timestamp", 6).alias("start_ts"), F.round("end_timestamp", 6).alias("end_ts"))


@query("d4_window_any", "SELECT source_file, start_index, sum(binary_label_id)::BIGINT AS events, (sum(binary_label_id) > 0)::INT::BIGINT AS positive FROM wf GROUP BY ALL")
def d4(t: Tables):
    d = WN.window_any(t.labelled, SRC, F.col("binary_label_id") == 1)
    return d.select("source_file", "start_index", "events", F.col("positive").cast("long").alias("positive"))


CTES["sg"] = """
SELECT *, row_number() OVER (PARTITION BY split, source_file ORDER BY row_in_source) - 1 AS gi, count(*) OVER (PARTITION BY split, source_file) AS gn FROM spl"""
CTES["sw"] = """
SELECT split, source_file, w, max(binary_label_id) AS y, sum((attack_type_id = 1)::INT) AS c1, sum((attack_type_id = 2)::INT) AS c2,
 sum((attack_type_id = 3)::INT) AS c3, sum((attack_type_id = 4)::INT) AS c4 FROM (
SELECT *, unnest(generate_series(greatest(0, CAST(ceil((gi - 127) / 32.0) AS BIGINT)), least(gi // 32, (gn - 128) // 32))) AS w FROM sg WHERE gn >= 128) GROUP BY ALL"""


@query("d5_window_stats", """
WITH k AS (SELECT *, greatest(c1, c2, c3, c4) AS m, CASE WHEN y = 0 THEN 0 WHEN c1 = greatest(c1,c2,c3,c4) THEN 1 WHEN c2 = greatest(c1,c2,c3,c4) THEN 2 WHEN c3 = greatest(c1,c2,c3,c4) THEN 3 ELSE 4 END AS ty FROM sw),
g AS (SELECT split, source_file, count(*) AS gn FROM spl GROUP BY ALL),
p AS (SELECT g.split, g.source_file, count(w) AS windows, count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS attack,
 count(*) FILTER (ty = 1) AS type_1, count(*) FILTER (ty = 2) AS type_2, count(*) FILTER (ty = 3) AS type_3, count(*) FILTER (ty = 4) AS type_4
 FROM g LEFT JOIN k ON g.split = k.split AND g.source_file = k.source_file GROUP BY ALL)
SELECT split, coalesce(source_file, 'ALL') AS source_file, count(*) AS groups_seen, count(*) FILTER (windows = 0) AS groups_short,
 sum(windows)::BIGINT AS windows, sum(normal)::BIGINT AS normal, sum(attack)::BIGINT AS attack,
 sum(type_1)::BIGINT AS type_1, sum(type_2)::BIGINT AS type_2, sum(type_3)::BIGINT AS type_3, sum(type_4)::BIGINT AS type_4
FROM p GROUP BY GROUPING SETS ((split), (split, source_file))""")
def d5(t: Tables):
    return WN.window_stats(t.split, ["split", "source_file"]).drop("type_5")


@query("d6_boundary_exposure", """
WITH e AS (SELECT source_file, start_index, sum((attack_type_id = 2)::INT) AS c FROM wf GROUP BY ALL HAVING sum((attack_type_id = 2)::INT) > 0)
SELECT k, count(*) FILTER (c <= k) AS attack_windows, round(count(*) FILTER (c <= k) / count(*), 6) AS share, round(quantile_cont(c, 0.5), 6) AS median_events
FROM e, (SELECT unnest([1, 2, 4, 8, 16])::BIGINT AS k) GROUP BY k""")
def d6(t: Tables):
    c = WN.window_any(t.labelled, SRC, F.col("attack_type_id") == 2)
    return WN.boundary_exposure(c).select(F.col("k").cast("long").alias("k"), "attack_windows", F.round("share", 6).alias("share"), F.round("median_events", 6).alias("median_events"))


def _feature_sql():
    parts = []
    for c in CHANNELS:
        nd = 3 if c == "delta_t" else 6
        parts += [f"round(avg({c}), {nd}) AS {c}_mean", f"round(stddev_pop({c}), {nd}) AS {c}_std", f"round(min({c}), {nd})::DOUBLE AS {c}_min",
                  f"round(max({c}), {nd})::DOUBLE AS {c}_max", f"round(arg_max({c}, pos) - arg_min({c}, pos), {nd})::DOUBLE AS {c}_delta"]
    return ", ".join(parts)


@query("d7_window_features", f"SELECT source_file, start_index, {_feature_sql()} FROM wf GROUP BY ALL")
def d7(t: Tables):
    f = WN.window_features(t.frames, SRC)
    nd = lambda c: 3 if c.startswith("delta_t") else 6
    return f.select("source_file", "start_index", *[F.round(F.col(c).cast("double"), nd(c)).alias(c) for c in WN.FEATURES])


def _corr_sql():
    out = []
    for i, j in WN.PAIRS:
        cov = f"(avg(data{i} * data{j}) - avg(data{i}) * avg(data{j}))"
        out.append(f"round(coalesce({cov} / nullif(stddev_pop(data{i}) * stddev_pop(data{j}), 0), 0), 5) AS corr_{i}_{j}")
    return ", ".join(out)


@query("d8_payload_correlations", f"SELECT source_file, start_index, {_corr_sql()} FROM wf GROUP BY ALL")
def d8(t: Tables):
    f = WN.payload_correlations(t.frames, SRC)
    return f.select("source_file", "start_index", *[F.round(c, 5).alias(c) for c in WN.CORRELATIONS])


CTES["ent"] = """
SELECT source_file, start_index, sum(-(n / 128) * log2(n / 128)) AS entropy FROM (
SELECT source_file, start_index, can_id, count(*) AS n FROM wf GROUP BY ALL) GROUP BY ALL"""


@query("d9_window_entropy", "SELECT source_file, start_index, round(entropy, 6) AS entropy FROM ent")
def d9(t: Tables):
    return WN.window_id_entropy(t.labelled, SRC).withColumn("entropy", F.round("entropy", 6))


@query("d10_window_timing", "SELECT source_file, start_index, round(avg(delta_t), 4) AS delta_t_mean, round(stddev_pop(delta_t), 4) AS delta_t_std FROM wf GROUP BY ALL")
def d10(t: Tables):
    d = WN.window_timing(t.frames, SRC)
    return d.select("source_file", "start_index", F.round("delta_t_mean", 4).alias("delta_t_mean"), F.round("delta_t_std", 4).alias("delta_t_std"))


CTES["iv"] = """
SELECT source_file, start_index, can_id, avg(gap) AS mean_gap, count(gap) AS gaps FROM (
SELECT *, c - lag(c) OVER (PARTITION BY source_file, start_index, can_id ORDER BY pos) AS gap FROM (
SELECT *, sum(delta_t) OVER (PARTITION BY source_file, start_index ORDER BY pos) AS c FROM wf)) GROUP BY ALL HAVING count(gap) > 0"""


@query("d11_id_intervals", "SELECT source_file, start_index, can_id::BIGINT AS can_id, gaps, round(mean_gap, 3) AS mean_gap FROM iv")
def d11(t: Tables):
    d = WN.window_id_intervals(t.frames, SRC)
    return d.select("source_file", "start_index", F.col("can_id").cast("long").alias("can_id"), "gaps", F.round("mean_gap", 3).alias("mean_gap"))


CTES["scl"] = "SELECT " + ", ".join(
    f"avg({c}) AS {c}_mu, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_sd" for c in CHANNELS) + " FROM wf"


@query("d12_scaler", "SELECT source_file, " + ", ".join(f"round(avg(({c} - {c}_mu) / {c}_sd), 6) AS {c}" for c in CHANNELS) + " FROM fr, scl GROUP BY source_file")
def d12(t: Tables):
    s = WN.fit_scaler(t.frames, ["source_file"])
    z = WN.apply_scaler(t.frames, s)
    return z.groupBy("source_file").agg(*[F.round(F.avg(c), 6).alias(c) for c in CHANNELS])
