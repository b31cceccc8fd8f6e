"""Queries for profiles and distribution shift (section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import profile as P
from busline.operators import timeline as TL
from busline.operators import windows as WN
from busline.plans.q_sources import FAMILIES, FILES_SQL, VEHICLES, files, frame_table
from busline.plans.registry import query
from busline.plans.views import CTES, Tables
from busline.schema import BYTES, CHANNELS
from busline.session import scratch_dir
from busline.sources import logs as L

# Two traffic domains: sources 0 and 1 against sources 2 and 3.
CTES["dom"] = "SELECT *, CASE WHEN source_file IN ('src_0', 'src_1') THEN 'a' ELSE 'b' END AS domain FROM fr"
CTES["domw"] = "SELECT wf.*, CASE WHEN source_file IN ('src_0', 'src_1') THEN 'a' ELSE 'b' END AS domain FROM wf JOIN wl USING (source_file, start_index) WHERE y_binary = 0"


def domains(t: Tables):
    return t.frames.withColumn("domain", F.when(F.col("source_file").isin("src_0", "src_1"), "a").otherwise("b"))


def normal_window_frames(t: Tables):
    w = t.labels_w.where("y_binary = 0").select("source_file", "start_index")
    d = t.wf.join(w, ["source_file", "start_index"])
    return d.withColumn("domain", F.when(F.col("source_file").isin("src_0", "src_1"), "a").otherwise("b"))


def r6(d, *cols, keep=()):
    return d.select(*keep, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in cols])


@query("e1_profile_sources", """
SELECT source_file, count(*) AS rows, count(*) FILTER (binary_label_id = 0) AS normal_rows, count(*) FILTER (binary_label_id = 1) AS attack_rows,
 count(*) FILTER (dlc NOT BETWEEN 0 AND 8) AS invalid_dlc, count(*) FILTER (dlc < 8) AS short_frames, count(DISTINCT can_id) AS unique_ids,
 round(min(timestamp), 6) AS ts_min, round(max(timestamp), 6) AS ts_max, round(min(delta_t), 6) AS dt_min, round(avg(delta_t), 6) AS dt_mean, round(max(delta_t), 6) AS dt_max
FROM fr GROUP BY source_file""")
def e1(t: Tables):
    return r6(P.profile_sources(t.frames), "ts_min", "ts_max", "dt_min", "dt_mean", "dt_max",
              keep=("source_file", "rows", "normal_rows", "attack_rows", "invalid_dlc", "short_frames", "unique_ids"))


@query("e2_top_ids", "SELECT can_id::BIGINT AS can_id, count(*) AS n FROM fr GROUP BY can_id ORDER BY n DESC, can_id LIMIT 20")
def e2(t: Tables):
    return P.top_ids(t.labelled, 20).select(F.col("can_id").cast("long").alias("can_id"), "n")


@query("e3_dt_histogram", """
WITH b AS (SELECT unnest(['neg','0','<0.1ms','0.1-0.5ms','0.5-1ms','1-5ms','5-10ms','10-50ms','50-100ms','>=100ms']) AS bin),
c AS (SELECT CASE WHEN x < 0 THEN 'neg' WHEN x = 0 THEN '0' WHEN x < 100 THEN '<0.1ms' WHEN x < 500 THEN '0.1-0.5ms' WHEN x < 1000 THEN '0.5-1ms'
 WHEN x < 5000 THEN '1-5ms' WHEN x < 10000 THEN '5-10ms' WHEN x < 50000 THEN '10-50ms' WHEN x < 100000 THEN '50-100ms' ELSE '>=100ms' END AS bin FROM (SELECT delta_t AS x FROM fr))
SELECT b.bin, count(c.bin) AS n FROM b LEFT JOIN c ON b.bin = c.bin GROUP BY b.bin""")
def e3(t: Tables):
    return P.dt_histogram(t.frames, scale=1e6)


@query("e4_preprocess_summary", """
WITH u AS (SELECT * FROM seg UNION ALL SELECT * REPLACE ('ALL' AS source_file, source_file || segment_id AS h) FROM seg),
m AS (SELECT source_file, string_agg(k || ':' || c, ';' ORDER BY k) AS binary_mix FROM (SELECT source_file, binary_label_id::VARCHAR AS k, count(*) AS c FROM u GROUP BY ALL) GROUP BY ALL),
d AS (SELECT source_file, string_agg(k || ':' || c, ';' ORDER BY k) AS dlc_mix FROM (SELECT source_file, dlc::VARCHAR AS k, count(*) AS c FROM u GROUP BY ALL) GROUP BY ALL),
s AS (SELECT source_file, count(DISTINCT segment_id) AS segments, count(DISTINCT segment_id) - 1 AS breaks FROM seg GROUP BY ALL),
st AS (SELECT * FROM s UNION ALL SELECT 'ALL', sum(segments)::BIGINT, sum(breaks)::BIGINT FROM s)
SELECT source_file, count(*) AS rows, count(*) FILTER (dlc NOT BETWEEN 0 AND 8) AS invalid_dlc, any_value(segments) AS segments, any_value(breaks) AS breaks,
 any_value(binary_mix) AS binary_mix, any_value(dlc_mix) AS dlc_mix FROM u JOIN m USING (source_file) JOIN d USING (source_file) JOIN st USING (source_file) GROUP BY source_file""")
def e4(t: Tables):
    return P.preprocess_summary(TL.with_segments(t.labelled, ts="clock"))


@query("e5_validate_table", """
SELECT count(*) AS rows, 0::BIGINT AS weak_rows, 0::BIGINT AS payload_len_mismatch, 0::BIGINT AS invalid_dlc,
 'Attack:' || sum(binary_label_id) || ';Normal:' || sum(1 - binary_label_id) AS binary_mix, 'DoS:' || sum(binary_label_id) || ';Normal:' || sum(1 - binary_label_id) AS attack_mix FROM lab""")
def e5(t: Tables):
    path = scratch_dir(t.spark, "frames")
    L.write_frames(frame_table(t), path)
    return P.validate_table(t.spark.read.parquet(path))


@query("e6_capture_profile", """
WITH c AS (SELECT 'src_' || (s_suppkey % 6) AS capture FROM supplier GROUP BY ALL),
g AS (SELECT source_file, count(*) AS n, sum(binary_label_id) AS a, count(DISTINCT can_id) AS u, max(timestamp) - min(timestamp) AS e FROM lab GROUP BY ALL)
SELECT capture, CASE capture WHEN 'src_0' THEN 'accelerator' WHEN 'src_1' THEN 'ambient' ELSE 'fuzzing' END AS family,
 CASE capture WHEN 'src_0' THEN 'excluded_accelerator' WHEN 'src_1' THEN 'ambient' ELSE 'attack' END AS role,
 (CASE capture WHEN 'src_0' THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS frames, (CASE capture WHEN 'src_0' THEN 0 ELSE coalesce(a, 0) END)::BIGINT AS attack_frames,
 (CASE capture WHEN 'src_0' THEN 0 ELSE coalesce(u, 0) END)::BIGINT AS unique_ids, round(CASE capture WHEN 'src_0' THEN 0 ELSE coalesce(e, 0) END, 6) AS elapsed
FROM c LEFT JOIN g ON capture = source_file""")
def e6(t: Tables):
    name = F.concat(F.lit("src_"), (F.col("s_suppkey") % 6).cast("string"))
    fam = F.when(F.col("capture") == "src_0", "accelerator").when(F.col("capture") == "src_1", "ambient").otherwise("fuzzing")
    caps = t.read("supplier").select(name.alias("capture")).distinct().withColumn("family", fam)
    caps = caps.withColumn("role", F.when(F.col("family") == "ambient", "ambient").otherwise("attack"))
    f = t.labelled.select(F.col("source_file").alias("capture"), F.col("binary_label_id").alias("attack"), "can_id", "timestamp", "row_in_source")
    d = P.capture_profile(f, caps)
    return d.select("capture", "family", "role", "frames", F.col("attack_frames").cast("long").alias("attack_frames"), "unique_ids", F.round(F.col("elapsed").cast("double"), 6).alias("elapsed"))


@query("e7_file_profile", """
SELECT source_file, count(*) AS rows, sum(binary_label_id)::BIGINT AS attack_frames, round(avg(binary_label_id), 6) AS attack_rate, min(can_id)::BIGINT AS min_id, max(can_id)::BIGINT AS max_id,
 count(DISTINCT can_id) AS unique_ids, count(*) FILTER (can_id > 2047) AS extended_id_frames, round(quantile_cont(delta_t, 0.5), 5) AS dt_p50, round(quantile_cont(delta_t, 0.95), 5) AS dt_p95, round(quantile_cont(delta_t, 0.99), 5) AS dt_p99
FROM fr GROUP BY source_file""")
def e7(t: Tables):
    d = P.file_profile(t.frames)
    return d.select("source_file", "rows", "attack_frames", F.round("attack_rate", 6).alias("attack_rate"), F.col("min_id").cast("long").alias("min_id"), F.col("max_id").cast("long").alias("max_id"),
                    "unique_ids", "extended_id_frames", *[F.round(c, 5).alias(c) for c in ("dt_p50", "dt_p95", "dt_p99")])


CTES["filesw"] = FILES_SQL
CTES["unitw"] = "SELECT sc.*, f.* EXCLUDE (unit) FROM sc JOIN filesw f USING (unit)"


def unit_windows(t: Tables):
    meta = L.with_path_meta(files(t), VEHICLES).drop("path")
    return t.scores.join(meta, "unit")


@query("e8_group_counts", """
SELECT coalesce(set_id, 'all') AS set_id, coalesce(subset_id, 'all') AS subset_id, coalesce(vehicle_axis, 'all') AS vehicle_axis, coalesce(attack_axis, 'all') AS attack_axis,
 count(*) AS rows, count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS attack_rows, round(avg(y), 6) AS attack_rate
FROM unitw GROUP BY GROUPING SETS ((set_id, subset_id, vehicle_axis, attack_axis), (set_id), ())""")
def e8(t: Tables):
    d = P.group_counts(unit_windows(t), ["subset_id", "vehicle_axis", "attack_axis"], "set_id", "y")
    return d.withColumn("attack_rate", F.round("attack_rate", 6))


@query("e9_id_overlap", """
WITH r AS (SELECT DISTINCT can_id FROM fr WHERE binary_label_id = 0 AND source_file = 'src_0'), c AS (SELECT source_file, can_id, count(*) AS n FROM fr WHERE binary_label_id = 0 GROUP BY ALL)
SELECT source_file, count(*) AS ids, (SELECT count(*) FROM r) AS ref_ids, count(r.can_id) AS shared_ids, round(count(r.can_id) / count(*), 6) AS id_ratio,
 round(sum(CASE WHEN r.can_id IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM c LEFT JOIN r USING (can_id) GROUP BY source_file""")
def e9(t: Tables):
    n = t.labelled.where("binary_label_id = 0")
    d = P.id_overlap(n, n.where("source_file = 'src_0'"), ["source_file"])
    return r6(d, "id_ratio", "coverage", keep=("source_file", "ids", "ref_ids", "shared_ids"))


def _unpivot_sql(src, extra="source_file"):
    return " UNION ALL ".join(f"SELECT {extra}, '{c}' AS channel, ({c} - {c}_mu) / {c}_sd AS v FROM {src}, scl" for c in CHANNELS)


CTES["shift"] = f"""SELECT source_file, channel, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99
FROM ({_unpivot_sql('(SELECT * FROM fr WHERE binary_label_id = 0)')}) GROUP BY ALL"""


def _shift(t: Tables):
    return P.scaled_shift(t.frames.where("binary_label_id = 0"), WN.fit_scaler(t.frames, ["source_file"]), ["source_file"])


@query("e10_scaled_shift", "SELECT source_file, channel, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sd", "p05", "p50", "p95", "p99")) + " FROM shift")
def e10(t: Tables):
    return r6(_shift(t), "mean", "sd", "p05", "p50", "p95", "p99", keep=("source_file", "channel"))


@query("e11_shift_outliers", "SELECT source_file, channel, round(mean, 6) AS mean, round(p99, 6) AS p99 FROM shift WHERE abs(mean) > 0.01 OR abs(p99) > 1.9")
def e11(t: Tables):
    return r6(P.shift_outliers(_shift(t), 0.01, 1.9), "mean", "p99", keep=("source_file", "channel"))


@query("e12_zscore_diag", "WITH r AS (SELECT DISTINCT can_id FROM fr WHERE binary_label_id = 0 AND source_file = 'src_0') SELECT source_file, count(*) AS frames, "
       + ", ".join(f"round(avg(abs(({c} - {c}_mu) / {c}_sd)), 6) AS z_mean_{c}, round(avg((abs(({c} - {c}_mu) / {c}_sd) > 3)::INT), 6) AS z_gt3_{c}" for c in CHANNELS)
       + ", round(avg((can_id IN (SELECT can_id FROM r))::INT) FILTER (binary_label_id = 0), 6) AS known_id_coverage FROM fr, scl GROUP BY source_file")
def e12(t: Tables):
    ref = t.labelled.where("binary_label_id = 0 AND source_file = 'src_0'")
    d = P.zscore_diag(t.frames, WN.fit_scaler(t.frames, ["source_file"]), ref)
    return r6(d, *[c for c in d.columns if c not in ("source_file", "frames")], keep=("source_file", "frames"))


def _ent_sql(col, src="domw"):
    return f"(SELECT domain, sum(-(n / t) * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY domain) AS t FROM (SELECT domain, {col} AS k, count(*) AS n FROM {src} GROUP BY ALL)) GROUP BY domain)"


_BYTE_LIST = "unnest([" + ", ".join(BYTES) + "])"


@query("e13_normal_summary", f"""
WITH i AS (SELECT domain, count(*) AS unique_ids, sum(n) FILTER (r <= 20) / sum(n) AS top20_coverage FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, can_id) AS r FROM (SELECT domain, can_id, count(*) AS n FROM domw GROUP BY ALL)) GROUP BY domain),
g AS (SELECT domain, count(*) AS frames, avg(delta_t) AS dt_mean, avg((dlc = 8)::INT) AS dlc8_share, quantile_cont(delta_t, 0.5) AS dt_median, quantile_cont(delta_t, 0.95) AS dt_p95, quantile_cont(delta_t, 0.99) AS dt_p99 FROM domw GROUP BY domain)
SELECT g.domain, frames, unique_ids, round(dt_mean, 5) AS dt_mean, round(top20_coverage, 6) AS top20_coverage, round(dlc8_share, 6) AS dlc8_share, round(a.e, 6) AS id_entropy, round(b.e, 6) AS dlc_entropy,
 round(c.e, 6) AS payload_entropy, round(dt_median, 5) AS dt_median, round(dt_p95, 5) AS dt_p95, round(dt_p99, 5) AS dt_p99,
 (SELECT string_agg(n, ',' ORDER BY k) FROM (SELECT k, count(l)::VARCHAR AS n FROM (SELECT unnest(generate_series(0, 78)) AS k) LEFT JOIN
  (SELECT log10(greatest(delta_t, 0) + 1e-8) AS l, (SELECT count(*) FROM (SELECT unnest(generate_series(1, 78)) AS i) WHERE i * 0.1::DOUBLE <= log10(greatest(delta_t, 0) + 1e-8)) AS b FROM domw WHERE domw.domain = g.domain
   AND log10(greatest(delta_t, 0) + 1e-8) BETWEEN 0 AND 79 * 0.1::DOUBLE) ON b = k GROUP BY k)) AS log_dt_counts
FROM g JOIN i USING (domain) JOIN {_ent_sql('can_id')} a USING (domain) JOIN {_ent_sql('dlc')} b USING (domain) JOIN {_ent_sql('v', f'(SELECT domain, {_BYTE_LIST} AS v FROM domw)')} c USING (domain)""")
def e13(t: Tables):
    d = P.normal_summary(normal_window_frames(t), edges=_EDGES).withColumn("log_dt_counts", F.array_join(F.col("log_dt_counts").cast("array<string>"), ","))
    nd = lambda c: 5 if c.startswith("dt_") else 6
    return d.select("domain", "frames", "unique_ids", *[F.round(c, nd(c)).alias(c) for c in (
        "dt_mean", "top20_coverage", "dlc8_share", "id_entropy", "dlc_entropy", "payload_entropy", "dt_median", "dt_p95", "dt_p99")], "log_dt_counts")


def _js_sql(counts, eps=0.0, bins=0):
    """Divergence of a subquery with columns domain, k, n."""
    norm = 1 + bins * eps
    return f"""(SELECT sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2 FROM (
 SELECT (coalesce(sum(n) FILTER (domain = 'a'), 0) / any_value(ta) + {eps}::DOUBLE) / {norm!r}::DOUBLE AS a, (coalesce(sum(n) FILTER (domain = 'b'), 0) / any_value(tb) + {eps}::DOUBLE) / {norm!r}::DOUBLE AS b
 FROM (SELECT *, sum(n) FILTER (domain = 'a') OVER () AS ta, sum(n) FILTER (domain = 'b') OVER () AS tb FROM {counts}) GROUP BY k))"""


def _cnt(col, src="dom"):
    return f"(SELECT domain, {col} AS k, count(*) AS n FROM {src} GROUP BY ALL)"


_EDGES = [i * 0.1 for i in range(80)]


@query("e14_normal_shift", f"""
SELECT round({_js_sql(_cnt('can_id'))}, 6) AS js_id, round({_js_sql(_cnt('dlc'))}, 6) AS js_dlc,
 round({_js_sql(_cnt('v', f'(SELECT domain, {_BYTE_LIST} AS v FROM dom)'))}, 6) AS js_payload,
 round({_js_sql("(SELECT domain, (SELECT count(*) FROM (SELECT unnest(generate_series(1, 78)) AS i) WHERE i * 0.1::DOUBLE <= l) AS k, count(*) AS n FROM (SELECT domain, log10(greatest(delta_t, 0) + 1e-8) AS l FROM dom) WHERE l BETWEEN 0 AND 79 * 0.1::DOUBLE GROUP BY ALL)")}, 6) AS js_log_dt,
 (SELECT round(count(*) FILTER (c = 2) / count(*), 6) FROM (SELECT can_id, count(*) AS c FROM (SELECT domain, can_id, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, can_id) AS r FROM dom GROUP BY domain, can_id) WHERE r <= 50 GROUP BY can_id)) AS top50_jaccard,
 (SELECT round(avg((can_id IN (SELECT can_id FROM (SELECT can_id FROM dom WHERE domain = 'a' GROUP BY can_id ORDER BY count(*) DESC, can_id LIMIT 20)))::INT), 6) FROM dom WHERE domain = 'b') AS top20_coverage""")
def e14(t: Tables):
    d = domains(t)
    s = P.normal_shift(d.where("domain = 'a'"), d.where("domain = 'b'"), _EDGES)
    return r6(s, *s.columns)


@query("e15_entropy", f"""
SELECT domain, round(e, 6) AS entropy, round((SELECT sum(-q * log2(q)) FROM (SELECT (n / t + 1e-12) / (1 + 2049 * 1e-12) AS q FROM (SELECT coalesce(c.n, 0) AS n, (SELECT count(*) FROM dom z WHERE z.domain = x.domain) AS t
 FROM (SELECT unnest(generate_series(0, 2048)) AS b) LEFT JOIN (SELECT can_id, count(*) AS n FROM dom y WHERE y.domain = x.domain GROUP BY can_id) c ON b = can_id))), 6) AS smoothed FROM {_ent_sql('can_id', 'dom')} x""")
def e15(t: Tables):
    c = domains(t).groupBy("domain", "can_id").agg(F.count("*").alias("n"))
    a = P.entropy_of(c, ["domain"])
    b = P.entropy_of(c, ["domain"], bins=2049, value="can_id").withColumnRenamed("entropy", "smoothed")
    return r6(a.join(b, "domain"), "entropy", "smoothed", keep=("domain",))


@query("e16_js_divergence", f"SELECT round({_js_sql(_cnt('can_id'))}, 8) AS js_exact, round({_js_sql(_cnt('can_id'), 1e-12, 2049)}, 8) AS js_smoothed")
def e16(t: Tables):
    c = _pair(t, {"id": F.array("can_id")})
    bins = t.spark.range(2049).select(F.lit("id").alias("kind"), F.col("id").cast("double").alias("v"))
    a, b = P.divergences(c).select("js").scalar(), P.divergences(c, P.EPS, bins, beyond=True).select("js").scalar()
    return t.spark.range(1).select(F.round(a, 8).alias("js_exact"), F.round(b, 8).alias("js_smoothed"))


def _pair(t: Tables, kinds):
    d = domains(t)
    return P.value_counts(d, kinds, {"a": F.col("domain") == "a", "b": F.col("domain") == "b"})


def _w1_sql(col):
    return f"""(SELECT sum(abs(ca / na - cb / nb) * (nx - v)) FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
 FROM (SELECT {col}::DOUBLE AS v, count(*) FILTER (domain = 'a') AS a, count(*) FILTER (domain = 'b') AS b FROM dom GROUP BY ALL)))"""


@query("e17_wasserstein", f"SELECT round({_w1_sql('can_id')}, 6) AS w_id, round({_w1_sql('delta_t')}, 4) AS w_dt")
def e17(t: Tables):
    d = P.distances(_pair(t, {"id": F.array("can_id"), "dt": F.array("delta_t")}))
    w = lambda k: F.max(F.when(F.col("kind") == k, F.col("distance")))
    return d.agg(F.round(w("id"), 6).alias("w_id"), F.round(w("dt"), 4).alias("w_dt"))


_HEDGES = [0, 60, 120, 300, 600, 1200, 3600]


@query("e18_histogram", """
WITH e AS (SELECT unnest([0, 60, 120, 300, 600, 1200]) AS lo, unnest([60, 120, 300, 600, 1200, 3600]) AS hi, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS bin),
s AS (SELECT DISTINCT source_file FROM fr)
SELECT s.source_file, bin, count(fr.event_id) AS n, round(count(fr.event_id) / sum(count(fr.event_id)) OVER (PARTITION BY s.source_file), 6) AS share
FROM s CROSS JOIN e LEFT JOIN fr ON fr.source_file = s.source_file AND delta_t >= lo AND (delta_t < hi OR (bin = 5 AND delta_t = hi)) GROUP BY s.source_file, bin""")
def e18(t: Tables):
    h = P.histogram(t.frames, "delta_t", _HEDGES, ["source_file"])
    return h.select("source_file", F.col("bin").cast("long").alias("bin"), "n", F.round("share", 6).alias("share"))


@query("e19_marginal_js", f"""
WITH r AS (SELECT min(delta_t) AS lo, max(delta_t) AS hi FROM dom)
SELECT round({_js_sql("(SELECT domain, least(floor((delta_t - lo) / (hi - lo) * 128)::INT + 1, 128) AS k, count(*) AS n FROM dom, r GROUP BY ALL)", 1e-12, 128)}, 6) AS js""")
def e19(t: Tables):
    d = domains(t)
    return r6(P.marginal_js(d.where("domain = 'a'"), d.where("domain = 'b'"), "delta_t"), "js")


@query("e20_periodicity_mae", """
WITH p AS (SELECT domain, can_id, avg(delta_t) AS m FROM dom GROUP BY ALL HAVING count(*) > 20)
SELECT round(avg(abs(a.m - b.m)), 5) AS mae, count(*) AS ids FROM p a JOIN p b USING (can_id) WHERE a.domain = 'a' AND b.domain = 'b'""")
def e20(t: Tables):
    d = domains(t)
    m = P.periodicity_mae(d.where("domain = 'a'"), d.where("domain = 'b'"), 20)
    return m.select(F.round("mae", 5).alias("mae"), "ids")


_STEM = "CASE WHEN source_file = 'src_0' THEN 'DoS' WHEN source_file = 'src_3' THEN 'odd' ELSE 'rpm' END"


@query("e22_grammar_distance", f"""
WITH p AS (SELECT source_file, {_STEM} AS stem, sum(binary_label_id) AS a, min(can_id) || '-' || max(can_id) AS rng FROM fr GROUP BY ALL),
r AS (SELECT stem, rng, sum(a) AS a FROM p GROUP BY ALL),
m AS (SELECT {_STEM} AS stem, dlc::VARCHAR AS k, count(*) AS n FROM fr GROUP BY ALL)
SELECT stem AS source_stem, (SELECT string_agg(rng || ':' || a, ';' ORDER BY a DESC, rng) FROM r WHERE r.stem = s.stem) AS id_ranges, (SELECT string_agg(k || ':' || n, ';' ORDER BY k) FROM m WHERE m.stem = s.stem) AS dlc_mix,
 CASE stem WHEN 'DoS' THEN 'DoS' WHEN 'rpm' THEN 'RPM' ELSE 'other_attack' END AS family, CASE stem WHEN 'odd' THEN 'binary_only' ELSE 'direct_name' END AS confidence FROM (SELECT DISTINCT stem FROM p) s""")
def e22(t: Tables):
    stem = F.when(F.col("source_file") == "src_0", "DoS").when(F.col("source_file") == "src_3", "odd").otherwise("rpm")
    f = t.labelled.withColumn("source_stem", stem)
    prof = f.groupBy("source_file", "source_stem").agg(F.sum("binary_label_id").alias("attack_frames"), F.min("can_id").alias("min_id"), F.max("can_id").alias("max_id"))
    mix = P.compact_counts(f, ["source_file"], "dlc", "dlc_mix")
    return P.grammar_distance(prof.join(mix, "source_file"), FAMILIES)


@query("e23_support_shift_summary", f"""
SELECT 'JS id' AS measure, 'a-b' AS domain, round({_js_sql(_cnt('can_id'))}, 6) AS value
UNION ALL SELECT 'unique ids', domain, count(DISTINCT can_id)::DOUBLE FROM dom GROUP BY domain
UNION ALL SELECT 'coverage', 'src_2', round((SELECT avg((can_id IN (SELECT can_id FROM fr WHERE source_file = 'src_0'))::INT) FROM fr WHERE source_file = 'src_2'), 6)""")
def e23(t: Tables):
    d = domains(t)
    js = P.js_divergence(*[d.where(f"domain = '{x}'").groupBy("can_id").agg(F.count("*").alias("n")) for x in "ab"], "can_id")
    ids = d.groupBy("domain").agg(F.count_distinct("can_id").alias("ids"))
    ov = P.id_overlap(d, d.where("source_file = 'src_0'"), ["source_file"])
    cells = [("JS id", "a-b", js, F.lit(True), F.col("js"))]
    cells += [("unique ids", x, ids, F.col("domain") == x, F.col("ids")) for x in "ab"]
    cells += [("coverage", "src_2", ov, F.col("source_file") == "src_2", F.col("coverage"))]
    return P.support_shift_summary(cells, t.spark).withColumn("value", F.round("value", 6))
