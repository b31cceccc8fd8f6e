"""Queries for validity, integrity and pairing audits (section F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.functions.keyed import draw_unit
from busline.operators import audit as AU
from busline.operators import augment as A
from busline.operators import sampling as S
from busline.plans.q_augment import SEED, cycled_pool, normals, pool_frames
from busline.plans.q_profile import r6
from busline.plans.registry import query
from busline.plans.views import CTES, Tables
from busline.schema import BYTES, CHANNELS

_PB = ", ".join(BYTES)
_OUT = " + ".join(f"({b} NOT BETWEEN 0 AND 255)::INT" for b in BYTES)


@query("f1_feature_validity", f"""
SELECT y_attack_type::BIGINT AS cls, min(can_id) AS can_id_min, max(can_id) AS can_id_max, min(dlc) AS dlc_min, max(dlc) AS dlc_max, min(least({_PB})) AS payload_min, max(greatest({_PB})) AS payload_max,
 round(min(delta_t), 6) AS delta_t_min, round(max(delta_t), 6) AS delta_t_max, count(*) FILTER (can_id NOT BETWEEN 0 AND 2047) AS invalid_can_id, count(*) FILTER (dlc NOT BETWEEN 0 AND 8) AS invalid_dlc,
 sum({_OUT})::BIGINT AS invalid_payload, count(*) FILTER (delta_t < 0) AS invalid_delta_t FROM pl GROUP BY ALL""")
def f1(t: Tables):
    d = AU.feature_validity(pool_frames(cycled_pool(t)), [F.col("y_attack_type").cast("long").alias("cls")])
    keep = [c for c in d.columns if not c.startswith("delta_t_m")]
    return d.select(*keep, F.round("delta_t_min", 6).alias("delta_t_min"), F.round("delta_t_max", 6).alias("delta_t_max"))


# Raw generator output: frames shifted and scaled so that every fault occurs.
CTES["rawf"] = "SELECT event_id, can_id * 16.5::DOUBLE - 100 AS can_id, dlc + 0.5::DOUBLE AS dlc, " + ", ".join(f"{b} * 1.1::DOUBLE - 5.25::DOUBLE AS {b}" for b in BYTES) + ", delta_t - 30 AS delta_t FROM fr"
_FIX = {"can_id": "least(greatest(round_even(can_id, 0), 0), 2047)", "dlc": "least(greatest(round_even(dlc, 0), 0), 8)", "delta_t": "least(greatest(delta_t, 0), 600)"}
for _j, _b in enumerate(BYTES):
    _FIX[_b] = f"CASE WHEN {_FIX['dlc']} <= {_j} THEN 0 ELSE least(greatest(round_even({_b}, 0), 0), 255) END"
CTES["fixf"] = "SELECT event_id, " + ", ".join(f"({_FIX[c]})::DOUBLE AS {c}" for c in CHANNELS) + " FROM rawf"


def raw_frames(t: Tables):
    return t.frames.select("event_id", (F.col("can_id") * 16.5 - 100).alias("can_id"), (F.col("dlc") + 0.5).alias("dlc"),
                           *[(F.col(b) * 1.1 - 5.25).alias(b) for b in BYTES], (F.col("delta_t") - 30).alias("delta_t"))


@query("f2_enforce_protocol", "SELECT event_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in CHANNELS) + " FROM fixf")
def f2(t: Tables):
    return r6(AU.enforce_protocol(raw_frames(t), 600.0), *CHANNELS, keep=("event_id",))


_CH = lambda c: f"(abs(r.{c} - p.{c}) > 1e-6)::INT"
_INT = ["can_id", "dlc", *BYTES]


@query("f3_repair_stats", f"""
SELECT count(*) AS frames, sum({' + '.join(_CH(c) for c in _INT)})::BIGINT AS integer_values_changed, count(*) FILTER (r.delta_t < 0) AS negative_delta_t_clipped,
 sum({' + '.join(f'(p.dlc <= {j})::INT' for j in range(8))})::BIGINT AS padding_slots, sum({' + '.join(f'(p.dlc <= {j} AND r.{b} <> 0)::INT' for j, b in enumerate(BYTES))})::BIGINT AS padding_zeroed,
 sum({' + '.join(_CH(c) for c in CHANNELS)})::BIGINT AS values_changed, round(sum({' + '.join(_CH(c) for c in _INT)}) / (count(*) * 10), 6) AS integer_share, round(sum({' + '.join(_CH(c) for c in CHANNELS)}) / (count(*) * 11), 6) AS value_share
FROM rawf r JOIN fixf p USING (event_id)""")
def f3(t: Tables):
    raw = raw_frames(t)
    d = AU.repair_stats(raw, AU.enforce_protocol(raw, 600.0), ["event_id"])
    return d.withColumn("integer_share", F.round("integer_share", 6)).withColumn("value_share", F.round("value_share", 6))


_NI = lambda c: f"(abs({c} - round_even({c}, 0)) > 1e-6)::INT"
_DOK = "(abs(dlc - round_even(dlc, 0)) <= 1e-6 AND dlc BETWEEN 0 AND 8)"
_PADB = [f"({_DOK} AND dlc <= {j} AND {b} <> 0)" for j, b in enumerate(BYTES)]
_BADF = "(abs(can_id - round_even(can_id, 0)) > 1e-6 OR can_id NOT BETWEEN 0 AND 2047 OR NOT " + _DOK + " OR " + " OR ".join(f"{_NI(b)} = 1 OR {b} NOT BETWEEN 0 AND 255" for b in BYTES) + " OR delta_t < 0 OR " + " OR ".join(_PADB) + ")"
# Mixed frames: raw output for every third event, else repaired.
CTES["mixf"] = "SELECT * FROM fixf WHERE event_id % 3 <> 0 UNION ALL SELECT * REPLACE (dlc - 0.5 AS dlc) FROM rawf WHERE event_id % 3 = 0"


@query("f4_protocol_validity", f"""
SELECT count(*) AS frames, 0::BIGINT AS nonfinite_can_id, sum({_NI('can_id')})::BIGINT AS noninteger_can_id, count(*) FILTER (can_id NOT BETWEEN 0 AND 2047) AS out_of_range_can_id,
 sum({_NI('dlc')})::BIGINT AS noninteger_dlc, sum({' + '.join(_NI(b) for b in BYTES)})::BIGINT AS noninteger_payload, sum({_OUT})::BIGINT AS out_of_range_payload,
 count(*) FILTER (delta_t < 0) AS negative_delta_t, sum({' + '.join(f'({_DOK} AND dlc <= {j})::INT' for j in range(8))})::BIGINT AS padding_slots, sum({' + '.join(p + '::INT' for p in _PADB)})::BIGINT AS nonzero_padding_slots,
 count(*) FILTER ({' OR '.join(_PADB)}) AS frames_with_nonzero_padding, count(*) FILTER {_BADF} AS invalid_frames, round(1 - count(*) FILTER {_BADF} / count(*), 6) AS valid_frame_share, false AS valid,
 round(1 - count(*) FILTER (delta_t < 0 OR delta_t > 500) / count(*), 6) AS delta_t_in_reference_share FROM mixf""")
def f4(t: Tables):
    raw = raw_frames(t)
    mix = AU.enforce_protocol(raw, 600.0).where("event_id % 3 <> 0").unionByName(raw.where("event_id % 3 = 0").withColumn("dlc", F.col("dlc") - 0.5))
    d = AU.protocol_validity(mix, ref=(0.0, 500.0))
    return d.select("frames", "nonfinite_can_id", "noninteger_can_id", "out_of_range_can_id", "noninteger_dlc", "noninteger_payload", "out_of_range_payload", "negative_delta_t", "padding_slots",
                    "nonzero_padding_slots", "frames_with_nonzero_padding", "invalid_frames", F.round("valid_frame_share", 6).alias("valid_frame_share"), "valid", F.round("delta_t_in_reference_share", 6).alias("delta_t_in_reference_share"))


@query("f5_condition_audit", """
WITH p AS (SELECT *, CASE y_attack_type WHEN 1 THEN 'DoS' WHEN 2 THEN 'Fuzzy' WHEN 3 THEN 'Gear' ELSE 'RPM' END AS nm, ('0x' || substr(md5(wkey), 1, 2))::INT AS z FROM pw)
SELECT count(*) AS windows, 1.0::DOUBLE AS binary_share, 1.0::DOUBLE AS valid_label_share, round(avg((z % 5 <> 0)::INT), 6) AS name_share, round(avg((z % 7 <> 0)::INT), 6) AS condition_label_share,
 round(avg((z % 5 <> 0)::INT), 6) AS condition_name_share, round(avg((z % 5 <> 0 AND z % 7 <> 0)::INT), 6) AS all_share, bool_and(z % 5 <> 0 AND z % 7 <> 0) AS all_valid FROM p""")
def f5(t: Tables):
    z = F.conv(F.substring(F.md5(F.col("wkey").cast("binary")), 1, 2), 16, 10).cast("int")
    p = cycled_pool(t).withColumn("z", z).withColumn("condition_name", F.col("synthetic_type"))
    p = p.withColumn("synthetic_type", F.when(F.col("z") % 5 == 0, "none").otherwise(F.col("synthetic_type")))
    p = p.withColumn("condition_label", F.when(F.col("z") % 7 == 0, -1).otherwise(F.col("y_attack_type")))
    d = AU.condition_audit(p, A.CLASSES)
    return r6(d, *[c for c in d.columns if c.endswith("_share")], keep=("windows", "all_valid"))


@query("f6_support_profile", f"""
WITH vn AS (SELECT DISTINCT can_id FROM fr WHERE binary_label_id = 0 AND source_file = 'src_0'), va AS (SELECT DISTINCT can_id FROM fr WHERE source_file IN ('src_0', 'src_1'))
SELECT y_attack_type::BIGINT AS cls, count(*) AS frames, count(DISTINCT can_id) AS unique_ids, round(avg((can_id IN (SELECT can_id FROM vn))::INT), 6) AS in_normal_vocab, round(avg((can_id IN (SELECT can_id FROM va))::INT), 6) AS in_all_vocab,
 1.0::DOUBLE AS dlc_integer_share, round(sum({' + '.join(f'({b} IN (0, 255))::INT' for b in BYTES)}) / (count(*) * 8), 6) AS payload_bound_share, round(avg((can_id IN (0, 2047))::INT), 6) AS id_bound_share, round(avg((delta_t = 0)::INT), 6) AS delta_t_zero_share
FROM pl GROUP BY ALL""")
def f6(t: Tables):
    f = pool_frames(cycled_pool(t)).withColumn("cls", F.col("y_attack_type").cast("long"))
    d = AU.support_profile(f, t.frames.where("binary_label_id = 0 AND source_file = 'src_0'"), t.frames.where("source_file IN ('src_0', 'src_1')"), ["cls"])
    return r6(d, *[c for c in d.columns if c not in ("cls", "frames", "unique_ids")], keep=("cls", "frames", "unique_ids"))


# Copies: each window comes once per pool it is put into, so contents repeat within and across pools.
CTES["cp"] = """SELECT wkey, p AS pool, y_attack_type, (split_part(wkey, ':', 2)::BIGINT // 32) % 4 AS cls FROM pw, (SELECT unnest([1, 2, 3]) AS p)
WHERE p = 1 OR ('0x' || substr(md5(wkey), 1, 2))::INT % p = 0 UNION ALL SELECT wkey, 3, y_attack_type, 0 FROM pw WHERE ('0x' || substr(md5(wkey), 1, 2))::INT % 6 = 0"""


def copies(t: Tables):
    z = F.conv(F.substring(F.md5(F.col("wkey").cast("binary")), 1, 2), 16, 10).cast("int")
    d = AU.window_digest(cycled_pool(t)).select("wkey", "y_attack_type", "digest", z.alias("z"))
    pools = F.concat(F.array(F.lit(1)), F.filter(F.array(F.lit(2), F.lit(3)), lambda p: F.col("z") % p == 0), F.when(F.col("z") % 6 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")))
    return d.withColumn("pool", F.explode(pools))


@query("f7_content_uniqueness", """
SELECT pool::BIGINT AS pool, sum(n)::BIGINT AS windows, count(*) AS unique_windows, count(*) FILTER (n > 1) AS repeated_contents, (sum(n) - count(*))::BIGINT AS repeats FROM (SELECT pool, wkey, count(*) AS n FROM cp GROUP BY ALL) GROUP BY pool""")
def f7(t: Tables):
    d = AU.content_uniqueness(copies(t), ["pool"])
    return d.withColumn("pool", F.col("pool").cast("long"))


@query("f8_ordered_digest")
def f8(t: Tables):
    d = AU.window_digest(cycled_pool(t))
    d = S.keyed_rank(d.select("wkey", "y_attack_type", "digest"), [], SEED, "wkey")
    return AU.ordered_digest(d, "rank")


@query("f9_pool_overlap", """
WITH k AS (SELECT pool, wkey, count(*) AS n FROM cp GROUP BY ALL), s AS (SELECT pool, sum(n)::BIGINT AS r, count(*) AS q FROM k GROUP BY pool)
SELECT a.pool::BIGINT AS left_pool, b.pool::BIGINT AS right_pool, a.r AS left_rows, b.r AS right_rows, a.q AS left_unique, b.q AS right_unique, o AS overlap, round(o / a.r, 6) AS left_share, round(o / b.r, 6) AS right_share, false AS identical_sets
FROM s a JOIN s b ON a.pool < b.pool, LATERAL (SELECT count(*) AS o FROM k x JOIN k y USING (wkey) WHERE x.pool = a.pool AND y.pool = b.pool)""")
def f9(t: Tables):
    d = AU.pool_overlap(copies(t))
    return d.select(F.col("left_pool").cast("long").alias("left_pool"), F.col("right_pool").cast("long").alias("right_pool"), "left_rows", "right_rows", "left_unique", "right_unique", "overlap",
                    F.round("left_share", 6).alias("left_share"), F.round("right_share", 6).alias("right_share"), "identical_sets")


# Gap mean and SD of real windows under the class of the pool window at the same place.
CTES["tf"] = """SELECT p.wkey, p.y_attack_type, avg(p.delta_t) AS pm, stddev_pop(p.delta_t) AS ps, avg(n.delta_t) AS rm, stddev_pop(n.delta_t) AS rs FROM pl p JOIN nf n USING (wkey, pos) GROUP BY ALL"""
CTES["tk"] = """SELECT tf.*, pm BETWEEN ml AND mh AND ps BETWEEN sl AND sh AS keep, floor(('0x' || substr(md5(concat_ws('|', 7, wkey, 'art')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 8) / 8 AS score FROM tf JOIN
 (SELECT y_attack_type, quantile_cont(rm, 0.05) AS ml, quantile_cont(rm, 0.95) AS mh, quantile_cont(rs, 0.05) AS sl, quantile_cont(rs, 0.95) AS sh FROM tf GROUP BY ALL) USING (y_attack_type)"""


def timing(frames, keys):
    return frames.groupBy(*keys).agg(F.avg("delta_t").alias("delta_t_mean"), F.stddev_pop("delta_t").alias("delta_t_std"))


def _filtered(t: Tables):
    pool = cycled_pool(t)
    syn = timing(pool_frames(pool), ["wkey", "y_attack_type"])
    real = timing(A.explode_frames(normals(t), ["wkey"]), ["wkey"]).join(pool.select("wkey", "y_attack_type"), "wkey")
    d = AU.temporal_filter(real, syn)
    return d.withColumn("score", F.floor(draw_unit(SEED, F.col("wkey"), "art") * 8) / 8)


@query("f10_temporal_filter", "SELECT wkey, y_attack_type::BIGINT AS cls, keep FROM tk")
def f10(t: Tables):
    return _filtered(t).select("wkey", F.col("y_attack_type").cast("long").alias("cls"), F.col("temporal_keep").alias("keep"))


CTES["ak"] = "SELECT *, row_number() OVER (PARTITION BY y_attack_type ORDER BY score, wkey) <= ceil(count(*) OVER (PARTITION BY y_attack_type) * 0.7::DOUBLE) AS akeep FROM tk"


@query("f11_artifact_filter", "SELECT wkey, akeep AS keep FROM ak")
def f11(t: Tables):
    return AU.artifact_filter(_filtered(t), "score", "wkey").select("wkey", F.col("artifact_keep").alias("keep"))


@query("f12_filter_stats", """
WITH u AS (SELECT *, 'temporal' AS filter FROM ak WHERE keep UNION ALL SELECT *, 'artifact' FROM ak WHERE akeep UNION ALL SELECT *, 'both' FROM ak WHERE keep AND akeep)
SELECT filter, count(*) AS windows, round(avg(score), 6) AS score_mean, max(score) AS score_max, count(*) FILTER (y_attack_type = 1) AS dos_windows, count(*) FILTER (y_attack_type = 2) AS fuzzy_windows,
 count(*) FILTER (y_attack_type = 3) AS gear_windows, count(*) FILTER (y_attack_type = 4) AS rpm_windows, round(count(*) / (SELECT count(*) FROM ak), 6) AS keep_ratio FROM u GROUP BY filter""")
def f12(t: Tables):
    d = AU.artifact_filter(_filtered(t), "score", "wkey")
    tk, ak = F.col("temporal_keep"), F.col("artifact_keep")
    s = AU.filter_stats(d, {"temporal": tk, "artifact": ak, "both": tk & ak}, "score", A.CLASSES)
    return s.withColumn("score_mean", F.round("score_mean", 6)).withColumn("keep_ratio", F.round("keep_ratio", 6))


@query("f13_pair_gates", """
SELECT count(DISTINCT wkey) AS windows, (count(DISTINCT wkey) * 128)::BIGINT AS frames, 0::BIGINT AS other_channel_changes, 0::BIGINT AS changes_off_injected,
 count(*) FILTER (data1 <> twin1) AS moved_values, 0::BIGINT AS windows_with_new_values, true AS pass FROM twin""")
def f13(t: Tables):
    p = cycled_pool(t).where("y_attack_type IN (3, 4)")
    return AU.pair_gates(pool_frames(p), pool_frames(A.placebo_twin(p, SEED)), ["wkey"])


_REL = "CASE WHEN y_attack_type = 3 THEN abs(255 - data0 - {d1}) <= 8 ELSE (({d1}::BIGINT - 8 * data0::BIGINT) % 256 + 256) % 256 < 8 END"


@query("f14_relation_residual", f"""
WITH b AS (SELECT wkey, y_attack_type, arm, data0::BIGINT % 32 AS b, count(*) AS n, count(*) FILTER (hit) AS h FROM (
 SELECT *, 'rule' AS arm, {_REL.format(d1='data1')} AS hit FROM twin UNION ALL SELECT *, 'placebo', {_REL.format(d1='twin1')} FROM twin) GROUP BY ALL),
w AS (SELECT wkey, y_attack_type, arm, sum(n) AS n, sum(h) AS h, max(n) AS m FROM b GROUP BY ALL)
SELECT arm, y_attack_type::BIGINT AS cls, count(*) AS windows, sum(n)::BIGINT AS frames, sum(h)::BIGINT AS residual, sum(CASE WHEN y_attack_type = 4 THEN greatest(0, 2 * m - n) ELSE 0 END)::BIGINT AS structural_minimum, round(sum(h) / sum(n), 6) AS residual_share FROM w GROUP BY ALL""")
def f14(t: Tables):
    p = cycled_pool(t).where("y_attack_type IN (3, 4)")
    arms = [AU.relation_residual(pool_frames(x), ["wkey"]).withColumn("arm", F.lit(n)) for n, x in (("rule", p), ("placebo", A.placebo_twin(p, SEED)))]
    d = arms[0].unionByName(arms[1])
    return d.select("arm", F.col("y_attack_type").cast("long").alias("cls"), "windows", "frames", "residual", "structural_minimum", F.round("residual_share", 6).alias("residual_share"))


CTES["vis"] = """SELECT p.wkey, min(p.data1) AS lo_a, max(p.data1) AS hi_a, arg_max(p.data1, p.pos) - arg_min(p.data1, p.pos) AS de_a, sum(p.data0 * p.data1) AS xy_a,
 min(coalesce(x.twin1, p.data1)) AS lo_b, max(coalesce(x.twin1, p.data1)) AS hi_b, arg_max(coalesce(x.twin1, p.data1), p.pos) - arg_min(coalesce(x.twin1, p.data1), p.pos) AS de_b, sum(p.data0 * coalesce(x.twin1, p.data1)) AS xy_b
FROM pl p LEFT JOIN twin x ON p.wkey = x.wkey AND p.pos = x.pos WHERE p.y_attack_type IN (3, 4) GROUP BY p.wkey"""


@query("f15_visibility", """
SELECT 'data1_min' AS feature, count(*) FILTER (lo_a <> lo_b) AS windows FROM vis UNION ALL SELECT 'data1_max', count(*) FILTER (hi_a <> hi_b) FROM vis
UNION ALL SELECT 'data1_delta', count(*) FILTER (de_a <> de_b) FROM vis UNION ALL SELECT 'xy', count(*) FILTER (xy_a <> xy_b) FROM vis
UNION ALL SELECT 'any', count(*) FILTER (lo_a <> lo_b OR hi_a <> hi_b OR de_a <> de_b OR xy_a <> xy_b) FROM vis""")
def f15(t: Tables):
    p = cycled_pool(t).where("y_attack_type IN (3, 4)")

    def feats(w):
        return A.explode_frames(w, ["wkey"]).groupBy("wkey").agg(
            F.min("data1").alias("data1_min"), F.max("data1").alias("data1_max"),
            (F.max_by("data1", "pos") - F.min_by("data1", "pos")).alias("data1_delta"), F.sum(F.col("data0") * F.col("data1")).alias("xy"))

    w, f = AU.visibility(feats(p), feats(A.placebo_twin(p, SEED)), ["wkey"], ["data1_min", "data1_max", "data1_delta", "xy"])
    return f.unionByName(w.select(F.lit("any").alias("feature"), F.col("visible_windows").alias("windows")))


@query("f16_assert_disjoint", """
SELECT source_file, count(*) AS windows, count(pe) AS comparisons, count(*) FILTER (start_index <= pe) AS overlaps, 0::BIGINT AS repeated_rows
FROM (SELECT *, lag(start_index + 127) OVER (PARTITION BY source_file ORDER BY start_index) AS pe FROM wl WHERE start_index % 96 = 0 OR start_index % 128 = 0) GROUP BY source_file""")
def f16(t: Tables):
    w = t.windows.where("start_index % 96 = 0 OR start_index % 128 = 0").select("source_file", "start_index", "end_index")
    return AU.assert_disjoint(w, ["source_file"])


@query("f17_grid", """
WITH c AS (SELECT construction, seed, block, count(*) AS n FROM fac WHERE NOT (construction = 1 AND seed = 2) GROUP BY ALL),
g AS (SELECT * FROM (SELECT unnest(range(5)) AS construction), (SELECT unnest(range(5)) AS seed), (SELECT unnest(range(3)) AS block))
SELECT (SELECT count(*) FROM c) AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS out_of_bounds, (SELECT count(*) FROM g ANTI JOIN c USING (construction, seed, block)) AS missing, 0::BIGINT AS extra, 0::BIGINT AS double""")
def f17(t: Tables):
    d = t.factorial.where("NOT (construction = 1 AND seed = 2)").groupBy("construction", "seed", "block").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return AU.grid_report(d, {"construction": list(range(5)), "seed": list(range(5)), "block": list(range(3))}, ["hits"], {"hits": "n"})


@query("f18_validate_source", """
SELECT count(*) AS windows, 0::BIGINT AS bad_length, 0::BIGINT AS not_finite, count(*) FILTER ((y_binary = 1) <> (y_attack_type > 0)) AS label_conflicts, count(*) FILTER (y_binary = 0) AS normals,
 count(*) FILTER ((y_binary = 1) <> (y_attack_type > 0)) = 0 AND count(*) FILTER (y_binary = 0) > 0 AS valid FROM wl""")
def f18(t: Tables):
    return AU.validate_source(t.windows)


@query("f19_retention", """
SELECT CASE WHEN source_file IS NULL THEN 'y_binary' ELSE 'source_file' END AS group_type, coalesce(source_file, y_binary::VARCHAR) AS group_key, count(*) AS full_windows,
 count(*) FILTER (start_index % 128 = 0) AS kept_windows, round(count(*) FILTER (start_index % 128 = 0) / count(*), 6) AS kept_share FROM wl GROUP BY GROUPING SETS ((source_file), (y_binary))""")
def f19(t: Tables):
    d = AU.retention(t.windows, F.col("start_index") % 128 == 0, ["source_file", "y_binary"])
    return d.withColumn("kept_share", F.round("kept_share", 6))


@query("f20_table_diff", """
WITH a AS (SELECT setting, seed, count(*) AS n FROM sc WHERE seed <> 7 GROUP BY ALL), b AS (SELECT setting, seed, count(*) FILTER (seed <> 3 OR y = 0) AS n FROM sc WHERE seed <> 1 GROUP BY ALL)
SELECT coalesce(a.setting, b.setting) AS setting, coalesce(a.seed, b.seed)::BIGINT AS seed, CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' WHEN a.n = b.n THEN 'equal' ELSE 'differs' END AS status
FROM a FULL JOIN b ON a.setting = b.setting AND a.seed = b.seed""")
def f20(t: Tables):
    s = t.scores
    a = s.where("seed <> 7").groupBy("setting", "seed").agg(F.count("*").alias("n"))
    b = s.where("seed <> 1").groupBy("setting", "seed").agg(F.count_if((F.col("seed") != 3) | (F.col("y") == 0)).alias("n"))
    return AU.table_diff(a, b, ["setting", "seed"]).select("setting", F.col("seed").cast("long").alias("seed"), "status")


@query("f21_draw_identity", """
SELECT count(*) AS positions, count(*) FILTER (o % 50 <> 0) AS same, 0::BIGINT AS unpaired, 0::BIGINT AS repeats_a, (count(*) - count(DISTINCT CASE WHEN o % 50 = 0 THEN o + 1 ELSE o END))::BIGINT AS repeats_b, count(*) FILTER (o % 50 = 0) = 0 AS identical
FROM (SELECT o_orderkey AS o FROM orders)""")
def f21(t: Tables):
    o = t.read("orders").select(F.col("o_orderkey").alias("draw"), F.col("o_orderkey").alias("row"))
    b = o.withColumn("row", F.when(F.col("row") % 50 == 0, F.col("row") + 1).otherwise(F.col("row")))
    return AU.draw_identity(o, b, ["draw"], "row")
