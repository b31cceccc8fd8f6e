"""Queries for seed summaries and paired statistics (section K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.functions import student as SD
from busline.operators import stats as ST
from busline.plans.q_augment import cycled_pool
from busline.plans.q_metrics import scored
from busline.plans.q_profile import r6
from busline.plans.registry import query
from busline.plans.views import CTES, Tables

# Seed metric table: one row per setting, arm (family) and seed.
CTES["stt"] = """SELECT setting, family, seed::BIGINT AS seed, count(*) AS n, sum((quantity >= 25)::INT)::BIGINT AS k, avg((quantity >= 25)::INT) AS recall,
 avg((score >= 0.5)::INT) AS alarm, avg((quantity >= 40)::INT) AS recall2 FROM sc GROUP BY ALL"""
CTES["sts"] = "SELECT setting, family, avg(recall) AS recall, avg(alarm) AS alarm, avg(recall2) AS recall2, stddev_samp(recall) AS sd FROM stt GROUP BY ALL"
# Paired differences of arm R against arm N.
CTES["prd"] = "SELECT a.setting, a.seed, a.recall AS va, b.recall AS vb, a.recall - b.recall AS delta FROM stt a JOIN stt b USING (setting, seed) WHERE a.family = 'R' AND b.family = 'N'"
T6 = 2.4469118511449692  # Student-t 0.975 quantile at 6 degrees of freedom
CTES["prs"] = f"""SELECT *, mean - {T6}::DOUBLE * sd / sqrt(n) AS ci_low, mean + {T6}::DOUBLE * sd / sqrt(n) AS ci_high, mean / (sd / sqrt(n)) AS t FROM (
SELECT setting, count(*) AS n, avg(va) AS mean_a, avg(vb) AS mean_b, avg(delta) AS mean, stddev_samp(delta) AS sd, min(delta) AS mn, max(delta) AS mx,
 count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta < 0) AS negative FROM prd GROUP BY setting)"""


def p6(t: str) -> str:
    """Two-sided p at 6 degrees of freedom in closed form."""
    c2 = f"(1 / (1 + {t} * {t} / 6.0::DOUBLE))"
    return f"(1 - abs({t}) / sqrt(6.0 + {t} * {t}) * (1 + 0.5 * {c2} + 0.375 * {c2} * {c2}))"


def seed_table(t: Tables):
    s = t.scores
    return s.groupBy("setting", "family", F.col("seed").cast("long").alias("seed")).agg(
        F.count("*").alias("n"), F.count_if(F.col("quantity") >= 25).alias("k"), F.avg((F.col("quantity") >= 25).cast("double")).alias("recall"),
        F.avg((F.col("score") >= 0.5).cast("double")).alias("alarm"), F.avg((F.col("quantity") >= 40).cast("double")).alias("recall2"))


@query("k1_summarize_seeds", """SELECT setting, family, count(DISTINCT seed) AS n_seeds, string_agg(DISTINCT seed::VARCHAR, ';' ORDER BY seed::VARCHAR) AS seeds, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std,
 round(avg(alarm), 6) AS alarm_mean, round(stddev_samp(alarm), 6) AS alarm_std FROM stt GROUP BY ALL""")
def k1(t: Tables):
    d = ST.summarize_seeds(seed_table(t), ["setting", "family"], ["recall", "alarm"])
    return r6(d, "recall_mean", "recall_std", "alarm_mean", "alarm_std", keep=("setting", "family", "n_seeds", "seeds"))


@query("k2_recall_delta", """WITH l AS (UNPIVOT (SELECT setting, family, seed, recall, alarm, recall2 FROM stt) ON recall, alarm, recall2 INTO NAME measure VALUE v), m AS (SELECT setting, family, measure, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY ALL)
SELECT m.setting, m.family, m.measure, round(m.mean, 6) AS mean, round(m.std, 6) AS std, round(m.mean - b.mean, 6) AS delta FROM m LEFT JOIN m b ON b.setting = m.setting AND b.measure = m.measure AND b.family = 'N'""")
def k2(t: Tables):
    d = ST.recall_delta(seed_table(t), ["setting"], "family", "N", ["recall", "alarm", "recall2"])
    return r6(d, "mean", "std", "delta", keep=("setting", "family", "measure"))


@query("k3_condition_gap", """SELECT family, round(avg(recall) FILTER (setting = 'F'), 6) AS recall_F, round(avg(recall) FILTER (setting = 'O'), 6) AS recall_O, round(avg(recall) FILTER (setting = 'F') - avg(recall) FILTER (setting = 'O'), 6) AS recall_drop FROM stt GROUP BY family""")
def k3(t: Tables):
    d = ST.condition_gap(seed_table(t), ["family"], "setting", "F", "O", ["recall"])
    return r6(d, "recall_F", "recall_O", "recall_drop", keep=("family",))


@query("k4_degradation", """SELECT x.seed, x.family, round(b.recall - x.recall, 6) AS recall_degradation, round(b.alarm - x.alarm, 6) AS alarm_degradation, round(o.recall - x.recall, 6) AS recall_gap, round(o.alarm - x.alarm, 6) AS alarm_gap
FROM (SELECT * FROM stt WHERE setting = 'O' AND family <> 'N') x JOIN (SELECT * FROM stt WHERE setting = 'O' AND family = 'N') b USING (seed) JOIN (SELECT * FROM stt WHERE setting = 'F') o ON o.seed = x.seed AND o.family = x.family""")
def k4(t: Tables):
    s = seed_table(t)
    d = ST.degradation(s.where("setting = 'O'"), ["seed"], "family", "N", ["recall", "alarm"], s.where("setting = 'F'"))
    return r6(d, "recall_degradation", "alarm_degradation", "recall_gap", "alarm_gap", keep=("seed", "family"))


@query("k5_correlations", """WITH r AS (SELECT setting, recall AS x, alarm AS y, rank() OVER (PARTITION BY setting ORDER BY recall) + (count(*) OVER (PARTITION BY setting, recall) - 1) / 2 AS rx, rank() OVER (PARTITION BY setting ORDER BY alarm) + (count(*) OVER (PARTITION BY setting, alarm) - 1) / 2 AS ry FROM stt)
SELECT setting, 'recall' AS x, 'alarm' AS y, count(*) AS n, round(corr(r.x, r.y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY setting""")
def k5(t: Tables):
    return r6(ST.correlations(seed_table(t), ["setting"], [("recall", "alarm")]), "pearson", "spearman", keep=("setting", "x", "y", "n"))


@query("k6_burst_mismatch", """WITH a AS (SELECT y_attack_type AS c, avg(injection_count) AS m FROM pw GROUP BY 1), b AS (SELECT y_attack_type AS c, avg(injection_count) AS m FROM pw WHERE split_part(wkey, ':', 1) <> 'src_0' GROUP BY 1),
j AS (SELECT c::VARCHAR AS cls, a.m AS am, b.m AS bm, abs(a.m - b.m) AS d FROM a JOIN b USING (c)) SELECT cls, round(am, 6) AS a_mean, round(bm, 6) AS b_mean, round(d, 6) AS mismatch FROM j UNION ALL SELECT 'all', round(avg(am), 6), round(avg(bm), 6), round(avg(d), 6) FROM j""")
def k6(t: Tables):
    p = cycled_pool(t).select(F.col("y_attack_type").alias("cls"), "injection_count", "source_file")
    return r6(ST.burst_mismatch(p, p.where("source_file <> 'src_0'"), "cls", "injection_count"), "a_mean", "b_mean", "mismatch", keep=("cls",))


_K7 = ["mean_a", "mean_b", "mean", "sd", "ci_low", "ci_high", "t", "p"]


@query("k7_paired_contrast", f"""SELECT setting, n, positive, negative, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean, 6) AS mean, round(sd, 6) AS sd, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(t, 6) AS t, round({p6('t')}, 6) AS p,
 CASE WHEN ci_low > 0 THEN 'positive_effect_supported' WHEN ci_high < 0 THEN 'negative_effect_supported' ELSE 'inconclusive_not_equivalent' END AS decision, greatest(positive, negative) || '/' || n AS sign_consistency FROM prs""")
def k7(t: Tables):
    d = ST.paired_contrast(seed_table(t), ["setting"], "family", "R", "N", "recall")
    return r6(d, *_K7, keep=("setting", "n", "positive", "negative", "decision", "sign_consistency"))


@query("k8_paired_settings", f"""WITH d AS (SELECT a.family, unnest(['recall', 'alarm']) AS metric, unnest([a.recall - b.recall, a.alarm - b.alarm]) AS x FROM stt a JOIN stt b USING (family, seed) WHERE a.setting = 'O' AND b.setting = 'F'),
g AS (SELECT family, metric, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative FROM d GROUP BY ALL)
SELECT family, metric, n, positive, negative, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - {T6}::DOUBLE * sd / sqrt(n), 6) AS ci_low, round(mean + {T6}::DOUBLE * sd / sqrt(n), 6) AS ci_high FROM g""")
def k8(t: Tables):
    d = ST.paired_settings(seed_table(t), ["family"], "setting", "O", "F", ["recall", "alarm"])
    return r6(d, "mean", "sd", "ci_low", "ci_high", keep=("family", "metric", "n", "positive", "negative"))


@query("k9_arm_contrast", """SELECT setting, 'arm' AS row_type, family AS name, count(*) AS n, round(avg(recall), 6) AS mean, round(stddev_samp(recall), 6) AS sd, false AS all_positive FROM stt GROUP BY ALL
UNION ALL SELECT setting, 'contrast', nm, count(*), round(avg(d), 6), round(stddev_samp(d), 6), bool_and(d > 0) FROM (SELECT a.setting, a.family || '-' || b.family AS nm, a.recall - b.recall AS d FROM stt a JOIN stt b USING (setting, seed) WHERE (a.family, b.family) IN (('R', 'N'), ('R', 'A'))) GROUP BY ALL""")
def k9(t: Tables):
    d = ST.arm_contrast_summary(seed_table(t), ["setting"], "family", "recall", {"R-N": ("R", "N"), "R-A": ("R", "A")})
    return r6(d, "mean", "sd", keep=("setting", "row_type", "name", "n", F.coalesce("all_positive", F.lit(False)).alias("all_positive")))


@query("k10_wilson", "SELECT setting, family, seed, round(1.96::DOUBLE * sqrt(recall * (1 - recall) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0 * n * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n), 8) AS hw FROM stt")
def k10(t: Tables):
    return seed_table(t).select("setting", "family", "seed", F.round(ST.wilson_hw(F.col("k"), F.col("n")), 8).alias("hw"))


@query("k11_wilcoxon", """WITH r AS (SELECT setting, delta, (rank() OVER w + (count(*) OVER (PARTITION BY setting, abs(delta)) - 1) / 2.0)::DOUBLE AS r, row_number() OVER (PARTITION BY setting ORDER BY seed) - 1 AS i FROM prd WHERE delta <> 0 WINDOW w AS (PARTITION BY setting ORDER BY abs(delta))),
o AS (SELECT setting, count(*) AS n, coalesce(sum(r) FILTER (delta > 0), 0) AS w FROM r GROUP BY setting),
e AS (SELECT setting, s, sum(CASE WHEN (s >> i) & 1 = 1 THEN r ELSE 0 END) AS x FROM r, (SELECT unnest(range(128)) AS s) GROUP BY ALL)
SELECT setting, any_value(n) AS n_used, any_value(w)::DOUBLE AS w_plus, round(least(1.0, 2 * least(count(*) FILTER (x <= w), count(*) FILTER (x >= w)) / 128.0), 6)::DOUBLE AS p FROM e JOIN o USING (setting) GROUP BY setting""")
def k11(t: Tables):
    d = ST.wilcoxon(ST.paired_values(seed_table(t), ["setting"], "family", "R", "N", "recall"), ["setting"])
    return d.select("setting", F.col("n_used").cast("long").alias("n_used"), "w_plus", F.round("p", 6).alias("p"))


@query("k12_t_from_summary", f"SELECT setting, round(t, 6) AS t, round({p6('t')}, 6) AS p FROM prs")
def k12(t: Tables):
    p = ST.paired_values(seed_table(t), ["setting"], "family", "R", "N", "recall")
    s = p.groupBy("setting").agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.count("*").alias("n"))
    return r6(ST.t_from_summary(s), "t", "p", keep=("setting",))


@query("k13_holm", """WITH p AS (SELECT setting, family || seed AS name, alarm * recall2 / 10 AS p FROM stt), s AS (SELECT *, (count(*) OVER (PARTITION BY setting) - row_number() OVER w + 1) * p AS a FROM p WINDOW w AS (PARTITION BY setting ORDER BY p, name))
SELECT setting, name, round(least(1.0, max(a) OVER (PARTITION BY setting ORDER BY p, name)), 6) AS holm_p FROM s""")
def k13(t: Tables):
    d = seed_table(t).select("setting", F.concat("family", F.col("seed").cast("string")).alias("name"), (F.col("alarm") * F.col("recall2") / 10).alias("p"))
    return r6(ST.holm(d, ["setting"]), "holm_p", keep=("setting", "name"))


CTES["un"] = "SELECT setting, unit, unit % 3 AS stratum, avg((score >= 0.5)::INT) AS rate FROM sc GROUP BY ALL"


def _boot_sql(own, label):
    part = ", ".join(own)
    return f"""(SELECT setting, b, avg(rate) AS m FROM (
 SELECT s.setting, s.b, r.rate FROM (SELECT {part}, rk, n, b, floor(('0x' || substr(md5(concat_ws('|', 3, {label}, b, rk)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT + 1 AS pick FROM ru, (SELECT unnest(range(2000)) AS b)) s
 JOIN ru r ON {' AND '.join(f's.{c} = r.{c}' for c in own)} AND r.rk = s.pick) GROUP BY ALL)"""


def _ru(own):
    part = ", ".join(own)
    return f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ('0x' || substr(md5(concat_ws('|', 3, 'boot', unit)), 1, 8))::BIGINT, unit) AS rk, count(*) OVER (PARTITION BY {part}) AS n FROM un"


def unit_rates(t: Tables):
    return scored(t).groupBy("setting", "unit", (F.col("unit") % 3).alias("stratum")).agg(F.avg(F.col("pred").cast("double")).alias("rate"))


@query("k14_bootstrap", f"WITH ru AS ({_ru(['setting'])}) SELECT u.setting, any_value(u.c) AS units, round(any_value(u.m), 6) AS mean, round(quantile_cont(b.m, 0.025), 6) AS ci_low, round(quantile_cont(b.m, 0.975), 6) AS ci_high FROM {_boot_sql(['setting'], 'setting')} b JOIN (SELECT setting, count(*) AS c, avg(rate) AS m FROM un GROUP BY setting) u ON u.setting = b.setting GROUP BY u.setting")
def k14(t: Tables):
    d = ST.bootstrap_ci(unit_rates(t), ["setting"], "rate", "unit", 2000, 3)
    return r6(d, "mean", "ci_low", "ci_high", keep=("setting", "units"))


@query("k15_bootstrap_strata", f"WITH ru AS ({_ru(['setting', 'stratum'])}) SELECT setting, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM {_boot_sql(['setting', 'stratum'], "setting || '/' || stratum")} GROUP BY setting")
def k15(t: Tables):
    d = ST.bootstrap_ci(unit_rates(t), ["setting"], "rate", "unit", 2000, 3, stratum=["stratum"])
    return r6(d, "ci_low", "ci_high", keep=("setting",))


CTES["blk"] = "SELECT family, seed::BIGINT AS seed, part % 4 AS block, avg((quantity >= 25)::INT) AS v FROM sc GROUP BY ALL"


def blocks(t: Tables):
    return t.scores.groupBy("family", F.col("seed").cast("long").alias("seed"), (F.col("part") % 4).alias("block")).agg(F.avg((F.col("quantity") >= 25).cast("double")).alias("v"))


@query("k16_nested_summary", f"""WITH s AS (SELECT family, seed, avg(v) AS x, stddev_samp(v) AS b FROM blk GROUP BY ALL)
SELECT family, count(*) AS n, 4::BIGINT AS blocks, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(avg(x) - {T6}::DOUBLE * stddev_samp(x) / sqrt(count(*)), 6) AS ci_low, round(avg(b), 6) AS mean_block_sd FROM s GROUP BY family""")
def k16(t: Tables):
    d = ST.nested_summary(blocks(t), ["family"], "seed", "block", "v")
    return r6(d, "mean", "sd", "ci_low", "mean_block_sd", keep=("family", "n", "blocks"))


@query("k17_paired_blocks", "SELECT a.seed, a.block, round(a.v, 6) AS treatment, round(b.v, 6) AS reference, round(a.v - b.v, 6) AS delta FROM blk a JOIN blk b USING (seed, block) WHERE a.family = 'R' AND b.family = 'A'")
def k17(t: Tables):
    d = ST.paired_blocks(blocks(t), [], "seed", "block", "family", "R", "A", "v")
    return r6(d, "treatment", "reference", "delta", keep=("seed", "block"))


_C = [1.0, 0.5, 0.375, 0.3125, 0.2734375, 0.24609375, 0.2255859375]
_SER = " + ".join(f"CASE WHEN df >= {2 * j + 2} THEN {c}::DOUBLE * power(1 / (1 + t * t / df), {j}) ELSE 0 END" for j, c in enumerate(_C))


@query("k18_student", f"""WITH x AS (SELECT l_linenumber * 2 AS df, floor(l_extendedprice / 5000) / 4 AS t, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT df::BIGINT AS df, t, n, round((1 - t / sqrt(df + t * t) * ({_SER})) / 2, 9) AS sf, round(t, 4) AS back FROM x""")
def k18(t: Tables):
    d = t.read("lineitem").groupBy((F.col("l_linenumber") * 2).cast("long").alias("df"), (F.floor(F.col("l_extendedprice") / 5000) / 4).alias("t")).agg(F.count("*").alias("n"))
    sf = SD.t_sf(F.col("t"), F.col("df"))
    d = d.withColumn("sf", sf)
    return d.select("df", "t", "n", F.round("sf", 9).alias("sf"), F.round(SD.t_ppf(1 - F.col("sf"), F.col("df")), 4).alias("back"))


@query("k19_ablation_delta", "WITH m AS (SELECT setting, family, avg(recall) AS recall, avg(alarm) AS alarm FROM stt GROUP BY ALL) SELECT m.setting, m.family, round(m.recall, 6) AS recall, round(m.alarm, 6) AS alarm, round(m.recall - o.recall, 6) AS recall_delta, round(m.alarm - o.alarm, 6) AS alarm_delta FROM m JOIN m o ON o.setting = m.setting AND o.family = 'N' WHERE m.family <> 'N'")
def k19(t: Tables):
    d = ST.ablation_delta(seed_table(t), ["setting"], "family", "N", ["recall", "alarm"])
    return r6(d, "recall", "alarm", "recall_delta", "alarm_delta", keep=("setting", "family"))


@query("k20_ladder", """WITH m AS (SELECT setting, family, seed % 3 AS g, avg(recall) AS mean, stddev_samp(recall) AS sd, avg(alarm) AS amean, stddev_samp(alarm) AS asd FROM stt GROUP BY ALL)
SELECT family, 0::BIGINT AS level, 'in_dataset' AS rung, round(avg(mean), 6) AS mean, round(sqrt(avg(sd * sd)), 6) AS sd, count(*) AS cells FROM m WHERE setting = 'F' GROUP BY family
UNION ALL SELECT family, 1, 'shifted', round(avg(mean), 6), round(sqrt(avg(sd * sd)), 6), count(*) FROM m WHERE setting = 'O' GROUP BY family UNION ALL SELECT family, 2, 'external_fpr', round(avg(amean), 6), round(sqrt(avg(asd * asd)), 6), count(*) FROM m GROUP BY family""")
def k20(t: Tables):
    g = [*("setting", "family"), (F.col("seed") % 3).alias("g")]
    s = seed_table(t)
    m = s.groupBy(*g).agg(F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("sd"))
    a = s.groupBy(*g).agg(F.avg("alarm").alias("mean"), F.stddev_samp("alarm").alias("sd"))
    d = ST.ladder([("in_dataset", m.where("setting = 'F'")), ("shifted", m.where("setting = 'O'")), ("external_fpr", a)], ["family"])
    return r6(d, "mean", "sd", keep=("family", F.col("level").cast("long").alias("level"), "rung", "cells"))


@query("k21_select_cells", "SELECT setting, seed, round(recall, 6) AS recall, CASE family WHEN 'R' THEN 'Rule' WHEN 'N' THEN 'Real only' ELSE family END AS label FROM stt WHERE family IN ('R', 'A') AND seed IN (1, 3, 7)")
def k21(t: Tables):
    d = ST.select_cells(seed_table(t), {"family": ["R", "A"], "seed": [1, 3, 7]}, {"R": "Rule", "N": "Real only"}, "family")
    return r6(d, "recall", keep=("setting", "seed", "label"))


@query("k22_merge_selections", "SELECT setting, family, seed, 'primary' AS role, 'recall' AS lineage, round(recall, 6) AS value FROM stt WHERE family = 'R' UNION ALL SELECT setting, family, seed, 'supporting', 'alarm', round(alarm, 6) FROM stt WHERE setting = 'O'")
def k22(t: Tables):
    s = seed_table(t)
    tabs = {c: s.select("setting", "family", "seed", F.round(c, 6).alias("value")) for c in ("recall", "alarm")}
    spec = [{"table": "recall", "where": "family = 'R'", "role": "primary"}, {"table": "alarm", "where": "setting = 'O'", "role": "supporting"}]
    return ST.merge_selections(tabs, spec, ["setting", "family", "seed"])
