"""Queries for factorial and decomposition analysis (section L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import factorial as FA
from busline.plans.q_profile import r6
from busline.plans.registry import query
from busline.plans.views import CTES, Tables

# The real arm has no construction: its cells are pooled over constructions.
CTES["scn"] = """SELECT construction, seed, block, attack, arm, p, s, d, hits / n AS v, hits, n FROM fac WHERE arm <> 'real'
UNION ALL SELECT -1, seed, block, attack, arm, p, s, d, sum(hits) / sum(n), sum(hits)::BIGINT, sum(n)::BIGINT FROM fac WHERE arm = 'real' GROUP BY ALL"""


def scenario(t: Tables):
    def build():
        f = t.factorial
        keys = ["seed", "block", "attack", "arm", "p", "s", "d"]
        real = f.where("arm = 'real'").groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).withColumn("construction", F.lit(-1).cast("long"))
        return f.where("arm <> 'real'").unionByName(real).withColumn("v", F.col("hits") / F.col("n"))

    return t.stored("scenario", build)


def _sg(e: str) -> str:
    return " * ".join(f"(2 * {c.lower()} - 1)" for c in e)


def _eff_sql(src: str, keys: str, value: str, names=FA.EFFECTS) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{e}' AS effect, sum({_sg(e)} * {value}) / {2 ** (3 - len(e))} AS value FROM {src} GROUP BY {keys}" for e in names)


CTES["cell8"] = "SELECT construction, arm, p, s, d, sum(hits) AS h, sum(hits) / sum(n) AS v FROM scn GROUP BY ALL"
CTES["adl"] = """SELECT c.*, c.value - r.value AS delta FROM (SELECT arm, construction, seed, p, s, d, avg(v) AS value FROM (SELECT arm, construction, seed, block, p, s, d, avg(v) AS v FROM scn GROUP BY ALL) GROUP BY ALL) c
JOIN (SELECT seed, p, s, d, avg(v) AS value FROM (SELECT seed, block, p, s, d, avg(v) AS v FROM scn WHERE arm = 'real' GROUP BY ALL) GROUP BY ALL) r USING (seed, p, s, d) WHERE c.arm <> 'real'"""
CTES["efp"] = _eff_sql("adl", "arm, construction, seed", "delta")
CTES["efc"] = "SELECT arm, construction, effect, avg(value) AS value FROM efp GROUP BY ALL"
CTES["dec"] = "SELECT a.construction, a.value AS rule_delta, b.value AS placebo_delta, a.value - b.value AS theta FROM efc a JOIN efc b USING (construction) WHERE a.effect = 'P' AND b.effect = 'P' AND a.arm = 'rule' AND b.arm = 'placebo'"
T4, T4_90 = 2.7764451051977987, 2.1318467863266499  # Student-t 0.975 and 0.95 quantiles at 4 degrees of freedom
CTES["ets"] = f"""SELECT arm, effect, n, mean, sd, pos, neg, mn = mx AS degenerate, mean / (sd / sqrt(n)) AS t, mean - {T4}::DOUBLE * sd / sqrt(n) AS lo, mean + {T4}::DOUBLE * sd / sqrt(n) AS hi FROM (
 SELECT arm, effect, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, count(*) FILTER (value > 0) AS pos, count(*) FILTER (value < 0) AS neg FROM efc GROUP BY ALL)"""


def p4(t: str) -> str:
    return f"(1 - abs({t}) / sqrt(4.0 + {t} * {t}) * (1 + 0.5 / (1 + {t} * {t} / 4.0::DOUBLE)))"


CTES["eth"] = f"""SELECT *, least(1.0, max(a) OVER (PARTITION BY arm ORDER BY p, effect)) AS holm_p FROM (SELECT *, (7 - row_number() OVER (PARTITION BY arm ORDER BY p, effect) + 1) * p AS a FROM (SELECT *, {p4('t')} AS p FROM ets))"""


def deltas(t: Tables):
    return t.stored("deltas", lambda: FA.augmentation_delta(scenario(t), "v"))


def per_construction(t: Tables):
    return t.stored("effects", lambda: FA.effects(deltas(t))[1])


def decomposition(t: Tables):
    """Stage table: the decomposition is published before it is judged."""
    return t.stored("decomposition", lambda: FA.decompose(per_construction(t)))


@query("l1_factor_contrast", f"WITH e AS ({_eff_sql('cell8', 'construction, arm', 'v')} UNION ALL SELECT construction, arm, 'corner', sum(v) FILTER (p + s + d = 3) - sum(v) FILTER (p + s + d = 0) FROM cell8 GROUP BY ALL) SELECT construction, arm, effect, round(value, 6) AS value FROM e")
def l1(t: Tables):
    c = scenario(t).groupBy("construction", "arm", "p", "s", "d").agg((F.sum("hits") / F.sum("n")).alias("v"))
    return r6(FA.factor_contrast(c, ["construction", "arm"], "v"), "value", keep=("construction", "arm", "effect"))


@query("l2_count_contrast", " UNION ALL ".join(f"SELECT construction, arm, '{e}' AS effect, sum({_sg(e)} * h)::BIGINT AS numerator, round(sum({_sg(e)} * h) / ({2 ** (3 - len(e))} * 100000.0::DOUBLE), 9) AS value FROM cell8 GROUP BY ALL" for e in FA.EFFECTS))
def l2(t: Tables):
    c = scenario(t).groupBy("construction", "arm", "p", "s", "d").agg(F.sum("hits").alias("h")).withColumn("n", F.lit(100000))
    d = FA.count_contrast(c, ["construction", "arm"], "h", "n", FA.EFFECTS)
    return d.withColumn("value", F.round("value", 9))


@query("l3_augmentation_delta", "SELECT arm, construction, seed, p::BIGINT AS p, s::BIGINT AS s, d::BIGINT AS d, round(value, 6) AS value, round(delta, 6) AS delta FROM adl")
def l3(t: Tables):
    d = FA.augmentation_delta(scenario(t), "v")
    return r6(d, "value", "delta", keep=("arm", "construction", "seed", *[F.col(c).cast("long").alias(c) for c in "psd"]))


@query("l4_effects", "SELECT arm, construction, effect, round(value, 6) AS value FROM efc")
def l4(t: Tables):
    return r6(per_construction(t), "value", keep=("arm", "construction", "effect"))


@query("l5_decompose", "SELECT construction, round(rule_delta, 6) AS rule_delta, round(placebo_delta, 6) AS placebo_delta, round(theta, 6) AS theta, true AS closed FROM dec")
def l5(t: Tables):
    return r6(decomposition(t), "rule_delta", "placebo_delta", "theta", keep=("construction", (F.abs("residual") <= 1e-12).alias("closed")))


CTES["rd"] = "SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', 20260725, 'boot', construction)), 1, 8))::BIGINT, construction) AS rk FROM dec"
CTES["bm"] = """SELECT b, avg(r.theta) AS m FROM (SELECT b, floor(('0x' || substr(md5(concat_ws('|', 20260725, 'all', b, rk)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 5)::BIGINT + 1 AS pick FROM rd, (SELECT unnest(range(10000)) AS b)) s JOIN rd r ON r.rk = s.pick GROUP BY b"""


def _eq_sql(margin):
    return f"""(SELECT *, CASE WHEN (above >= 3 AND below >= 3) OR (above + below >= 5 AND eq) THEN 'C' WHEN eq <> beq OR ma <> bma THEN 'D' WHEN eq THEN 'A' WHEN ma THEN 'B' ELSE 'D' END AS verdict FROM (
SELECT *, lo90 >= -m AND hi90 <= m AS eq, lo95 > m OR hi95 < -m AS ma, bl90 >= -m AND bh90 <= m AS beq, bl95 > m OR bh95 < -m AS bma FROM (
SELECT any_value(mg) AS m, count(*) AS n, avg(theta) AS mean, avg(theta) - {T4_90}::DOUBLE * stddev_samp(theta) / sqrt(5) AS lo90, avg(theta) + {T4_90}::DOUBLE * stddev_samp(theta) / sqrt(5) AS hi90,
 avg(theta) - {T4}::DOUBLE * stddev_samp(theta) / sqrt(5) AS lo95, avg(theta) + {T4}::DOUBLE * stddev_samp(theta) / sqrt(5) AS hi95, count(*) FILTER (theta > mg) AS above, count(*) FILTER (theta < -mg) AS below
FROM dec, (SELECT {margin} AS mg)), (SELECT quantile_cont(m, 0.05) AS bl90, quantile_cont(m, 0.95) AS bh90, quantile_cont(m, 0.025) AS bl95, quantile_cont(m, 0.975) AS bh95 FROM bm)))"""


@query("l6_equivalence", f"SELECT n, round(mean, 6) AS mean, round(lo90, 6) AS lo90, round(hi90, 6) AS hi90, round(lo95, 6) AS lo95, round(hi95, 6) AS hi95, round(bl90, 6) AS b_lo90, round(bh90, 6) AS b_hi90, above, below, eq AS equivalent, ma AS material, verdict FROM {_eq_sql('0.133855625::DOUBLE')}")
def l6(t: Tables):
    d = FA.equivalence(decomposition(t).withColumn("g", F.lit("all")), ["g"], b=10000)
    return r6(d, "mean", "lo90", "hi90", "lo95", "hi95", "b_lo90", "b_hi90", keep=("n", "above", "below", "equivalent", "material", "verdict"))


CTES["cmp"] = """SELECT x.*, rule_recall - real_recall AS rule_gain, placebo_recall - real_recall AS placebo_gain FROM (SELECT scope, construction, avg(v) FILTER (arm = 'rule') AS rule_recall, avg(v) FILTER (arm = 'placebo') AS placebo_recall FROM (
 SELECT scope, arm, construction, seed, avg(v) AS v FROM (SELECT scope, arm, construction, seed, attack, avg(v) AS v FROM (SELECT *, unnest(['equal_macro', attack]) AS scope FROM scn WHERE p = 1) GROUP BY ALL) GROUP BY ALL) WHERE arm <> 'real' GROUP BY ALL) x
JOIN (SELECT scope, avg(v) AS real_recall FROM (SELECT scope, seed, avg(v) AS v FROM (SELECT scope, seed, attack, avg(v) AS v FROM (SELECT *, unnest(['equal_macro', attack]) AS scope FROM scn WHERE p = 1 AND arm = 'real') GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) r USING (scope)"""


@query("l7_margin_sensitivity", f"""WITH g AS (SELECT avg(placebo_gain) + 0.2 AS pg FROM cmp WHERE scope = 'equal_macro')
SELECT a.verdict, round(a.m, 6) AS margin, round(g.pg * 0.15::DOUBLE, 6) AS strict_margin, b.verdict AS strict_verdict, a.verdict <> b.verdict AS disagreement FROM {_eq_sql('0.133855625::DOUBLE')} a, g, {_eq_sql('(SELECT (avg(placebo_gain) + 0.2) * 0.15::DOUBLE FROM cmp WHERE scope = ' + chr(39) + 'equal_macro' + chr(39) + ')')} b""")
def l7(t: Tables):
    cells = FA.cell_comparison(scenario(t), "v", 1)
    gain = cells.where("scope = 'equal_macro'").agg((F.avg("placebo_gain") + 0.2).alias("placebo_gain")).withColumn("g", F.lit("all"))
    d = FA.margin_sensitivity(decomposition(t).withColumn("g", F.lit("all")), ["g"], gain, b=10000)
    return r6(d, "margin", "strict_margin", keep=("verdict", "strict_verdict", "disagreement"))


@query("l8_relational_share", "WITH s AS (SELECT CASE WHEN abs(rule_delta) >= 0.005 THEN theta / abs(rule_delta) END AS x, abs(rule_delta) < 0.005 AS out FROM dec) SELECT round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, count(x) AS used, count(*) FILTER (out) AS excluded FROM s")
def l8(t: Tables):
    return r6(FA.relational_share(decomposition(t), floor=0.005), "median", "q25", "q75", keep=("used", "excluded"))


@query("l9_response_share", "SELECT count(*) AS n, round(avg(placebo_delta) / avg(rule_delta), 5) AS share, round(quantile_cont(placebo_delta / rule_delta, 0.25), 5) AS ratio_q25, round(quantile_cont(placebo_delta / rule_delta, 0.5), 5) AS ratio_median, round(quantile_cont(placebo_delta / rule_delta, 0.75), 5) AS ratio_q75 FROM dec")
def l9(t: Tables):
    d = FA.response_share(decomposition(t))
    return d.select("n", *[F.round(c, 5).alias(c) for c in ("share", "ratio_q25", "ratio_median", "ratio_q75")])


@query("l10_cell_comparison", "SELECT scope, construction, round(real_recall, 6) AS real_recall, round(rule_recall, 6) AS rule_recall, round(placebo_recall, 6) AS placebo_recall, round(rule_gain, 6) AS rule_gain, abs(placebo_gain) < 0.01 AS ratio_unstable FROM cmp_r")
def l10(t: Tables):
    d = FA.cell_comparison(scenario(t), "v", 1)
    return r6(d, "real_recall", "rule_recall", "placebo_recall", "rule_gain", keep=("scope", "construction", "ratio_unstable"))


CTES["cmp_r"] = "SELECT *, rule_recall - rule_gain AS real_recall FROM cmp"


@query("l11_saturated", "SELECT scope, round(avg(rule_recall), 6) AS rule_recall, round(avg(placebo_recall), 6) AS placebo_recall, avg(rule_recall) > 0.99 AND avg(placebo_recall) > 0.99 AND abs(avg(rule_recall) - avg(placebo_recall)) < 0.01 AS saturated FROM cmp GROUP BY scope")
def l11(t: Tables):
    return r6(FA.saturated(FA.cell_comparison(scenario(t), "v", 1)), "rule_recall", "placebo_recall", keep=("scope", "saturated"))


@query("l12_secondary", "SELECT arm, effect, n, round(mean, 6) AS mean, round(p, 6) AS p, round(holm_p, 6) AS holm_p FROM eth")
def l12(t: Tables):
    return r6(FA.secondary(per_construction(t), FA.EFFECTS, ["arm"]), "mean", "p", "holm_p", keep=("arm", "effect", "n"))


CTES["grd"] = "SELECT arm, effect, construction, seed, value, avg(value) OVER (PARTITION BY arm, effect) AS g, avg(value) OVER (PARTITION BY arm, effect, construction) AS r, avg(value) OVER (PARTITION BY arm, effect, seed) AS c FROM efp"


@query("l13_crossed_dispersion", "SELECT arm, effect, count(*) AS cells, round(sum((r - g) * (r - g)), 8) AS ss_row, round(sum((c - g) * (c - g)), 8) AS ss_col, round(sum((value - r - c + g) * (value - r - c + g)), 8) AS ss_interaction, round(sum((value - g) * (value - g)), 8) AS ss_total, round(sum((r - g) * (r - g)) / sum((value - g) * (value - g)), 6) AS share_row FROM grd GROUP BY ALL")
def l13(t: Tables):
    per, _ = FA.effects(deltas(t))
    d = FA.crossed_dispersion(per, ["arm", "effect"], "construction", "seed", "value")
    return d.select("arm", "effect", "cells", *[F.round(c, 8).alias(c) for c in ("ss_row", "ss_col", "ss_interaction", "ss_total")], F.round("share_row", 6).alias("share_row"))


@query("l14_t_summary", f"SELECT arm, effect, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round({p4('t')}, 6) AS p, degenerate FROM ets")
def l14(t: Tables):
    d = FA.t_summary(per_construction(t), ["arm", "effect"])
    return r6(d, "mean", "sd", "ci_low", "ci_high", "p", keep=("arm", "effect", "n", "degenerate"))


_ADL_ATT = CTES["adl"].replace("FROM scn GROUP BY ALL", "FROM scn WHERE attack = '{a}' GROUP BY ALL").replace("WHERE arm = 'real' GROUP", "WHERE arm = 'real' AND attack = '{a}' GROUP")
CTES["adg"], CTES["adr"] = _ADL_ATT.format(a="gear"), _ADL_ATT.format(a="rpm")
CTES["het"] = f"""SELECT g.arm, g.effect, g.v AS gear, r.v AS rpm, g.v * r.v < 0 AS opposed FROM (SELECT arm, effect, avg(value) AS v FROM ({_eff_sql('adg', 'arm, construction, seed', 'delta')}) GROUP BY ALL) g
JOIN (SELECT arm, effect, avg(value) AS v FROM ({_eff_sql('adr', 'arm, construction, seed', 'delta')}) GROUP BY ALL) r ON g.arm = r.arm AND g.effect = r.effect"""


def attack_effects(t: Tables):
    def build():
        parts = []
        for a in ("gear", "rpm"):
            _, per = FA.effects(FA.augmentation_delta(scenario(t), "v", attack=a))
            parts.append(per.withColumn("attack", F.lit(a)))
        return parts[0].unionByName(parts[1])

    return t.stored("attack_effects", build)


@query("l15_verdict", """WITH r AS (SELECT *, NOT degenerate AND holm_p < 0.6 AND ((mean > 0 AND pos >= 3) OR (mean < 0 AND neg >= 3)) AS res FROM eth), o AS (SELECT DISTINCT arm FROM het WHERE opposed)
SELECT arm, CASE WHEN bool_or(holm_p < 0.05 AND ((mean > 0 AND pos >= 4) OR (mean < 0 AND neg >= 4)) AND length(effect) = 1) THEN 'F-MAIN' WHEN bool_or(holm_p < 0.05 AND ((mean > 0 AND pos >= 4) OR (mean < 0 AND neg >= 4))) THEN 'F-INTERACTION' WHEN bool_or(holm_p < 0.05) THEN 'F-MIXED' ELSE 'F-UNRESOLVED' END
 || CASE WHEN arm IN (SELECT arm FROM o) THEN '+attack-heterogeneous' ELSE '' END AS verdict FROM r GROUP BY arm""")
def l15(t: Tables):
    e = FA.secondary(per_construction(t), FA.EFFECTS, ["arm"])
    het = FA.heterogeneous(attack_effects(t), ["arm"])
    return FA.verdict(e, ["arm"], het.where("opposed"))


@query("l16_heterogeneous", "SELECT arm, effect, round(gear, 6) AS gear, round(rpm, 6) AS rpm, opposed FROM het")
def l16(t: Tables):
    return r6(FA.heterogeneous(attack_effects(t), ["arm"]), "gear", "rpm", keep=("arm", "effect", "opposed"))


@query("l17_budget_class", """SELECT a.effect, CASE WHEN b.mean = 0 THEN 'budget-direction-unresolved-zero' WHEN a.mean = 0 OR a.mean * b.mean < 0 OR (a.mean > 0 AND b.hi < 0) OR (a.mean < 0 AND b.lo > 0) THEN 'budget-discordant'
 WHEN (a.mean > 0 AND b.mean > 0 AND b.lo > 0) OR (a.mean < 0 AND b.mean < 0 AND b.hi < 0) THEN 'budget-stable' ELSE 'directionally-concordant-unresolved' END AS budget FROM ets a JOIN ets b USING (effect) WHERE a.arm = 'rule' AND b.arm = 'placebo'""")
def l17(t: Tables):
    s = FA.t_summary(per_construction(t), ["arm", "effect"])
    a = s.where("arm = 'rule'").select("effect", F.col("mean").alias("pm"))
    b = s.where("arm = 'placebo'").select("effect", F.col("mean").alias("lm"), "ci_low", "ci_high")
    return a.join(b, "effect").select("effect", FA.budget_class(F.col("pm"), F.col("lm"), F.col("ci_low"), F.col("ci_high")).alias("budget"))


CTES["fam2"] = "SELECT construction, effect, max(value) FILTER (arm = 'rule') AS a, max(value) FILTER (arm = 'placebo') AS b FROM efc GROUP BY ALL"


@query("l18_family_comparison", """WITH r AS (SELECT *, rank() OVER (PARTITION BY effect ORDER BY a) AS ra, rank() OVER (PARTITION BY effect ORDER BY b) AS rb FROM fam2)
SELECT effect, count(*) AS n, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_sd, round(avg(b - a), 6) AS difference, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman FROM r GROUP BY effect""")
def l18(t: Tables):
    e = per_construction(t)
    side = lambda a: e.where(F.col("arm") == a).select("construction", "effect", F.col("value").alias("theta"))
    d = FA.family_comparison(side("rule"), side("placebo"), ["effect"])
    return d.select("effect", "n", F.round("a_mean", 6).alias("a_mean"), F.round("a_sd", 6).alias("a_sd"), F.round("difference", 6).alias("difference"), F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


CTES["rel"] = "SELECT construction, seed, block, attack, arm, CASE s WHEN 0 THEN 'intact' ELSE 'broken' END AS relation, (p * 2 + d + 1) * 2 AS k, avg(v) AS v FROM scn WHERE arm <> 'real' GROUP BY ALL"
CTES["url"] = """SELECT construction, avg(ri - pi) AS u, avg((ri - rb) - (pi - pb)) AS l FROM (SELECT construction, seed, avg(v) FILTER (arm = 'rule' AND relation = 'intact') AS ri, avg(v) FILTER (arm = 'rule' AND relation = 'broken') AS rb,
 avg(v) FILTER (arm = 'placebo' AND relation = 'intact') AS pi, avg(v) FILTER (arm = 'placebo' AND relation = 'broken') AS pb FROM rel GROUP BY ALL) GROUP BY construction"""


def relation_rows(t: Tables):
    rel = F.when(F.col("s") == 0, "intact").otherwise("broken")
    k = ((F.col("p") * 2 + F.col("d") + 1) * 2).alias("k")
    return scenario(t).where("arm <> 'real'").groupBy("construction", "seed", "block", "attack", "arm", rel.alias("relation"), k).agg(F.avg("v").alias("v"))


T4_9875 = 3.4954059325  # Student-t 0.9875 quantile at 4 degrees of freedom


@query("l19_utility_reliance", f"SELECT 'U' AS endpoint, count(*) AS n, round(avg(u), 6) AS mean, round(avg(u) - {T4_9875}::DOUBLE * stddev_samp(u) / sqrt(5), 5) AS ci_low FROM url UNION ALL SELECT 'L', count(*), round(avg(l), 6), round(avg(l) - {T4_9875}::DOUBLE * stddev_samp(l) / sqrt(5), 5) FROM url")
def l19(t: Tables):
    _, d = FA.utility_reliance(relation_rows(t), "v")
    return d.select("endpoint", "n", F.round("mean", 6).alias("mean"), F.round("ci_low", 5).alias("ci_low"))


@query("l20_fpr_units", "WITH p AS (SELECT construction, seed, avg(hits / n) FILTER (arm = 'rule') AS r, avg(hits / n) FILTER (arm = 'placebo') AS q FROM scn WHERE arm <> 'real' GROUP BY ALL) SELECT construction, round(avg(r), 6) AS rule, round(avg(q), 6) AS placebo, round(avg(r - q), 6) AS delta FROM p GROUP BY construction")
def l20(t: Tables):
    return r6(FA.fpr_units(scenario(t).where("arm <> 'real'"), "hits", "n"), "rule", "placebo", "delta", keep=("construction",))


@query("l21_recovery", f"SELECT count(*) AS n, round(avg(u), 6) AS mean, round(0.4::DOUBLE * 0.5, 6) AS minimum_mean, avg(u) - {T4}::DOUBLE * stddev_samp(u) / sqrt(5) > 0 AND avg(u) >= 0.2 AS recovered FROM url")
def l21(t: Tables):
    u, _ = FA.utility_reliance(relation_rows(t), "v")
    d = FA.recovery(u.withColumn("g", F.lit(1)), ["g"])
    return r6(d, "mean", "minimum_mean", keep=("n", "recovered"))


@query("l22_band_verdict", "SELECT arm, effect, CASE WHEN lo > 0.002 THEN CASE WHEN mean > 0.01 THEN 'S+' ELSE 'S+asym' END WHEN hi < -0.002 THEN 'S-' WHEN lo > -0.002 AND hi < 0.002 THEN 'S0' ELSE 'SX' END AS band FROM ets")
def l22(t: Tables):
    s = FA.t_summary(per_construction(t), ["arm", "effect"])
    return s.select("arm", "effect", FA.band_verdict(F.col("ci_low"), F.col("ci_high"), F.lit(0.002), F.col("mean") - 0.01).alias("band"))


CTES["spk"] = """SELECT arm, construction, k, avg(v) FILTER (relation = 'intact') AS i, avg(v) FILTER (relation = 'broken') AS b FROM (SELECT arm, construction, seed, k, relation, avg(v) AS v FROM (SELECT arm, construction, seed, block, k, relation, avg(v) AS v FROM rel GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""
CTES["spq"] = """SELECT arm, k, unnest(['intact', 'broken', 'difference']) AS quantity, unnest([i, b, i - b]) AS x FROM spk UNION ALL
SELECT 'rule_minus_placebo', r.k, 'theta', (r.i - r.b) - (q.i - q.b) FROM spk r JOIN spk q USING (construction, k) WHERE r.arm = 'rule' AND q.arm = 'placebo'"""


@query("l23_sparse_curves", f"SELECT arm, k::BIGINT AS k, quantity, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) - {T4_90}::DOUBLE * stddev_samp(x) / sqrt(5), 6) AS lo90, round(avg(x) + {T4}::DOUBLE * stddev_samp(x) / sqrt(5), 6) AS hi95 FROM spq GROUP BY ALL")
def l23(t: Tables):
    d = FA.sparse_curves(relation_rows(t), "v")
    return r6(d, "mean", "lo90", "hi95", keep=("arm", F.col("k").cast("long").alias("k"), "quantity", "n"))


def _p3(t):
    """Two-sided p at 3 degrees of freedom."""
    return f"(1 - 2 / pi() * (atan(abs({t}) / sqrt(3)) + abs({t}) / sqrt(3.0) / (1 + {t} * {t} / 3.0::DOUBLE)))"


CTES["hsc"] = "SELECT arm, effect, unnest(CASE WHEN construction = 0 THEN ['anchor_inclusive', 'construction_0'] ELSE ['new', 'anchor_inclusive', 'construction_' || construction] END) AS scope, value FROM efc"
CTES["hst"] = f"SELECT *, CASE WHEN scope = 'new' THEN {_p3('(mean / (sd / sqrt(n)))')} END AS p FROM (SELECT arm, effect, scope, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM hsc GROUP BY ALL)"


@query("l24_hierarchical", """WITH h AS (SELECT arm, effect, least(1.0, max(a) OVER (PARTITION BY arm ORDER BY p, effect)) AS holm_p FROM (SELECT *, (8 - row_number() OVER (PARTITION BY arm ORDER BY p, effect)) * p AS a FROM hst WHERE scope = 'new'))
SELECT t.arm, t.effect, t.scope, n, round(mean, 6) AS mean, round(p, 6) AS p, round(CASE WHEN t.scope = 'new' THEN holm_p END, 6) AS holm_p FROM hst t JOIN h USING (arm, effect)""")
def l24(t: Tables):
    d = FA.hierarchical(per_construction(t), ["arm"], 0)
    return r6(d, "mean", "p", "holm_p", keep=("arm", "effect", "scope", "n"))


@query("l25_l2_summary", f"""WITH c AS (SELECT attack, arm, construction, seed, avg(v) AS v FROM scn GROUP BY ALL), u AS (SELECT c.attack, c.arm, c.construction, avg(c.v - r.v) AS x FROM c JOIN (SELECT attack, seed, v FROM c WHERE arm = 'real') r USING (attack, seed) WHERE c.arm <> 'real' GROUP BY ALL)
SELECT attack, arm, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(avg(x) - {T4}::DOUBLE * stddev_samp(x) / sqrt(5), 6) AS ci_low FROM u GROUP BY ALL""")
def l25(t: Tables):
    return r6(FA.l2_summary(scenario(t), ["attack"], "v"), "mean", "sd", "ci_low", keep=("attack", "arm", "n"))


@query("l26_findings", """WITH r AS (SELECT arm, effect, sign(mean)::BIGINT AS sg, NOT degenerate AND holm_p < 0.05 AND ((mean > 0 AND pos >= 4) OR (mean < 0 AND neg >= 4)) AS res FROM eth),
pc AS (SELECT p.effect, count(*) FILTER (sign(v) = sg) AS same FROM (SELECT effect, seed, avg(value) AS v FROM efp WHERE arm = 'rule' GROUP BY ALL) p JOIN r ON r.effect = p.effect AND r.arm = 'rule' GROUP BY p.effect)
SELECT e.effect, e.sg AS exact_sign, b.sg AS binary_sign, e.res AS exact_resolved, b.res AS binary_resolved, e.sg <> 0 AND same >= 4 AS pipelines_agree, e.res AND NOT (e.sg <> 0 AND same >= 4) AS pipelines_differ, h.opposed AND e.res AS attacks_oppose,
 CASE WHEN e.res AND b.res AND e.sg = b.sg THEN 'endpoint-directionally-concordant' WHEN e.res AND b.res AND e.sg = -b.sg THEN 'endpoint-discordant' WHEN e.res THEN 'exact-only' WHEN b.res THEN 'binary-only' ELSE 'neither-endpoint-resolved' END AS endpoint_relation
FROM r e JOIN r b ON e.effect = b.effect AND b.arm = 'placebo' JOIN pc ON pc.effect = e.effect JOIN het h ON h.effect = e.effect AND h.arm = 'rule' WHERE e.arm = 'rule'""")
def l26(t: Tables):
    per, unit = FA.effects(deltas(t))
    e = FA.secondary(unit, FA.EFFECTS, ["arm"])
    pipes = per.where("arm = 'rule'").groupBy("effect", "seed").agg(F.avg("value").alias("value"))
    att = attack_effects(t).where("arm = 'rule'").groupBy("effect", "attack").agg(F.avg("value").alias("mean"))
    d = FA.findings(e.where("arm = 'rule'"), e.where("arm = 'placebo'"), pipes, att)
    return d.withColumn("exact_sign", F.col("exact_sign").cast("long")).withColumn("binary_sign", F.col("binary_sign").cast("long"))
