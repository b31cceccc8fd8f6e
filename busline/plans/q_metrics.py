"""Queries for detectors and metrics (sections I and J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import augment as A
from busline.operators import detect as DE
from busline.operators import metrics as ME
from busline.operators import profile as P
from busline.operators import timeline as TL
from busline.operators import windows as WN
from busline.plans.q_augment import cycled_pool, pool_frames
from busline.plans.q_profile import _BYTE_LIST, _cnt, _js_sql, _w1_sql, r6, unit_windows
from busline.plans.registry import query
from busline.plans.views import CTES, Tables

SRC = ["source_file"]

CTES["sp"] = "SELECT *, (score >= 0.5)::INT AS pred FROM sc"
_ZK = ", ".join(f"((part * {k + 3} + unit * {2 * k + 1}) % 97) / 10.0::DOUBLE - 4 AS z{k}" for k in range(5))
CTES["lg"] = f"SELECT *, order_id % 5 AS y_class, CASE unit % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, {_ZK} FROM sc"
_MX = "greatest(z0, z1, z2, z3, z4)"
_SE = "(" + " + ".join(f"exp(z{k} - {_MX})" for k in range(5)) + ")"
CTES["pb"] = (
    f"SELECT *, {', '.join(f'exp(z{k} - {_MX}) / {_SE} AS p{k}' for k in range(5))}, "
    f"CASE WHEN z0 = {_MX} THEN 0 WHEN z1 = {_MX} THEN 1 WHEN z2 = {_MX} THEN 2 WHEN z3 = {_MX} THEN 3 ELSE 4 END AS pred_class, {_MX} AS zmax, {_SE} AS zsum FROM lg"
)


def scored(t: Tables):
    return t.scores.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def logits(t: Tables):
    z = F.array(*[((F.col("part") * (k + 3) + F.col("unit") * (2 * k + 1)) % 97) / 10.0 - 4 for k in range(5)])
    sev = F.when(F.col("unit") % 3 == 0, "low").when(F.col("unit") % 3 == 1, "medium").otherwise("high")
    d = t.scores.select("*", (F.col("order_id") % 5).alias("y_class"), sev.alias("severity"), z.alias("logits")).drop("score")
    return DE.with_scores(d.withColumn("probs", DE.softmax(F.col("logits"))))


# ---- I ---------------------------------------------------------------------------------

CTES["wlist"] = """SELECT source_file, start_index, sum((can_id NOT IN (SELECT can_id FROM sg WHERE binary_label_id = 0 AND split = 'train'))::INT)::BIGINT AS unknown_frames FROM wf GROUP BY ALL"""


@query("i1_whitelist", "SELECT source_file, start_index, unknown_frames, (unknown_frames > 0)::INT::BIGINT AS pred FROM wlist")
def i1(t: Tables):
    ids = DE.normal_ids(t.split.where("split = 'train'"))
    d = DE.detect_whitelist(t.frames, ids, SRC)
    return d.withColumn("pred", F.col("pred").cast("long"))


@query("i2_entropy_band", """
WITH b AS (SELECT quantile_cont(entropy, 0.1) AS lo, quantile_cont(entropy, 0.9) AS hi FROM ent JOIN wl USING (source_file, start_index) WHERE y_binary = 0)
SELECT source_file, start_index, (entropy < lo OR entropy > hi)::INT::BIGINT AS pred FROM ent, b""")
def i2(t: Tables):
    e = WN.window_id_entropy(t.frames, SRC).withColumn("entropy", F.round("entropy", 12))
    band = DE.fit_entropy(e.join(t.labels_w.where("y_binary = 0"), ["source_file", "start_index"]), 0.1, 0.9)
    d = DE.detect_entropy(e, band)
    return d.select("source_file", "start_index", F.col("pred").cast("long").alias("pred"))


@query("i3_interval_rule", """
WITH p AS (SELECT can_id, quantile_cont(gap, 0.5) FILTER (gap > 0 AND gap < 400000) AS med FROM (SELECT can_id, timestamp - lag(timestamp) OVER (PARTITION BY source_file, can_id ORDER BY idx) AS gap FROM sg WHERE binary_label_id = 0 AND split = 'train') GROUP BY can_id),
c AS (SELECT DISTINCT source_file, start_index, can_id FROM wf)
SELECT source_file, start_index, max(coalesce(gaps >= 2 AND mean_gap < med * 0.5, false)::INT)::BIGINT AS pred_ignore_unseen,
 max((coalesce(gaps >= 2 AND mean_gap < med * 0.5, false) OR p.can_id IS NULL)::INT)::BIGINT AS pred_unseen_attack
FROM c LEFT JOIN iv USING (source_file, start_index, can_id) LEFT JOIN p ON p.can_id = c.can_id GROUP BY ALL""")
def i3(t: Tables):
    prof = TL.timing_profile(t.split.where("split = 'train'"), 400000.0)
    d = DE.detect_timing(WN.window_id_intervals(t.frames, SRC), WN.window_id_counts(t.frames, SRC), prof, ["source_file", "start_index"], min_gaps=2)
    return d.select("source_file", "start_index", *[F.col(c).cast("long").alias(c) for c in ("pred_ignore_unseen", "pred_unseen_attack")])


def features(t: Tables):
    """Window features with labels: stage table for the forests."""
    def build():
        f = WN.window_features(t.frames, SRC)
        f = f.join(t.labels_w, ["source_file", "start_index"])
        return f.withColumn("wkey", A.window_key("source_file", "start_index"))

    return t.stored("features", build)


def pool_features(t: Tables):
    def build():
        f = pool_frames(cycled_pool(t)).withColumnRenamed("pos", "idx")
        d = WN.window_features(f, ["wkey", "y_attack_type"], stride=32)
        return d.withColumn("wkey", F.concat("wkey", F.lit("|syn")))

    return t.stored("pool_features", build)


@query("i4_forest")
def i4(t: Tables):
    f = features(t)
    corr = WN.payload_correlations(t.frames, SRC)
    f = f.join(corr, ["source_file", "start_index"])
    m = DE.fit_forest(f, WN.FEATURES + WN.CORRELATIONS, "y_attack_type")
    s = DE.score_forest(f, m)
    return s.groupBy("y_attack_type", "pred_class").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 4).alias("score"))


@query("i5_discriminator")
def i5(t: Tables):
    auc, s = DE.discriminator(features(t), pool_features(t), WN.FEATURES, "wkey")
    return s.groupBy("y_attack_type").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 4).alias("score")).withColumn("auc", F.round(auc.scalar(), 4))


@query("i5_domain_audit")
def i5_audit(t: Tables):
    real = features(t).withColumn("end_index", F.col("start_index") + 127)
    classes = (1, 2, 3)  # those that the cycled pool has
    return DE.domain_audit(real, pool_features(t), WN.FEATURES, SRC, "wkey", 256, classes=classes).withColumn("auc", F.round("auc", 4))


@query("i6_condition_agreement")
def i6(t: Tables):
    d = DE.condition_agreement(features(t), pool_features(t), WN.FEATURES)
    return d.withColumn("agreement", F.round("agreement", 4))


@query("i7_transfer_matrix")
def i7(t: Tables):
    f = features(t).withColumn("y", F.col("y_binary"))
    doms = {"a": f.where("source_file IN ('src_0', 'src_1')"), "b": f.where("source_file IN ('src_2', 'src_3')")}
    models = {k: DE.fit_forest(d, WN.FEATURES, "y") for k, d in doms.items()}
    return DE.transfer_matrix(models, doms)


@query("i8_scores", "SELECT y_class::BIGINT AS y_class, count(*) AS n, round(avg(1 - p0), 6) AS score, sum(pred_class)::BIGINT AS preds, round(avg(-zmax), 6) AS maxlogit, round(avg(-(zmax + ln(zsum))), 6) AS energy, round(avg(greatest(z1, z2, z3, z4) - z0), 6) AS margin FROM pb GROUP BY y_class")
def i8(t: Tables):
    g = logits(t).groupBy("y_class").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.sum("pred_class").alias("preds"), F.avg("maxlogit").alias("maxlogit"), F.avg("energy").alias("energy"), F.avg("margin").alias("margin"))
    return r6(g, "score", "maxlogit", "energy", "margin", keep=("y_class", "n", "preds"))


def quality_frames(t: Tables):
    """Frames of real attack windows and of the cycled pool."""
    real = t.wf.join(t.labels_w.where("y_binary = 1").select("source_file", "start_index"), ["source_file", "start_index"])
    real = real.withColumn("wkey", A.window_key("source_file", "start_index"))
    return real, pool_frames(cycled_pool(t))


@query("e21_synthetic_quality")
def e21(t: Tables):
    real, syn = quality_frames(t)
    auc, _ = DE.discriminator(features(t).where("y_binary = 1"), pool_features(t), WN.FEATURES, "wkey")
    d = P.synthetic_quality(real, syn, auc, ["wkey"], dt_edges=_QDT)
    return d.select(*[F.round(c, 5).alias(c) if k == "double" else c for c, k in d.dtypes])


_QDT = [0, 60, 120, 300, 600, 1200, 3600, 1e9]
# Frames of real attack windows and of the cycled pool, in the shape of ``dom``.
CTES["qd"] = "SELECT 'a' AS domain, source_file || ':' || start_index AS wkey, can_id::DOUBLE AS can_id, delta_t, " + ", ".join(f"data{i}::DOUBLE AS data{i}" for i in range(8)) + """
 FROM wf JOIN wl USING (source_file, start_index) WHERE y_binary = 1 UNION ALL SELECT 'b', wkey, can_id, delta_t, """ + ", ".join(f"data{i}" for i in range(8)) + " FROM pl"
CTES["qb"] = f"SELECT domain, {_BYTE_LIST} AS v FROM qd"


def _smooth_entropy(col, src, side, bins):
    return f"""(SELECT -sum(q * log2(q)) - any_value({bins} - k) * ((1e-12 / (1 + {bins} * 1e-12)) * log2(1e-12 / (1 + {bins} * 1e-12))) FROM (
 SELECT (n / sum(n) OVER () + 1e-12) / (1 + {bins} * 1e-12) AS q, count(*) OVER () AS k FROM (SELECT {col}, count(*) AS n FROM {src} WHERE domain = '{side}' GROUP BY {col})))"""


_QBIN = "(SELECT count(*) FROM (SELECT unnest([" + ", ".join(map(str, _QDT[1:-1])) + "]) AS e) WHERE e <= delta_t)"


@query("e21_quality_counts", f"""SELECT (SELECT count(DISTINCT wkey) FROM qd WHERE domain = 'a') AS real_windows, (SELECT count(DISTINCT wkey) FROM qd WHERE domain = 'b') AS synthetic_windows,
 round({_js_sql(_cnt("can_id", "qd"), 1e-12, 2049)}, 5) AS can_id_js, round({_js_sql(_cnt("v", "qb"), 1e-12, 257)}, 5) AS payload_js,
 round({_js_sql(_cnt("b", f"(SELECT domain, {_QBIN} AS b FROM qd WHERE delta_t BETWEEN 0 AND 1e9)"), 1e-12, len(_QDT) - 1)}, 5) AS delta_t_js,
 round({_w1_sql("can_id").replace("FROM dom ", "FROM qd ")}, 5) AS can_id_wasserstein, round({_w1_sql("v").replace("FROM dom ", "FROM qb ")}, 5) AS payload_wasserstein,
 round({_smooth_entropy("can_id", "qd", "a", 2049)}, 5) AS real_can_id_entropy, round({_smooth_entropy("v", "qb", "b", 257)}, 5) AS synthetic_payload_entropy,
 round((SELECT avg(delta_t) FROM qd WHERE domain = 'a'), 4) AS real_delta_t_mean, round((SELECT avg(delta_t) FROM qd WHERE domain = 'b'), 4) AS synthetic_delta_t_mean""")
def e21_counts(t: Tables):
    """The part of the quality row that needs no forest."""
    real, syn = quality_frames(t)
    none = t.spark.createDataFrame([(None,)], "auc double")
    d = P.synthetic_quality(real, syn, none, ["wkey"], dt_edges=_QDT)
    five = ["can_id_js", "payload_js", "delta_t_js", "can_id_wasserstein", "payload_wasserstein", "real_can_id_entropy", "synthetic_payload_entropy"]
    return d.select("real_windows", "synthetic_windows", *[F.round(c, 5).alias(c) for c in five], *[F.round(c, 4).alias(c) for c in ("real_delta_t_mean", "synthetic_delta_t_mean")])


# ---- J ---------------------------------------------------------------------------------

_CONF = "count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"


@query("j1_confusion", f"SELECT setting, seed::BIGINT AS seed, {_CONF} FROM sp GROUP BY ALL")
def j1(t: Tables):
    return ME.confusion(scored(t), ["setting", F.col("seed").cast("long").alias("seed")])


CTES["cu"] = f"SELECT unit, {_CONF} FROM sp WHERE (unit % 10 <> 3 OR y = 0) AND (unit % 10 <> 4 OR y = 1) GROUP BY unit"
CTES["mu"] = """SELECT *, tn + fp AS normal_windows, fn + tp AS attack_windows, (tn + tp) / (tn + fp + fn + tp) AS accuracy,
 (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT) AS macro_f1,
 tp / nullif(tp + fn, 0) AS attack_recall, tn / nullif(tn + fp, 0) AS normal_recall, fp / nullif(tn + fp, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr FROM cu"""
_RATES = ("accuracy", "macro_f1", "attack_recall", "normal_recall", "fpr", "fnr")


def units(t: Tables):
    return ME.confusion(scored(t).where("(unit % 10 <> 3 OR y = 0) AND (unit % 10 <> 4 OR y = 1)"), ["unit"])


@query("j2_binary_metrics", "SELECT unit, tn, fp, fn, tp, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + " FROM mu")
def j2(t: Tables):
    return r6(ME.binary_metrics(units(t)), *_RATES, keep=("unit", "tn", "fp", "fn", "tp"))


@query("j3_class_recall", "SELECT setting, y_class, count(*) AS windows, round(avg((pred_class = y_class)::INT), 6) AS exact_recall, round(avg((pred_class > 0)::INT), 6) AS detection_recall FROM pb WHERE y_class > 0 GROUP BY ALL")
def j3(t: Tables):
    return r6(ME.class_recall(logits(t), ["setting"]), "exact_recall", "detection_recall", keep=("setting", "y_class", "windows"))


def _auc_sql(src, by):
    return f"""SELECT {by}, (sum(r) FILTER (y = 1) - any_value(np) * (any_value(np) + 1) / 2.0) / nullif(any_value(np) * any_value(nn), 0) AS auc FROM (
 SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY {by})::DOUBLE AS np, sum(1 - y) OVER (PARTITION BY {by})::DOUBLE AS nn FROM {src}) GROUP BY {by}"""


@query("j4_roc_auc", f"SELECT unit, round(auc, 6) AS auc FROM ({_auc_sql('sc', 'unit')})")
def j4(t: Tables):
    return r6(ME.roc_auc(t.scores, ["unit"]), "auc", keep=("unit",))


CTES["tie"] = "SELECT seed, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY ALL"
CTES["crv"] = """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY seed) AS np, sum(neg) OVER (PARTITION BY seed) AS nn FROM tie WINDOW w AS (PARTITION BY seed ORDER BY score DESC)"""


@query("j5_avg_precision", "SELECT seed::BIGINT AS seed, round(sum(tp / (tp + fp) * pos / np), 6) AS ap FROM crv GROUP BY seed")
def j5(t: Tables):
    return r6(ME.avg_precision(t.scores, ["seed"]), "ap", keep=(F.col("seed").cast("long").alias("seed"),))


@query("j6_curves", "SELECT seed::BIGINT AS seed, round(score, 6) AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM crv")
def j6(t: Tables):
    return r6(ME.curves(t.scores, ["seed"]), "score", "fpr", "tpr", "precision", keep=(F.col("seed").cast("long").alias("seed"), "tp", "fp"))


@query("j7_ece", """SELECT setting, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM (SELECT setting, count(*) AS n, avg(((score >= 0.5)::INT = y)::INT) AS a, avg(greatest(score, 1 - score)) AS c FROM sc
 GROUP BY setting, greatest(ceil(greatest(score, 1 - score) * 15), 1)) GROUP BY setting""")
def j7(t: Tables):
    return r6(ME.ece(t.scores, ["setting"]), "ece", keep=("setting",))


_QS = {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}


@query("j8_score_summary", "SELECT setting, seed::BIGINT AS seed, count(*) AS windows, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(avg((score >= 0.5)::INT), 6) AS share_ge_50, round(avg((score >= 0.9)::INT), 6) AS share_ge_90, round(avg((score >= 0.99)::INT), 6) AS share_ge_99, "
       + ", ".join(f"round(quantile_cont(score, {p}), 6) AS {n}" for n, p in _QS.items()) + " FROM sc GROUP BY ALL")
def j8(t: Tables):
    d = ME.score_summary(t.scores.withColumn("seed", F.col("seed").cast("long")), ["setting", "seed"])
    return r6(d, "mean", "max", "share_ge_50", "share_ge_90", "share_ge_99", *_QS, keep=("setting", "seed", "windows"))


@query("j9_score_hist", """WITH h AS (SELECT setting, least(floor(quantity / 50.0::DOUBLE * 1000) + 1, 1000) AS b, count(*) AS n FROM sc GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY setting ORDER BY b) AS cum, sum(n) OVER (PARTITION BY setting) AS t FROM h)
SELECT setting, any_value(t)::BIGINT AS scores, """ + ", ".join(f"round(min((b - 0.5) / 1000) FILTER (cum > greatest(0, least(t - 1, ceil({p}::DOUBLE * t) - 1))), 6) AS {n}" for n, p in {"p01": 0.01, "p50": 0.5, "p99": 0.99}.items()) + " FROM c GROUP BY setting")
def j9(t: Tables):
    d = t.scores.withColumn("score", F.col("quantity") / 50.0)
    return r6(ME.score_hist(d, ["setting"], {"p01": 0.01, "p50": 0.5, "p99": 0.99}), "p01", "p50", "p99", keep=("setting", "scores"))


@query("j10_threshold_higher", """WITH r AS (SELECT seed, score, row_number() OVER (PARTITION BY seed ORDER BY score) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM sc WHERE y = 0), h AS (SELECT seed, score AS thr FROM r WHERE rn = ceil((n - 1) * (1.0::DOUBLE - 0.05::DOUBLE)) + 1)
SELECT s.seed::BIGINT AS seed, round(thr, 6) AS threshold, count(*) FILTER (y = 0 AND score < thr) AS tn, count(*) FILTER (y = 0 AND score >= thr) AS fp, count(*) FILTER (y = 1 AND score < thr) AS fn, count(*) FILTER (y = 1 AND score >= thr) AS tp FROM sc s JOIN h USING (seed) GROUP BY s.seed, thr""")
def j10(t: Tables):
    thr = ME.threshold_higher(t.scores.where("y = 0"), 0.05, ["seed"])
    c = ME.confusion(ME.apply_threshold(t.scores, thr, ["seed"]), ["seed", "threshold"])
    return c.select(F.col("seed").cast("long").alias("seed"), F.round("threshold", 6).alias("threshold"), "tn", "fp", "fn", "tp")


@query("j11_threshold_linear", """WITH h AS (SELECT seed, quantile_cont(price, 1.0::DOUBLE - 0.01::DOUBLE) AS thr FROM sc WHERE y = 0 GROUP BY seed)
SELECT s.seed::BIGINT AS seed, round(thr, 4) AS threshold, round(avg((price > thr)::INT), 6) AS achieved FROM sc s JOIN h USING (seed) WHERE y = 0 GROUP BY s.seed, thr""")
def j11(t: Tables):
    d = ME.threshold_linear(t.scores.where("y = 0"), 0.01, ["seed"], "price")
    return d.select(F.col("seed").cast("long").alias("seed"), F.round("threshold", 4).alias("threshold"), F.round("achieved", 6).alias("achieved"))


def _low_sql(target):
    return f"""SELECT {target}::DOUBLE AS target, seed::BIGINT AS seed, floor({target}::DOUBLE * any_value(nn))::BIGINT AS allowed_fp, coalesce(arg_max(fp - neg, score) FILTER (bad), any_value(nn))::BIGINT AS achieved_fp,
 round(coalesce(arg_max(tp - pos, score) FILTER (bad), any_value(np)) / any_value(np), 6) AS tpr, round(max(score) FILTER (bad), 6) AS excluded_score, coalesce(arg_max(neg, score) FILTER (bad), 0)::BIGINT AS normal_ties,
 coalesce(nextafter(max(score) FILTER (bad), 'infinity'::DOUBLE), '-infinity'::DOUBLE) AS threshold, (floor({target}::DOUBLE * any_value(nn)) - coalesce(arg_max(fp - neg, score) FILTER (bad), any_value(nn)))::BIGINT AS unused_fp,
 max(score) FILTER (bad) IS NOT NULL AS tie_step_exceeds, CASE WHEN max(score) FILTER (bad) IS NULL THEN 'all_normals_included' WHEN arg_max(neg, score) FILTER (bad) > 1 OR arg_max(pos, score) FILTER (bad) > 0 THEN 'attainable_boundary_tie' ELSE 'attainable' END AS status
 FROM (SELECT *, fp > floor({target}::DOUBLE * nn) AND neg > 0 AS bad FROM crv) GROUP BY seed"""


@query("j12_low_fpr_point", f"{_low_sql(0.01)} UNION ALL {_low_sql(0.2)}")
def j12(t: Tables):
    d = ME.low_fpr_point(t.scores, (0.01, 0.2), ["seed"])
    return d.select("target", F.col("seed").cast("long").alias("seed"), F.col("allowed_fp").cast("long").alias("allowed_fp"), "achieved_fp", F.round("tpr", 6).alias("tpr"), F.round("excluded_score", 6).alias("excluded_score"), "normal_ties",
                    "threshold", F.col("unused_fp").cast("long").alias("unused_fp"), "tie_step_exceeds", "status")


@query("j13_best_f1", """WITH q AS (SELECT i, quantile_cont(price, i / 511.0::DOUBLE) AS thr FROM sc, (SELECT unnest(range(512)) AS i) GROUP BY i),
m AS (SELECT i, thr, 2 * count(*) FILTER (y = 1 AND price > thr) / nullif(count(*) FILTER (y = 1 AND price > thr) + count(*) FILTER (y = 0 AND price > thr) + count(*) FILTER (y = 1), 0) AS f1 FROM sc, q GROUP BY ALL)
SELECT round(thr, 4) AS threshold, round(f1, 6) AS f1 FROM m ORDER BY m.f1 DESC, i LIMIT 1""".replace("quantile_cont(price, i / 511.0::DOUBLE) AS thr FROM sc, (SELECT unnest(range(512)) AS i) GROUP BY i",
       "v AS thr FROM (SELECT unnest(range(512)) AS i, unnest(quantile_cont(price, [" + ", ".join(f"{i}/511.0" for i in range(512)) + "])) AS v FROM sc)"))
def j13(t: Tables):
    d = ME.best_f1(t.scores, score="price")
    return d.select(F.round("threshold", 4).alias("threshold"), F.round("f1", 6).alias("f1"))


CTES["prb"] = "SELECT seed, y, CASE unit % 4 WHEN 0 THEN 'calibration' WHEN 1 THEN 'ambient' ELSE 'attack' END AS role, score AS score_o, (price / 100000) AS score_r, (score >= 0.5)::INT AS pred_o, (price >= 50000)::INT AS pred_r FROM sc"


@query("j14_calibration_probe", """WITH q AS (SELECT seed, quantile_cont(score_o, 0.99) AS qo, quantile_cont(score_r, 0.99) AS qr FROM prb WHERE role = 'calibration' GROUP BY seed),
e AS (SELECT p.*, unnest(['original', 'threshold', 'refit', 'refit_threshold']) AS condition, unnest([pred_o, (score_o >= qo)::INT, pred_r, (score_r >= qr)::INT]) AS pred FROM prb p JOIN q USING (seed) WHERE role <> 'calibration')
SELECT seed::BIGINT AS seed, role, condition, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM e GROUP BY ALL""")
def j14(t: Tables):
    role = F.when(F.col("unit") % 4 == 0, "calibration").when(F.col("unit") % 4 == 1, "ambient").otherwise("attack")
    d = t.scores.select("seed", "y", role.alias("role"), F.col("score").alias("score_o"), (F.col("price") / 100000).alias("score_r"),
                        (F.col("score") >= 0.5).cast("int").alias("pred_o"), (F.col("price") >= 50000).cast("int").alias("pred_r"))
    p = ME.calibration_probe(d, ["seed"])
    return p.select(F.col("seed").cast("long").alias("seed"), "role", "condition", "tn", "fp", "fn", "tp")


CTES["sat"] = "SELECT seed, score, CASE WHEN unit % 4 = 0 THEN 'ambient' WHEN y = 1 THEN 'attack' ELSE 'attack_normal' END AS role FROM sc"


@query("j15_saturation", """WITH h AS (SELECT seed, quantile_cont(score, 0.9) AS thr, max(score) AS mx FROM sat WHERE role = 'ambient' GROUP BY seed),
a AS (""" + _auc_sql("(SELECT seed, score, (role = 'attack')::INT AS y FROM sat WHERE role <> 'attack_normal')", "seed") + """)
SELECT s.seed::BIGINT AS seed, round(any_value(mx), 6) AS ambient_max, round(avg((score = mx)::INT) FILTER (role = 'ambient'), 6) AS share_at_max, round(avg((score >= thr)::INT) FILTER (role = 'ambient'), 6) AS ambient_fpr,
 round(avg((score >= thr)::INT) FILTER (role = 'attack'), 6) AS attack_recall, round(avg((score >= thr)::INT) FILTER (role = 'attack_normal'), 6) AS attack_capture_fpr, round(any_value(auc), 6) AS auc FROM sat s JOIN h USING (seed) JOIN a USING (seed) GROUP BY s.seed""")
def j15(t: Tables):
    role = F.when(F.col("unit") % 4 == 0, "ambient").when(F.col("y") == 1, "attack").otherwise("attack_normal")
    d = t.scores.select(F.col("seed").cast("long").alias("seed"), "score", role.alias("role"))
    thr = ME.threshold_linear(d.where("role = 'ambient'"), 0.1, ["seed"])
    s = ME.saturation(d, ["seed"], thr)
    return r6(s, "ambient_max", "share_at_max", "ambient_fpr", "attack_recall", "attack_capture_fpr", "auc", keep=("seed",))


@query("j16_scenario_metrics", """SELECT family, severity, count(*) AS windows, round(avg((pred_class > 0)::INT) FILTER (y_class > 0), 6) AS detection_recall, round(avg((pred_class = y_class)::INT) FILTER (y_class > 0), 6) AS exact_recall,
 round(avg((pred_class = 0)::INT) FILTER (y_class = 0), 6) AS normal_recall, round(avg(1 - p0), 6) AS mean_score FROM pb GROUP BY ALL""")
def j16(t: Tables):
    return r6(ME.scenario_metrics(logits(t), ["family", "severity"]), "detection_recall", "exact_recall", "normal_recall", "mean_score", keep=("family", "severity", "windows"))


@query("j17_granular_recall", """SELECT CASE grouping_id(severity, family, setting) WHEN 7 THEN 'overall' WHEN 3 THEN 'severity' WHEN 5 THEN 'family' ELSE 'setting' END AS granularity, coalesce(severity, family, setting, 'all') AS value,
 count(*) AS windows, round(avg((pred_class = y_class)::INT), 6) AS exact_recall, round(avg((pred_class > 0)::INT), 6) AS detection_recall FROM pb WHERE y_class > 0 GROUP BY GROUPING SETS ((), (severity), (family), (setting))""")
def j17(t: Tables):
    return r6(ME.granular_recall(logits(t), ["severity", "family", "setting"]), "exact_recall", "detection_recall", keep=("granularity", "value", "windows"))


@query("j18_axis_metrics", f"""WITH u AS (SELECT *, (score >= 0.5)::INT AS pred FROM unitw)
SELECT setting, CASE WHEN subset_id IS NOT NULL THEN 'subset_id' WHEN vehicle_axis IS NOT NULL THEN 'vehicle_axis' WHEN attack_axis IS NOT NULL THEN 'attack_axis' WHEN source_stem IS NOT NULL THEN 'source_stem' ELSE 'summary' END AS axis,
 coalesce(subset_id, vehicle_axis, attack_axis, source_stem, 'all') AS value, {_CONF} FROM u GROUP BY GROUPING SETS ((setting), (setting, subset_id), (setting, vehicle_axis), (setting, attack_axis), (setting, source_stem))""")
def j18(t: Tables):
    d = unit_windows(t).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return ME.axis_metrics(d, ["setting"], ["subset_id", "vehicle_axis", "attack_axis", "source_stem"]).select("setting", "axis", "value", "tn", "fp", "fn", "tp")


_UM = ["pooled_fpr", "pooled_recall", "macro_fpr", "fpr_sd", "fpr_min", "fpr_max", "macro_recall", "recall_sd", "recall_min", "recall_max", "share_fpr_ge_99"]


@query("j19_unit_macro", """SELECT unit % 7 AS grp, count(*) AS units, count(fpr) AS units_with_normals, count(attack_recall) AS units_with_attacks, round(sum(fp) / sum(normal_windows), 6) AS pooled_fpr, round(sum(tp) / sum(attack_windows), 6) AS pooled_recall,
 round(avg(fpr), 6) AS macro_fpr, round(stddev_samp(fpr), 6) AS fpr_sd, round(min(fpr), 6) AS fpr_min, round(max(fpr), 6) AS fpr_max, round(avg(attack_recall), 6) AS macro_recall, round(stddev_samp(attack_recall), 6) AS recall_sd,
 round(min(attack_recall), 6) AS recall_min, round(max(attack_recall), 6) AS recall_max, round(avg((fpr >= 0.99)::INT), 6) AS share_fpr_ge_99 FROM mu GROUP BY grp""")
def j19(t: Tables):
    d = ME.unit_macro(units(t).withColumn("grp", F.col("unit") % 7), ["grp"])
    return r6(d, *_UM, keep=("grp", "units", "units_with_normals", "units_with_attacks"))


@query("j20_boundary_metrics", """SELECT setting, count(*) AS windows, round(avg((greatest(p0, p1, p2, p3, p4) < 0.6)::INT), 6) AS low_confidence, round(avg((pred_class <> y_class)::INT), 6) AS misassigned,
 round(avg(CASE y_class WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END), 6) AS true_probability, round(avg(greatest(p0, p1, p2, p3, p4)), 6) AS max_probability FROM pb GROUP BY setting""")
def j20(t: Tables):
    return r6(ME.boundary_metrics(logits(t), ["setting"]), "low_confidence", "misassigned", "true_probability", "max_probability", keep=("setting", "windows"))


@query("j21_confusion_matrix", "SELECT y_class, " + ", ".join(f"count(*) FILTER (pred_class = {k}) AS pred_{k}" for k in range(5)) + ", " + ", ".join(f"round(count(*) FILTER (pred_class = {k}) / count(*), 6) AS share_{k}" for k in range(5)) + " FROM pb GROUP BY y_class")
def j21(t: Tables):
    d = ME.confusion_matrix(logits(t), list(range(5)))
    return r6(d, *[f"share_{k}" for k in range(5)], keep=("y_class", *[f"pred_{k}" for k in range(5)]))


@query("j22_prob_superiority", """WITH b AS (SELECT seed, score AS da, tax * 10 AS db, price AS cl FROM sc), m AS (SELECT seed, quantile_cont(cl, 0.5) AS med, quantile_cont(cl, 0.9) - quantile_cont(cl, 0.1) AS spread, max(cl) AS mx FROM b GROUP BY seed)
SELECT seed::BIGINT AS seed, round(avg((da - db > 1e-9)::INT) + avg((abs(da - db) <= 1e-9)::INT) / 2, 6) AS superiority, round((avg(da) - avg(db)) / quantile_cont(abs(cl - med), 0.5), 9) AS mad_effect,
 round(avg((abs(da - db) <= 1e-9)::INT), 6) AS pair_tie_share, round(avg((abs(cl - mx) <= 1e-9)::INT), 6) AS max_tie_share, round(any_value(spread), 4) AS spread FROM b JOIN m USING (seed) GROUP BY seed""")
def j22(t: Tables):
    d = t.scores.select(F.col("seed").cast("long").alias("seed"), F.col("score").alias("da"), (F.col("tax") * 10).alias("db"), F.col("price").alias("clean"))
    s = ME.prob_superiority(d, ["seed"])
    return s.select("seed", F.round("superiority", 6).alias("superiority"), F.round("mad_effect", 9).alias("mad_effect"), F.round("pair_tie_share", 6).alias("pair_tie_share"), F.round("max_tie_share", 6).alias("max_tie_share"), F.round("spread", 4).alias("spread"))


CTES["rk"] = """SELECT setting, unnest([family, '__pooled__']) AS grp, score, CASE WHEN family = 'N' THEN 0 ELSE (part % 3 = 0)::INT END AS y, (score >= 0.5)::INT AS pred FROM sc"""
CTES["rkt"] = "SELECT setting || '|' || grp AS k, * FROM rk"
CTES["rkc"] = """SELECT k, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS np, sum(neg) OVER (PARTITION BY k) AS nn FROM (SELECT k, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM rkt GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY score DESC)"""
CTES["rkm"] = ("SELECT r.k, any_value(setting) AS setting, any_value(grp) AS grp, count(*) FILTER (y = 0) AS normal_windows, count(*) FILTER (y = 1) AS attack_windows, avg(pred) FILTER (y = 0) AS fpr, avg(pred) FILTER (y = 1) AS attack_recall, any_value(auc) AS auc, "
               "any_value(CASE WHEN auc IS NULL THEN NULL ELSE ap END) AS ap, any_value(tpr) AS tpr FROM rkt r JOIN (" + _auc_sql("rkt", "k") + ") a ON a.k = r.k JOIN (SELECT k, sum(tp / (tp + fp) * pos) / nullif(any_value(np), 0) AS ap, coalesce(arg_max(tp - pos, score) FILTER (fp > floor(0.2::DOUBLE * nn) AND neg > 0), any_value(np)) / nullif(any_value(np), 0) AS tpr FROM rkc GROUP BY k) p ON p.k = r.k GROUP BY r.k")


@query("j23_ranking_table", """SELECT setting, grp AS "group", normal_windows, attack_windows, round(fpr, 6) AS fpr, round(attack_recall, 6) AS attack_recall, round(auc, 6) AS auc, round(ap, 6) AS ap, round(tpr, 6) AS tpr_at_0, -1::BIGINT AS groups, -1::BIGINT AS auc_eligible FROM rkm
UNION ALL SELECT setting, '__macro__', -1, -1, round(avg(fpr), 6), round(avg(attack_recall), 6), round(avg(auc), 6), round(avg(ap), 6), round(avg(tpr), 6), count(*), count(auc) FROM rkm WHERE grp <> '__pooled__' GROUP BY setting""")
def j23(t: Tables):
    d = scored(t).withColumn("y", F.when(F.col("family") == "N", 0).otherwise((F.col("part") % 3 == 0).cast("int")))
    r = ME.ranking_table(d, ["setting"], "family", (0.2,))
    n = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return r6(r, "fpr", "attack_recall", "auc", "ap", "tpr_at_0", keep=("setting", "group", n("normal_windows"), n("attack_windows"), n("groups"), n("auc_eligible")))


CTES["mf"] = "SELECT setting, seed, (" + " + ".join(f"coalesce(2 * count(*) FILTER (y_class = {k} AND pred_class = {k}) / nullif(count(*) FILTER (y_class = {k}) + count(*) FILTER (pred_class = {k}), 0), 0)" for k in range(5)) + ") / 5 AS macro_f1 FROM pb GROUP BY ALL"


@query("j24_macro_f1_best", "SELECT setting, arg_max(seed, macro_f1 * 1000000 - seed * 1e-9)::BIGINT AS step, round(max(macro_f1), 6) AS macro_f1 FROM mf GROUP BY setting")
def j24(t: Tables):
    m = ME.macro_f1(logits(t), ["setting", "seed"], list(range(5))).withColumn("step", F.col("seed").cast("long"))
    return r6(ME.pick_best(m, ["setting"]), "macro_f1", keep=("setting", "step"))
