"""Evaluation metrics as aggregations over scored windows.

Threshold-free metrics first count labels per distinct score, so ties shrink
before the shuffle, and take running counts span by span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from busline.operators import ordered as O


def confusion(d: DataFrame, by: list[str], y="y", pred="pred") -> DataFrame:
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return d.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def binary_metrics(c: DataFrame) -> DataFrame:
    """Rates from confusion counts; NULL without a denominator.

    Macro-F1 averages over the classes that occur in labels or predictions.
    """
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    div = F.try_divide
    f1 = lambda hit: F.coalesce(div(2 * hit, 2 * hit + fp + fn), F.lit(0.0))
    seen = lambda hit: ((hit + fp + fn) > 0).cast("int")
    return c.select(
        "*",
        (tn + fp).alias("normal_windows"), (fn + tp).alias("attack_windows"),
        div(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        div(f1(tp) + f1(tn), seen(tp) + seen(tn)).alias("macro_f1"),
        div(tp, tp + fn).alias("attack_recall"), div(tn, tn + fp).alias("normal_recall"),
        div(fp, tn + fp).alias("fpr"), div(fn, fn + tp).alias("fnr"),
    )


def class_recall(d: DataFrame, by: list[str] = (), y="y_class", pred="pred_class") -> DataFrame:
    """Exact and detection recall per attack class."""
    return d.where(F.col(y) > 0).groupBy(*by, y).agg(
        F.count("*").alias("windows"), F.avg((F.col(pred) == F.col(y)).cast("double")).alias("exact_recall"),
        F.avg((F.col(pred) > 0).cast("double")).alias("detection_recall"),
    )


def _ties(d, by, score, y, splits=None) -> DataFrame:
    pos = F.col(y).cast("long")
    t = O.tie_table(d, by, score, {"pos": pos, "neg": 1 - pos})
    return O.with_value_span(t, score, O.value_splits(d, score) if splits is None else splits)


def roc_auc(d: DataFrame, by: list[str] = (), score="score", y="y", splits=None) -> DataFrame:
    """Exact tie-aware area; NULL with one class."""
    t = O.prefix_sums(_ties(d, list(by), score, y, splits), list(by), [score], {"nb": "neg"})
    part = F.sum(F.col("pos") * (F.col("nb") - F.col("neg") / 2))
    return t.groupBy(*by).agg(F.try_divide(part, F.sum("pos") * F.sum("neg")).alias("auc"))


def curves(d: DataFrame, by: list[str] = (), score="score", y="y", splits=None) -> DataFrame:
    """One ROC and one PR point per distinct score, from the highest score down."""
    t = O.prefix_sums(_ties(d, list(by), score, y, splits), list(by), [score], {"tp": "pos", "fp": "neg"}, descending=True)
    return t.select(
        *by, score, "pos", "neg", "tp", "fp",
        F.try_divide("fp", "fp_total").alias("fpr"), F.try_divide("tp", "tp_total").alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ((F.col("pos") >= 0) & (F.col("neg") >= 0)).alias("monotonic"), "tp_total",
    )


def avg_precision(d: DataFrame, by: list[str] = (), score="score", y="y", splits=None) -> DataFrame:
    """Step sum of precision over recall gains."""
    c = curves(d, by, score, y, splits)
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.max("tp_total")).alias("ap"))


def ece(d: DataFrame, by: list[str] = (), bins=15, score="score", y="y") -> DataFrame:
    """Calibration error on max(s, 1-s); first bin closed on the left, others (lo, hi]."""
    conf = F.greatest(F.col(score), 1 - F.col(score))
    right = ((F.col(score) >= 0.5).cast("int") == F.col(y)).cast("double")
    b = F.greatest(F.ceil(conf * bins), F.lit(1))
    g = d.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("n"), F.avg(right).alias("a"), F.avg(conf).alias("c"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def score_summary(d: DataFrame, by: list[str], score="score") -> DataFrame:
    s = F.col(score)
    share = lambda x: F.avg((s >= x).cast("double"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg(s).alias("mean"), F.max(s).alias("max"),
        share(0.5).alias("share_ge_50"), share(0.9).alias("share_ge_90"), share(0.99).alias("share_ge_99"),
    )
    return g.join(O.exact_quantiles(d, by, score, {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}), by)


def score_hist(d: DataFrame, by: list[str], probs: dict[str, float], bins=1000, score="score") -> DataFrame:
    """Quantiles from a histogram on [0, 1]: the middle of the bin that holds the rank.

    The histogram has at most ``bins`` rows per group, whatever the input size.
    """
    x = d.where(F.col(score).between(0, 1))
    b = F.least(F.width_bucket(F.col(score).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    h = x.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("n"))
    over = W.partitionBy(*by)
    h = h.select("*", F.sum("n").over(over.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(over).alias("t"))
    mid = (F.col("_b") - 0.5) / bins

    def q(p):
        r = F.greatest(F.lit(0), F.least(F.col("t") - 1, F.ceil(F.lit(p) * F.col("t")) - 1))
        return F.min(F.when(F.col("cum") > r, mid))

    return h.groupBy(*by).agg(F.max("t").alias("scores"), *[q(p).alias(n) for n, p in probs.items()])


def threshold_higher(normal: DataFrame, fpr: float, by: list[str] = (), score="score", splits=None) -> DataFrame:
    """Smallest observed score at or above the 1-fpr quantile; the alarm is ``score >= threshold``."""
    t = O.tie_table(normal, list(by), score, {"n": F.lit(1)})
    t = O.with_value_span(t, score, O.value_splits(normal, score) if splits is None else splits)
    t = O.prefix_sums(t, list(by), [score], {"cum": "n"})
    r = F.ceil((F.col("cum_total") - 1) * F.lit(1.0 - fpr))
    return t.groupBy(*by).agg(F.min(F.when(F.col("cum") > r, F.col(score))).alias("threshold"))


def threshold_linear(normal: DataFrame, fpr: float, by: list[str] = (), score="score", splits=None) -> DataFrame:
    """Linear 1-fpr quantile and the rate that ``score > threshold`` achieves."""
    q = O.exact_quantiles(normal, list(by), score, {"threshold": 1.0 - fpr}, splits)
    ties = O.tie_table(normal, list(by), score, {"n": F.lit(1)})
    j = ties.join(q, list(by)) if by else ties.withColumn("threshold", q.scalar())
    above = F.sum(F.when(F.col(score) > F.col("threshold"), F.col("n")).otherwise(0))
    return j.groupBy(*by).agg(F.max("threshold").alias("threshold"), (above / F.sum("n")).alias("achieved"))


def apply_threshold(d: DataFrame, thr: DataFrame, by: list[str] = (), score="score", strict=False, without=1.0) -> DataFrame:
    """Alarm where the score reaches the threshold of its group; groups without normals have the threshold ``without``."""
    j = d.join(thr.select(*by, "threshold"), list(by), "left") if by else d.withColumn("threshold", thr.select("threshold").scalar())
    j = j.withColumn("threshold", F.coalesce("threshold", F.lit(without)))
    hit = F.col(score) > F.col("threshold") if strict else F.col(score) >= F.col("threshold")
    return j.withColumn("pred", hit.cast("int"))


def low_fpr_point(d: DataFrame, fprs=(0.001, 0.01), by: list[str] = (), score="score", y="y", splits=None) -> DataFrame:
    """Largest set of whole tie groups of normals within floor(fpr*n) false alarms, and its TPR.

    Alarms are scores above the first excluded normal score; ``threshold`` is
    the least double above it, or minus infinity if no normal is excluded, so
    they are the scores that reach it. ``unused_fp`` false alarms would still be
    allowed; ``tie_step_exceeds`` says that the next tie group is too large for
    them. Scores that are null or not finite raise.
    """
    x = F.col(score).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.withColumn(score, F.when(finite, x).otherwise(F.raise_error(F.lit("non-finite scores")).cast("double")))
    c = curves(d, by, score, y, splits)
    tot = c.groupBy(*by).agg(F.sum("neg").alias("normals"), F.sum("pos").alias("attacks"))
    grid = F.array(*[F.lit(float(f)) for f in fprs])
    c = c.withColumn("target", F.explode(grid))
    c = c.join(tot, list(by)) if by else c.withColumn("_t", tot.select(F.struct("*")).scalar()).select("*", "_t.*")
    allowed = F.floor(F.col("target") * F.col("normals"))
    inside = F.col("fp") <= allowed
    over = ~inside & (F.col("neg") > 0)
    ex = F.max(F.when(over, F.struct(score, "neg", "pos", F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg"))))
    g = c.groupBy(*by, "target").agg(
        ex.alias("_x"), F.max("normals").alias("normals"), F.max("attacks").alias("attacks"), F.max(F.when(inside, F.col("fp"))).alias("_in")
    )
    fp = F.coalesce(F.col("_x.col5"), F.col("normals"))
    tp = F.coalesce(F.col("_x.col4"), F.col("attacks"))
    tie = (F.col("_x.neg") > 1) | (F.col("_x.pos") > 0)
    status = (
        F.when(F.col("normals") == 0, "undefined_no_normals").when(F.col("_x").isNull(), "all_normals_included")
        .when(tie, "attainable_boundary_tie").otherwise("attainable")
    )
    ok = F.col("normals") > 0
    allowed = F.floor(F.col("target") * F.col("normals"))
    excluded = F.col(f"_x.{score}")
    above = F.when(excluded.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), excluded).cast("double")).otherwise(float("-inf"))
    fp = F.when(ok, fp).otherwise(0)
    return g.select(
        *by, "target", allowed.alias("allowed_fp"), fp.alias("achieved_fp"), (allowed - fp).alias("unused_fp"),
        F.when(ok, above).alias("threshold"), F.when(ok, excluded.isNotNull()).alias("tie_step_exceeds"),
        F.when(ok, F.try_divide(fp, "normals")).alias("achieved_fpr"), F.when(ok, F.try_divide(tp, "attacks")).alias("tpr"),
        F.col(f"_x.{score}").alias("excluded_score"), F.coalesce("_x.neg", F.lit(0)).alias("normal_ties"),
        F.coalesce("_x.pos", F.lit(0)).alias("attack_ties"), status.alias("status"),
    )


def best_f1(d: DataFrame, candidates=512, score="score", y="y", splits=None) -> DataFrame:
    """Threshold with the highest F1 among evenly spaced quantiles; the first one on ties.

    Ranks of the candidates are located on the running counts, so candidates
    meet only the score that holds them and no range join is needed.
    """
    t = O.prefix_sums(_ties(d, [], score, y, splits).withColumn("n", F.col("pos") + F.col("neg")), [], [score], {"cp": "pos", "cn": "n"})
    k = candidates - 1
    last = F.greatest(F.col("cn_total") - 1, F.lit(1))
    a, b = F.col("cn") - F.col("n"), F.col("cn") - 1
    lo = F.greatest(F.floor(a * k / last) - 1, F.lit(0))
    hi = F.least(F.ceil((b + 1) * k / last) + 1, F.lit(k))
    e = t.select("*", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("i"))
    pos = (F.col("cn_total") - 1) * (F.col("i") / k)
    here = lambda r: (r >= a) & (r <= b)
    low, high = here(F.floor(pos)), here(F.ceil(pos))
    row = F.struct(F.col(score).alias("v"), "cp", "cn")
    g = e.groupBy("i").agg(
        F.max(F.when(low, row)).alias("l"), F.max(F.when(high, row)).alias("h"), F.max("cp_total").alias("p"), F.max("cn_total").alias("t"),
        F.max(pos - F.floor(pos)).alias("w"),
    )
    thr = F.col("l.v") + (F.col("h.v") - F.col("l.v")) * F.col("w")
    at_high = thr >= F.col("h.v")
    below_p = F.when(at_high, F.col("h.cp")).otherwise(F.col("l.cp"))
    below_n = F.when(at_high, F.col("h.cn")).otherwise(F.col("l.cn"))
    tp = F.col("p") - below_p
    fp = F.col("t") - below_n - tp
    f1 = F.coalesce(F.try_divide(2 * tp, tp + fp + F.col("p")), F.lit(0.0))
    best = g.select("i", thr.alias("threshold"), f1.alias("f1"))
    return best.agg(F.max(F.struct("f1", (-F.col("i")).alias("o"), "threshold")).alias("m")).select("m.threshold", "m.f1")


def calibration_probe(d: DataFrame, by: list[str], fpr=0.01, without=1.0) -> DataFrame:
    """Confusion counts under four conditions: argmax, threshold, refit scaler, both.

    Rows carry role ('calibration' or an evaluation axis), y, and score and
    pred with the original (``_o``) and the refit (``_r``) scaler.  Thresholds
    come from calibration rows only, by group; a group without any has the
    threshold ``without``.
    """
    cal, held = d.where("role = 'calibration'"), d.where("role <> 'calibration'")
    thr = lambda s: O.exact_quantiles(cal, by, f"score_{s}", {f"thr_{s}": 1.0 - fpr})
    j = held.join(thr("o"), by, "left").join(thr("r"), by, "left")
    at = lambda s: (F.col(f"score_{s}") >= F.coalesce(f"thr_{s}", F.lit(without))).cast("int")
    conds = {"original": F.col("pred_o"), "threshold": at("o"), "refit": F.col("pred_r"), "refit_threshold": at("r")}
    c = F.array(*[F.struct(F.lit(n).alias("condition"), p.alias("pred")) for n, p in conds.items()])
    e = j.select(*by, "role", "y", F.inline(c))
    return binary_metrics(confusion(e, [*by, "role", "condition"]))


def saturation(d: DataFrame, by: list[str], thr: DataFrame, score="score") -> DataFrame:
    """Ambient maximum, share of windows at it, AUROC ambient against attack, alarm rates by role.

    Roles: ambient, attack (attack windows), attack_normal (other windows of attack captures).
    What a group lacks rows or a threshold for is NULL.
    """
    top = d.where("role = 'ambient'").groupBy(*by).agg(F.max(score).alias("ambient_max"))
    j = d.join(top, by, "left").join(thr.select(*by, "threshold"), by, "left")
    hit = (F.col(score) >= F.col("threshold")).cast("double")
    rate = lambda r: F.avg(F.when(F.col("role") == r, hit))
    g = j.groupBy(*by).agg(
        F.max("ambient_max").alias("ambient_max"),
        F.avg(F.when(F.col("role") == "ambient", (F.col(score) == F.col("ambient_max")).cast("double"))).alias("share_at_max"),
        rate("ambient").alias("ambient_fpr"), rate("attack").alias("attack_recall"), rate("attack_normal").alias("attack_capture_fpr"),
    )
    two = d.where("role IN ('ambient', 'attack')").withColumn("_y", (F.col("role") == "attack").cast("int"))
    return g.join(roc_auc(two, by, score, "_y"), by, "left")


def scenario_metrics(d: DataFrame, by: list[str], y="y_class", pred="pred_class", score="score") -> DataFrame:
    hit = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*by).agg(
        F.count("*").alias("windows"),
        hit(F.when(F.col(y) > 0, F.col(pred) > 0)).alias("detection_recall"),
        hit(F.when(F.col(y) > 0, F.col(pred) == F.col(y))).alias("exact_recall"),
        hit(F.when(F.col(y) == 0, F.col(pred) == 0)).alias("normal_recall"),
        F.avg(score).alias("mean_score"),
    )


def granular_recall(d: DataFrame, levels: list[str], y="y_class", pred="pred_class") -> DataFrame:
    """Recall overall and by each level column, in one table told apart by ``granularity``."""
    a = d.where(F.col(y) > 0)
    g = a.groupingSets([(), *[(c,) for c in levels]], *levels).agg(
        F.count("*").alias("windows"), F.avg((F.col(pred) == F.col(y)).cast("double")).alias("exact_recall"),
        F.avg((F.col(pred) > 0).cast("double")).alias("detection_recall"), F.grouping_id().alias("_g"),
    )
    n = len(levels)
    kind = F.coalesce(*[F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.lit(c)) for i, c in enumerate(levels)], F.lit("overall"))
    value = F.coalesce(*[F.col(c).cast("string") for c in levels], F.lit("all"))
    return g.select(kind.alias("granularity"), value.alias("value"), "windows", "exact_recall", "detection_recall")


def axis_metrics(d: DataFrame, by: list[str], axes: list[str], y="y", pred="pred") -> DataFrame:
    """Confusion and rates for a summary and for every axis, one grouping set each."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    g = d.groupingSets([tuple(by), *[(*by, c) for c in axes]], *by, *axes).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), F.grouping_id().alias("_g"))
    n = len(axes)
    kind = F.coalesce(*[F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.lit(c)) for i, c in enumerate(axes)], F.lit("summary"))
    value = F.coalesce(*[F.col(c).cast("string") for c in axes], F.lit("all"))
    return binary_metrics(g.select(*by, kind.alias("axis"), value.alias("value"), "tn", "fp", "fn", "tp"))


def unit_macro(units: DataFrame, by: list[str], high=0.99) -> DataFrame:
    """Pooled rates beside mean, SD, minimum and maximum of the rates of the units.

    ``units`` has one row of confusion counts per unit.
    """
    m = binary_metrics(units)
    rate = lambda c, n: [
        F.avg(c).alias(f"macro_{n}"), F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0).alias(f"{n}_sd"),
        F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"),
    ]
    return m.groupBy(*by).agg(
        F.count("*").alias("units"), F.count("fpr").alias("units_with_normals"), F.count("attack_recall").alias("units_with_attacks"),
        F.try_divide(F.sum("fp"), F.sum("normal_windows")).alias("pooled_fpr"),
        F.try_divide(F.sum("tp"), F.sum("attack_windows")).alias("pooled_recall"),
        *rate("fpr", "fpr"), *rate("attack_recall", "recall"), F.avg((F.col("fpr") >= high).cast("double")).alias("share_fpr_ge_99"),
    )


def boundary_metrics(d: DataFrame, by: list[str], limit=0.6, probs="probs", y="y_class") -> DataFrame:
    """Share of unsure and of misassigned windows, mean true-class and largest probability."""
    top = F.array_max(probs)
    pred = F.array_position(probs, top) - 1
    return d.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg((top < limit).cast("double")).alias("low_confidence"),
        F.avg((pred != F.col(y)).cast("double")).alias("misassigned"),
        F.avg(F.element_at(probs, F.col(y).cast("int") + 1)).alias("true_probability"), F.avg(top).alias("max_probability"),
    )


def confusion_matrix(d: DataFrame, classes: list[int], y="y_class", pred="pred_class") -> DataFrame:
    """Counts by true and predicted class, with shares of each row."""
    p = d.groupBy(y).pivot(pred, classes).count().na.fill(0)
    total = sum(F.col(str(c)) for c in classes)
    return p.select(y, *[F.col(str(c)).alias(f"pred_{c}") for c in classes], *[F.try_divide(F.col(str(c)), total).alias(f"share_{c}") for c in classes])


def prob_superiority(d: DataFrame, by: list[str], a="da", b="db", clean="clean", eps=1e-9) -> DataFrame:
    """P(a > b) + P(tie)/2 over pairs, the effect in MAD units of the clean scores, and degeneracy gates."""
    diff = F.col(a) - F.col(b)
    tie = F.abs(diff) <= eps
    med = O.exact_quantiles(d, by, clean, {"_med": 0.5, "_q90": 0.9, "_q10": 0.1})
    top = d.groupBy(*by).agg(F.max(clean).alias("_top"))
    j = d.join(med, by).join(top, by).withColumn("_dev", F.abs(F.col(clean) - F.col("_med")))
    mad = O.exact_quantiles(j.select(*by, "_dev"), by, "_dev", {"_mad": 0.5})
    g = j.groupBy(*by).agg(
        (F.avg(((diff > 0) & ~tie).cast("double")) + F.avg(tie.cast("double")) / 2).alias("superiority"),
        (F.avg(a) - F.avg(b)).alias("_d"), F.avg(tie.cast("double")).alias("pair_tie_share"),
        F.avg((F.abs(F.col(clean) - F.col("_top")) <= eps).cast("double")).alias("max_tie_share"),
        F.max(F.col("_q90") - F.col("_q10")).alias("spread"),
    )
    ok = (F.col("max_tie_share") < 0.01) & (F.col("spread") >= 1e-3) & (F.col("pair_tie_share") < 0.5)
    return g.join(mad, by).select(
        *by, "superiority", F.when(F.col("_mad") > 0, F.col("_d") / F.col("_mad")).alias("mad_effect"), "pair_tie_share", "max_tie_share", "spread", ok.alias("gates_pass"))


def ranking_table(d: DataFrame, by: list[str], group: str, fprs=(0.001, 0.01), score="score", y="y", pred="pred") -> DataFrame:
    """Rates, AUC, AP and low-FPR points per group and pooled, plus group-macro rows with eligible counts.

    Pooled rows are made by letting every tie row count for its group and for
    the pool; the scores are scanned once per metric, not once per group.
    """
    both = d.withColumn("_g", F.explode(F.array(F.col(group).cast("string"), F.lit("__pooled__"))))
    keys = [*by, "_g"]
    splits = O.value_splits(d, score)
    rows = binary_metrics(confusion(both, keys, y, pred))
    rows = rows.join(roc_auc(both, keys, score, y, splits), keys).join(avg_precision(both, keys, score, y, splits), keys)
    pts = low_fpr_point(both, fprs, keys, score, y, splits).groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == float(f), F.col("tpr"))).alias(f"tpr_at_{i}") for i, f in enumerate(fprs)])
    rows = rows.join(pts, keys)
    metrics = ["fpr", "attack_recall", "auc", "ap", *[f"tpr_at_{i}" for i in range(len(fprs))]]
    rows = rows.withColumn("ap", F.when(F.col("auc").isNotNull(), F.col("ap")))
    rows = rows.select(*by, F.col("_g").alias("group"), "normal_windows", "attack_windows", *metrics)
    macro = rows.where("`group` <> '__pooled__'").groupBy(*by).agg(
        F.count("*").alias("groups"), *[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_eligible") for m in metrics])
    macro = macro.withColumn("group", F.lit("__macro__"))
    return rows.unionByName(macro, allowMissingColumns=True)


def macro_f1(d: DataFrame, by: list[str], classes: list[int], y="y_class", pred="pred_class") -> DataFrame:
    """Mean one-against-rest F1 over the classes."""
    c = d.groupBy(*by, y, pred).agg(F.count("*").alias("n"))
    f = []
    for k in classes:
        tp = F.sum(F.when((F.col(y) == k) & (F.col(pred) == k), F.col("n")).otherwise(0))
        margins = F.sum(F.when(F.col(y) == k, F.col("n")).otherwise(0)) + F.sum(F.when(F.col(pred) == k, F.col("n")).otherwise(0))
        f.append(F.coalesce(F.try_divide(2 * tp, margins), F.lit(0.0)))
    return c.groupBy(*by).agg((sum(f) / len(classes)).alias("macro_f1"))


def pick_best(d: DataFrame, by: list[str], value="macro_f1", step="step") -> DataFrame:
    """Earliest row with the highest value per group."""
    best = F.max(F.struct(F.col(value), (-F.col(step)).alias("_o")))
    return d.groupBy(*by).agg(best.alias("m")).select(*by, (-F.col("m._o")).alias(step), F.col(f"m.{value}").alias(value))
