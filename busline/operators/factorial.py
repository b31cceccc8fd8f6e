"""Factorial contrasts, paired-arm decomposition and their decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from busline.functions.student import sign_p
from busline.operators import stats as ST

EFFECTS = ["P", "S", "D", "PS", "PD", "SD", "PSD"]
# Margin of practical equivalence and the decision limits that go with it.
MARGIN = 0.133855625
MARGIN_SHARE = 0.15
OUTSIDE_LIMIT, SIDE_LIMIT = 5, 3
MIN_SHARE_DENOMINATOR, MIN_RATIO_DENOMINATOR = 0.10, 0.01
SATURATION, SATURATION_GAP = 0.99, 0.01


def _sign(effect: str) -> Column:
    s = F.lit(1)
    for f in effect:
        s = s * F.when(F.col(f.lower()) == 1, 1).otherwise(-1)
    return s


def _coefficient(effect: str) -> Column:
    """Sign of a cell in the sum of one effect; the corner effect only uses 111 and 000."""
    total = F.col("p") + F.col("s") + F.col("d")
    if effect == "corner":
        return F.when(total == 3, 1).when(total == 0, -1).otherwise(0)
    return _sign(effect)


def _divisor(effect: str) -> int:
    return 1 if effect == "corner" else 2 ** (3 - len(effect))


def _eight(c: Column) -> Column:
    """A contrast needs all eight cells once."""
    return F.when(F.count("*") != 8, F.raise_error(F.lit("a factorial group lacks cells")).cast("double")).otherwise(c)


def factor_contrast(d: DataFrame, by: list[str], value: str, effects=(*EFFECTS, "corner")) -> DataFrame:
    """All effects of each group of eight cells, one row per effect; the cells are scanned once."""
    aggs = [_eight(F.sum(_coefficient(e) * F.col(value)) / _divisor(e)).alias(e) for e in effects]
    return d.groupBy(*by).agg(*aggs).unpivot(by, list(effects), "effect", "value")


def count_contrast(d: DataFrame, by: list[str], count: str, n: str, effects=(*EFFECTS, "corner")) -> DataFrame:
    """Contrasts on whole numerators over a common denominator: a true zero stays zero."""
    same = F.when(F.min(n) != F.max(n), F.raise_error(F.lit("cells differ in their denominator")).cast("long")).otherwise(F.max(n))
    aggs = [F.sum(_coefficient(e).cast("long") * F.col(count).cast("long")).alias(e) for e in effects]
    g = d.groupBy(*by).agg(same.alias("_n"), *aggs).unpivot([*by, "_n"], list(effects), "effect", "numerator")
    div = F.coalesce(*[F.when(F.col("effect") == e, F.lit(_divisor(e))) for e in effects])
    return g.select(*by, "effect", "numerator", (F.col("numerator") / (F.col("_n") * div)).alias("value"))


CELL = ["p", "s", "d"]


def augmentation_delta(d: DataFrame, value: str, real="real", attack: str | None = None) -> DataFrame:
    """Attack-equal, then block-equal mean per cell, minus the real arm at the same seed and cell."""
    if attack is not None:
        d = d.where(F.col("attack") == attack)
    b = d.groupBy("arm", "construction", "seed", "block", *CELL).agg(F.avg(value).alias("_v"))
    c = b.groupBy("arm", "construction", "seed", *CELL).agg(F.avg("_v").alias("value"))
    r = c.where(F.col("arm") == real).groupBy("seed", *CELL).agg(F.max("value").alias("real_value"), F.count("*").alias("_n"))
    j = c.where(F.col("arm") != real).join(r, ["seed", *CELL], "left")
    ok = F.col("_n") == 1
    delta = F.when(ok, F.col("value") - F.col("real_value")).otherwise(F.raise_error(F.lit("no single real reference for a cell")).cast("double"))
    return j.withColumn("delta", delta).drop("_n")


def effects(deltas: DataFrame, names=EFFECTS, value="delta", extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Contrast per pipeline seed, and its mean per construction."""
    per = factor_contrast(deltas, [*extra, "arm", "construction", "seed"], value, names)
    return per, per.groupBy(*extra, "arm", "construction", "effect").agg(F.avg("value").alias("value"))


def decompose(per_construction: DataFrame, effect="P", rule="rule", placebo="placebo", tolerance=1e-12) -> DataFrame:
    """rule = placebo + theta per construction; a residual above the tolerance raises."""
    e = per_construction.where(F.col("effect") == effect)
    side = lambda a, n: e.where(F.col("arm") == a).select("construction", F.col("value").alias(n))
    j = side(rule, "rule_delta").join(side(placebo, "placebo_delta"), "construction")
    j = j.withColumn("theta", F.col("rule_delta") - F.col("placebo_delta"))
    res = F.col("rule_delta") - (F.col("placebo_delta") + F.col("theta"))
    closed = F.when(F.abs(res) <= tolerance, res).otherwise(F.raise_error(F.lit("decomposition does not close")).cast("double"))
    return j.withColumn("residual", closed)


def _two_levels(d: DataFrame, by: list[str], value: str) -> DataFrame:
    """Summary with the 90 and the 95 % interval, from one pass."""
    t = ST.t_interval(d, by, value, {"90": 0.90, "95": 0.95})
    ends = [F.col(f"ci_{a}{c}").alias(f"{b}{c}") for c in ("90", "95") for a, b in (("low", "lo"), ("high", "hi"))]
    return t.select(*by, "n", "mean", "sd", "positive", "negative", *ends)


def equivalence(d: DataFrame, by: list[str], value="theta", key="construction", margin: float | Column = MARGIN, b=10000, seed=20260725) -> DataFrame:
    """A equivalent, B material, C heterogeneous, D inconclusive.

    90 % interval inside the margin, 95 % interval beyond it, disagreement of
    units, and agreement of t and bootstrap verdicts decide in this order.
    """
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    d = d.withColumn("_m", m)
    x = _two_levels(d, by, value)
    v = F.col(value)
    units = d.groupBy(*by).agg(F.count_if(v > F.col("_m")).alias("above"), F.count_if(v < -F.col("_m")).alias("below"), F.max("_m").alias("margin"))
    bm = ST.bootstrap_means(d, by, value, key, b, seed)
    q = lambda p: F.percentile("boot_mean", F.lit(p))
    boot = bm.groupBy(*by).agg(q(0.05).alias("b_lo90"), q(0.95).alias("b_hi90"), q(0.025).alias("b_lo95"), q(0.975).alias("b_hi95"))
    j = reduce(lambda a, c: a.join(c, by), [x, units, boot])
    mm = F.col("margin")
    inside = lambda lo, hi: (F.col(lo) >= -mm) & (F.col(hi) <= mm)
    beyond = lambda lo, hi: (F.col(lo) > mm) | (F.col(hi) < -mm)
    j = j.select(
        "*", inside("lo90", "hi90").alias("equivalent"), beyond("lo95", "hi95").alias("material"),
        inside("b_lo90", "b_hi90").alias("boot_equivalent"), beyond("b_lo95", "b_hi95").alias("boot_material"),
        sign_p(F.greatest("positive", "negative"), F.col("n")).alias("sign_p"),
    )
    both = (F.col("above") >= SIDE_LIMIT) & (F.col("below") >= SIDE_LIMIT)
    mixed = both | ((F.col("above") + F.col("below") >= OUTSIDE_LIMIT) & F.col("equivalent"))
    apart = (F.col("equivalent") != F.col("boot_equivalent")) | (F.col("material") != F.col("boot_material"))
    verdict = F.when(mixed, "C").when(apart, "D").when(F.col("equivalent"), "A").when(F.col("material"), "B").otherwise("D")
    return j.select("*", mixed.alias("heterogeneous"), apart.alias("boot_disagrees"), verdict.alias("verdict"))


def margin_sensitivity(d: DataFrame, by: list[str], gain: DataFrame, value="theta", margin=MARGIN, floor=0.01, b=10000) -> DataFrame:
    """Verdict under the given margin and under one scaled by the placebo gain.

    ``gain`` has one row per group with ``placebo_gain``; a gain at or below
    ``floor`` leaves the second margin undefined.
    """
    a = equivalence(d, by, value, margin=margin, b=b).select(*by, F.col("margin"), "verdict")
    g = gain.select(*by, F.when(F.col("placebo_gain") > floor, F.col("placebo_gain") * MARGIN_SHARE).alias("strict_margin"))
    s = d.join(g, by).where(F.col("strict_margin").isNotNull())
    st = equivalence(s, by, value, margin=F.col("strict_margin"), b=b).select(*by, F.col("verdict").alias("strict_verdict"))
    j = a.join(g, by).join(st, by, "left").withColumn("strict_verdict", F.coalesce("strict_verdict", F.lit("undefined")))
    differs = (F.col("strict_verdict") != "undefined") & (F.col("strict_verdict") != F.col("verdict"))
    return j.withColumn("disagreement", differs).withColumn("margin_ratio", F.col("strict_margin") / F.col("margin"))


def relational_share(dec: DataFrame, by: list[str] = (), floor=MIN_SHARE_DENOMINATOR) -> DataFrame:
    """theta over |rule delta|: median and quartiles over constructions; small denominators are left out and counted."""
    den = F.abs("rule_delta")
    share = F.when(den >= floor, F.col("theta") / den)
    q = lambda p: F.percentile(share, F.lit(p))
    return dec.groupBy(*by).agg(
        q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.min(share).alias("min"), F.max(share).alias("max"),
        F.count(share).alias("used"), F.count_if(den < floor).alias("excluded"))


def response_share(dec: DataFrame, by: list[str] = ()) -> DataFrame:
    """Placebo over rule response as a ratio of means, with quartiles of the single ratios beside it."""
    ratio = F.try_divide(F.col("placebo_delta"), F.col("rule_delta"))
    q = lambda p: F.percentile(ratio, F.lit(p))
    return dec.groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.avg("placebo_delta"), F.avg("rule_delta")).alias("share"),
        q(0.25).alias("ratio_q25"), q(0.5).alias("ratio_median"), q(0.75).alias("ratio_q75"))


def cell_comparison(d: DataFrame, value: str, p_level: int, real="real", rule="rule", placebo="placebo") -> DataFrame:
    """Recall of each arm in one P cell per attack scope and construction, gains over real and their ratio."""
    f = d.where(F.col("p") == p_level)
    f = f.withColumn("scope", F.explode(F.array(F.lit("equal_macro"), F.col("attack"))))
    a = f.groupBy("scope", "arm", "construction", "seed", "attack").agg(F.avg(value).alias("_v"))
    pipe = a.groupBy("scope", "arm", "construction", "seed").agg(F.avg("_v").alias("_v"))
    unit = pipe.groupBy("scope", "arm", "construction").agg(F.avg("_v").alias("_v"))
    base = pipe.where(F.col("arm") == real).groupBy("scope").agg(F.avg("_v").alias("real_recall"))
    side = lambda x, n: unit.where(F.col("arm") == x).select("scope", "construction", F.col("_v").alias(n))
    j = side(rule, "rule_recall").join(side(placebo, "placebo_recall"), ["scope", "construction"]).join(base, "scope")
    j = j.select("*", (F.col("rule_recall") - F.col("real_recall")).alias("rule_gain"), (F.col("placebo_recall") - F.col("real_recall")).alias("placebo_gain"))
    shaky = F.abs("placebo_gain") < MIN_RATIO_DENOMINATOR
    return j.select(
        "*", (F.col("rule_recall") - F.col("placebo_recall")).alias("difference"), shaky.alias("ratio_unstable"),
        F.when(~shaky, F.try_divide(F.col("rule_gain"), F.col("placebo_gain"))).alias("gain_ratio"))


def saturated(cells: DataFrame, by: list[str] = ("scope",)) -> DataFrame:
    """Are both arms above the saturation recall and closer than the gap?"""
    g = cells.groupBy(*by).agg(F.avg("rule_recall").alias("rule_recall"), F.avg("placebo_recall").alias("placebo_recall"))
    gap = F.abs(F.col("rule_recall") - F.col("placebo_recall"))
    full = (F.col("rule_recall") > SATURATION) & (F.col("placebo_recall") > SATURATION) & (gap < SATURATION_GAP)
    return g.select("*", gap.alias("gap"), full.alias("saturated"), F.when(full, "saturated").otherwise("unsaturated").alias("determination"))


def secondary(per_construction: DataFrame, effects_: list[str], family: list[str], value="value") -> DataFrame:
    """t test of each named effect over constructions, Holm-adjusted within the family."""
    d = per_construction.where(F.col("effect").isin(*effects_))
    t = ST.t_interval(d, [*family, "effect"], value)
    return ST.holm(t, family, "p", "effect")


def crossed_dispersion(d: DataFrame, by: list[str], row: str, col: str, value: str, tolerance=1e-9) -> DataFrame:
    """Sums of squares of rows, columns and interaction on a full grid, their shares and the closure error."""
    avg = lambda *k: F.avg(value).over(W.partitionBy(*by, *k))
    g = d.select(*by, row, col, F.col(value).alias("_v"), avg().alias("_g"), avg(row).alias("_r"), avg(col).alias("_c"))
    sq = lambda c: F.sum(c * c)
    s = g.groupBy(*by).agg(
        F.count_distinct(row).alias("rows"), F.count_distinct(col).alias("cols"), F.count("*").alias("cells"), F.avg("_v").alias("grand_mean"),
        sq(F.col("_r") - F.col("_g")).alias("ss_row"), sq(F.col("_c") - F.col("_g")).alias("ss_col"),
        sq(F.col("_v") - F.col("_r") - F.col("_c") + F.col("_g")).alias("ss_interaction"), sq(F.col("_v") - F.col("_g")).alias("ss_total"))
    err = F.abs(F.col("ss_total") - F.col("ss_row") - F.col("ss_col") - F.col("ss_interaction"))
    whole = F.col("cells") == F.col("rows") * F.col("cols")
    ok = F.when(~whole, F.raise_error(F.lit("grid is not complete")).cast("double")).when(
        err > tolerance * F.greatest(F.lit(1.0), F.col("ss_total")), F.raise_error(F.lit("sums of squares do not close")).cast("double")).otherwise(err)
    share = lambda c: F.when(F.col("ss_total") > 0, F.col(c) / F.col("ss_total")).alias(c.replace("ss_", "share_"))
    return s.select(
        "*", F.sqrt(F.col("ss_interaction") / F.col("cells")).alias("rms_interaction"), share("ss_row"), share("ss_col"), share("ss_interaction"),
        ok.alias("closure_error"), F.when(F.col("ss_total") == 0, "degenerate_total_dispersion").otherwise("complete").alias("status"))


def t_summary(d: DataFrame, by: list[str], value="value", conf=0.95) -> DataFrame:
    """t interval that survives equal values: status flag, p = 1 for bookkeeping only."""
    t = ST.t_interval(d, by, value, conf)
    status = F.when(F.col("degenerate"), "bookkeeping_p").otherwise("inferential_p")
    blank = lambda c: F.when(~F.col("degenerate"), F.col(c)).alias(c)
    keep = [c for c in t.columns if c not in ("sd", "ci_low", "ci_high", "t")]
    return t.select(*keep, blank("sd"), blank("ci_low"), blank("ci_high"), blank("t"), status.alias("p_status"))


def _resolved(alpha=0.05, need=4) -> Column:
    m = F.col("mean")
    signs = F.when(m > 0, F.col("positive") >= need).when(m < 0, F.col("negative") >= need).otherwise(False)
    return ~F.col("degenerate") & (F.col("holm_p") < alpha) & signs


def verdict(d: DataFrame, by: list[str], opposed: DataFrame | None = None, need=4) -> DataFrame:
    """Localisation verdict of the seven effects of each group, with its suffixes.

    ``d``: effect, mean, holm_p, degenerate, positive, negative.  ``opposed``
    lists groups with effects whose attacks point apart.  A group without all
    seven effects is an error.
    """
    d = d.withColumn("_res", _resolved(need=need)).withColumn("_sig", ~F.col("degenerate") & (F.col("holm_p") < 0.05))
    pos = F.array_position(F.array(*[F.lit(e) for e in EFFECTS]), F.col("effect"))
    deg = F.sort_array(F.collect_list(F.when(F.col("degenerate"), F.struct(pos.alias("i"), F.col("effect").alias("e")))))["e"]
    g = d.groupBy(*by).agg(
        F.bool_or(F.col("_res") & (F.length("effect") == 1)).alias("_main"), F.bool_or("_res").alias("_any"), F.bool_or("_sig").alias("_mixed"), deg.alias("_deg"), F.count_distinct("effect").alias("_n"))
    whole = F.when(F.col("_n") != len(EFFECTS), F.raise_error(F.lit("a group lacks effects")).cast("long")).otherwise(F.col("_n"))
    g = g.withColumn("_n", whole).where(F.col("_n") == len(EFFECTS))
    base = F.when(F.col("_main"), "F-MAIN").when(F.col("_any"), "F-INTERACTION").when(F.col("_mixed"), "F-MIXED").otherwise("F-UNRESOLVED")
    tail = F.when(F.size("_deg") > 0, F.concat(F.lit("+DEGENERATE("), F.array_join("_deg", ","), F.lit(")"))).otherwise("")
    if opposed is None:
        return g.select(*by, F.concat(base, tail).alias("verdict"))
    o = opposed.select(*by).distinct().withColumn("_o", F.lit("+attack-heterogeneous"))
    return g.join(o, by, "left").select(*by, F.concat(base, tail, F.coalesce("_o", F.lit(""))).alias("verdict"))


def heterogeneous(d: DataFrame, by: list[str], value="value", attacks=("gear", "rpm")) -> DataFrame:
    """Effects whose attack means have opposite signs. ``d`` has one row per unit, attack and effect."""
    p = d.groupBy(*by, "effect").pivot("attack", list(attacks)).agg(F.avg(value))
    a, b = attacks
    return p.withColumn("opposed", F.coalesce(F.col(a) * F.col(b) < 0, F.lit(False)))


def budget_class(primary: Column, legacy: Column, lo: Column, hi: Column) -> Column:
    """Does the earlier budget repeat a primary effect?"""
    same = ((primary > 0) & (legacy > 0) & (lo > 0)) | ((primary < 0) & (legacy < 0) & (hi < 0))
    opposite = ((primary > 0) & (hi < 0)) | ((primary < 0) & (lo > 0))
    return (
        F.when(legacy == 0, "budget-direction-unresolved-zero")
        .when((primary == 0) | (primary * legacy < 0) | F.coalesce(opposite, F.lit(False)), "budget-discordant")
        .when(F.coalesce(same, F.lit(False)), "budget-stable")
        .otherwise("directionally-concordant-unresolved")
    )


def family_comparison(a: DataFrame, b: DataFrame, by: list[str] = (), key="construction", value="theta") -> DataFrame:
    """Paired theta of two detector families: means, SDs, difference and correlations."""
    j = a.select(*by, key, F.col(value).alias("a")).join(b.select(*by, key, F.col(value).alias("b")), [*by, key])
    j = ST.with_rank(ST.with_rank(j, list(by), "a", "ra"), list(by), "b", "rb")
    diff = F.col("b") - F.col("a")
    return j.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("a").alias("a_mean"), F.stddev_samp("a").alias("a_sd"), F.avg("b").alias("b_mean"), F.stddev_samp("b").alias("b_sd"),
        F.avg(diff).alias("difference"), F.stddev_samp(diff).alias("difference_sd"), ST._pearson("a", "b").alias("pearson"), ST._pearson("ra", "rb").alias("spearman"))


def utility_reliance(d: DataFrame, value: str, by: list[str] = (), conf=0.975) -> tuple[DataFrame, DataFrame]:
    """U = rule minus placebo intact, L = difference of the intact-minus-broken drops.

    Attacks are averaged first, then pipelines; constructions are the units.
    Returns unit rows and intervals.
    """
    cell = lambda a, r: F.avg(F.when((F.col("arm") == a) & (F.col("relation") == r), F.col(value)))
    p = d.groupBy(*by, "construction", "seed").agg(
        *[cell(a, r).alias(f"{a}_{r}") for a in ("rule", "placebo") for r in ("intact", "broken")])
    u = F.col("rule_intact") - F.col("placebo_intact")
    rel = (F.col("rule_intact") - F.col("rule_broken")) - (F.col("placebo_intact") - F.col("placebo_broken"))
    units = p.select(*by, "construction", "seed", u.alias("U"), rel.alias("L")).groupBy(*by, "construction").agg(F.avg("U").alias("U"), F.avg("L").alias("L"))
    long = units.unpivot([*by, "construction"], ["U", "L"], "endpoint", "value")
    return units, ST.t_interval(long, [*by, "endpoint"], "value", conf)


def fpr_units(d: DataFrame, fp: str, n: str) -> DataFrame:
    """False-alarm rate of both arms and their difference, per construction."""
    r = d.groupBy("construction", "seed").pivot("arm", ["rule", "placebo"]).agg(F.avg(F.try_divide(F.col(fp), F.col(n))))
    return r.groupBy("construction").agg(
        F.avg("rule").alias("rule"), F.avg("placebo").alias("placebo"), F.avg(F.col("rule") - F.col("placebo")).alias("delta"))


def recovery(units: DataFrame, by: list[str], value="U", noise=0.1, share=0.5, conf=0.95) -> DataFrame:
    """Interval above 0 and mean at least the wanted share of the oracle advantage."""
    need = ((1 - noise) - 0.5) * share
    t = ST.t_interval(units, by, value, conf)
    return t.select("*", F.lit(need).alias("minimum_mean"), ((F.col("ci_low") > 0) & (F.col("mean") >= need)).alias("recovered"))


def band_verdict(lo: Column, hi: Column, delta: Column, comparison_lo: Column) -> Column:
    """Interval against a band, strict on both edges."""
    return (
        F.when(lo > delta, F.when(comparison_lo > 0, "S+").otherwise("S+asym"))
        .when(hi < -delta, "S-").when((lo > -delta) & (hi < delta), "S0").otherwise("SX")
    )


def sparse_curves(d: DataFrame, value: str) -> DataFrame:
    """Per k: recall intact and broken, their difference per arm, and theta between arms, with 90 and 95 % intervals.

    Attacks, blocks and pipelines are averaged in this order; constructions are the units.
    """
    m = d.groupBy("arm", "construction", "seed", "block", "k", "relation").agg(F.avg(value).alias("_v"))
    m = m.groupBy("arm", "construction", "seed", "k", "relation").agg(F.avg("_v").alias("_v"))
    m = m.groupBy("arm", "construction", "k").pivot("relation", ["intact", "broken"]).agg(F.avg("_v"))
    m = m.withColumn("difference", F.col("intact") - F.col("broken"))
    long = m.unpivot(["arm", "construction", "k"], ["intact", "broken", "difference"], "quantity", "value")
    th = m.groupBy("construction", "k").pivot("arm", ["rule", "placebo"]).agg(F.max("difference"))
    th = th.select(F.lit("rule_minus_placebo").alias("arm"), "construction", "k", F.lit("theta").alias("quantity"), (F.col("rule") - F.col("placebo")).alias("value"))
    both = long.unionByName(th)
    by = ["arm", "k", "quantity"]
    return _two_levels(both, by, "value")


def hierarchical(per_construction: DataFrame, family: list[str], anchor, value="value") -> DataFrame:
    """Effect summaries by scope: constructions without the anchor, all, and each alone.

    Only the scope without the anchor is tested, with Holm inside the family.
    """
    new = F.col("construction") != anchor
    scopes = F.array(
        F.when(new, F.lit("new")), F.lit("anchor_inclusive"), F.concat(F.lit("construction_"), F.col("construction").cast("string")))
    d = per_construction.withColumn("scope", F.explode(F.filter(scopes, lambda x: x.isNotNull())))
    t = t_summary(d, [*family, "scope", "effect"], value)
    tested = ST.holm(t.where("scope = 'new'"), family, "p", "effect").select(*family, "scope", "effect", "holm_p")
    p = F.when(F.col("scope") == "new", F.col("p"))
    return t.withColumn("p", p).join(tested, [*family, "scope", "effect"], "left")


def l2_summary(d: DataFrame, by: list[str], value: str, real="real") -> DataFrame:
    """Severity-set deltas against the real arm at the same seed: pipelines averaged, constructions as units."""
    c = d.groupBy(*by, "arm", "construction", "seed").agg(F.avg(value).alias("_v"))
    r = c.where(F.col("arm") == real).groupBy(*by, "seed").agg(F.avg("_v").alias("_r"))
    j = c.where(F.col("arm") != real).join(r, [*by, "seed"]).withColumn("delta", F.col("_v") - F.col("_r"))
    u = j.groupBy(*by, "arm", "construction").agg(F.avg("delta").alias("delta"))
    return t_summary(u, [*by, "arm"], "delta")


def findings(exact: DataFrame, binary: DataFrame, pipelines: DataFrame, attacks: DataFrame, need=4) -> DataFrame:
    """Sign, direction and significance labels per effect, and the relation of the two endpoints.

    ``exact``/``binary``: effect, mean, holm_p, degenerate, positive, negative.
    ``pipelines``: effect, value per pipeline.  ``attacks``: effect, attack, mean.
    """
    sign = lambda c: F.signum(c).cast("int")
    lab = lambda d, p: d.select("effect", sign(F.col("mean")).alias(f"{p}_sign"), _resolved(need=need).alias(f"{p}_resolved"))
    j = lab(exact, "exact").join(lab(binary, "binary"), "effect")
    s = exact.select("effect", sign(F.col("mean")).alias("_s"))
    pc = pipelines.join(s, "effect").groupBy("effect").agg(F.count_if(sign(F.col("value")) == F.col("_s")).alias("_same"))
    at = attacks.groupBy("effect").agg(F.min(sign(F.col("mean"))).alias("_lo"), F.max(sign(F.col("mean"))).alias("_hi"))
    j = j.join(pc, "effect").join(at, "effect")
    es, bs, er, br = (F.col(c) for c in ("exact_sign", "binary_sign", "exact_resolved", "binary_resolved"))
    relation = (
        F.when(er & br & (es == bs), "endpoint-directionally-concordant").when(er & br & (es == -bs), "endpoint-discordant")
        .when(er, "exact-only").when(br, "binary-only").otherwise("neither-endpoint-resolved")
    )
    conc = (es != 0) & (F.col("_same") >= 4)
    return j.select(
        "effect", "exact_sign", "binary_sign", "exact_resolved", "binary_resolved", conc.alias("pipelines_agree"),
        (er & ~conc).alias("pipelines_differ"), ((F.col("_lo") == -1) & (F.col("_hi") == 1) & er).alias("attacks_oppose"), relation.alias("endpoint_relation"))
