import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from busline.operators import audit as AU
from busline.operators import factorial as FA
from busline.operators import metrics as ME
from busline.operators import profile as P
from busline.operators import stats as ST


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    rows = [("a" if rnd.random() < 0.7 else "b", rnd.randrange(20) / 20, int(rnd.random() < 0.4)) for _ in range(500)]
    rows += [("only", 0.5, 0)]
    return spark.createDataFrame(rows, "g string, score double, y int")


def groups(d):
    out = {}
    for r in d.collect():
        out.setdefault(r.g, []).append((r.score, r.y))
    return {k: (np.array([s for s, _ in v]), np.array([y for _, y in v])) for k, v in out.items()}


def test_auc_and_ap(scored):
    auc = {r.g: r.auc for r in ME.roc_auc(scored, ["g"]).collect()}
    ap = {r.g: r.ap for r in ME.avg_precision(scored, ["g"]).collect()}
    assert auc["only"] is None
    for g, (s, y) in groups(scored).items():
        if g == "only":
            continue
        p, n = s[y == 1], s[y == 0]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
        assert auc[g] == pytest.approx(want)
        total = 0.0
        for t in sorted(set(s), reverse=True):
            total += (y[s >= t].mean()) * (y[s == t].sum() / y.sum())
        assert ap[g] == pytest.approx(total)


def test_low_fpr_tie_group_is_whole(spark):
    """Eight normals at 0.0 and two at 0.5: at a ceiling of 0.1 no alarm is allowed."""
    d = spark.createDataFrame([(0.0, 0)] * 8 + [(0.5, 0)] * 2 + [(0.5, 1), (0.9, 1)], "score double, y int")
    r = ME.low_fpr_point(d, (0.1,)).first()
    assert (r.achieved_fp, r.excluded_score, r.normal_ties, r.attack_ties, r.tpr, r.status) == (0, 0.5, 2, 1, 0.5, "attainable_boundary_tie")
    n = d.where("y = 0")
    t = ME.threshold_linear(n, 0.1).first()
    assert t.threshold > 0 and t.achieved == 0
    h = ME.threshold_higher(n, 0.1).first().threshold
    assert h == np.quantile([0.0] * 8 + [0.5] * 2, 0.9, method="higher")
    assert (r.threshold, r.unused_fp, r.tie_step_exceeds) == (np.nextafter(0.5, np.inf), 1, True)
    every = ME.low_fpr_point(d, (1.0,)).first()
    assert (every.threshold, every.unused_fp, every.tie_step_exceeds) == (-np.inf, 0, False)
    tiny = ME.low_fpr_point(spark.createDataFrame([(-0.5, 0), (1e-310, 0), (1.0, 1)], "score double, y int"), (0.1, 0.6)).collect()
    assert {x.target: x.threshold for x in tiny} == {0.1: np.nextafter(1e-310, 1), 0.6: np.nextafter(-0.5, 1)}
    none = ME.low_fpr_point(spark.createDataFrame([(0.5, 1)], "score double, y int"), (0.1,)).first()
    assert (none.status, none.threshold, none.achieved_fp, none.tpr) == ("undefined_no_normals", None, 0, None)
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="non-finite"):
            ME.low_fpr_point(spark.createDataFrame([(0.5, 1), (bad, 0)], "score double, y int")).collect()
    assert (every.status, every.achieved_fp, every.tpr) == ("all_normals_included", 10, 1.0)


def test_groups_without_calibration_rows_stay(spark):
    d = spark.createDataFrame(
        [("a", "calibration", 0, 0.3, 0.2, 0, 0), ("a", "ambient", 0, 0.4, 0.1, 1, 0), ("b", "ambient", 1, 0.9, 1.0, 1, 0)],
        "g string, role string, y int, score_o double, score_r double, pred_o int, pred_r int")
    got = {(r.g, r.condition): (r.tn, r.fp, r.fn, r.tp) for r in ME.calibration_probe(d, ["g"]).collect()}
    assert got["a", "threshold"] == (0, 1, 0, 0) and got["a", "refit_threshold"] == (1, 0, 0, 0)
    assert got["b", "original"] == (0, 0, 0, 1) and got["b", "threshold"] == (0, 0, 1, 0) and got["b", "refit_threshold"] == (0, 0, 0, 1)
    s = spark.createDataFrame([("a", "ambient", 0.2), ("a", "attack", 0.8), ("b", "attack", 0.7)], "g string, role string, score double")
    thr = spark.createDataFrame([("a", 0.5)], "g string, threshold double")
    out = {r.g: r for r in ME.saturation(s, ["g"], thr).collect()}
    assert (out["a"].attack_recall, out["a"].ambient_fpr, out["a"].auc) == (1.0, 0.0, 1.0)
    assert (out["b"].attack_recall, out["b"].ambient_max, out["b"].auc) == (None, None, None)


def test_confusion_one_of_each(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "y int, pred int")
    r = ME.binary_metrics(ME.confusion(d, [])).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.fpr, r.attack_recall, r.macro_f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    one = ME.binary_metrics(ME.confusion(spark.createDataFrame([(0, 0)], "y int, pred int"), [])).first()
    assert one.attack_recall is None and one.macro_f1 == 1.0


def test_pooled_against_macro(spark):
    u = spark.createDataFrame([("u1", 0, 10, 0, 0), ("u2", 90, 0, 0, 0)], "unit string, tn long, fp long, fn long, tp long")
    r = ME.unit_macro(u.withColumn("g", F.lit(1)), ["g"]).first()
    assert (r.pooled_fpr, r.macro_fpr, r.units_with_attacks, r.macro_recall) == (0.1, 0.5, 0, None)


def test_best_f1_matches_loop(spark, scored):
    s, y = (np.concatenate(x) for x in zip(*groups(scored).values()))
    best, thr = -1.0, None
    for c in np.quantile(s, np.linspace(0, 1, 64)):
        pred = s > c
        tp, fp = (pred & (y == 1)).sum(), (pred & (y == 0)).sum()
        f1 = 2 * tp / (tp + fp + y.sum())
        if f1 > best:
            best, thr = f1, c
    r = ME.best_f1(scored, 64).first()
    assert r.f1 == pytest.approx(best) and r.threshold == pytest.approx(thr)


def test_wasserstein_and_js(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 30, 200) / 3, rnd.integers(5, 40, 150) / 3
    da, db = (spark.createDataFrame([(float(x),) for x in v], "v double") for v in (a, b))
    grid = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    want = np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))
    assert P.wasserstein_1d(da, db, "v").first()[0] == pytest.approx(want)
    ca, cb = (spark.createDataFrame([(i, n) for i, n in enumerate(c) if n], "k int, n long") for c in ([5, 0, 3, 2, 0], [0, 0, 4, 4, 1]))
    p, q = np.array([5, 0, 3, 2, 0]) / 10, np.array([0, 0, 4, 4, 1]) / 9
    for eps in (0.0, 1e-3):
        x, y = (v + eps for v in (p, q))
        x, y = x / x.sum(), y / y.sum()
        m = (x + y) / 2
        kl = lambda u: np.sum(u[u > 0] * np.log2(u[u > 0] / m[u > 0]))
        got = P.js_divergence(ca, cb, "k", eps=eps, bins=5).first()[0]
        assert got == pytest.approx((kl(x) + kl(y)) / 2)


def test_histogram_last_bin_closed_and_empty(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,), (-1.0,)], "v double")
    assert [r.n for r in P.histogram(d, "v", [0, 1, 2]).orderBy("bin").collect()] == [1, 2]
    assert [r.share for r in P.histogram(d.where("v > 9"), "v", [0, 1, 2]).collect()] == [0.5, 0.5]


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r.name: r.holm_p for r in ST.holm(d, []).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_paired_seeds(spark):
    d = spark.createDataFrame([("x", 7, 0.5), ("x", 42, 0.6), ("y", 7, 0.4), ("y", 42, 0.3)], "arm string, seed int, v double").withColumn("g", F.lit(1))
    r = ST.paired_contrast(d, ["g"], "arm", "x", "y", "v").first()
    assert r["mean"] == pytest.approx(0.2) and r.positive == 2 and r.sign_consistency == "2/2"


def test_wilcoxon_exact(spark):
    deltas = [0.3, -0.1, 0.4, 0.2, 0.2, 0.0]
    d = spark.createDataFrame([(1, x) for x in deltas] + [(2, 0.0), (2, 0.0)], "g int, delta double")
    got = {r.g: r for r in ST.wilcoxon(d, ["g"]).collect()}
    x = [v for v in deltas if v]
    order = sorted(abs(v) for v in x)
    rank = lambda v: np.mean([i + 1 for i, o in enumerate(order) if o == abs(v)])
    w = sum(rank(v) for v in x if v > 0)
    sums = [sum(rank(v) * s for v, s in zip(x, signs)) for signs in itertools.product((0, 1), repeat=len(x))]
    p = min(1.0, 2 * min(np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])))
    assert got[1].p == pytest.approx(p) and got[1].n_used == 5 and got[2].p == 1.0


def test_wilcoxon_equals_all_signs(spark):
    """Every n up to 12, with ties, zeros and undefined values."""
    rnd = np.random.default_rng(2)
    rows = [(n, float(v)) for n in range(1, 13) for v in rnd.integers(-4, 6, n)] + [(3, None), (3, float("nan")), (5, 0.0)]
    got = {r.g: r for r in ST.wilcoxon(spark.createDataFrame(rows, "g int, delta double"), ["g"]).collect()}
    for n in range(1, 13):
        x = [v for g, v in rows if g == n and v]
        x = [v for v in x if v == v]
        rank = [np.mean([i + 1 for i, o in enumerate(sorted(map(abs, x))) if o == abs(v)]) for v in x]
        w = sum(r for v, r in zip(x, rank) if v > 0)
        sums = np.array(list(itertools.product((0, 1), repeat=len(x)))) @ np.array(rank) if x else np.zeros(1)
        p = min(1.0, 2 * min(np.mean(sums <= w), np.mean(sums >= w)))
        assert got[n].n_used == len(x) and got[n].w_plus == pytest.approx(w) and got[n].p == pytest.approx(p, rel=1e-12)


def test_wilcoxon_of_many_pairs(spark, monkeypatch):
    """2,000 differences in seconds, equal to whole-number counts; beyond the bound close to them."""
    n = 400
    ways = [1]  # counts of subsets of 1..n by their sum
    for r in range(1, n + 1):
        ways = [a + b for a, b in itertools.zip_longest(ways, [0] * r + ways, fillvalue=0)]
    up = set(range(1, n + 1, 3)) | set(range(200, 320))
    w = sum(up)
    want = 2 * min(sum(ways[: w + 1]), sum(ways[w:])) / 2**n
    rows = [("a", float(i if i in up else -i)) for i in range(1, n + 1)]
    rows += [("b", float(i if i % 9 < 5 else -i)) for i in range(1, 2001)]
    d = spark.createDataFrame(rows, "g string, delta double")
    t = time.time()
    got = {r.g: r for r in ST.wilcoxon(d, ["g"]).collect()}
    assert time.time() - t < 60
    assert got["a"].p == pytest.approx(want, rel=1e-11) and got["b"].n_used == 2000 and 0 < got["b"].p < 1
    monkeypatch.setattr(ST, "EXACT_PAIRS", 10)
    near = {r.g: r for r in ST.wilcoxon(d, ["g"]).collect()}
    assert near["a"].p == pytest.approx(got["a"].p, rel=0.05) and near["b"].p == pytest.approx(got["b"].p, rel=0.05)
    assert ST.wilcoxon(d.where("g = 'a'"), []).first()["n_used"] == n and ST.wilcoxon(d.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("stratum", [[], ["s"]])
def test_bootstrap_arrays_equal_ranks(spark, monkeypatch, stratum):
    """Small and large groups take different ways to the same draws."""
    rnd = np.random.default_rng(3)
    rows = [("big", i, i % 2, float(rnd.normal())) for i in range(60)] + [("small", i, i % 3, float(rnd.normal())) for i in range(7)] + [("small", 99, 0, None)]
    d = spark.createDataFrame(rows, "g string, u int, s int, v double")
    run = lambda: {(r.g, r._b): r.boot_mean for r in ST.bootstrap_means(d, ["g"], "v", "u", 120, 5, stratum).collect()}
    arrays = run()
    assert len(arrays) == 240
    for most in (10, 0):
        monkeypatch.setattr(ST, "GROUP_UNITS", most)
        assert run() == pytest.approx(arrays)
    key = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
    if not stratum:
        vals = [r[3] for r in sorted((r for r in rows if r[0] == "small" and r[3] is not None), key=lambda r: (key(5, "boot", r[1]), r[1]))]
        for i in range(120):
            assert arrays["small", i] == pytest.approx(np.mean([vals[int(key(5, "small", i, s) / 2**32 * 7)] for s in range(1, 8)]))


def test_bootstrap_single_unit(spark):
    d = spark.createDataFrame([("g", 1, 0.25)], "g string, u int, v double")
    r = ST.bootstrap_ci(d, ["g"], "v", "u", 50).first()
    assert (r.ci_low, r.ci_high, r.units) == (0.25, 0.25, 1)


def cells(spark, fn, units=((1, 1),)):
    rows = [(c, s, p, q, d, float(fn(p, q, d))) for c, s in units for p, q, d in itertools.product((0, 1), repeat=3)]
    return spark.createDataFrame(rows, "construction long, seed long, p int, s int, d int, v double")


def test_contrast_divisors(spark):
    d = cells(spark, lambda p, s, d: 3 * p + 5 * p * s + 7 * p * s * d)
    got = {r.effect: r.value for r in FA.factor_contrast(d, ["construction"], "v").collect()}
    assert got["P"] == pytest.approx(3 + 2.5 + 7 / 4) and got["PS"] == pytest.approx(5 + 3.5) and got["PSD"] == pytest.approx(7)
    assert got["corner"] == pytest.approx(15)
    with pytest.raises(Exception, match="lacks cells"):
        FA.factor_contrast(d.where("p + s + d < 3"), ["construction"], "v").collect()


def test_count_contrast_keeps_zero(spark):
    d = cells(spark, lambda p, s, d: 1).withColumn("n", F.lit(3))
    assert all(r.value == 0.0 and r.numerator == 0 for r in FA.count_contrast(d, ["construction"], "v", "n", FA.EFFECTS).collect())


def test_grid_faults_raise(spark):
    d = spark.createDataFrame([(i, j, 1.0, 5, 10) for i in (1, 2) for j in (1, 2)], "a int, b int, v double, k long, n long")
    levels = {"a": [1, 2], "b": [1, 2]}
    assert AU.assert_grid(d, levels, ["v"], {"k": "n"}).count() == 4
    broken = {
        "missing": d.where("a + b < 4"), "double": d.unionAll(d.limit(1)), "extra": d.unionAll(d.limit(1).withColumn("a", F.lit(9))),
        "not_finite": d.withColumn("v", F.lit(float("nan"))), "out_of_bounds": d.withColumn("k", F.lit(11).cast("long")),
    }
    for fault, x in broken.items():
        with pytest.raises(Exception, match=fault):
            AU.assert_grid(x, levels, ["v"], {"k": "n"}).collect()
    with pytest.raises(ValueError, match="columns missing"):
        AU.grid_report(d.drop("b"), levels)


@pytest.mark.parametrize("theta, want", [
    ([0.01, -0.01, 0.02, 0.0, 0.01, -0.02], "A"),
    ([0.5, 0.52, 0.49, 0.51, 0.5, 0.48], "B"),
    ([0.5, 0.5, 0.5, -0.5, -0.5, -0.5], "C"),
    ([0.3, -0.1, 0.4, 0.0, 0.2, 0.1], "D"),
])
def test_equivalence_branches(spark, theta, want):
    d = spark.createDataFrame([("g", i, x) for i, x in enumerate(theta)], "g string, construction int, theta double")
    assert FA.equivalence(d, ["g"], b=400).first().verdict == want


def test_utility_and_reliance(spark):
    rows = []
    for c, s, at in itertools.product((1, 2), (1, 2), ("gear", "rpm")):
        for arm, rel, v in (("rule", "intact", 0.6 + c / 1000), ("rule", "broken", 0.3), ("placebo", "intact", 0.64), ("placebo", "broken", 0.55)):
            rows.append((c, s, at, arm, rel, v))
    d = spark.createDataFrame(rows, "construction int, seed int, attack string, arm string, relation string, v double")
    u, t = FA.utility_reliance(d, "v")
    got = {r.construction: (r.U, r.L) for r in u.collect()}
    assert got[1] == pytest.approx((-0.039, 0.211)) and got[2] == pytest.approx((-0.038, 0.212))
    assert {r.endpoint: r.n for r in t.collect()} == {"U": 2, "L": 2}
