import random
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from busline.operators import detect as DE
from busline.operators import profile as P
from busline.operators import windows as WN
from busline.plans import q_metrics as Q

KEYS = ["source_file", "start_index"]


@pytest.fixture
def grown(spark, monkeypatch):
    """Trees and depth of each forest that a query fits, on two classes that every feature separates."""
    y = (F.col("id") % 2).cast("int")
    wide = lambda names, y=y: [(y * 10 + F.rand(3)).alias(c) for c in names]
    d = spark.range(120).select((F.col("id") % 4).alias("part"), F.col("id").alias("start_index"), y.alias("y_binary"), y.alias("y_attack_type"), *wide(WN.FEATURES))
    d = d.select(F.concat(F.lit("src_"), F.floor(F.col("start_index") / 30).cast("string")).alias("source_file"), F.col("start_index").cast("string").alias("wkey"), "*").cache()
    monkeypatch.setattr(Q, "features", lambda t: d)
    monkeypatch.setattr(Q, "pool_features", lambda t: d.withColumn("wkey", F.concat("wkey", F.lit("|syn"))))
    monkeypatch.setattr(WN, "payload_correlations", lambda *a: d.select(*KEYS, *wide(WN.CORRELATIONS, F.col("y_binary"))))
    seen, real = [], DE.RandomForestClassifier
    monkeypatch.setattr(DE, "RandomForestClassifier", lambda **k: (seen.append((k["numTrees"], k["maxDepth"])), real(**k))[1])
    return seen


def test_forests_of_queries_have_full_size(grown):
    t = MagicMock()
    assert {(r["y_attack_type"], r["pred_class"]): r["windows"] for r in Q.i4(t).collect()} == {(0, 0): 60, (1, 1): 60}
    assert [r["agreement"] for r in Q.i6(t).collect()] == [1.0, 1.0]
    for r in Q.i7(t).collect():
        assert all(r[f"{s}_recall"] == 1.0 and r[f"{s}_fpr"] == 0.0 for s in "ab")
    assert grown == [(160, 30), (100, 30), (160, 30), (160, 30)]
    assert {r["windows"] for r in Q.i5(t).collect()} == {60}
    assert grown[4:] == [(100, 30)]


def test_forest_in_batches(spark, monkeypatch):
    """A table whose trees pass the node limit is fitted in batches: as many trees, each batch of few nodes, votes of all of them."""
    d = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    d = d.withColumn("y", ((F.col("a") + F.rand(4) / 2 > 0.7).cast("int") + (F.col("b") > 0.8).cast("int"))).cache()
    monkeypatch.setattr(DE, "FOREST_NODES", 1000)
    seen, real = [], DE.RandomForestClassifier.fit
    monkeypatch.setattr(DE.RandomForestClassifier, "fit", lambda self, t: (seen.append(real(self, t)), seen[-1])[1])
    model = DE.fit_forest(d, ["a", "b", "c"], "y", trees=12)
    assert len(seen) > 2 and sum(m.getNumTrees for m in seen) == 12 and max(m.totalNumNodes for m in seen) <= 1000
    x = model.vectors.transform(d)
    votes = [{r.id: r.v for r in m.transform(x).select("id", DE.vector_to_array("rawPrediction").alias("v")).collect()} for m in seen]
    got = {r.id: r for r in DE.score_forest(d, model).collect()}
    assert len(got) == 600
    for i, r in got.items():
        want = np.sum([v[i] for v in votes], axis=0) / 12
        assert np.allclose(r.probs, want) and r.score == pytest.approx(1 - want[0])


def test_quality_counts_long_ids(spark):
    """Ids beyond the 2049 bins count: sides that share no id are one bit apart, and their entropy is that of all ids."""
    real, syn = frames_of(spark, 1, [5, 3000, 70000, 80000], 0.3), frames_of(spark, 2, [6, 4000], 0.2)
    r = P.synthetic_quality(real, syn, spark.createDataFrame([(None,)], "auc double"), ["w"]).first()
    p = real.toPandas().can_id.value_counts(normalize=True)
    assert r.can_id_js == pytest.approx(1.0, abs=1e-6) and r.real_can_id_entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-6)


def test_smoothed_entropy_has_no_bins_beyond(spark):
    """Values outside the bins belong to the total only."""
    c = spark.createDataFrame([("a", 0, 2), ("a", 7, 1), ("a", 8, 1), ("a", -1, 4)], "d string, v int, n long")
    q = (np.array([2, 0, 0, 0, 0, 0, 0, 1]) / 8 + P.EPS) / (1 + 8 * P.EPS)
    got = P.entropy_of(c, ["d"], bins=8, value="v").first().entropy
    assert got == pytest.approx(float(-(q * np.log2(q)).sum()), abs=1e-12)


def audit_windows(spark, shift, n=240):
    """Windows of two classes in blocks of four; ``shift`` moves the first feature of the synthetic ones of class 2."""
    i = F.col("id")
    cls = (F.floor(i / 4) % 2 + 1).cast("int")
    base = spark.range(n).select("id", cls.alias("y_attack_type"), F.lit("s").alias("source_file"), (i * 64).alias("start_index"), (i * 64 + 63).alias("end_index"))
    real = base.select("*", F.concat(F.lit("r"), i.cast("string")).alias("wkey"), F.rand(1).alias("f0"), F.rand(2).alias("f1"))
    syn = base.select("*", F.concat(F.lit("p"), i.cast("string")).alias("wkey"), (F.rand(3) + F.when(cls == 2, shift).otherwise(0.0)).alias("f0"), F.rand(4).alias("f1"))
    return real, syn


def test_domain_audit_per_class(spark):
    """A class that the domains share has an AUC near a half, one that differs has 1."""
    real, syn = audit_windows(spark, 2.0)
    got = {r["class"]: r for r in DE.domain_audit(real, syn, ["f0", "f1"], ["source_file"], "wkey", 256, classes=(1, 2), trees=40).collect()}
    assert set(got) == {"all", "1", "2"} and got["2"].auc == 1.0 and 0.3 < got["1"].auc < 0.7 and got["1"].auc < got["all"].auc < 1.0
    assert {(r.train_windows, r.test_windows) for r in got.values()} == {(84, 36)}  # 70 and 30 % of 30 blocks of four
    few = {(r.train_windows, r.test_windows) for r in DE.domain_audit(real, syn, ["f0", "f1"], ["source_file"], "wkey", 256, classes=(1, 2), most=20, trees=2).collect()}
    assert few == {(14, 6)}
    with pytest.raises(ValueError, match="too few windows"):
        DE.domain_audit(real, syn.where("y_attack_type = 1"), ["f0", "f1"], ["source_file"], "wkey", 256, classes=(1, 2))


def test_audit_parts_share_no_block(spark, monkeypatch):
    real, syn = audit_windows(spark, 0.0)
    seen = []
    fit = DE.fit_forest
    monkeypatch.setattr(DE, "fit_forest", lambda d, *a, **k: (seen.append(d.groupBy("y").count().collect()), fit(d, *a, **k))[1])
    parts = DE.S.purged_split(real, 256, 42, ["source_file"], test_share=0.3).select("group", "part").distinct().collect()
    assert len({r.group for r in parts}) == len(parts)
    DE.domain_audit(real, syn, ["f0", "f1"], ["source_file"], "wkey", 256, classes=(1, 2), trees=2).collect()
    assert [sorted((r.y, r["count"]) for r in s) for s in seen] == [[(0, 168), (1, 168)], [(0, 84), (1, 84)], [(0, 84), (1, 84)]]


def test_held_out_part_is_stratified(spark):
    d = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") < 60).cast("int").alias("y"))
    train, test = DE._held_out(d, "y", "k", 0.3, 5)
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 282, 1: 18}
    assert train.count() == 700 and train.join(test, "k").count() == 0


QUALITY = "can_id int, delta_t double, data0 int, data1 int, data2 int, data3 int, data4 int, data5 int, data6 int, data7 int, w int"


def frames_of(spark, seed, ids, top, n=640):
    rnd = random.Random(seed)
    return spark.createDataFrame([(rnd.choice(ids), rnd.random() * top, *[rnd.randrange(256) for _ in range(8)], i // 64) for i in range(n)], QUALITY)


def test_synthetic_quality_row(spark):
    """Values of every cell against numpy on small tables."""
    real, syn = frames_of(spark, 1, [5, 9, 700], 0.3), frames_of(spark, 2, [5, 9, 30, 2047], 0.2)
    auc = spark.createDataFrame([(0.75,)], "auc double")
    r = P.synthetic_quality(real, syn, auc, ["w"]).first()
    a, b = real.toPandas(), syn.toPandas()
    cols = [f"data{i}" for i in range(8)]
    eps = P.EPS

    def share(x, edges):
        h = np.histogram(x, bins=edges)[0].astype(float)
        h = h / max(h.sum(), 1) + eps
        return h / h.sum()

    def js(p, q):
        m = (p + q) / 2
        return float((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2

    def distance(x, y):
        v = np.sort(np.concatenate([x, y]))
        f = lambda z: np.searchsorted(np.sort(z), v[:-1], side="right") / len(z)
        return float((np.abs(f(x) - f(y)) * np.diff(v)).sum())

    ids, byte = np.arange(2050), np.arange(258)
    entropy = lambda p: float(-(p * np.log2(p)).sum())
    flat = lambda t: t[cols].to_numpy().ravel()
    assert (r.real_windows, r.synthetic_windows) == (10, 10)
    assert r.can_id_js == pytest.approx(js(share(a.can_id, ids), share(b.can_id, ids)), abs=1e-9)
    assert r.delta_t_js == pytest.approx(js(share(a.delta_t, P.DT_EDGES), share(b.delta_t, P.DT_EDGES)), abs=1e-9)
    assert r.payload_js == pytest.approx(js(share(flat(a), byte), share(flat(b), byte)), abs=1e-9)
    assert r.can_id_wasserstein == pytest.approx(distance(a.can_id, b.can_id)) and r.delta_t_wasserstein == pytest.approx(distance(a.delta_t, b.delta_t))
    assert r.payload_wasserstein == pytest.approx(distance(flat(a), flat(b)))
    assert r.real_can_id_entropy == pytest.approx(entropy(share(a.can_id, ids))) and r.synthetic_can_id_entropy == pytest.approx(entropy(share(b.can_id, ids)))
    assert r.real_payload_entropy == pytest.approx(entropy(share(flat(a), byte))) and r.synthetic_payload_entropy == pytest.approx(entropy(share(flat(b), byte)))
    assert r.real_delta_t_mean == pytest.approx(a.delta_t.mean()) and r.synthetic_delta_t_mean == pytest.approx(b.delta_t.mean())
    means = [(a[a.can_id == i].delta_t.mean(), b[b.can_id == i].delta_t.mean()) for i in (5, 9)]
    assert r.periodicity_mae == pytest.approx(np.mean([abs(x - y) for x, y in means])) and r.real_vs_synthetic_auc == 0.75


def test_batch_of_one_tree_draws_features(spark, monkeypatch):
    """A tree that grows alone looks at a draw of the features like any other: not each root is the one feature that separates."""
    y = (F.col("id") % 2).cast("int")
    d = spark.range(400).select(y.alias("y"), (y * 10 + F.rand(1)).alias("f0"), *[F.rand(i + 2).alias(f"f{i}") for i in range(1, 16)]).cache()
    monkeypatch.setattr(DE, "FOREST_NODES", 1)
    seen, real = [], DE.RandomForestClassifier.fit
    monkeypatch.setattr(DE.RandomForestClassifier, "fit", lambda self, t: (seen.append(real(self, t)), seen[-1])[1])
    DE.fit_forest(d, [f"f{i}" for i in range(16)], "y", trees=8)
    assert [m.getNumTrees for m in seen] == [1] * 8 and max(m.totalNumNodes for m in seen) > 3
