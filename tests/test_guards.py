"""Results that must not fall short without a word, and groups too small for a statistic."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from busline.operators import audit as AU
from busline.operators import augment as A
from busline.operators import factorial as FA
from busline.operators import metrics as ME
from busline.operators import ordered as O
from busline.operators import stats as ST
from busline.operators import timeline as TL


def test_ordered_digest_is_one_row_for_any_size(spark):
    for n in (1, 2, 20):
        d = spark.createDataFrame([(i, 1, f"{i:064x}") for i in range(1, n + 1)], "rank long, y_attack_type int, digest string")
        assert AU.ordered_digest(d, "rank", fan=2).count() == 1
    swapped = d.withColumn("rank", F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")))
    assert AU.ordered_digest(d, "rank", fan=2).first() != AU.ordered_digest(swapped, "rank", fan=2).first()


def test_slices_need_enough_normals(spark):
    d = spark.range(30).select(F.col("id").cast("string").alias("wkey"))
    assert A.take_slices(d, [20, 5, 5], 1).count() == 30
    with pytest.raises(ValueError, match="not enough normal windows"):
        A.take_slices(d, [20, 10, 10], 1)


def test_bootstrap_leaves_out_what_is_not_finite(spark):
    rows = [("a", 1, 0.1), ("a", 2, 0.3), ("a", 3, math.nan), ("a", 4, None), ("a", 5, math.inf), ("b", 6, 0.5)]
    d = spark.createDataFrame(rows, "g string, u int, v double").withColumn("s", F.lit("x"))
    out = {r.g: r for r in ST.bootstrap_ci(d, ["g"], "v", "u", 50).collect()}
    assert (out["a"].units, out["a"].undefined) == (2, 3) and out["a"].mean == pytest.approx(0.2)
    assert 0.1 <= out["a"].ci_low <= out["a"].ci_high <= 0.3
    assert (out["b"].ci_low, out["b"].ci_high) == (0.5, 0.5)
    out = {r.g: r for r in ST.bootstrap_ci(d, ["g"], "v", "u", 50, stratum=["s"]).collect()}
    assert out["a"].ci_low is not None and (out["b"].ci_low, out["b"].ci_high, out["b"].units) == (None, None, 1)


def test_groups_without_normals_keep_their_rows(spark):
    d = spark.createDataFrame([("a", 0.4), ("b", 0.9), ("b", 1.0)], "g string, score double")
    thr = spark.createDataFrame([("a", 0.3)], "g string, threshold double")
    assert sorted((r.g, r.score, r.pred) for r in ME.apply_threshold(d, thr, ["g"]).collect()) == [("a", 0.4, 1), ("b", 0.9, 0), ("b", 1.0, 1)]


def test_verdict_needs_all_effects(spark):
    rows = [("x", e, 0.0, 1.0, False, 2, 2) for e in FA.EFFECTS]
    schema = "arm string, effect string, mean double, holm_p double, degenerate boolean, positive int, negative int"
    assert FA.verdict(spark.createDataFrame(rows, schema), ["arm"]).first().verdict == "F-UNRESOLVED"
    with pytest.raises(Exception, match="lacks effects"):
        FA.verdict(spark.createDataFrame(rows[:-1], schema), ["arm"]).collect()


def test_file_ranks_under_one_root(spark):
    paths = [f"s3a://bucket/a/long/common/root/of/all/logs/{i:05d}.csv" for i in range(200)]
    out = TL.split_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r.path for r in out if r.role == "calibration"} == set(paths[::5])


def test_file_ranks_under_two_roots(spark):
    """Spans come from the paths themselves, wherever they differ."""
    paths = [f"s3a://one/a/long/common/root/of/all/logs/{i:05d}.csv" for i in range(990)] + [f"hdfs://two/b/{i}.csv" for i in range(10)]
    d = spark.createDataFrame([(p,) for p in paths], "path string").repartition(6)
    out = TL.split_files(d).collect()
    assert {r.path for r in out if r.role == "calibration"} == set(sorted(paths)[::5])
    sizes = [r["count"] for r in O.ranged(d, ["path"], parts=20).groupBy("_span").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * len(paths) / 20


def test_spans_follow_the_partitions(spark):
    d = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    assert 200 < len(O.value_splits(d, "v", 300)) <= 299 and len(O.value_splits(d, "v")) <= 63
