"""Span-wise operators against plain Python on small spans, so that every span edge is crossed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from busline.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # Group 'hot' holds most rows; values carry many ties.
    return [("hot" if rnd.random() < 0.8 else "cold", i, rnd.randrange(12) / 4, rnd.randrange(5)) for i in range(400)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, i long, v double, n long").repartition(5)


def by_group(rows):
    out = {}
    for g, i, v, n in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, v, n))
    return out


def test_previous_is_lag(df, rows):
    got = {r.i: r.p for r in O.previous(df, ["g"], "i", {"p": "v"}, span=7).collect()}
    for items in by_group(rows).values():
        prev = None
        for i, v, _ in items:
            assert got[i] == prev
            prev = v


def test_ranked_and_prefix_sums(df, rows):
    d = O.ranked(df, ["g"], ["i"], O.span_of("i", 11))
    got = {r.i: r["rank"] for r in d.collect()}
    for items in by_group(rows).values():
        assert [got[i] for i, _, _ in items] == list(range(1, len(items) + 1))
    p = O.prefix_sums(df.withColumn("_span", O.span_of("i", 11)), ["g"], ["i"], {"s": "n"}, descending=True)
    got = {r.i: (r.s, r.s_total) for r in p.collect()}
    for items in by_group(rows).values():
        total = sum(n for *_, n in items)
        run = 0
        for i, _, n in reversed(items):
            run += n
            assert got[i] == (run, total)


@pytest.mark.parametrize("span", [1, 3, 50, 1000])
def test_islands(df, rows, span):
    d = O.islands(df, ["g"], "i", "v", lambda p, c: c < p, "run", "pos", span)
    got = {r.i: (r.run, r.pos) for r in d.collect()}
    for items in by_group(rows).values():
        run, pos, prev = 0, -1, None
        for i, v, _ in items:
            if prev is not None and v < prev:
                run, pos = run + 1, -1
            pos += 1
            assert got[i] == (run, pos)
            prev = v


def test_carry_last(df, rows):
    d = O.carry_last(df, ["g"], "i", F.when(F.col("n") == 0, F.col("v")), "last", span=5)
    got = {r.i: r["last"] for r in d.collect()}
    for items in by_group(rows).values():
        last = None
        for i, v, n in items:
            last = v if n == 0 else last
            assert got[i] == last


@pytest.mark.parametrize("splits", [[], [0.5, 1.0, 2.0], None])
def test_exact_quantiles(df, rows, splits):
    numpy = pytest.importorskip("numpy")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.g: r for r in O.exact_quantiles(df, ["g"], "v", probs, splits).collect()}
    for g, items in by_group(rows).items():
        v = [x for _, x, _ in items]
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(numpy.quantile(v, p))


def test_quantiles_of_nothing(df):
    assert O.exact_quantiles(df.where("i < 0"), ["g"], "v", {"q": 0.5}, []).count() == 0


@pytest.fixture(scope="module")
def tied():
    """One group with most rows, 95 % of them with one score; scales of the groups lie far apart."""
    rnd = random.Random(9)
    score = lambda: 0.5 if rnd.random() < 0.95 else rnd.random()
    rows = [("hot", i, score()) for i in range(6000)] + [("far", 10_000 + i, 1e6 * score()) for i in range(900)]
    rows += [("hot", 20_000, 0.7)] * 3 + [("hot", 20_001, None), ("cold", 20_002, 0.1), ("cold", 20_003, float("nan"))]
    rnd.shuffle(rows)
    return rows


def test_spans_of_ties_are_even(spark, tied):
    df = spark.createDataFrame(tied, "g string, i long, v double").repartition(7)
    for order in (["g", "v", "i"], ["g", "v"]):
        sizes = [r["count"] for r in O.ranged(df, order, parts=20).groupBy("_span").count().collect()]
        assert len(sizes) == 20 and max(sizes) < 2 * len(tied) / 20
    same = spark.range(5000).selectExpr("'g' as g", "1.0 as v")
    sizes = [r["count"] for r in O.ranged(same, ["g", "v"], parts=20).groupBy("_span").count().collect()]
    assert max(sizes) < 2 * 5000 / 20


def test_ranks_of_ties(spark, tied):
    df = spark.createDataFrame(tied, "g string, i long, v double").repartition(7)
    got = sorted((r.g, r["rank"], r.i, r.rank_total) for r in O.ranked_by_value(df, ["g"], "v", ["i"]).collect())
    want = []
    for g in ("cold", "far", "hot"):
        own = sorted((r for r in tied if r[0] == g), key=lambda r: (r[2] is None, r[2] != r[2], r[2] if r[2] == r[2] else 0, r[1]))
        want += [(g, n, r[1], len(own)) for n, r in enumerate(own, 1)]
    assert got == want


def test_average_ranks_return_to_their_rows(spark, tied):
    df = spark.createDataFrame(tied, "g string, i long, v double").repartition(7)
    got = [(r.g, r.i, r.r) for r in O.join_ties(df, O.average_ranks(df, ["g"], "v", "r"), ["g", "v"]).collect()]
    want = []
    for g in ("cold", "far", "hot"):
        own = [r for r in tied if r[0] == g and r[2] is not None]
        key = lambda v: (v != v, v if v == v else 0)
        for _, i, v in own:
            less, same = sum(key(r[2]) < key(v) for r in own), sum(key(r[2]) == key(v) for r in own)
            want.append((g, i, less + (same + 1) / 2))
    assert sorted(got) == sorted(want)
    plan = O.join_ties(df, O.average_ranks(df, ["g"], "v", "r"), ["g", "v"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_facts_do_not_gather_a_group(spark):
    """Facts of a group are sent to its rows: no shuffle deals frames by their source alone."""
    from busline.operators import timeline as TL
    from busline.operators import windows as WN

    d = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("source_file"), F.col("id").alias("idx"), F.col("id").alias("row_in_source"), (F.col("id") % 50).alias("can_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        for made in (WN.window_id_counts(d, ["source_file"]), TL.assign_split_fraction(d)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(source_file#\d+, \d+\)", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_default_span_is_a_small_task(spark):
    most = spark.range(300_000).groupBy(O.span_of("id")).count().agg(F.max("count")).first()[0]
    assert most <= 1 << 16
