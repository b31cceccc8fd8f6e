"""Clustering, top-k search and resampling against brute force on small tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from busline.llm import crc_resampling as crc
from busline.llm import simplex_clusters as simplex
from busline.llm import voronoi_join as voronoi
from busline.llm.vectors import pack, unpack

ROWS = "vec_id long, embedding array<float>, label int, row string, cell int, cluster int, `query` string"


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r", 1, 9, "q") for i, v in rows], ROWS)


def some(n, dim, seed, spread=0.12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.12, (6, dim))
    return [(middle[rng.integers(6)] + rng.normal(0, spread, dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    """Copies for a third of the rows, equal ids, no id, and vectors that take no part."""
    good = some(240, 8, 1)
    rows = list(enumerate(good))
    rows += [(1000 + i, good[5]) for i in range(120)]
    rows += [(7, good[9]), (None, good[3]), (50, good[50]), (50, [0.0] * 8), (-100, good[1])]
    bad = [(2000, None), (2050, good[0][:7] + [None]), (2100, good[0][:7] + [float("nan")]), (2150, good[0][:7] + [float("-inf")])]
    return rows, bad


def brute_clusters(rows, k, rounds):
    digest = lambda i: ("~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    x = [(i, floors(v), v) for i, v in rows]
    first = sorted(x, key=lambda r: (digest(r[0]), [float(np.float32(c)) for c in r[2]]))[:k]
    centroids = [list(r[1]) for r in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        got = [near(v) for _, v, _ in x]
        for j in range(len(centroids)):
            own = [v for (_, v, _), (_, c) in zip(x, got) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    got = [near(v) for _, v, _ in x]
    inertia = Counter()
    for d, j in got:
        inertia[j] += d
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, j, d, inertia[j], sum(inertia.values()), name(centroids[j])) for (i, _, _), (d, j) in zip(x, got)]


def text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize(("k", "pivots"), [(6, 5), (400, 3), (1, 1)])
def test_clusters_equal_brute_force(spark, odd, k, pivots):
    rows, bad = odd
    out = simplex.clusters(table(spark, [*rows, *bad, (3000, some(1, 9, 2)[0]), (3001, [])]), k=k, rounds=3, dim=8, pivots=pivots)
    assert text(tuple(r) for r in out.collect()) == text(brute_clusters(rows, k, 3))


def test_clusters_of_nothing(spark):
    out = simplex.clusters(table(spark, []), dim=8)
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert simplex.clusters(table(spark, [(1, None), (2, [1.0])]), dim=8).count() == 0
    only = simplex.clusters(table(spark, [(4, [0.5] * 8)]), dim=8).collect()
    assert [tuple(r)[:5] for r in only] == [(4, 0, 0, 0, 0)]


def test_components_too_large_for_a_long_raise(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        simplex.clusters(table(spark, [(1, [1e9] * 8)]), dim=8).collect()


def test_simplex_bounds_hold():
    rng = np.random.default_rng(5)
    for dim, pivots in ((3, 2), (8, 6), (8, 8), (16, 4)):
        x, c, p = (rng.integers(-200, 200, (n, dim)) for n in (200, 12, pivots))
        p = np.vstack([p, p[:1]])  # a pivot twice
        s = simplex.Simplex(p)
        assert len(s.pivots) <= pivots
        over = s.apex(simplex.squared(c, s.pivots).astype(float))
        apex = s.apex(simplex.squared(x, s.pivots).astype(float))
        d = np.sqrt(simplex.squared(x, c))
        inside = ((apex[:, None, :-1] - over[None, :, :-1]) ** 2).sum(2)
        low = np.sqrt(inside + (apex[:, None, -1] - over[None, :, -1]) ** 2)
        high = np.sqrt(inside + (apex[:, None, -1] + over[None, :, -1]) ** 2)
        assert (low <= d + 1e-3).all() and (high >= d - 1e-3).all()
        cluster, least, compared = simplex.nearest(x, apex, c, over)
        assert (cluster == d.argmin(1)).all() and (least == (d.min(1) ** 2).round()).all()
        if dim == pivots:
            assert compared < d.size / 2  # pivots that span the space leave few


def brute_top(rows, k, every):
    x = [(i, floors(v)) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(x):
        if i is not None and i % every == 0:
            found = [(-sum(s * t for s, t in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(x) if a != b]
            out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


@pytest.mark.parametrize(("k", "every", "queries", "chunk"), [(5, 50, 4096, 8192), (3, 2, 7, 16), (1, 1, 50, 40)])
def test_top_products_equal_brute_force(spark, odd, monkeypatch, k, every, queries, chunk):
    monkeypatch.setattr(voronoi, "QUERIES", queries)
    monkeypatch.setattr(voronoi, "CHUNK", chunk)
    rows, bad = odd
    rows = [*rows, (3000, some(1, 9, 2)[0]), (3050, []), (3100, [2.5])]
    out = voronoi.top_products(table(spark, [*rows, *bad]), k=k, every=every)
    assert text(tuple(r) for r in out.collect()) == text(brute_top(rows, k, every))


def test_top_products_of_few_rows(spark):
    assert voronoi.top_products(table(spark, [])).collect() == []
    assert voronoi.top_products(table(spark, [(50, None), (51, [1.0])])).collect() == []
    assert voronoi.top_products(table(spark, [(50, [1.0])])).collect() == []
    got = voronoi.top_products(table(spark, [(50, [1.0]), (3, [-1.0]), (2, [-1.0])])).collect()
    assert [tuple(r) for r in got] == [(50, 1, 2, -65536), (50, 2, 3, -65536)]


def test_far_cells_are_not_sent(spark, monkeypatch):
    """Two far bunches: each group of queries needs rows of its own bunch only."""
    monkeypatch.setattr(voronoi, "QUERIES", 4)
    near = lambda at, n, seed: [[at + x for x in v] for v in some(n, 4, seed, 0.01)]
    rows = [*enumerate(near(10.0, 200, 1)), *((1000 + i, v) for i, v in enumerate(near(-10.0, 200, 2)))]
    vectors = voronoi.integer_vectors(table(spark, rows), 50).cache()
    facts = vectors.agg({"norm": "max"}).first()[0]
    pivots = voronoi.choose_pivots(vectors, 20, 4, facts)
    cells = voronoi.in_cells(vectors, pivots).collect()
    data = [{"cell": c, "n": sum(r.cell == c for r in cells), "low": min(r.far for r in cells if r.cell == c), "high": max(r.far for r in cells if r.cell == c)} for c in {r.cell for r in cells}]
    least = [{"cell": c, "far": f} for c in {r.cell for r in cells} for f in sorted(r.far for r in cells if r.cell == c)[:6]]
    asks = [r for r in cells if r.query_cell is not None]
    queries = [{"query_cell": c, "n": sum(r.query_cell == c for r in asks), "high": max(r.query_far for r in asks if r.query_cell == c)} for c in {r.query_cell for r in asks}]
    plan = voronoi.Plan(pivots, data, least, queries, 5)
    sent = sum(plan.low[g][r.cell] <= r.far <= plan.high[g][r.cell] for r in cells for g in range(len(plan.parts)))
    assert len(plan.parts) > 1 and 0 < sent < 0.8 * len(cells) * len(plan.parts)


def test_best_of_without_room_in_doubles():
    data = pa.table({"row": [0, 1, 2, 3], "vec_id": pa.array([9, None, 4, 4], pa.int64()), "vector": pack(np.array([1, 2, 2, 2]), np.arange(1, 5))})
    asks = pa.table({"row": [2, 8], "vec_id": pa.array([4, 8], pa.int64()), "vector": pack(np.array([3, -1]), np.arange(1, 3))})
    for bound in (10.0, 2.0**52, 2.0**60):
        got = voronoi.best_of(data, asks, 3, 1, bound).to_pylist()
        assert [[r["query"], r["vec_id"], r["score"]] for r in sorted(got, key=lambda r: (r["query"], -r["score"], r["vec_id"] is None))] == [
            [2, 4, 6], [2, None, 6], [2, 9, 3], [8, 9, -1], [8, 4, -2], [8, 4, -2]]


def test_packed_vectors_return():
    values, ends = np.array([1, -2, 3, 4, 5]), np.array([2, 2, 5])
    assert unpack(pack(values, ends), 4).tolist() == [[1, -2, 0, 0], [0, 0, 0, 0], [3, 4, 5, 0]]
    assert unpack(pack(values, ends).slice(1, 2), 3).tolist() == [[0, 0, 0], [3, 4, 5]]


# ---- resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, key string, rank int, `row` long, n_words int, score int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_crcs_of_all_runs():
    rng = random.Random(4)
    letters = "abcz09éß日𝒜"
    own = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 40, 70, 200]))) for _ in range(300)]
    own.insert(100, "x" * 300_000)
    raw = [w.encode() for w in own]
    for n, got in enumerate(crc.gram_crcs(raw, 4), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(raw[i : i + n])) for i in range(len(raw) - n + 1)]
    assert [len(g) for g in crc.gram_crcs([], 2)] == [0, 0] and [len(g) for g in crc.gram_crcs([b"a"], 3)] == [1, 0, 0]


@pytest.mark.parametrize("text", ["", " -- ", "A-b_c\tÀ1'x", "\x00\x7f@[`{", "É é", "a\nb\n", None])
def test_words_of_text(text):
    assert [w.decode() for w in crc.cleaned(text).split()] == words(text)


@pytest.mark.parametrize("longest", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_long_texts_in_pieces(monkeypatch, longest, size):
    monkeypatch.setattr(crc, "PIECE", size)
    for raw in (b"a", b" a  bb ccc d " * 9, b"one" + b" x" * 50 + b"  ", b"   ", b"w" * 60 + b" v"):
        whole, _, n = crc.buckets_of([raw], 1000, longest)
        pieces, ends, m = crc.buckets_of_long(raw, 1000, longest)
        assert sorted(whole) == sorted(pieces) and ends.tolist() == [len(whole)] and n.tolist() == m.tolist()


def brute_resample(docs, items, share, least, buckets):
    features = lambda w: [zlib.crc32(x.encode()) % buckets for x in [*w, *(a + " " + b for a, b in zip(w, w[1:]))]]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(words(x)))
    for x in items:
        t.update(features(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = features(words(x))
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize(("share", "least", "buckets"), [(25, 20, 10_000), (100, 0, 50), (50, 1, 70_000), (0, 0, 10)])
def test_resample_equals_brute_force(spark, share, least, buckets):
    rng = random.Random(6)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(stock) + rng.choice(["", ",", "! "]) for _ in range(n))
    docs = [(i, prose(rng.randint(0, 60))) for i in range(150)]
    docs += [(500, docs[3][1])] * 70  # one id and text for a third of the rows
    docs += [(501, None), (502, ""), (503, " ;; "), (None, prose(30)), (None, prose(40)), (504, "Word"), (505, prose(20_000)), (7, prose(25))]
    items = [prose(12) for _ in range(9)] + [None, ""]
    d = spark.createDataFrame([(i, x, "en", "k", 1, 5, 3, 2) for i, x in docs], DOCS).repartition(5)
    b = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    out = crc.resample(d, b, share=share, least_words=least, buckets=buckets)
    assert text(tuple(r) for r in out.collect()) == text(brute_resample(docs, items, share, least, buckets))
    assert [t for _, t in out.dtypes] == ["bigint"] * 5


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert crc.resample(none, items).collect() == []
    docs = spark.createDataFrame([(1, "word " * 30, "", "", 0, 0, 0, 0)], DOCS)
    assert [tuple(r)[:3] for r in crc.resample(docs, items.limit(0), share=100).collect()] == [tuple(brute_resample([(1, "word " * 30)], [], 100, 20, 10_000)[0])[:3]]
