"""Exact top-k search by inner product as a Voronoi kNN join.

A vector x gets one more coordinate, the root of M - |x|^2 with M the largest
squared norm; a query gets zero there.  Then |q - x|^2 = |q|^2 + M - 2 q.x, so
the largest inner products are the nearest neighbours, and the triangle
inequality holds.

1. Every vector goes to the cell of its nearest pivot; queries likewise, by
   their own place.
2. Each cell of data is summed up by its number of rows, its radii and its
   least ``k + 1`` distances to the pivot; each cell of queries by its number
   and radius.  From these a cell of queries gets a bound that its k-th
   neighbour cannot exceed.
3. Near cells of queries form groups.  A row of data is sent to a group only if
   its distance to its own pivot leaves it within the bound of one of the cells.
4. A group meets its rows in chunks of bounded size; each chunk gives the best
   ``k`` of each query, and the best of these are the result.

What the driver and every task hold is bounded by ``MOST_PIVOTS``.  A cell with
very many queries is cut into parts of ``QUERIES``, rows of a group are dealt in
turn to chunks of about ``CHUNK``, so copies and hot cells spread evenly.

Defined cases: null vectors and those with null, NaN or infinite components
take no part; a shorter vector counts as padded with zeros, an empty one as all
zeros; rows without an id are no queries and come last among equal scores; rows
that repeat an id are queries of their own and candidates of each other; an
empty table gives an empty result; other columns are ignored.  Components of
2^23 and more raise, and so do scores that could leave the long range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from busline.llm.common import discard, landed
from busline.llm.vectors import blocks, lists, pack, unpack, usable, whole

K = 5
EVERY = 50
MOST_PIVOTS = 512
QUERIES = 4096  # of one group
CHUNK = 8192  # rows of data that a group meets at once
LIMIT = 1 << 31
EXACT = 1 << 53
SLACK = 1e-6  # of the largest distance, for rounding of bounds
BEST = "query long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, every: int) -> DataFrame:
    """(row, vec_id, is_query, vector, width, peak, norm) of the vectors that take part."""
    named = df.select("vec_id", "embedding").filter(usable("embedding"))
    named = named.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def run(batches):
        for batch in batches:
            longest = max([0, *batch.column("embedding").value_lengths().to_pylist()])
            for part in blocks(batch, longest):
                values, ends = lists(part.column("embedding"))
                x, size = whole(values, LIMIT), np.diff(ends, prepend=0)
                packed = pack(x, ends)
                y = unpack(packed, int(size.max(initial=0)))
                norm = (y.astype(float) ** 2).sum(1)
                peak = np.abs(y).max(1, initial=0)
                ids = part.column("vec_id")
                asks = pa.array([v is not None and v % every == 0 for v in ids.to_pylist()], pa.bool_())
                yield pa.record_batch([part.column("row"), ids, asks, packed, pa.array(size), pa.array(peak), pa.array(norm)], ["row", "vec_id", "is_query", "vector", "width", "peak", "norm"])

    return named.mapInArrow(run, "row long, vec_id long, is_query boolean, vector binary, width long, peak long, norm double")


class Pivots:
    """Distances to the pivots in the space with one more coordinate."""

    def __init__(self, vectors: np.ndarray, most: float):
        self.at, self.most = vectors.astype(float), most
        self.extra = np.sqrt(np.maximum(0, most - (self.at**2).sum(1)))
        self.apart = self.distances(self.at, self.extra)

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        flat = (x**2).sum(1)[:, None] + (self.at**2).sum(1) - 2 * x @ self.at.T
        return np.sqrt(np.maximum(0, flat + (extra[:, None] - self.extra) ** 2))

    def of_data(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return self.distances(x, np.sqrt(np.maximum(0, self.most - (x**2).sum(1))))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x.astype(float), np.zeros(len(x)))


def choose_pivots(vectors: DataFrame, n: int, width: int, most: float) -> Pivots:
    """``n`` distinct vectors of a sample of ``4 n`` by hash of the row."""
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(4 * n).select("vector").collect()
    seen = dict.fromkeys(bytes(r["vector"]) for r in sample)
    return Pivots(unpack(pa.array(list(seen)[:n], pa.binary()), width), most)


def in_cells(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """Cell and distance to its pivot of each row, as data and (queries only) as query."""
    width = pivots.at.shape[1]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, max(width, len(pivots.at))):
                x = unpack(part.column("vector"), width)
                d, asks = pivots.of_data(x), np.asarray(part.column("is_query"))
                cell = d.argmin(1)
                q = pivots.of_queries(x)
                near = q.argmin(1)
                rows = np.arange(len(x))
                yield pa.record_batch(
                    [part.column("row"), part.column("vec_id"), part.column("vector"), pa.array(cell, pa.int32()), pa.array(d[rows, cell]),
                     pa.array(near, pa.int32(), mask=~asks), pa.array(q[rows, near], mask=~asks)],
                    ["row", "vec_id", "vector", "cell", "far", "query_cell", "query_far"],
                )

    return vectors.select("row", "vec_id", "vector", "is_query").mapInArrow(run, "row long, vec_id long, vector binary, cell int, far double, query_cell int, query_far double")


class Plan:
    """Groups of query cells, and which distances of each data cell they need."""

    def __init__(self, pivots: Pivots, data: list, least: list, queries: list, k: int):
        n = len(pivots.at)
        slack = SLACK * (1 + math.sqrt(pivots.most))
        apart = pivots.apart
        rows, low, high = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for r in data:
            rows[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        near = [(r["cell"], r["far"]) for r in least]  # the k + 1 nearest rows of each cell
        cells = [(r["query_cell"], r["n"], r["high"]) for r in queries]
        need_low, need_high = {}, {}
        for i, _, radius in cells:
            reach = sorted(radius + apart[i, j] + far for j, far in near)
            # one of the k + 1 may be the query itself
            bound = reach[k] if len(reach) > k else np.inf
            need_low[i] = apart[i] - radius - bound - slack
            need_high[i] = apart[i] + radius + bound + slack
        self.group_of: dict[int, int] = {}
        self.parts: list[int] = []
        left = {i: m for i, m, _ in cells}
        bounds = []
        while left:
            start = max(left, key=lambda i: (left[i], -i))
            group, size = [], 0
            for i in sorted(left, key=lambda j: (apart[start, j], j)):
                if group and size + left[i] > QUERIES:
                    break
                group.append(i)
                size += left[i]
            for i in group:
                self.group_of[i] = len(self.parts)
                del left[i]
            self.parts.append(-(-size // QUERIES))
            bounds.append((np.min([need_low[i] for i in group], 0), np.max([need_high[i] for i in group], 0)))
        self.low = np.array([b[0] for b in bounds]).reshape(-1, n)
        self.high = np.array([b[1] for b in bounds]).reshape(-1, n)
        touched = (self.low <= high) & (self.high >= low)
        self.chunks = [max(1, -(-int(rows[t].sum()) // CHUNK)) for t in touched]


def _deal(columns: dict, group: int, part: int, chunk) -> pa.RecordBatch:
    n = len(columns["row"])
    names = {"part_of": pa.array(np.full(n, group, np.int32)), "part": pa.array(np.full(n, part, np.int32)), "chunk": pa.array(chunk, pa.int32())}
    return pa.record_batch([*names.values(), *columns.values()], [*names, *columns])


def data_for_groups(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row of data for each part of each group that needs it, with the chunk it falls into."""

    def run(batches):
        ctx = TaskContext.get()
        turn = (ctx.partitionId() if ctx else 0) * 7919
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            for group, parts in enumerate(plan.parts):
                at = np.flatnonzero((far >= plan.low[group][cell]) & (far <= plan.high[group][cell]))
                if len(at):
                    picked = {c: batch.column(c).take(pa.array(at)) for c in ("row", "vec_id", "vector")}
                    for part in range(parts):
                        yield _deal(picked, group, part, (turn + at) % plan.chunks[group])
            turn += batch.num_rows

    return rows.mapInArrow(run, "part_of int, part int, chunk int, row long, vec_id long, vector binary")


def queries_for_groups(rows: DataFrame, plan: Plan) -> DataFrame:
    """Each query once for every chunk of its group."""
    spark = rows.sparkSession
    facts = [(c, g, plan.parts[g], plan.chunks[g]) for c, g in plan.group_of.items()]  # one per pivot at most
    facts = spark.createDataFrame(facts, "query_cell int, part_of int, parts int, chunks int")
    asks = rows.filter("query_cell is not null").join(F.broadcast(facts), "query_cell")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return asks.select("part_of", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "row", "vec_id", "vector")


def _order(ids: pa.Array) -> np.ndarray:
    """Ascending ids, nulls last."""
    missing = np.asarray(ids.is_null())
    return np.lexsort([np.asarray(ids.fill_null(0)), missing])


def best_of(data: pa.Table, queries: pa.Table, k: int, width: int, bound: float) -> pa.Table:
    """The ``k`` best rows of ``data`` for each query, its own row left out."""
    data, queries = data.combine_chunks(), queries.combine_chunks()
    ids = data.column("vec_id").combine_chunks()
    order = _order(ids)
    kind = np.float64 if bound < EXACT else np.int64
    x = unpack(data.column("vector"), width)[order].astype(kind)
    q = unpack(queries.column("vector"), width).astype(kind)
    row, own = np.asarray(data.column("row"))[order], np.asarray(queries.column("row"))
    ids = ids.take(pa.array(order))
    n, m = len(x), min(k, len(x))
    asked, found, scores = [], [], []
    step = max(1, (4 << 20) // max(1, n))
    for at in range(0, len(q), step):
        score = q[at : at + step] @ x.T
        self_at = row == own[at : at + step, None]
        if bound * n < EXACT:
            rank = score * n - np.arange(n)  # smaller ids first among equal scores
            rank[self_at] = -np.inf
            top = np.argpartition(-rank, m - 1, axis=1)[:, :m]
        else:
            top = np.argsort(np.where(self_at, np.iinfo(np.int64).max, -score.astype(np.int64)), axis=1, kind="stable")[:, :m]
        line = np.repeat(np.arange(len(score)), m)
        top = top.ravel()
        keep = ~self_at[line, top]
        asked.append(at + line[keep])
        found.append(top[keep])
        scores.append(score[line, top][keep].astype(np.int64))
    asked, found = np.concatenate(asked), np.concatenate(found)
    return pa.table([queries.column("row").take(pa.array(asked)), queries.column("vec_id").take(pa.array(asked)), ids.take(pa.array(found)), pa.array(np.concatenate(scores))], ["query", "query_id", "vec_id", "score"])


def top_products(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, equal ones by smaller vec_id."""
    vectors = landed(integer_vectors(df, every), "voronoi-vectors")
    facts = vectors.agg(F.max("width").alias("width"), F.max("peak").alias("peak"), F.max("norm").alias("norm"), F.count("*").alias("n"), F.count_if("is_query").alias("queries")).first()
    if not facts["queries"]:
        return vectors.limit(0).selectExpr("vec_id as query_id", "0 as rank", "vec_id", "vec_id as score")
    width = max(1, facts["width"])
    bound = width * float(facts["peak"]) ** 2
    if bound >= 2**63:
        raise ValueError("inner products could leave the range of a long")
    pivots = choose_pivots(vectors, min(MOST_PIVOTS, math.isqrt(facts["n"]) + 1), width, facts["norm"])
    rows = landed(in_cells(vectors, pivots), "voronoi-cells")
    discard(vectors)
    # summaries: a few rows for each of at most MOST_PIVOTS cells
    data = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    in_cell = W.partitionBy("cell").orderBy("far")
    least = rows.select("cell", "far", F.row_number().over(in_cell).alias("r")).filter(F.col("r") <= k + 1).select("cell", "far").collect()
    queries = rows.filter("query_cell is not null").groupBy("query_cell").agg(F.count("*").alias("n"), F.max("query_far").alias("high")).collect()
    plan = Plan(pivots, data, least, queries, k)
    keys = ["part_of", "part", "chunk"]
    sides = data_for_groups(rows, plan).groupBy(*keys).cogroup(queries_for_groups(rows, plan).groupBy(*keys))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        return best_of(left, right, k, width, bound)

    best = sides.applyInArrow(solve, BEST)
    by_query = W.partitionBy("query").orderBy(F.col("score").desc(), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
