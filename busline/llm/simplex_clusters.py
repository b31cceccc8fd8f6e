"""Centroid clustering in whole numbers with n-simplex bounds.

A few vectors serve as pivots.  The squared distances of every vector to them
are computed once and kept.  Pivots span a simplex; the distances of a vector
fix an apex over it: coordinates inside the span of the pivots, and a height.
For two apexes the Euclidean distance is a lower bound of the true distance,
and that with one height turned over an upper bound.  A centroid whose lower
bound exceeds the least upper bound cannot be the nearest; the rest are
compared exactly in integers.

The table of vectors stays where it is: a round sends every task the centroids
(``k`` x ``dim`` numbers), and each task returns one sum per centroid.

Defined cases: null vectors, those with another number of components or with
null, NaN or infinite ones are left out; a vector without an id is clustered
but starts no cluster before all others have; rows that repeat an id are
vectors of their own, started in the order of their components; with fewer
than ``k`` vectors each starts a cluster; equal centroids and equal distances
go to the smaller number; an empty table gives an empty result; other columns
are ignored.  Components of 2^19 and more raise, as distances leave a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import landed
from busline.llm.vectors import blocks, lists, pack, unpack, usable, whole

K = 40
ROUNDS = 5
DIM = 64
PIVOTS = 48
LIMIT = 1 << 27
FLAT = 0.05  # a pivot nearer than this share of its distance to the span of those before it adds nothing
SLACK = 1e-6  # of the largest squared distance; rounding of bounds stays far below


class Simplex:
    """Coordinates of pivots, from their distances to each other alone."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots[:1]
        self.corners = np.zeros((1, 0))
        for p in pivots[1:]:
            d2 = squared(p[None], self.pivots)
            apex = self.apex(d2.astype(float))[0]
            if apex[-1] > FLAT * np.sqrt(d2.max()):
                self.pivots = np.vstack([self.pivots, p])
                self.corners = np.vstack([np.pad(self.corners, ((0, 0), (0, 1))), apex])

    def apex(self, d2: np.ndarray) -> np.ndarray:
        """Apex over the simplex from squared distances to the pivots; the last coordinate is the height."""
        base = self.corners[1:]
        right = (d2[:, :1] - d2[:, 1:] + (base**2).sum(1)) / 2
        inside = np.linalg.solve(base, right.T).T if len(base) else right
        return np.column_stack([inside, np.sqrt(np.maximum(0, d2[:, 0] - (inside**2).sum(1)))])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two integer matrices."""
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


def candidates(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which apexes ``c`` can be the nearest of each apex ``x``."""
    inside = (x[:, :-1] ** 2).sum(1)[:, None] + (c[:, :-1] ** 2).sum(1) - 2 * x[:, :-1] @ c[:, :-1].T
    low = inside + (x[:, -1:] - c[:, -1]) ** 2
    high = inside + (x[:, -1:] + c[:, -1]) ** 2
    return low <= high.min(1)[:, None] + SLACK * (1 + high.max())


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, and how many were compared exactly."""
    row, number = np.nonzero(candidates(apexes, over))
    d2 = ((x[row] - centroids[number]) ** 2).sum(1)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(d2, starts)
    hit = np.flatnonzero(d2 == least[row])  # row by row, smaller numbers first
    first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
    return number[first].astype(np.int32), least, len(row)


def vectors_of(df: DataFrame, dim: int) -> DataFrame:
    return df.select("vec_id", "embedding").filter((F.size("embedding") == dim) & usable("embedding"))


def first_vectors(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The ``n`` vectors with the least sha256 of ``<seed>:<vec_id>``."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("name", name).orderBy(F.asc_nulls_last("name"), "embedding").limit(n).collect()
    return np.array([whole(np.array(r["embedding"]), LIMIT) for r in rows], np.int64)


def with_pivot_distances(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """Packed integer components and squared distances to the pivots."""
    dim = simplex.pivots.shape[1]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, dim):
                values, ends = lists(part.column("embedding"))
                x = whole(values, LIMIT)
                d2 = squared(x.reshape(-1, dim), simplex.pivots)
                upto = np.arange(1, len(d2) + 1) * d2.shape[1]
                yield pa.record_batch([part.column("vec_id"), pack(x, ends), pack(d2.ravel(), upto, "<i8")], ["vec_id", "vector", "pivot_d2"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, vector binary, pivot_d2 binary")


def _assigned(batches, simplex: Simplex, centroids: np.ndarray):
    """(batch, vectors, cluster, distance) of each slice."""
    dim, m = simplex.pivots.shape[1], len(simplex.pivots)
    over = simplex.apex(squared(centroids, simplex.pivots).astype(float))
    for batch in batches:
        for part in blocks(batch, dim):
            x = unpack(part.column("vector"), dim)
            apexes = simplex.apex(unpack(part.column("pivot_d2"), m, "<i8").astype(float))
            cluster, distance, _ = nearest(x, apexes, centroids, over)
            yield part, x, cluster, distance


def moved(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the exact means; one without vectors stays."""
    k, dim = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x, cluster, _ in _assigned(batches, simplex, centroids):
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    flat = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    sums = flat.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k x dim rows
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def assigned(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for given centroids."""

    def run(batches):
        for part, _, cluster, distance in _assigned(batches, simplex, centroids):
            yield pa.record_batch([part.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2, pivots: int = PIVOTS) -> DataFrame:
    """Cluster, squared distance, inertia of the cluster and of all, and digest of the centroid for each vector."""
    spark = df.sparkSession
    vectors = vectors_of(df, dim)
    first = first_vectors(vectors, max(k, pivots), seed)
    if not len(first):
        none = "cast(null as {}) as {}".format
        kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return vectors.select("vec_id").selectExpr("vec_id", *[none(t, c) for c, t in kinds.items()])
    simplex, centroids = Simplex(first[:pivots]), first[:k]
    table = landed(with_pivot_distances(vectors, simplex), "simplex-vectors")
    for _ in range(rounds):
        centroids = moved(table, simplex, centroids)
    rows = landed(assigned(table, simplex, centroids), "simplex-clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    facts = [(c, s, total, centroid_digest(centroids[c])) for c, s in inertia.items()]  # k rows at most
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
