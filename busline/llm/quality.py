"""Document quality by pairwise ranking.

A Bradley-Terry model: document i is preferred to j with probability
sigmoid(s_i - s_j), s = w . x over features of the text. The weights minimise
the logistic loss on feature differences of (good, bad) pairs. A quantile of
the scores, at the share of bad documents among the labels, is the threshold;
the reported score is sigmoid(s - threshold), so 0.5 is the threshold.

``train_all`` fits on all labelled documents, copies once: a hash of the text
deals them to buckets of about ``BUCKET`` of the rarer class, all pairs of a
bucket count, and each Newton step is one sum over the buckets. The threshold is
the exact quantile over all labelled rows. ``train`` is the bounded form, on at
most ``SAMPLE`` documents of each class and ``PAIRS`` pairs. Features and scores
cover all documents.

Defined cases: a null text is an empty one and gets a score like any other;
without labels of both classes every score is 0.5; labels that contradict each
other for one document are left out; a null doc_id is never labelled or held
out; rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import arrow_map, landed
from busline.operators import ordered as O

SAMPLE = 20_000
PAIRS = 200_000
BUCKET = 32
RIDGE = 1e-3
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str | None) -> list[float]:
    """Traits of a whole text that tell running prose from lists, shouting, repetition and symbols."""
    text = text or ""
    words = text.split()
    lines = text.split("\n")
    n, n_lines = max(1, len(words)), max(1, len(lines))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    upper, lower, digit, wide = (int(raw[s].sum()) for s in (_UPPER, _LOWER, _DIGIT, slice(128, 256)))
    letters = max(1, upper + lower + wide)
    space = int(raw[[9, 10, 13, 32]].sum())
    count = Counter(words)
    top = count.most_common(2)
    share = lambda chars: sum(int(raw[ord(c)]) for c in chars)
    return [
        upper / letters,
        digit / size,
        wide / size,
        (size - space - letters - digit) / size,
        share("|") / n,
        share("!") / n,
        share("#$%&*") / n,
        share(".") / n,
        share(",") / n,
        share("?;:\"'()") / n,
        math.sqrt(share("|") / n),
        math.sqrt(share("!") / n),
        math.sqrt(share("#$%&*") / n),
        len(count) / n,
        len(count) / math.sqrt(n),
        top[0][1] / n if top else 0.0,
        top[1][1] / n if len(top) > 1 else 0.0,
        sum(map(eq, words, words[1:])) / n,
        (size - space) / n,
        math.log1p(len(words)),
        math.log1p(len(words) / n_lines),
        len(set(lines)) / n_lines,
        float(not words),
    ]


def with_features(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with a hash of the text (``__hash``) and its features (``__x``). No shuffle."""
    src = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"), F.col(text).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "__x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return arrow_map(src, run, f"{schema}, __x array<double>", "__text")


def held_out(key: str = "doc_id") -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, rounds: int = 25) -> Ranker:
    """Newton steps on the logistic loss of feature differences."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    g, b = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(7)
    d = g[rng.integers(0, len(g), pairs)] - b[rng.integers(0, len(b), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the pair is ranked wrongly
        grad = d.T @ p / pairs - RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Ranker(mean, scale, w, _quantile(g @ w, b @ w, bad_share))


def _quantile(good: np.ndarray, bad: np.ndarray, bad_share: float) -> float:
    """Score below which ``bad_share`` of all labelled documents lie; the classes of the sample are weighted to their shares."""
    s = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(s, kind="stable")
    s, below = s[order], np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, bad_share - 1e-12)), len(s) - 2)
    return float((s[k] + s[k + 1]) / 2)


def train(featured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality") -> Ranker | None:
    """Fit on a sample of the labelled documents that are not held out; None without both classes."""
    rows = _labelled(featured, labels, key, label)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    picked = [np.array([r["__x"] for r in rows.filter(F.col("y") == y).groupBy("__hash").agg(F.min("__x").alias("__x")).orderBy("__hash").limit(SAMPLE).select("__x").collect()]) for y in (1, 0)]
    return fit_pairs(*picked, bad_share=n[0] / (n[0] + n[1]))


def _labelled(featured: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(y, __hash, __x) of the documents with one label that are not held out."""
    agreed = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    agreed = agreed.filter("low = high").select(key, F.col("low").cast("int").alias("y"))
    return featured.select(key, "__hash", "__x").filter(~held_out(key)).join(agreed, key).select("y", "__hash", "__x")


def _matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten(), dtype=float).reshape(len(x), -1)


def _total(d: DataFrame, part) -> np.ndarray:
    """Sum of the vectors ``part(batch)``; each task sends one vector of fixed size."""

    def run(batches):
        total = None
        for batch in batches:
            v = part(batch)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r["v"] for r in d.mapInArrow(run, "v array<double>").collect()], axis=0)


def _newton_sums(w: np.ndarray, scale: np.ndarray):
    """Pairs, gradient and Hessian of the buckets of a batch (good, bad) at the weights ``w``."""
    n = len(w)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        count, grad, hess = 0, np.zeros(n), np.zeros((n, n))
        for good, bad in zip(batch.column(0), batch.column(1)):
            if not len(good) or not len(bad):
                continue
            g, b = _matrix(good.values) / scale, _matrix(bad.values) / scale
            step = max(1, 50_000 // len(b))
            for at in range(0, len(g), step):
                d = (g[at : at + step, None] - b[None]).reshape(-1, n)
                p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the pair is ranked wrongly
                count += len(d)
                grad += d.T @ p
                hess += (d * (p * (1 - p))[:, None]).T @ d
        return np.concatenate([[count], grad, hess.ravel()])

    return part


def train_all(featured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", rounds: int = 25) -> Ranker | None:
    """Fit on all labelled documents that are not held out; None without both classes. The driver holds sums only."""
    rows = _labelled(featured, labels, key, label)
    texts = landed(rows.groupBy("y", "__hash").agg(F.min("__x").alias("__x"), F.count("*").alias("__n")), "quality-labelled")
    n = {r["y"]: r for r in texts.groupBy("y").agg(F.count("*").alias("texts"), F.sum("__n").alias("rows")).collect()}
    if len(n) < 2:
        return None
    x = texts.select("__x")
    size = n[0]["texts"] + n[1]["texts"]
    mean = _total(x, lambda batch: _matrix(batch.column(0)).sum(axis=0)) / size
    scale = np.sqrt(_total(x, lambda batch: ((_matrix(batch.column(0)) - mean) ** 2).sum(axis=0)) / size)
    scale = np.where(scale < 1e-9, 1.0, scale)
    buckets = max(1, min(n[0]["texts"], n[1]["texts"]) // BUCKET)
    of = lambda y: F.collect_list(F.when(F.col("y") == y, F.col("__x")))
    pairs = texts.groupBy(F.pmod(F.col("__hash"), F.lit(buckets)).alias("__bucket")).agg(of(1).alias("good"), of(0).alias("bad"))
    pairs = landed(pairs.select("good", "bad"), "quality-pairs")
    w = np.zeros(len(mean))
    for _ in range(rounds):
        s = _total(pairs, _newton_sums(w, scale))
        count, grad, hess = max(1.0, s[0]), s[1 : 1 + len(w)], s[1 + len(w) :].reshape(len(w), -1)
        step = np.linalg.solve(hess / count + RIDGE * np.eye(len(w)), grad / count - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch.column(0)) - mean) / scale) @ w, pa.float64()), batch.column(1)], names=["s", "n"])

    scores = texts.select("__x", "__n").mapInArrow(raw, "s double, n long")
    at = (n[0]["rows"] - 0.5) / (n[0]["rows"] + n[1]["rows"] - 1)  # midway between the ranks that the bad share divides
    return Ranker(mean, scale, w, O.exact_quantiles(scores, [], "s", {"t": at}, weight=F.col("n")).first()["t"])


def score(featured: DataFrame, ranker: Ranker | None, *, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` with the score, and 1 from 0.5 on, else 0."""

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            m = np.asarray(x.flatten()).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            s = ranker.scores(m) if ranker is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], *names])

    src = featured.select(*keep, "__x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} int")


def score_texts(docs: DataFrame, ranker: Ranker | None, *, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with the score, and 1 from 0.5 on, else 0. Features and score in one pass, so a task needs one worker."""
    src = docs.select("*", F.col(text).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        s = ranker.scores(np.array([features(t) for t in texts])) if ranker is not None and texts else np.full(len(texts), 0.5)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], *names])

    schema = T.StructType([*src.schema.fields[:-1], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return arrow_map(src, run, schema, "__text")


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    featured = landed(with_features(docs.withColumnRenamed(key, "doc_id"), keep=["doc_id"], text=text), "quality-features")
    labels = labels.withColumnRenamed(key, "doc_id")
    return score(featured.withColumn("held_out", held_out()), train_all(featured, labels), keep=["doc_id", "held_out"])
