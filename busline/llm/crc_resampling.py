"""Target-distribution importance resampling with n-gram hashes from prefix CRCs.

A text is lower-cased and its separators become single blanks.  One scan keeps
the running CRC at the end of every word.  The CRC of the words i to j is that
of the prefix up to the end of j, with the prefix before i, shifted over the
length in between, cancelled out of it (addition in GF(2)); so n-grams of any
length need no further look at the bytes.  Texts of a task run on as one stream,
as what lies before an n-gram cancels anyway.

The first pass writes the buckets of all n-grams of each text; counts of
buckets, weights and ranks are made from that table.  Ranks come from a range
partitioning of (score, doc_id) and counts per partition, so nothing is ordered
by one task, however many rows share a score.

Defined cases: null texts have no features, weight 0 and rank only if
``least_words`` is 0; a document without an id hashes as ``<seed>:`` and comes
last among equal scores; rows that repeat an id are documents of their own, and
equal scores of theirs are ranked by n_features; an empty table gives an empty
result, an empty benchmark gives gains from documents alone; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import landed, slices
from busline.llm.vectors import pack

BUCKETS = 10_000
LONGEST = 2
SEED = 7
SHARE = 25  # per cent of the documents with enough words
LEAST_WORDS = 20
_POLY = 0xEDB88320  # reversed CRC-32 polynomial of zlib
PIECE = 1 << 20  # bytes whose words are held at once
_SHORT = 64  # shifts over fewer bytes have a table of their own
# A-Z become a-z, other ASCII characters than letters and digits a blank.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@cache
def _byte_table() -> np.ndarray:
    """CRC step of one zero byte for each low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    return c


def _zeros(c: np.ndarray) -> np.ndarray:
    """Shift by one byte: multiplication by x^8 in GF(2) modulo the polynomial."""
    return _byte_table()[c & 255] ^ (c >> np.uint32(8))


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each of four bytes."""
    out = tables[0][c & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][(c >> np.uint32(8 * k)) & 255]
    return out


@cache
def _short_shifts() -> np.ndarray:
    """[byte place, length, byte]: shifts over 0 to ``_SHORT`` - 1 bytes."""
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    rows = [table]
    for _ in range(_SHORT - 1):
        rows.append(_zeros(rows[-1]))
    return np.stack(rows, 1)


@cache
def _long_shift(k: int) -> np.ndarray:
    """Shift over ``_SHORT`` * 2^k bytes."""
    if k:
        half = _long_shift(k - 1)
        return _apply(half, half)
    return _zeros(_short_shifts()[:, -1])


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved over ``length`` bytes each."""
    tables, low = _short_shifts(), length % _SHORT
    out = tables[0][low, crc & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][low, (crc >> np.uint32(8 * k)) & 255]
    rest, k = length // _SHORT, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        if len(at):
            out[at] = _apply(_long_shift(k), out[at])
        rest, k = rest >> 1, k + 1
    return out


def cleaned(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(CLEAN)


def gram_crcs(words: list[bytes], longest: int) -> list[np.ndarray]:
    """Unsigned crc32 of all runs of n words joined by a blank, for n = 1 to ``longest``, by start."""
    if not words:
        return [np.zeros(0, np.uint32)] * longest
    ends = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=0), np.uint32, len(words) + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1)
    begin = stop - size  # of each word; the stream starts with a blank
    before = (ends[:-1] ^ np.uint32(0xFFFFFFFF)) ^ np.uint32(32)
    before = (_zeros(before) ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)  # prefix up to and with the blank
    out = []
    for n in range(1, longest + 1):
        m = max(0, len(words) - n + 1)
        out.append(ends[n : n + m] ^ shifted(before[:m], stop[n - 1 : n - 1 + m] - begin[:m]))
    return out


def buckets_of(raws: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all cleaned texts one after the other, where each text ends, and words per text."""
    words, counts = [], []
    for raw in raws:
        own = raw.split()
        words += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    found, owner = [], []
    for n, crc in enumerate(gram_crcs(words, longest), 1):
        inside = doc[: len(crc)] == doc[n - 1 :]  # a run over the end of a text is none
        found.append((crc % np.uint32(buckets))[inside])
        owner.append(doc[: len(crc)][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(counts)))
    return np.concatenate(found)[order], ends, counts


def buckets_of_long(raw: bytes, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one text, cut between words; runs that end in a piece are counted with it."""
    found, tail, at, count = [], [], 0, 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        words = tail + raw[at:end].split()
        for n, crc in enumerate(gram_crcs(words, longest), 1):
            found.append(crc[max(0, len(tail) - n + 1) :] % np.uint32(buckets))
        count += len(words) - len(tail)
        tail = words[-(longest - 1) :] if longest > 1 else []
        at = end
    found = np.concatenate(found)
    return found, np.array([len(found)]), np.array([count])


def with_buckets(df: DataFrame, key: str, buckets: int, longest: int) -> DataFrame:
    """(key, n_words, features): packed buckets of every n-gram of the whole text."""
    kind = df.schema[key].dataType.simpleString()
    wide = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", size=PIECE):
                raws = [cleaned(t) for t in part.column("text").to_pylist()]
                long = len(raws) == 1 and len(raws[0]) > PIECE
                found, ends, words = buckets_of_long(raws[0], buckets, longest) if long else buckets_of(raws, buckets, longest)
                yield pa.record_batch([part.column("key"), pa.array(words), pack(found, ends, wide)], ["key", "n_words", "features"])

    return df.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n_words long, features binary")


def _numbers(value: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(value, "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket; ``buckets`` numbers reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("features"):
                total += np.bincount(_numbers(value.as_buffer(), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, in doubles."""
    n = len(source)
    whole_s, whole_t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * whole_s / ((s + 1) * whole_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key, seed: int) -> int:
    """Gumbel noise in thousandths from the sha256 of the id."""
    name = f"{seed}:{'' if key is None else key}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(key, n_words, n_features, weight, score)."""
    kind = rows.schema["key"].dataType.simpleString()
    buckets = len(gains)

    def run(batches):
        for batch in batches:
            features = [_numbers(v.as_buffer(), buckets) for v in batch.column("features")]
            size = [len(f) for f in features]
            weight = [int(gains[f].sum()) // len(f) if len(f) else 0 for f in features]
            score = [w + noise(k, seed) for w, k in zip(weight, batch.column("key").to_pylist())]
            yield pa.record_batch([batch.column("key"), batch.column("n_words"), pa.array(size, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["key", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long, score long")


def ranks(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with ``row``, a number of its own) and their rank by score, key, n_features.

    Rows are dealt by ranges of the order, which ends with ``row``: equal scores
    and even equal keys are split.  Ranges are written, so their bounds are the
    same for every later reader.
    """
    order = [F.col("score").desc(), F.asc_nulls_last("key"), F.col("n_features"), F.col("row")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = landed(placed.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate((m for _, m in sizes), initial=0))
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")  # one per shuffle partition
    inside = F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + inside).drop("part", "before", "place")


def resample(docs: DataFrame, targets: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; documents that are not drawn have no rank."""
    source = landed(with_buckets(docs, "doc_id", buckets, longest), "crc-documents")
    target = landed(with_buckets(targets, "item_id", buckets, longest), "crc-targets")
    gains = gains_of(bucket_counts(source, buckets), bucket_counts(target, buckets))
    rows = landed(scored(source, gains, seed).withColumn("row", F.monotonically_increasing_id()), "crc-scores")
    able = F.col("n_words") >= least_words
    most = rows.filter(able).count() * share // 100
    drawn = ranks(rows.filter(able).select("row", "key", "n_features", "score"), "crc-ranks").filter(F.col("rank") <= most)
    out = rows.join(drawn.select("row", "rank"), "row", "left")
    return out.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
