"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; the words at its zeros are
ignored, so a seed still hits when one of them was substituted. Seeds of test
items and documents are joined on their hash. A hit fixes how an item lies over
a document; there the words are compared one by one, and the best stretch
(match 1, mismatch -2) decides, which tolerates substitutions around the hit.

Documents send only windows that a Bloom filter of all test seeds lets through.
The filter has a fixed size, so what each task receives does not grow; a full
filter lets more through, and the join stays exact.

Words are runs of letters and digits, case ignored. A stretch counts with
``LEAST`` matching words. Items of up to ``SHORT`` words, which are shorter than
that or near it, have masks of four words besides, of which one misses every
set of substitutions allowed; their overlaps are counted over the whole item
and need ``PART`` of it, five words at least.

Defined cases: null or empty texts match nothing; items of one or two words are
not searched for; items of three to five words match as a whole; rows that repeat doc_id and text give one row per item; the best stretch
is the one with most matches, then the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import arrow_map, landed
from busline.llm.hashing import NON_WORD, STEPS, mix, word_hashes

MASKS = ("11101001011", "11011001101", "10110011011")
SHORT_MASKS = ("1111", "110011")  # for short items
WHOLE_MASK = "111"  # for items of three words
ALL_MASKS = (*MASKS, *SHORT_MASKS, WHOLE_MASK)
SHORT = 16
LEAST = 13
PART = 0.8
BITS = 1 << 24  # of the Bloom filter
SLICES = 64
PAD = 64  # words sent on either side of a hit
SALTS = 8


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the chosen words of each window."""
    shape = ALL_MASKS[mask]
    n = len(words) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, mask + 1, np.uint64) * STEPS[63]
        for j, c in enumerate(shape):
            if c == "1":
                total += words[j : j + n] * STEPS[j]
        return mix(total)


def masks_for(n: int) -> list[int]:
    """Numbers of the masks for an item of ``n`` words."""
    if n <= 3:
        return [ALL_MASKS.index(WHOLE_MASK)] if n == 3 else []
    return [m for m, shape in enumerate(ALL_MASKS[:-1]) if len(shape) <= n and (n <= SHORT or m < len(MASKS))]


def least_matches(n: int) -> float:
    """Matching words that an item of ``n`` words needs."""
    return min(LEAST, max(min(5, n), PART * n))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def item_seeds(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Words of each item, and its seeds (item, mask, h, at)."""
    src = items.select(F.col(key).alias("item"), F.col(text).alias("__text"))
    key_type = src.schema["item"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seeds, words = [], word_hashes([t or "" for t in batch.column(1).to_pylist()], NON_WORD)
        for w in words:
            seeds.append([{"mask": m, "h": int(h), "at": i} for m in masks_for(len(w)) for i, h in enumerate(seed_hashes(w, m).view(np.int64))])
        kind = pa.list_(pa.struct([("mask", pa.int32()), ("h", pa.int64()), ("at", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(seeds, kind)], names=["item", "words", "seeds"])

    full = landed(arrow_map(src, run, f"item {key_type}, words binary, seeds array<struct<mask: int, h: long, at: int>>", "__text"), "leak-items")
    return full.select("item", "words"), full.select("item", F.explode("seeds").alias("s")).select("item", "s.*")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bloom filter of all seeds as bits; put together in slices, ``BITS`` bits in all."""
    width = BITS // SLICES
    low, high = F.col("h").bitwiseAND(F.lit(BITS - 1)), F.shiftright("h", 32).bitwiseAND(F.lit(BITS - 1))
    at = seeds.select(F.explode(F.array(low, high)).alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / width).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[np.asarray(table.column("bit")) % width] = True
        return pa.table({"part": table.column("part").slice(0, 1).combine_chunks(), "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((SLICES, width // 8), np.uint8)
    for r in at.groupBy("part").applyInArrow(pack, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def regions(docs: DataFrame, bloom: np.ndarray, *, key: str, text: str) -> DataFrame:
    """Stretches of documents around windows that pass the filter: (a, b, doc_id, start, words, hits)."""
    src = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key).alias("a"), F.xxhash64(text).alias("b"), F.col(text).alias("__text"))
    key_type = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # BITS / 8 bytes
    kind = pa.list_(pa.struct([("mask", pa.int32()), ("h", pa.int64()), ("at", pa.int64())]))

    def passing(words: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        h = seed_hashes(words, mask)
        one, two = _bits(h)
        table = shared.value
        ok = np.flatnonzero((table[one >> 3] << (one & 7).astype(np.uint8)) & 128)
        ok = ok[((table[two[ok] >> 3] << (two[ok] & 7).astype(np.uint8)) & 128) > 0]
        return ok, h[ok]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, words, hits = [], [], [], []
        for k, w in enumerate(word_hashes([t or "" for t in batch.column(3).to_pylist()], NON_WORD)):
            found = [(*passing(w, m), m) for m in range(len(ALL_MASKS))]
            at = np.concatenate([f[0] for f in found])
            if not len(at):
                continue
            h = np.concatenate([f[1] for f in found]).view(np.int64)
            mask = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
            order = np.argsort(at, kind="stable")
            at, h, mask = at[order], h[order], mask[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > PAD) + 1):
                start = max(0, int(at[part[0]]) - PAD)
                rows.append(k)
                starts.append(start)
                words.append(w[start : int(at[part[-1]]) + len(MASKS[0]) + PAD].tobytes())
                hits.append([{"mask": int(mask[i]), "h": int(h[i]), "at": int(at[i])} for i in part])
        take = pa.array(rows, pa.int64())
        cols = [batch.column(i).take(take) for i in range(3)] + [pa.array(starts, pa.int64()), pa.array(words, pa.binary()), pa.array(hits, kind)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "a", "b", "start", "words", "hits"])

    schema = f"doc_id {key_type}, a long, b long, start long, words binary, hits array<struct<mask: int, h: long, at: long>>"
    return arrow_map(src, run, schema, "__text", rows=512)


def best_stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matches, first, end) of the best stretch of ``item`` laid over ``words`` from ``shift`` on, in places of the item."""
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    if hi <= lo:
        return 0, 0, 0
    same = words[lo + shift : hi + shift] == item[lo:hi]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    first = int(np.argmin(total[: end + 1])) if end else 0
    return int(same[first:end].sum()), lo + first, lo + end


def overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Matches and their first place in the item: all of a short item, the best stretch of a longer one."""
    if len(item) > SHORT:
        return best_stretch(words, item, shift)[:2]
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    at = lo + np.flatnonzero(words[lo + shift : hi + shift] == item[lo:hi]) if hi > lo else ()
    return (len(at), int(at[0])) if len(at) else (0, 0)


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, a, b, item_id, matched, item_words, doc_start): best verified overlap of each document and item.

    ``a`` and ``b`` are hashes of key and text, which name a row of ``docs``.
    """
    words, seeds = item_seeds(items, item_key, item_text)
    found = landed(regions(docs, seed_filter(seeds), key=key, text=text), "leak-regions").dropDuplicates(["a", "b", "start"])
    hits = found.select("a", "b", "start", F.explode("hits").alias("s")).select("a", "b", "start", "s.*")
    # an item may be in a third of all documents: its seeds are dealt out over SALTS keys
    hits = hits.withColumn("salt", F.pmod("b", F.lit(SALTS)).cast("int"))
    salted = seeds.select("item", "mask", "h", F.col("at").alias("item_at"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    laid = hits.join(salted, ["mask", "h", "salt"]).select("a", "b", "start", "item", (F.col("at") - F.col("item_at") - F.col("start")).alias("shift")).distinct()
    both = laid.groupBy("a", "b", "start", "item").agg(F.collect_set("shift").alias("shifts"))
    both = both.join(found.select("a", "b", "start", "doc_id", "words"), ["a", "b", "start"]).join(words.withColumnRenamed("words", "item_words"), "item")
    both = both.select("doc_id", "a", "b", "item", "start", "words", "item_words", "shifts")
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def verify(batches):
        for batch in batches:
            keep, matched, length, begin = [], [], [], []
            for r, (start, w, i, shifts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6, 7)))):
                w, i = np.frombuffer(w, np.uint64), np.frombuffer(i, np.uint64)
                n, at = max(((m, -(start + s + f)) for s in shifts for m, f in [overlap(w, i, s)]), default=(0, 0))
                if n >= least_matches(len(i)):
                    keep.append(r)
                    matched.append(n)
                    length.append(len(i))
                    begin.append(-at)
            cols = [batch.column(c).take(pa.array(keep, pa.int64())) for c in range(4)] + [pa.array(x, pa.int64()) for x in (matched, length, begin)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "a", "b", "item_id", "matched", "item_words", "doc_start"])

    good = both.mapInArrow(verify, f"doc_id {types['doc_id']}, a long, b long, item_id {types['item']}, matched long, item_words long, doc_start long")
    best = F.max(F.struct("matched", (-F.col("doc_start")).alias("back"), "item_words"))
    good = good.groupBy("doc_id", "a", "b", "item_id").agg(best.alias("m"))
    return good.select("doc_id", "a", "b", "item_id", "m.matched", "m.item_words", (-F.col("m.back")).alias("doc_start"))


def without_leaks(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """Rows of ``docs`` that hold no test item, with all their columns."""
    key, text = names.get("key", "doc_id"), names.get("text", "text")
    bad = leaks(docs, items, **names).select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
    return docs.withColumn("__a", F.xxhash64(key)).withColumn("__b", F.xxhash64(text)).join(bad, ["__a", "__b"], "left_anti").select(*docs.columns)
