"""Documents whose word shingle sets have a Jaccard similarity of 0.9 or more, by T-occurrence search.

Two sets of n and m shingles link if they share T = ceil(9 (n + m) / 19). So,
with tokens in one common order, they share one of the first n - ceil(0.9 n) + 1
of either. The order puts tokens with long inverted lists last: long lists are
told by a fixed number of counters over all documents. Records that share such
a token are candidates if their sizes, the places of the token in their orders,
and the parities of their hashed tokens allow T common tokens; these tests lose no
link. Sizes and places travel with each prefix token, parities only with tokens
that pass for some pair by them.

A candidate list is then searched with DivideSkip: the long lists among the
query's tokens are set aside, the short ones are merged with a heap, and records
that can still reach T are looked up in the long ones by binary search.

Equal sets are one record from the start. Candidates are made and verified in
two rounds: first the nearest one of each record and token, a number in
proportion to the input, then, for the tokens that had more, those that the
links so far leave in different components. A link inside a component that is known already changes nothing, so
a large group of near copies does not become all its pairs.

Defined cases: null or empty texts have no shingles and link with nothing; fewer
than three words are one shingle; rows that repeat a doc_id are records of their
own by text; a null doc_id takes part and never gives the id of a component
unless all are null. Sets and records are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import arrow_map, discard, landed
from busline.llm.components import components
from busline.llm.decontaminate import _bits, seed_filter
from busline.llm.hashing import sequences, word_hashes

WORDS = 3
SHARE = (9, 10)  # Jaccard of 90 to 100
COUNTERS = 1 << 20  # of token hashes; a bit of each is sent to every task
SLICES = 64
PARITY = 256  # bits of the parity test for up to four times as many tokens; eight times as many for each eightfold size
BLOCK = 4096  # records compared in one go for one token
NEIGHBOURS = 16  # rows by size of which one must fit before parities are fetched


def least_overlap(n, m):
    """Common tokens that sets of n and m tokens need."""
    a, b = SHARE
    return -(-a * (n + m) // (a + b))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(sequences(w, WORDS)) for w in word_hashes([t or "" for t in texts])]


def _counter(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def long_lists(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bit per counter: is it far above the mean? One array of counters per task, added up in slices."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                for s in shingle_sets(texts[at : at + 256]):
                    np.add.at(total, _counter(s), 1)
        if total.any():
            parts = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(b), np.int32)
        mean = total.mean()
        return pa.table({"part": table.column("part").slice(0, 1).combine_chunks(), "bits": [np.packbits(total > mean + 8 * mean**0.5 + 32).tobytes()]})

    rows = docs.select(F.col(text)).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect()
    bits = np.zeros((SLICES, COUNTERS // SLICES), bool)
    for r in rows:  # COUNTERS bits in all
        bits[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return bits.ravel()


def records(docs: DataFrame, long: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, id, n, prefix, n_short, parity) of each document."""
    src = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(long))  # COUNTERS / 8 bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        is_long = np.unpackbits(shared.value).astype(bool)
        ids, sizes, prefixes, shorts, wide = [], [], [], [], []
        for s in shingle_sets(batch.column(2).to_pylist()):
            n = len(s)
            digest = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
            late = is_long[_counter(s)]
            take = n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0
            short = s[~late][:take]
            wide.append(parity_bits(s).tobytes())
            ids.append(int.from_bytes(digest, "little", signed=True))
            sizes.append(n)
            prefixes.append(np.concatenate([short, s[late][: take - len(short)]]).view(np.int64).tolist())
            shorts.append(len(short))
        cols = [pa.array(x, pa.int64()) for x in (ids, sizes)] + [pa.array(prefixes, pa.list_(pa.int64())), pa.array(shorts, pa.int32()), pa.array(wide, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "text_hash", "id", "n", "prefix", "n_short", "parity"])

    key_type = src.schema["doc_id"].dataType.simpleString()
    return arrow_map(src, run, f"doc_id {key_type}, text_hash long, id long, n long, prefix array<long>, n_short int, parity binary", "__text", rows=512)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Bytes with a bit per hash class of the tokens: is the number of tokens in it odd?"""
    bits = PARITY
    while len(s) > 4 * bits:
        bits *= 8
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def fold(parity: np.ndarray, size: int) -> np.ndarray:
    """The parity with fewer classes, ``size`` bytes; rows of a matrix one by one."""
    while parity.shape[-1] > size:
        half = parity.shape[-1] // 2
        parity = parity[..., :half] ^ parity[..., half:]
    return np.ascontiguousarray(parity)


def may_link(n, pos, m, other):
    """Can sets of n <= m tokens link whose common prefix token has the places ``pos`` and ``other`` in their orders?

    The first common token of linked sets has all T in and after it.
    """
    need = least_overlap(n, m)
    return (pos + need <= n) & (other + need <= m)


def _run_pairs(ids: np.ndarray, n: np.ndarray, parity: list[bytes], side: np.ndarray, label: np.ndarray, pos: np.ndarray | None = None):
    """(x, y, apart) of pairs of a block with different labels that pass the size, place and parity tests; across sides if it has two.

    ``apart`` is the parity difference per mille of the two sizes. Places count from 0.
    """
    order = np.argsort(n, kind="stable")
    pos = np.zeros(len(n), np.int64) if pos is None else pos[order].astype(np.int64)
    ids, n, side, label = ids[order], n[order].astype(np.int64), side[order], label[order]
    width = np.array([len(parity[i]) for i in order])
    first = {w: int(np.argmax(width == w)) for w in set(width.tolist())}  # rows of a width follow each other
    bits = {w: np.frombuffer(b"".join(parity[i] for i in order if len(parity[i]) == w), np.uint8).reshape(-1, w) for w in first}
    two = side.any() and not side.all()
    step = max(1, (1 << 18) // max(1, len(n)))
    for at in range(0, len(n), step):
        rows = np.arange(at, min(at + step, len(n)))
        last = int(np.searchsorted(n, SHARE[1] * n[rows[-1]] // SHARE[0], side="right"))
        other = np.arange(at, last)
        ok = (other > rows[:, None]) & (SHARE[1] * n[rows][:, None] >= SHARE[0] * n[other]) & (label[rows][:, None] != label[other])
        if two:
            ok &= side[rows][:, None] != side[other]
        i, j = np.nonzero(ok)
        i, j = rows[i], other[j]
        fit = may_link(n[i], pos[i], n[j], pos[j])
        i, j = i[fit], j[fit]
        for v, w in set(zip(width[i].tolist(), width[j].tolist())):
            chosen = np.flatnonzero((width[i] == v) & (width[j] == w))
            for c in range(0, len(chosen), max(1, (1 << 23) // w)):
                a, b = i[chosen[c : c + max(1, (1 << 23) // w)]], j[chosen[c : c + max(1, (1 << 23) // w)]]
                apart = np.bitwise_count(bits[v][a - first[v]] ^ fold(bits[w][b - first[w]], v)).sum(axis=1).astype(np.int64)
                total = (n[a] + n[b]).astype(np.int64)
                good = apart <= total - 2 * least_overlap(total, 0)
                x, y = ids[a[good]], ids[b[good]]
                yield np.minimum(x, y), np.maximum(x, y), 1000 * apart[good] // total[good]


def _runs(batches, keys: list[str]):
    """Tables of whole runs of equal keys from sorted batches, with the places where runs begin."""
    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
        cols = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(len(t) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        heads = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(heads) > 1:
            yield t.slice(0, int(heads[-1])), heads
        kept = t.slice(int(heads[-1]))
    if kept is not None:
        yield kept, np.array([0, len(kept)])


def _partners(heads: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Has a row another one in its run that it may link with? Rows of a run rise by ``n``.

    Only the next ``NEIGHBOURS`` rows are looked at; a run in which more have fitting sizes counts as a whole.
    """
    run = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    out, left = np.zeros(len(n), bool), np.arange(len(n))
    for step in range(1, NEIGHBOURS + 2):
        left = left[left + step < len(n)]
        left = left[(run[left] == run[left + step]) & (SHARE[1] * n[left] >= SHARE[0] * n[left + step])]
        if step <= NEIGHBOURS:
            fit = left[may_link(n[left], pos[left], n[left + step], pos[left + step])]
            out[fit] = out[fit + step] = True
    whole = np.zeros(len(heads), bool)
    whole[run[left]] = True
    return out | whole[run]


def shared_tokens(reps: DataFrame) -> DataFrame:
    """(token, id, n, pos, late) of prefix tokens, for records that may link with another one that has the token."""
    place = F.shiftleft(F.col("n"), 32) + F.shiftleft(F.col("pos").cast("long"), 1) + (F.col("pos") >= F.col("n_short")).cast("long")  # one number shuffles in fewer bytes
    flat = reps.select("id", "n", "n_short", F.posexplode("prefix").alias("pos", "token")).select("token", "id", place.alias("place"))

    def run(batches):
        for t, heads in _runs(batches, ["token"]):
            size = np.diff(heads)
            many = np.flatnonzero(np.repeat(size > 1, size))
            if not len(many):
                continue
            token, place = (np.asarray(t.column(c))[many] for c in ("token", "place"))
            order = np.lexsort((place, token))  # by size in a token
            many, place = many[order], place[order]
            n, pos = place >> 32, (place & (1 << 32) - 1) >> 1
            chosen = np.flatnonzero(_partners(np.concatenate([[0], np.cumsum(size[size > 1])]), n, pos))
            if len(chosen):
                found = t.select(["token", "id"]).take(pa.array(many[chosen]))
                cols = [pa.array(n[chosen], pa.int32()), pa.array(pos[chosen], pa.int32()), pa.array((place[chosen] & 1).astype(bool))]
                yield from pa.table([*found.columns, *cols], names=["token", "id", "n", "pos", "late"]).combine_chunks().to_batches()

    return flat.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, id long, n int, pos int, late boolean")


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of (x, y, apart) rows those that are the nearest of x or of y."""
    keep = np.zeros(len(pairs), bool)
    for c in (0, 1):
        order = np.lexsort((pairs[:, 1 - c], pairs[:, 2], pairs[:, c]))
        keep[order[np.concatenate([[True], np.diff(pairs[order, c]) != 0])]] = True
    return pairs[keep]


def candidates(shared: DataFrame, large: DataFrame, reps: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(x, y) of records that share a prefix token and may reach the overlap.

    Without ``labels`` only the nearest of each record and token, and a row
    (null, null, token) for each token that has more; with them all that are in
    different components. Rows of a token lie together in a task,
    sorted; tokens with more than ``BLOCK`` records (``large``) are dealt out as
    pairs of blocks.
    """
    dealt = shared.join(large, "token", "left").withColumn("own", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"), "id", "n", "pos")
    rows = reps.select("id", "parity")
    names = ["token", "p", "q", "side", "id", "n", "pos", "parity"]
    if labels is not None:
        names.append("label")
        rows = rows.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    dealt = dealt.join(rows, "id").select(*names)
    nearest = labels is None

    def run(batches):
        for t, heads in _runs(batches, ["token", "p", "q"]):
            ids, n, pos, side, label = *(np.asarray(t.column(c)) for c in ("id", "n", "pos")), np.asarray(t.column("side").to_pylist(), bool), np.asarray(t.column("id" if nearest else "label"))
            token, parity, found, more = np.asarray(t.column("token")), t.column("parity"), [], []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if b - a > 1 and (label[a:b] != label[a]).any():
                    own = [np.stack(p, axis=1) for p in _run_pairs(ids[a:b], n[a:b], parity.slice(a, b - a).to_pylist(), side[a:b], label[a:b], pos[a:b])]
                    own = np.concatenate(own) if own else np.zeros((0, 3), np.int64)
                    found.append(_nearest(own) if nearest and len(own) else own)
                    if len(found[-1]) < len(own):
                        more.append(token[a])
            if sum(map(len, found)):
                pairs = np.unique(np.concatenate(found)[:, :2], axis=0)
                for at in range(0, len(pairs), 10_000):
                    x, y = pairs[at : at + 10_000].T
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], names=["x", "y", "token"])
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64())] * 2 + [pa.array(more, pa.int64())], names=["x", "y", "token"])

    keys = ["token", "p", "q"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x long, y long, token long").distinct()


def divide_skip(query: np.ndarray, sets: list[np.ndarray], need: list[int], mu: float = 0.01) -> list[bool]:
    """Which of ``sets`` share at least ``need`` tokens with ``query``? All are sorted arrays of distinct tokens.

    Lists hold the numbers of the sets with a token of the query. The longest
    are set aside; the rest are merged with a heap, and a set that was met often
    enough is looked up in the long ones.
    """
    lists: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        for token in s[np.isin(s, query, assume_unique=True)].tolist():
            lists.setdefault(token, []).append(k)
    order = sorted(lists.values(), key=len)
    most = min(need, default=0)
    aside = min(len(order), max(0, int(most / (mu * np.log2(max(2, len(order[-1]) if order else 2)) + 1)) - 1)) if len(sets) > 8 else 0
    short, long = order[: len(order) - aside], order[len(order) - aside :]
    out = [False] * len(sets)
    last, seen = -1, 0

    def settle(k: int, seen: int) -> None:
        if seen + len(long) < need[k]:
            return
        left = len(long)
        for lst in long:
            if seen >= need[k] or seen + left < need[k]:
                break
            left -= 1
            at = bisect_left(lst, k)
            seen += at < len(lst) and lst[at] == k
        out[k] = seen >= need[k]

    for k in heapq.merge(*short):
        if k != last:
            if seen:
                settle(last, seen)
            last, seen = k, 0
        seen += 1
    if seen:
        settle(last, seen)
    met = {k for lst in short for k in lst}
    for k in range(len(sets)):  # sets found in long lists only
        if k not in met and need[k] <= len(long):
            settle(k, 0)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) that reach the overlap. The lists of a query are searched per batch of its candidates."""
    with_y = pairs.join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("set_y")), "y")
    both = with_y.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("set_x")), "x").select("x", "set_x", "y", "set_y")

    def run(batches):
        for batch in batches:
            xs = np.asarray(batch.column(0))
            heads = np.concatenate([[0], np.flatnonzero(np.diff(xs)) + 1, [len(xs)]])
            found = []
            for a, b in zip(heads[:-1], heads[1:]):
                for c in range(a, b, 256):
                    rows = range(c, min(c + 256, b))
                    query = np.frombuffer(batch.column(1)[c].as_py(), np.uint64)
                    others = [np.frombuffer(batch.column(3)[r].as_py(), np.uint64) for r in rows]
                    hit = divide_skip(query, others, [least_overlap(len(query), len(s)) for s in others])
                    found += [r for r, h in zip(rows, hit) if h]
            yield batch.select([0, 2]).take(pa.array(found, pa.int64()))

    return both.mapInArrow(run, "x long, y long")


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` (a, b, ...) that ``wanted`` (a, b) may have, told by a Bloom filter of fixed size, so that the join need not shuffle all texts."""
    h = F.xxhash64("a", "b")
    shared = texts.sparkSession.sparkContext.broadcast(seed_filter(wanted.select(h.alias("h"))))

    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        table = shared.value
        one, two = _bits(np.asarray(h).view(np.uint64))
        return pa.array(((table[one >> 3] << (one & 7).astype(np.uint8)) & (table[two >> 3] << (two & 7).astype(np.uint8)) & 128) > 0)

    return texts.filter(known(h))


def linked(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component) of every row; ``component`` tells components apart where ids repeat or are null."""
    found = landed(records(docs, long_lists(docs, text), key=key, text=text), "ngram-records")
    traits = ("n", "prefix", "n_short", "parity")
    reps = found.filter("n > 0").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *[F.first(c).alias(c) for c in traits])
    reps = landed(reps, "ngram-sets")
    shared = landed(shared_tokens(reps), "ngram-shared")
    large = shared.filter("late").groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    large = landed(large, "ngram-large")
    first = landed(candidates(shared, large, reps), "ngram-near")
    near, open_tokens = first.filter("x IS NOT NULL").select("x", "y"), first.filter("x IS NULL").select("token")
    # a record with any candidate has a nearest one, so these are all whose sets are needed
    needed = near.select(F.col("x").alias("id")).unionByName(near.select(F.col("y").alias("id"))).distinct()
    wanted = landed(reps.select("id", "rep").join(needed, "id").select("id", F.xxhash64("rep.doc_id").alias("a"), F.col("rep.text_hash").alias("b")), "ngram-wanted")
    texts = docs.select(F.xxhash64(key).alias("a"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("b"), F.col(text).alias("__text"))
    chosen = wanted.join(likely(texts, wanted), ["a", "b"]).select("id", "__text")

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())], pa.binary())], names=["id", "tokens"])

    sets = tokens_of = landed(arrow_map(chosen, tokens, "id long, tokens binary", "__text", rows=256), "ngram-tokens")
    if sets.count() > wanted.count():  # rows that repeat doc_id and text
        sets = sets.dropDuplicates(["id"])
    links = landed(verified(near, sets), "ngram-links")
    labels = landed(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "ngram-labels")
    rest = landed(candidates(shared.join(open_tokens, "token", "left_semi"), large, reps, labels).select("x", "y").join(near, ["x", "y"], "left_anti"), "ngram-rest")
    more = landed(verified(rest, sets), "ngram-links")
    discard(tokens_of, first, rest, shared, large, wanted, reps, labels)
    labels = components(links.unionByName(more).select(F.col("x").alias("u"), F.col("y").alias("v")))
    rows = found.select("doc_id", "text_hash", "id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "id"), "id", "left")
    own = landed(rows.withColumn("label", F.coalesce("label", "id")), "ngram-rows")
    discard(found)
    least = own.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).filter("size > 1").select("label", "least")
    out = own.join(least, "label", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("label").alias("component"))
