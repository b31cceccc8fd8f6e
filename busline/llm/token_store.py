"""Token ids in binary shards with a minimal perfect hash index over the documents.

Layout of a store folder:

* ``ids/*.bin``: raw little-endian ids, 16 bits wide if the vocabulary allows,
  32 otherwise. Each document ends with the end id. Documents are in ascending
  order of their key, in a file and across files.
* ``shards``: one row per file that counts (number, path, documents, ids, ids
  in all files before it).
* ``index``: one row per hash bucket of keys. A bucket holds a minimal perfect
  hash of its keys and, per slot, a fingerprint of the key, the shard, the
  offset in ids and the number of ids. A look-up hashes the key, tests a bit
  per level, and reads one slot, whatever the size of the store.

A file is named by the attempt that wrote it and counts only if the committed
``written`` table names it, so a lost executor leaves nothing but an orphan.

Defined cases: a null text is an empty one (the end id alone); a null key sorts
first and can be looked up like any other; rows that repeat a key are all
kept, numbered from 0 in ``copy``; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busline.llm.common import open_fs, scratch_dir, slices

BUCKET_KEYS = 16_384  # keys of a bucket, in the mean
LOAD = 1.6  # bits per key on each level of the hash
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: White space that is more than a blank or up to two line feeds between words.
_BREAKS = ("  ", " \n", "\n ", "\n\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class UnitEncoder:
    """The library's encoder, asked once per unit (a run without white space and the blank before it).

    The byte-level pre-tokenizer never joins two units, so their ids can be
    kept. Texts with control separators or special tokens go through whole.
    """

    def __init__(self, path: str, width: int, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.type = np.dtype(f"<u{width}")
        # tokens that begin with a blank or a line feed, in the printable stand-ins of the vocabulary
        self.blank, self.line = np.zeros((2, self.lib.get_vocab_size()), bool)
        for token, i in self.lib.get_vocab().items():
            self.blank[i], self.line[i] = token[0] == "\u0120", token[0] == "\u010a"
        # does the vocabulary never join letters and signs after them? They are two pieces then
        self.apart = self.lib.pre_tokenizer is not None and len(self.lib.pre_tokenizer.pre_tokenize_str(f" ab\u00e9{_SIGNS}")) == 2
        self.cache = cache
        self.signs: dict[str, bytes] = {}
        self.long: list[str] = []
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, units: list[str], glue: str, begins: np.ndarray) -> dict[str, bytes]:
        """Ids of units with ``glue`` before each, asked for in rows. The ids of one go from a token of ``begins`` to the next.

        A token over the border of two units would be one beginning less; then each unit of the row is asked for alone.
        """
        out, width = {}, self.type.itemsize
        groups = [units[i : i + 256] for i in range(0, len(units), 256)]
        for us, e in zip(groups, self.lib.encode_batch_fast([glue + glue.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.type)
            at = np.flatnonzero(begins[ids])
            if len(at) != len(us):
                out.update(zip(us, self._bytes([glue + u for u in us])))
                continue
            raw = ids.tobytes()
            ends = [*(at[1:] * width).tolist(), len(raw)]
            out.update(zip(us, map(raw.__getitem__, map(slice, (at * width).tolist(), ends))))
        return out

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units, see ``_cut``. Words are told apart by the blank or the line feed before them."""
        rest = [u for u in units if not u or u.isspace()]
        words = [u for u in units if u and not u.isspace()]
        out = dict(zip(rest, self._bytes([u or " " for u in rest])))
        out.update(self._rows([u for u in words if u[0] != "\n"], " ", self.blank))
        out.update(self._rows([u for u in words if u[0] == "\n"], "", self.line))
        return out

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new units into ``known``; a word with signs after it is that word and the signs."""
        known, words, heads, tails = self.known, [], [], []
        for u in [u for u in new if not u.isalpha()] if self.apart else ():
            head = u.rstrip(_SIGNS)
            if len(head) < len(u):
                word = head[1:] if head[:1] == "\n" else head
                if word.isalpha() and (word.isascii() or max(word) < "\u0180"):
                    words.append(u)
                    heads.append(head)
                    tails.append(u[len(head) :])
        ask = set(heads).difference(known)
        for u in self.older.keys() & ask:
            known[u] = self.older[u]
        ask.update(set(new).difference(words))
        known.update(self._units(list(ask.difference(known))))
        if len(self.signs) > 10_000:
            self.signs = {}
        signs = list(set(tails).difference(self.signs))
        self.signs.update(zip(signs, self._bytes(signs)))
        known.update(zip(words, map(bytes.__add__, map(known.__getitem__, heads), map(self.signs.__getitem__, tails))))
        self.long = [u for u in ask if len(u) > 40] + [u for u in words if len(u) > 40]

    def _cut(self, text: str) -> tuple[list[str], list[bool] | None]:
        """Units of a text: a word stands for itself after a blank, or begins with the line feed before it; "" is a blank alone.

        Words that have neither get a line feed, whose id is cut off again: the
        first unit of a text, or, where other white space takes the slow way, those marked.
        """
        if not text.endswith("\n\n") and not any(map(text.__contains__, _BREAKS)):
            units = text.replace("\n", " \n").split(" ")
            units[0] = "\n" + units[0]
            return units, None
        units = _UNIT.findall(text)
        bare = [u[0] != " " and not u.isspace() for u in units]
        return ["\n" + u if b else u if u.isspace() else u[1:] for u, b in zip(units, bare)], bare

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(o in t for o in _ODD)]
        cut = [self._cut(t) for t in texts]
        for i in whole:
            cut[i] = [], []
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        known, width = self.known, self.type.itemsize
        found = [list(map(known.get, us)) for us, _ in cut]
        gaps = [[i for i, b in enumerate(bs) if b is None] for bs in found]
        new = {us[i] for (us, _), gap in zip(cut, gaps) for i in gap}
        again = self.older.keys() & new
        for u in again:
            known[u] = self.older[u]
        self._learn(list(new - again))
        out = []
        for (us, bare), bs, gap in zip(cut, found, gaps):
            for i in gap:
                bs[i] = known[us[i]]
            out.append(b"".join(bs)[width:] if bare is None else b"".join([b[width:] if c else b for b, c in zip(bs, bare)]))
        for u in self.long:
            del known[u]
        for i, b in zip(whole, self._bytes([texts[i] for i in whole])):
            out[i] = b
        return out


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def _encoder(path: str, width: int) -> UnitEncoder:
    """One encoder per worker process: later tasks find the vocabulary loaded and most units known."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = UnitEncoder(path, width)
    return _ENCODERS[path, width]


@dataclass
class Store:
    folder: str
    width: int
    key: str
    shards: DataFrame
    index: DataFrame


def _key_hash(key: str):
    """64-bit hash of a key; a null key has one too."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00")))


def write_store(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: int = 50_257, folder: str | None = None) -> Store:
    """Encode and write ``df``, then build the index.

    One shuffle of the texts, by ranges of the key. The index sees 30 bytes a document.
    """
    spark = df.sparkSession
    folder = folder or scratch_dir(spark, "token-store")
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    key_type = rows.schema["key"].dataType.simpleString()

    def write(batches):
        enc = _encoder(tokenizer, width)
        end = np.array([end_id], enc.type).tobytes()
        ctx = TaskContext.get()
        fs, root = open_fs(f"{folder}/ids")
        path, out, at, last, copy = f"{root}/{ctx.partitionId():07d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin", None, 0, object(), 0
        for batch in batches:
            for part in slices(batch, "text", 512):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                offsets, counts, copies = [], [], []
                for k, b in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    copy, last = (copy + 1 if k == last else 0), k
                    out.write(b)
                    out.write(end)
                    n = len(b) // width + 1
                    offsets.append(at)
                    counts.append(n)
                    copies.append(copy)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(copies, pa.int64()), pa.array([ctx.partitionId()] * len(part), pa.int32()), pa.array([os.path.basename(path)] * len(part)), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                    names=["key", "copy", "shard", "file", "offset", "n"],
                )
        if out is not None:
            out.close()

    rows.mapInArrow(write, f"key {key_type}, copy long, shard int, file string, offset long, n long").write.parquet(f"{folder}/written")
    written = spark.read.parquet(f"{folder}/written")
    sums = written.groupBy("shard", "file").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/shards")

    n_buckets = max(1, written.count() // BUCKET_KEYS)
    h = F.xxhash64(_key_hash("key"), F.col("copy"))
    slots = written.select(h.alias("h"), "shard", "offset", "n").withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)).cast("int"))
    slots.groupBy("bucket").applyInArrow(_build_bucket, "bucket int, buckets int, keys int, levels array<int>, bits binary, ranks binary, prints binary, shard binary, offset binary, n binary").withColumn("buckets", F.lit(n_buckets)).write.parquet(f"{folder}/index")
    return open_store(spark, folder, key, width)


def open_store(spark, folder: str, key: str = "doc_id", width: int = 2) -> Store:
    return Store(folder, width, key, spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/index"))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct 64-bit keys: level sizes, bits of all levels, slot of each key.

    On each level a key takes the bit it hashes to if no other key does; the
    rest go on to the next level. The slot is the number of set bits before.
    Equal hashes, which no level can tell apart, raise.
    """
    if len(np.unique(h)) < len(h):
        raise ValueError("two keys have the same 64-bit hash and cannot share an index")
    sizes, bits, at = [], [], np.empty(len(h), np.int64)
    left, start = np.arange(len(h)), 0
    while len(left):
        size = max(2, int(len(left) * LOAD))
        place = (_mix(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        here = alone[place]
        at[left[here]] = start + place[here]
        sizes.append(size)
        bits.append(alone)
        left, start = left[~here], start + size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, (np.cumsum(flat) - 1)[at] if len(h) else at


def find_slots(h: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slots of keys, -1 where no level has their bit. ``ranks``: set bits before each bit."""
    slot = np.full(len(h), -1, np.int64)
    left, start = np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        place = start + (_mix(h[left], level) % np.uint64(size)).astype(np.int64)
        here = bits[place]
        slot[left[here]] = ranks[place[here]]
        left, start = left[~here], start + size
    return slot


def _prints(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 1000) >> np.uint64(32)).astype(np.uint32)


def _build_bucket(table: pa.Table) -> pa.Table:
    h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    sizes, bits, slot = build_mph(h)
    back = np.argsort(slot)
    put = lambda a: pa.array([a.tobytes()], pa.binary())
    words = np.packbits(bits, bitorder="little")
    return pa.table(
        {
            "bucket": table.column("bucket").slice(0, 1).combine_chunks(),
            "buckets": pa.array([0], pa.int32()),
            "keys": pa.array([len(h)], pa.int32()),
            "levels": pa.array([sizes], pa.list_(pa.int32())),
            "bits": put(words),
            "ranks": put((np.cumsum(bits)[63::64] if len(bits) > 63 else np.zeros(0)).astype(np.uint32)),
            "prints": put(_prints(h)[back]),
            "shard": put(table.column("shard").to_numpy()[back].astype(np.int32)),
            "offset": put(table.column("offset").to_numpy()[back].astype(np.int64)),
            "n": put(table.column("n").to_numpy()[back].astype(np.int64)),
        }
    )


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    h = keys.column("h").to_numpy().astype(np.int64).view(np.uint64)
    shard, offset, n = (np.full(len(h), -1, t) for t in (np.int32, np.int64, np.int64))
    if len(h) and index.num_rows:
        row = {c: index.column(c)[0].as_py() for c in ("keys", "levels", "bits", "ranks", "prints", "shard", "offset", "n")}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")[: sum(row["levels"])].astype(bool)
        # set bits before a bit: those of the full 64-bit words before it, and those before it in its word
        word = np.concatenate([[0], np.frombuffer(row["ranks"], np.uint32).astype(np.int64)])
        inside = np.cumsum(np.pad(bits, (0, -len(bits) % 64)).reshape(-1, 64), axis=1).ravel()[: len(bits)] - bits
        slot = find_slots(h, row["levels"], bits, word[np.arange(len(bits)) // 64] + inside)
        known = slot >= 0
        known[known] = np.frombuffer(row["prints"], np.uint32)[slot[known]] == _prints(h[known])
        for out, name in ((shard, "shard"), (offset, "offset"), (n, "n")):
            out[known] = np.frombuffer(row[name], out.dtype)[slot[known]]
    return pa.table({"key": keys.column("key"), "copy": keys.column("copy"), "shard": shard, "offset": offset, "n": n}).filter(pa.array(shard >= 0))


def look_up(store: Store, keys: DataFrame) -> DataFrame:
    """Places of documents by key: rows of ``keys`` (key, copy) that the store has, with shard, offset and n.

    Keys are put together by bucket, a bounded set as they are made distinct first.
    """
    key_type = keys.schema["key"].dataType.simpleString()
    n_buckets = store.index.agg(F.max("buckets")).first()[0] or 1
    h = F.xxhash64(_key_hash("key"), F.col("copy"))
    asked = keys.select("key", "copy").distinct().withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)).cast("int"))
    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(_look_up, f"key {key_type}, copy long, shard int, offset long, n long")


def read_documents(store: Store, places: DataFrame, columns: str, fn) -> DataFrame:
    """Read the payload of each place and return ``fn(ids as bytes)`` as ``columns``.

    ``places`` comes from ``look_up``. The reads of a shard are sorted, so each file is read forwards.
    """
    width, folder = store.width, store.folder
    key_type = places.schema["key"].dataType.simpleString()
    wanted = places.join(store.shards.select("shard", "file", "before"), "shard").select("key", "copy", "file", "before", "offset", "n")

    def read(batches):
        fs, root = open_fs(f"{folder}/ids")
        name, src = None, None
        for batch in batches:
            found = []
            for f, offset, n in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5))):
                if f != name:
                    if src is not None:
                        src.close()
                    name, src = f, fs.open_input_file(f"{root}/{f}")
                found.append(fn(src.read_at(n * width, offset * width)))
            cols = list(zip(*found)) if found else [[] for _ in columns.split(",")]
            extra = [pa.array(c, pa.int64()) for c in cols]
            start = pa.array(np.asarray(batch.column(3)) + np.asarray(batch.column(4)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), start, batch.column(5), *extra], names=["key", "copy", "start", "n_tokens", *[c.split()[0] for c in columns.split(",")]])
        if src is not None:
            src.close()

    tasks = max(1, store.shards.count())  # the list of places is short, the payload behind it is not
    return wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, f"key {key_type}, copy long, start long, n_tokens long, {columns}")


def crc_of_ids(width: int):
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""

    def crc(raw: bytes) -> tuple[int]:
        return (zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()),)

    return crc
