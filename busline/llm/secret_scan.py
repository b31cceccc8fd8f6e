"""Secrets in texts: fixed patterns, and a linear-chain CRF for what they miss.

The CRF tags the words of each line as begin, inside or outside of a secret.
Its features are the shape of a word, its neighbours, and traits of the file;
Viterbi gives the best tag sequence. It learns from the pattern spans in a
bounded sample of documents, with the neighbours hidden in half of the copies,
so that it also finds values without a telling key.

Spans of the CRF that meet a pattern span are left out: pattern spans stay as
they are, the rest is added as kind ``crf``.

Defined cases: a null or empty text has no spans; without a pattern span in
the sample there is no model and only pattern spans are returned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import arrow_map

# The base patterns and their least lengths, in the order of their kinds.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_DOCUMENTS = 60_000  # documents looked at for training lines, about
SAMPLE_LINES = 1_000  # training lines with a pattern span, and as many without
WINDOW = 32  # words of a training line
BINS = 1 << 13  # hashed features
_WORD = re.compile(r"\S+")
_EDGE = " \t\"'`.,;:!?()[]{}<>%&$*#|"
_KEY = re.compile(r"(?i:pass|pwd|secret|token|key|auth|cred)", re.ASCII)
_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+", re.S)
_OTHER = re.compile(r"[^\x00-\x7f]")
_NOT_HEX = re.compile("[^0-9a-fA-F]")
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches that pass, by start and kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _bin(name: str) -> int:
    return zlib.crc32(name.encode()) % BINS


def signature(word: str) -> tuple:
    """What the features of a word depend on; few words have one of their own."""
    key = bool(_KEY.search(word))
    core = word.strip(_EDGE)
    if "=" in core[:-1]:
        core = core[core.rindex("=", 0, len(core) - 1) + 1 :].strip(_EDGE)
    if not core:
        return "", 0, -1, False, key, word if len(word) < 3 else word[:3]
    flat = (core if core.isascii() else _OTHER.sub("a", core)).translate(_SHAPE)
    shape = _RUNS.sub(r"\1", flat)
    bits, is_hex = -1, False
    if "0" in shape and len(core) >= 8:
        bits, is_hex = int(_entropy(core) * 2), not _NOT_HEX.search(core)
    last = word[-1] if word[-1] in "=:" else "="if "=" in word else ""
    return shape[:6] + str(min(len(shape) // 3, 8)), min(len(core) // 4, 12), bits, is_hex, key, last


def word_features(sig: tuple) -> tuple[list[int], list[int], list[int]]:
    """Features of a word for itself, for the words after it, and for the word before it."""
    shape, size, bits, is_hex, key, sign = sig
    mixed = len(set(shape[:6]) & {"a", "A"}) + ("0" in shape[:6])
    names = [f"size{size}", f"shape{shape[:6]}", f"runs{shape[-1:]}", f"mixed{mixed}{size >= 4}", "bias"]
    if bits >= 0:
        names += [f"bits{bits}", f"hex{is_hex}{size}"]
    if key:
        names.append(f"key{sign}")
    alone = not size and not shape
    if alone:
        names.append(f"sign{sign}")
    trait = "sign" if alone and sign[:1] in ("=", ":") else "key=" if key and sign else "key" if key else "word" if set(shape[:6]) <= {"a"} else "mixed" if mixed > 1 else "other"
    return [_bin("w:" + x) for x in names], [_bin("p:" + trait)], [_bin("n:" + trait)]


def file_features(text: str) -> list[int]:
    """Traits of the whole text: keys, assignments, digits."""
    key = "token" in text or "secret" in text or "password" in text or "key" in text or "TOKEN" in text
    return [_bin(f"f:key{key}"), _bin(f"f:sign{' = ' in text or '=\"' in text}"), _bin(f"f:size{min(len(text).bit_length(), 18)}")]


def line_words(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(line)]


def _core_span(line: str, a: int, b: int) -> tuple[int, int]:
    while a < b and line[a] in _EDGE:
        a += 1
    while b > a and line[b - 1] in _EDGE:
        b -= 1
    return a, b


def training_lines(text: str, every: int) -> list[dict]:
    """Lines with a pattern span, and one of ``every`` others, as words with tags."""
    spans, at, out = base_spans(text), 0, []
    traits = file_features(text)
    for line in text.split("\n"):
        inside = [(a - at, b - at) for a, b, _ in spans if at <= a < at + len(line) + 1]
        if inside or zlib.crc32(line.encode("utf-8", "replace")) % every == 0:
            words = line_words(line)
            tags, open_until = [], -1
            for a, b in words:
                hit = next((s for s in inside if s[0] < b and a < s[1]), None)
                if hit is None:
                    tags.append(O)
                else:
                    tags.append(I if a < open_until else B)
                    open_until = max(open_until, *(s[1] for s in inside if s[0] < max(b, open_until) and a < s[1]))
            first = next((k for k, t in enumerate(tags) if t), 0)
            cut = slice(max(0, first - WINDOW // 2), max(0, first - WINDOW // 2) + WINDOW)
            if words:
                out.append({"words": [line[a:b] for a, b in words[cut]], "tags": tags[cut], "traits": traits, "hit": bool(inside)})
        at += len(line) + 1
    return out


@dataclass
class Model:
    weights: np.ndarray  # BINS + 1 features x 3 tags; the last row is empty
    steps: np.ndarray  # tag x next tag
    first: np.ndarray


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(axis=0)
    return m + np.log(np.exp(x - m).sum(axis=0))


def fit(lines: list[dict], rounds: int = 60, rate: float = 0.2, ridge: float = 1e-4) -> Model | None:
    """Maximum likelihood by full-batch Adam; gradients by forward and backward sums."""
    if not any(x["hit"] for x in lines):
        return None
    lines = sorted(lines, key=lambda x: (x["words"], x["tags"]))
    rows = []
    for k, x in enumerate(lines):
        feats = [word_features(signature(w)) for w in x["words"]]
        for hide in (False, True):
            seq = []
            for i, (own, _, _) in enumerate(feats):
                f = own + x["traits"]
                if not hide:
                    f = f + (feats[i - 1][1] if i else []) + ([v ^ 1 for v in feats[i - 2][1]] if i > 1 else []) + (feats[i + 1][2] if i + 1 < len(feats) else [])
                seq.append(f)
            if hide and any(x["tags"]):  # the value alone: keys and signs are plain words
                tags = [B if t and len(w.strip(_EDGE)) >= 12 else O for w, t in zip(x["words"], x["tags"])]
                own = [[_bin("w:bias"), *x["traits"]] if t and not u else s for s, t, u in zip(seq, x["tags"], tags)]
                rows.append((own, tags))
            elif not hide or k % 2:
                rows.append((seq, x["tags"]))
    n, t, width = len(rows), max(len(r[1]) for r in rows), max(len(f) for r in rows for f in r[0])
    feats = np.full((n, t, width), BINS, np.int32)
    tags, mask = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for k, (seq, ys) in enumerate(rows):
        for i, f in enumerate(seq):
            feats[k, i, : len(f)] = f
        tags[k, : len(ys)], mask[k, : len(ys)] = ys, True
    used, feats = np.unique(feats, return_inverse=True)
    feats = feats.reshape(n, t, width)
    empty = int(np.searchsorted(used, BINS)) if BINS in used else -1
    w, steps, first = np.zeros((len(used), 3)), np.zeros((3, 3)), np.zeros(3)
    params, m1, m2 = [w, steps, first], [0, 0, 0], [0, 0, 0]
    gold = (np.arange(3)[:, None, None] == tags) & mask  # tag x row x word
    gold_steps = np.array([[(gold[i, :, :-1] & gold[j, :, 1:]).sum() for j in range(3)] for i in range(3)])
    feats, mask = np.ascontiguousarray(feats), mask.T
    gold = np.ascontiguousarray(gold.transpose(2, 0, 1))  # word x tag x row
    for r in range(1, rounds + 1):
        e = np.ascontiguousarray(w[feats].sum(axis=2).transpose(1, 2, 0))
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[0] = first[:, None] + e[0]
        for i in range(1, t):
            fwd[i] = np.where(mask[i], _lse(fwd[i - 1][:, None] + steps[:, :, None]) + e[i], fwd[i - 1])
        for i in range(t - 2, -1, -1):
            bwd[i] = np.where(mask[i + 1], _lse((steps.T[:, :, None]) + (e[i + 1] + bwd[i + 1])[:, None]), bwd[i + 1])
        z = _lse(fwd[-1])
        p = np.exp(fwd + bwd - z) * mask[:, None]
        after = np.exp(e[1:] + bwd[1:] - z) * mask[1:, None]
        pair = np.einsum("tin,tjn->ij", np.exp(fwd[:-1]), after) * np.exp(steps)
        diff = (gold - p).transpose(2, 0, 1).reshape(-1, 3)
        gw = np.stack([np.bincount(feats.reshape(-1), np.repeat(diff[:, c], width), len(used)) for c in range(3)], axis=1) / n - ridge * w
        if empty >= 0:
            gw[empty] = 0
        grads = [gw, (gold_steps - pair) / n - ridge * steps, (gold[0] - p[0]).sum(axis=1) / n - ridge * first]
        for k, g in enumerate(grads):
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
            params[k] += rate * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-8)
    full = np.zeros((BINS + 1, 3))
    full[used] = w
    full[BINS] = 0
    steps[O, I] = -30.0  # inside follows begin or inside
    first[I] = -30.0
    return Model(full, steps, first)


class Tagger:
    """Tags the words of many lines at once."""

    def __init__(self, model: Model, cache: int = 200_000):
        self.model, self.cache = model, cache
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.signs: dict[tuple, int] = {}
        self.table = np.zeros((12, 256))

    def _row(self, word: str) -> int:
        sig = signature(word)
        at = self.signs.get(sig)
        if at is None:
            at = self.signs[sig] = len(self.signs)
            if at >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            own, after, before = word_features(sig)
            w = self.model.weights
            self.table[:, at] = np.concatenate([w[own].sum(0), w[after].sum(0), w[[x ^ 1 for x in after]].sum(0), w[before].sum(0)])
        self.known[word] = at
        return at

    def tags(self, lines: list[list[str]], traits: list[list[int]]) -> list[np.ndarray]:
        """Viterbi tags of each line."""
        if len(self.known) > self.cache:
            self._clear()
        known, row = self.known, self._row
        ids = [known[w] if w in known else row(w) for line in lines for w in line]
        lengths = np.array([len(x) for x in lines], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        if not ids:
            return [np.zeros(0, np.int8) for _ in lines]
        table = self.table[:, np.array(ids)]
        e = table[:3] + np.repeat(np.array([self.model.weights[t].sum(0) for t in traits]).T, lengths, axis=1)
        line_of = np.repeat(np.arange(len(lines)), lengths)
        for gap, part in ((1, table[3:6]), (2, table[6:9])):
            e[:, gap:] += part[:, :-gap] * (line_of[gap:] == line_of[:-gap])
        e[:, :-1] += table[9:12, 1:] * (line_of[1:] == line_of[:-1])
        return self._viterbi(e, starts, lengths)

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Step t handles every line that is longer than t, so the work is one pass over the words."""
        steps, order = self.model.steps[:, :, None], np.argsort(-lengths, kind="stable")
        size = lengths[order]
        size = size[size > 0]
        first, longest = starts[order][: len(size)], int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), side="left")  # lines longer than t
        back = np.zeros(e.shape, np.int8)
        v = e[:, first] + self.model.first[:, None]
        for t in range(1, longest):
            k = live[t]
            at = first[:k] + t
            cand = v[:, None, :k] + steps
            back[:, at] = cand.argmax(0)
            v[:, :k] = cand.max(0) + e[:, at]
        tags, state = np.zeros(e.shape[1], np.int8), v.argmax(0)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            at = first[:k] + t
            tags[at] = state[:k]
            state[:k] = back[state[:k], at]
        return np.split(tags, starts[1:])


def crf_spans(text: str, lines: list[str], tags: list[np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tagged words that meet no pattern span."""
    out, at = [], 0
    for line, ys in zip(lines, tags):
        if ys.any():
            words, k = line_words(line), 0
            while k < len(words):
                if ys[k] == O:
                    k += 1
                    continue
                end = k + 1
                while end < len(words) and ys[end] == I:
                    end += 1
                a, b = _core_span(line, words[k][0], words[end - 1][1])
                if a < b and not any(s < at + b and at + a < e for s, e, _ in base):
                    out.append((at + a, at + b, 3))
                k = end
        at += len(line) + 1
    return out


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit the CRF on lines from about ``SAMPLE_DOCUMENTS`` documents, chosen by a hash of their key."""
    d = docs.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("text"))
    every = max(1, docs.select(key).count() // SAMPLE_DOCUMENTS)
    d = d.filter((F.pmod("h", F.lit(every)) == 0) & F.col("text").isNotNull())

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for t in batch.column(1).to_pylist() for x in training_lines(t, 40)]
        return pa.RecordBatch.from_pylist(found, pa.schema([("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("traits", pa.list_(pa.int32())), ("hit", pa.bool_())]))

    found = arrow_map(d, lines, "words array<string>, tags array<int>, traits array<int>, hit boolean").withColumn("o", F.xxhash64("words", "tags"))
    once = F.min(F.struct("words", "tags", "traits", "hit")).alias("line")  # of the copies of a line
    picked = [found.filter(c).groupBy("o").agg(once).select("o", "line.*").orderBy("o").limit(SAMPLE_LINES) for c in (F.col("hit"), ~F.col("hit"))]
    rows = [r.asDict() for p in picked for r in p.drop("o").collect()]
    return fit(rows)


def scan(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans of every document: (key, spans array of (start, end, kind)). One pass, no shuffle."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = src.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x 3 numbers at most
    kept: dict[str, Tagger] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        if shared.value is not None:
            tagger = kept.setdefault("tagger", Tagger(shared.value))
            lines = [t.split("\n") for t in texts]
            traits = [f for t, ls in zip(texts, lines) for f in [file_features(t)] * len(ls)]
            tags = tagger.tags([x.split() for ls in lines for x in ls], traits)
            at = 0
            for k, ls in enumerate(lines):
                added[k] = crf_spans(texts[k], ls, tags[at : at + len(ls)], base[k])
                at += len(ls)
        spans = [sorted(b + a, key=lambda s: (s[0], s[2])) for b, a in zip(base, added)]
        rows = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in spans]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["key", "spans"])

    return arrow_map(src, run, f"key {key_type}, spans array<struct<start: long, end: long, kind: string>>", rows=256)


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans, and all spans as text."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return spans.select(
        F.col("key").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )
