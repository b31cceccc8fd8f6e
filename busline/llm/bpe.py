"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can be last in the
BPE encoding of that prefix. It is found among the tokens that end there (the
matches of a suffix automaton) by testing whether it can follow the last token
of the prefix before it: two tokens can be neighbours if undoing their merges,
the later one first, never shows a merge across their border that BPE would
have made earlier. Back-pointers from the end of the word give the ids.

The work is linear in the text, also for a word of a million letters, and the
ids are those of the merge loop.

Defined cases: a null or empty text has no ids; special tokens in a text are
encoded as their ids; ``decode`` of no ids is the empty string.
"""

from __future__ import annotations

import json
import unicodedata

import ahocorasick
import regex

# Fixed values of the vocabulary format: printable stand-ins for the 256 bytes.
_PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}

_SPACE = "[\t\n\x0b\x0c\r \x85\xa0  -     　]+"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


PAIRS_KEPT = 150_000  # answers of the pair test that a worker keeps, about 25 MB


class PairTable:
    """Merges as numbers: base symbols first, then one token per merge in rank order."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.names = list(base)
        number = {s: i for i, s in enumerate(base)}
        self.base = len(base)
        self.left, self.right = [-1] * self.base, [-1] * self.base
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = (number[a], number[b])
            if a + b in number or pair in self.merged:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = self.merged[pair] = len(self.names)
            self.names.append(a + b)
            self.left.append(pair[0])
            self.right.append(pair[1])
        self.known: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int, ceiling: int = 1 << 60) -> bool:
        """Can ``b`` follow ``a``, if merges of rank ``ceiling`` and later do not count?"""
        while True:
            cross = self.merged.get((a, b))
            if cross is not None and cross < ceiling:
                return False
            if max(a, b) < self.base:
                return True
            if a > b:
                ceiling, a = a, self.right[a]
            else:  # of two equal tokens the left one is made first
                ceiling, b = b + 1, self.left[b]

    def neighbours(self, a: int, b: int) -> bool:
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) >= PAIRS_KEPT:
                self.known.clear()
            known = self.known[(a, b)] = self.fits(a, b)
        return known

    def reachable(self) -> list[bool]:
        """Tokens that BPE makes of their own text."""
        ok = [True] * self.base
        for t in range(self.base, len(self.names)):
            a, b = self.left[t], self.right[t]
            ok.append(ok[a] and ok[b] and self.fits(a, b, t))
        return ok


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends and lower-cased, white-space-free words."""

    def __init__(self, path: str, cache: int = 60_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = sorted((t for t in vocab if t not in made), key=vocab.get)
        self.table = PairTable(base, merges)
        self.ids = [vocab[t] for t in self.table.names]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in (vocab | self.special).items()}
        self.id_text = {i: str(i) for i in self.text_of}
        self.automaton = ahocorasick.Automaton()
        for t, ok in enumerate(self.table.reachable()):
            if ok:
                s = self._symbols(self.table.names[t])
                self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache_size = cache
        self._words: dict[str, tuple[int, ...]] = {}
        self._older_words: dict[str, tuple[int, ...]] = {}
        self._chunks, self._older = {}, {}

    def _symbols(self, token: str) -> str:
        """One character per byte, with 256 added to the last byte of a word."""
        ends = bool(self.end) and token.endswith(self.end)
        s = "".join(chr(BYTE_OF[c]) for c in (token[: -len(self.end)] if ends else token))
        return s[:-1] + chr(ord(s[-1]) + 256) if ends else s

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one word: fill in the last token of each prefix, then walk back."""
        fits, known, last, width, found = self.table.neighbours, self.table.known.get, [-1] * (len(s) + 1), [0] * (len(s) + 1), -1
        for at, (token, n) in self.automaton.iter(s):
            if at == found:
                continue
            if n <= at:
                before = last[at + 1 - n]
                if before < 0:
                    continue
                ok = known((before, token))
                if not (fits(before, token) if ok is None else ok):
                    continue
            last[at + 1], width[at + 1], found = token, n, at
        out, end, ids = [], len(s), self.ids
        while end:
            out.append(ids[last[end]])
            end -= width[end]
        out.reverse()
        return out

    def _word(self, piece: str) -> tuple[int, ...]:
        """Ids of a word; short ones are kept in two generations of bounded size."""
        ids = self._words.get(piece)
        if ids is None:
            ids = self._older_words.get(piece)
            if ids is None:
                s = piece if piece.isascii() else piece.encode().decode("latin-1")
                ids = tuple(self.encode_symbols(s[:-1] + chr(ord(s[-1]) + 256) if self.end else s))
            if len(piece) <= 32:
                if len(self._words) >= self.cache_size:
                    self._words, self._older_words = {}, self._words
                self._words[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run without white space; the most frequent ones are kept, a quarter as many as words."""
        ids = self._older.get(chunk)
        if ids is None:
            ids = self._encode_chunk(chunk)
        if len(chunk) <= 32:
            if len(self._chunks) >= self.cache_size // 4:
                self._chunks, self._older = {}, self._chunks
            self._chunks[chunk] = ids
        return ids

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isascii():
            s = chunk.lower()
            if s.isalpha():  # one piece
                return self._word(s)
        else:
            s = unicodedata.normalize("NFC", chunk)
            s = s.lower() if "Σ" not in s else "".join(c.lower() for c in s)
        return tuple(i for piece in self.pieces.findall(s) for i in self._word(piece))

    def _plain(self, text: str, out: list[int]) -> None:
        for chunk in text.split() if not _ODD_SPACE.search(text) else regex.split(_SPACE, text):
            if (ids := self._chunks.get(chunk)) is None:
                ids = self._chunk(chunk)
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if "<" not in text:
            self._plain(text, out)
            return out
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                self._plain(part, out)
        return out

    def forget(self) -> None:
        """Empty the caches; the vocabulary and its automaton stay."""
        self.table.known.clear()
        self._words, self._older_words = {}, {}
        self._chunks, self._older = {}, {}

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space: the format names no decoder."""
        return " ".join(map(self.text_of.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of a vocabulary file, read once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_columns(df, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False):
    """Encode and decode ``text`` of every row.

    Returns the columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256,
    and the ids themselves if ``with_ids``. No shuffle: each row is on its own.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from busline.llm.common import arrow_map

    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        n, a, b, rows = [], [], [], []
        shown = bpe.id_text.__getitem__
        for t in batch.column(batch.num_columns - 1).to_pylist():
            ids = bpe.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            if with_ids:
                rows.append(ids)
        cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(rows, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(src, run, T.StructType(fields), "__text", after=lambda: encoder(path).forget())
