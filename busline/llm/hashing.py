"""64-bit hashes of the words of many texts at once, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # bytes hashed at once
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
STEPS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)  # factors for hashing sequences
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Anything but ASCII letters and digits and the bytes of other scripts.
NON_WORD = ~(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]) | (np.arange(256) >= 128))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_piece(raw: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``raw``."""
    a = np.frombuffer(raw, np.uint8)
    inside = ~separators[a]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, size)
    with np.errstate(over="ignore"):
        part = (_BYTE[a[at]] + (place >> 12).astype(np.uint64)) * _PLACE[place & 4095]
        return mix(np.add.reduceat(part, head) + size.astype(np.uint64)), at[head]


def word_hashes(texts: list[str], separators: np.ndarray = BLANKS) -> list[np.ndarray]:
    """Word hashes of each text; A-Z count as a-z. Long texts are cut between words."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not waiting:
            return
        ends = np.cumsum([len(b) + 1 for b in waiting])
        hashes, starts = _hash_piece(b"\n".join(waiting), separators)
        out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
        waiting.clear()
        size = 0

    for text in texts:
        raw = text.encode("utf-8", "replace").translate(ASCII_LOWER)
        if len(raw) > PIECE:
            flush()
            parts, at = [], 0
            while at < len(raw):
                end = min(len(raw), at + PIECE)
                while end < len(raw) and not separators[raw[end]]:
                    end += 1
                parts.append(_hash_piece(raw[at:end], separators)[0])
                at = end
            out.append(np.concatenate(parts))
            continue
        waiting.append(raw)
        size += len(raw)
        if size > PIECE:
            flush()
    flush()
    return out


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence if it is shorter."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            total += words[j : len(words) - n + 1 + j] * STEPS[j]
        return mix(total)
