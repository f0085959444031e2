"""Words of many texts as flat numpy arrays, for operators that run inside Arrow batches.

Two word patterns are in use. Both cut the UTF-8 bytes at a set of ASCII separators, so a byte table
describes each of them:

* ``SPACED``: ``[^\\x20\\x09-\\x0D]+``
* ``ALNUM``:  ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

PIECE_BYTES = 1 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ROLL = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACED = _separators([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _A)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of several texts: byte spans in ``buf``; text i has the words first[i]..first[i+1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from prefix sums over the bytes in bounded stretches."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, begin + PIECE_BYTES, "right")))
            stop = int(self.ends[to - 1])
            n = stop - begin
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.buf[begin:stop]] * powers(_BASE, n), out=sums[1:])
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = (sums[e] - sums[s]) * powers(_BASE_INV, n)[s] + (e - s).astype(np.uint64) * _A
            at = to
        return mix(out)

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def all_bytes(self) -> list[bytes]:
        whole = self.buf.tobytes()
        return [whole[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def split_words(texts: list[bytes | None], separators: np.ndarray, lower: bool) -> Words:
    """Words of each text; a null text has none."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    inside = ~separators[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    text_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=text_at[1:])
    return Words(buf, starts, ends, np.searchsorted(starts, text_at), text_at)


def pieces(texts: list[bytes | None], size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each; one long text is a range of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > at and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def sequence_hashes(words: Words, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each word on, by a rolling sum. Values that run over the end of the words are zero."""
    h = words.hashes
    n = len(h)
    out = np.zeros(n, np.uint64)
    if n >= k:
        base = _ROLL[seed]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(base, n), out=sums[1:])
        out[: n - k + 1] = (sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n)[: n - k + 1]
        out[: n - k + 1] = mix(out[: n - k + 1] + np.uint64(k * int(_A) & 0xFFFFFFFFFFFFFFFF))
    return out


def window_starts(words: Words, k: int) -> np.ndarray:
    """Which words begin a window of k words that ends within the same text."""
    counts = words.counts
    last = np.repeat(words.first[1:], counts)
    return np.arange(len(words.starts)) + k <= last


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + k, -1)
    return np.cumsum(change[:n]) > 0


def cut_words(words: Words, removed: np.ndarray, original: list[bytes | None]) -> list[bytes | None]:
    """The texts without the removed words; each goes with the separators up to the next word."""
    out: list[bytes | None] = []
    for i, text in enumerate(original):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        gone = removed[lo:hi]
        if text is None or not gone.any():
            out.append(text)
            continue
        base = int(words.text_at[i])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        at, kept = 0, []
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            kept.append(text[at : int(words.starts[lo + s]) - base])
            at = int(words.starts[lo + e]) - base if lo + e < hi else len(text)
        kept.append(text[at:])
        out.append(b"".join(kept))
    return out


def spans(flags: np.ndarray) -> list[list[int]]:
    """[first, past last] of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2]], 1).tolist() if len(edges) else []
