"""Benchmark passages in training text, found with an FM-index over each shard of documents.

A task cuts its documents into shards. A shard becomes one sequence of word symbols, over which an FM-index is
built: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. All windows of the
benchmark run through backward search together; their occurrences are located by walking back to the next sampled
position, and the word spans are merged per document.

Words that no window holds can't be part of an occurrence, nor can runs of window words that are shorter than the
window; both become separators before the index is built. This keeps the index to a few hundredths of the text.

The benchmark is the query set. Up to ``BLOCK_BYTES`` of text (its size is checked) it is broadcast as one block, and documents
aren't shuffled. A larger one is taken in blocks of about that size, one after the other: a block is broadcast, every
document is scanned for it, the spans found are kept as a table and the broadcast goes. Then the spans of all blocks are
joined to their documents. So the driver and a worker hold one block at any time.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import kept, packed, row_field, trimmed, unpacked
from ladderworks.llm.words import ALNUM, Words, covered, cut_words, pieces, spans, split_words

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
_SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by doubling the compared length."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < n and rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


class Bits:
    """A bit vector with counts of ones before any place: packed words and a running count for each."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols by bit planes, highest first; each plane puts the zeros before the ones for the next."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes: list[tuple[int, Bits, int]] = []
        for b in range(bits - 1, -1, -1):
            flags = ((symbols >> b) & 1).astype(bool)
            self.planes.append((b, Bits(flags), int(len(flags) - flags.sum())))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for b, plane, zeros in self.planes:
            one = ((symbol >> b) & 1).astype(bool)
            a, s = plane.ones(at), plane.ones(start)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for b, plane, zeros in self.planes:
            one = plane.get(at).astype(bool)
            out |= one.astype(np.int64) << b
            a = plane.ones(at)
            at = np.where(one, zeros + a, at - a)
        return out


class FMIndex:
    """Over symbols of 1 or more; symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.matrix = WaveletMatrix(bwt, max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        sampled = order % _SAMPLE == 0
        self.sampled = Bits(sampled)
        self.positions = order[sampled]

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.matrix.rank(symbol, at)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns that are written right-aligned, one to a row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - j) & (low < high))
            symbol = patterns[live, j]
            low[live], high[live] = self.back(symbol, low[live]), self.back(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, text position) of every occurrence."""
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), counts)
        row = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        position, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        open_ = np.arange(len(row))
        while len(open_):
            hit = self.sampled.get(row[open_]).astype(bool)
            done = open_[hit]
            position[done] = self.positions[self.sampled.ones(row[done])] + steps[done]
            open_ = open_[~hit]
            row[open_] = self.back(self.matrix.access(row[open_]), row[open_])
            steps[open_] += 1
        return which, position


@dataclass
class Phrases:
    """The windows of a block of items: symbols right-aligned, and the items that hold each."""

    vocabulary: np.ndarray
    lengths_of: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int) -> Phrases:
        words = split_words([None if t is None else t.encode() for _, t in items], ALNUM, lower=True)
        vocabulary, symbol = np.unique(words.hashes, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            own = (symbol[words.first[i] : words.first[i + 1]] + 2).tolist()
            size = min(window, len(own))
            for at in range(len(own) - size + 1) if size else ():
                found[tuple(own[at : at + size])].update(() if item is None else (item,))
        patterns = np.ones((len(found), window), np.int64)
        lengths = np.fromiter((len(p) for p in found), np.int64, len(found))
        lengths_of = np.zeros(len(vocabulary) + 2, np.int64)
        for i, p in enumerate(found):
            patterns[i, window - len(p) :] = p
            np.bitwise_or.at(lengths_of, np.array(p), 1 << len(p))
        return cls(vocabulary, lengths_of, patterns, lengths, [sorted(x) for x in found.values()])

    def occurrences(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, first word) of every occurrence in the texts."""
        none = np.empty(0, np.int64)
        if not len(self.patterns) or not len(words.starts):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == words.hashes, at + 2, 1)
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)
        keep = np.zeros(len(symbol), bool)
        for length in np.unique(self.lengths).tolist():
            good = np.concatenate([[0], (self.lengths_of[symbol] >> length) & 1])
            fresh = np.flatnonzero((good[1:] == 1) & ((good[:-1] == 0) | np.concatenate([[True], text_of[1:] != text_of[:-1]])))
            stop = np.flatnonzero((good[1:] == 1) & np.concatenate([(good[2:] == 0) | (text_of[1:] != text_of[:-1]), [True]])) + 1
            long = stop - fresh >= length
            change = np.zeros(len(symbol) + 1, np.int64)
            np.add.at(change, fresh[long], 1)
            np.add.at(change, stop[long], -1)
            keep |= np.cumsum(change[:-1]) > 0
        kept = np.flatnonzero(keep)
        if not len(kept):
            return none, none
        gap = np.concatenate([[False], (np.diff(kept) > 1) | (text_of[kept[1:]] != text_of[kept[:-1]])])
        place = np.arange(len(kept)) + np.cumsum(gap)
        text = np.ones(place[-1] + 1, np.int64)
        text[place] = symbol[kept]
        origin = np.zeros(len(text), np.int64)
        origin[place] = kept
        index = FMIndex(text, len(self.vocabulary) + 1)
        which, position = index.locate(*index.search(self.patterns, self.lengths))
        return which, origin[position]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """The number of blocks, and the items of each."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 16)).first()[0] or 0
    n = 1 if total <= block_bytes else math.ceil(2 * total / block_bytes)
    return n, lambda b: [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).collect()]


_compiled: dict[tuple[str, int], Phrases] = {}


def _phrases(held, key: tuple[str, int], window: int) -> Phrases:
    """Compiled once in a worker; one block at a time is kept, and its rows go once it is compiled.

    ``key`` is of one call and block: places in memory and Spark's own numbers may be used again.
    """
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Phrases.of(held.value, window)
        if getattr(held, "_path", None):
            vars(held).pop("_value", None)
    return _compiled[key]


def _found(words: Words, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words lie in an occurrence, and per text the items that occur."""
    which, first = phrases.occurrences(words)
    items: list[set[str]] = [set() for _ in words.counts]
    pairs = np.unique(np.stack([np.searchsorted(words.first, first, "right") - 1, which], 1), axis=0)
    for d, p in pairs.tolist():
        items[d].update(phrases.items[p])
    return covered(first, phrases.lengths[which], len(words.starts)), items


def _spans_of(words: Words, inside: np.ndarray) -> list[list[list[int]]]:
    sums = np.concatenate([[0], np.cumsum(inside)])
    return [spans(inside[a:b]) if sums[b] > sums[a] else [] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


_HITS = pa.list_(pa.list_(pa.int64()))


def _answer(batch: pa.RecordBatch, judge: Callable[[Words, int, int], tuple[np.ndarray, list]], cut: bool) -> pa.RecordBatch:
    texts = batch.column("_text").cast(pa.binary()).to_pylist()
    n_words, n_hit, hits, items, left = [], [], [], [], []
    for lo, hi in pieces(texts, SHARD_BYTES):
        words = split_words(texts[lo:hi], ALNUM, lower=True)
        inside, found = judge(words, lo, hi)
        sums = np.concatenate([[0], np.cumsum(inside)])
        n_words += words.counts.tolist()
        n_hit += (sums[words.first[1:]] - sums[words.first[:-1]]).tolist()
        hits += _spans_of(words, inside)
        items += [sorted(x) for x in found]
        left += cut_words(words, inside, texts[lo:hi]) if cut else []
    columns = {"_row": batch.column("_row"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, _HITS), "items": pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(left, pa.binary()).cast(pa.string())} if cut else {}))


def _scan(batches: Iterator[pa.RecordBatch], held, key: tuple[str, int], window: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Answers for a benchmark of one block."""
    for batch in batches:
        yield _answer(batch, lambda words, lo, hi: _found(words, _phrases(held, key, window)), cut)
    trimmed()


def _scan_block(batches: Iterator[pa.RecordBatch], held, key: tuple[str, int], window: int) -> Iterator[pa.RecordBatch]:
    """Spans and items of one block, for the documents that have any."""
    for batch in batches:
        at, texts, rows = batch.column("_at").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist(), []
        for lo, hi in pieces(texts, SHARD_BYTES):
            words = split_words(texts[lo:hi], ALNUM, lower=True)
            inside, found = _found(words, _phrases(held, key, window))
            rows += [(at[lo + k], h, sorted(i)) for k, (h, i) in enumerate(zip(_spans_of(words, inside), found, strict=True)) if h]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], _HITS), pa.array(columns[2], pa.list_(pa.string()))], names=["_at", "hits", "items"])


def _join(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """Answers from the spans and items of all blocks."""
    for batch in batches:
        hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()

        def judge(words: Words, lo: int, hi: int) -> tuple[np.ndarray, list]:
            own = [(int(words.first[k]) + s, e - s) for k in range(hi - lo) for s, e in hits[lo + k] or ()]
            starts, sizes = np.array(own, np.int64).reshape(-1, 2).T
            return covered(starts, sizes, len(words.starts)), [set(i or ()) for i in items[lo:hi]]

        yield _answer(batch, judge, cut)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with the benchmark windows that occur in them: ``n_words``, ``n_hit``, ``hits`` (merged word spans),
    ``items`` (sorted ids whose windows occur). With ``cut``, the text comes too, without the spans; else it is left out.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Words are runs of ASCII
    letters, ASCII digits and characters beyond ASCII; A-Z count as a-z.

    * A null or empty text has no words and no hits. An item without words or text has no windows; the
      windows of an item without an id hit as others do, but ``items`` has no id for them.
    * Repeated items and windows shared by items count for each item; repeated rows each get the same result.
    * Empty tables give no hits or no rows. Input columns of the names of the results are replaced.
    """
    context, call = docs.sparkSession.sparkContext, uuid.uuid4().hex
    n, block = _blocks(benchmark, item_col, item_text_col, block_bytes)
    fields = [row_field(docs, text_col), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("hits", T.ArrayType(T.ArrayType(T.LongType()))), ("items", T.ArrayType(T.StringType()))))]
    answer = T.StructType(fields + ([T.StructField("kept", T.StringType())] if cut else []))
    frame = packed(docs, text_col)
    if n == 1:
        held = context.broadcast(block(0))
        scanned = frame.mapInArrow(lambda batches: _scan(batches, held, (call, 0), window, cut), answer)
    else:
        frame = kept(frame.withColumn("_at", F.monotonically_increasing_id()))
        parts = None
        for b in range(n):
            held = context.broadcast(block(b))
            own = kept(frame.select("_at", "_text").mapInArrow(lambda batches, held=held, key=(call, b): _scan_block(batches, held, key, window), "_at bigint, hits array<array<bigint>>, items array<string>"))
            held.destroy()
            parts = own if parts is None else parts.unionByName(own)
        found = parts.groupBy("_at").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        scanned = frame.join(found, "_at", "left").select("_row", "_text", "hits", "items").mapInArrow(lambda batches: _join(batches, cut), answer)
    new = {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "hits": F.col("hits"), "items": F.col("items")}
    return unpacked(scanned, docs, text_col, F.col("kept") if cut else None, **new)
