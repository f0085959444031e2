"""Count-min sketches of hashed items, kept in slices that shuffle, merge and answer without a broadcast.

Documents are dealt into blocks by a hash. Every block makes a partial sketch of its items (``DEPTH`` rows of
counters, sparse); its non-zero counters go to the slice of the sketch that owns them. A slice adds the partial
sketches of all blocks, then answers each block with those of the block's counters that reached 2. The width of
the sketch grows with the corpus, and so does the number of slices; no task and no message holds the whole.

An item counted at least twice always has all its counters at 2 or more, so the answers lose no repeated item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderworks.llm.words import mix

DEPTH = 2
_SEEDS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xE220A8397B1DCDAF))


@dataclass(frozen=True)
class Layout:
    """Sizes that follow from the bytes of text. width: counters in a row; slices: parts of a row; blocks: of documents."""

    blocks: int
    width_bits: int
    slice_bits: int

    @property
    def slices(self) -> int:
        return 1 << (self.width_bits - self.slice_bits)


def layout(docs: DataFrame, text_col: str, block_bytes: int = 6 << 20, counters_per_word: int = 4) -> Layout:
    """From one pass over the text's length. Blocks and slices grow as the square root of a corpus up to 4 TB, so messages stay
    few; beyond it both have the largest size that a task holds, and the number of messages grows with the square."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    scale = max(1.0, min(32.0, math.sqrt(total / 4e9)))
    blocks = max(1, round(total / (block_bytes * scale)))
    width = max(14, math.ceil(math.log2(max(1, counters_per_word * total / 6))))
    return Layout(blocks, width, min(width, 20 + round(math.log2(scale))))


def in_blocks(docs: DataFrame, key: F.Column | list, sizes: Layout) -> DataFrame:
    """The documents with a column ``_block``, dealt by a hash of the key columns and of the partition that reads them.

    So equal rows of many partitions spread over the blocks; a task that runs again deals out its rows as before.
    """
    return docs.withColumn("_block", F.pmod(F.xxhash64(*key, F.spark_partition_id()), F.lit(sizes.blocks)).cast("int"))


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct integers: low bytes plain, high parts as a unary bitmap. About 2 bits above the entropy each."""
    m = len(values)
    if not m:
        return b""
    low = 0
    while int(values[-1]) >> (8 * low) > 6 * m + 64 and low < 7:
        low += 1
    high = (values >> np.uint64(8 * low)).astype(np.int64)
    bits = np.zeros(int(high[-1]) + m, np.uint8)
    bits[high + np.arange(m)] = 1
    lows = values.astype("<u8").view(np.uint8).reshape(m, 8)[:, :low]
    return np.array([m, low], "<u4").tobytes() + lows.tobytes() + np.packbits(bits).tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    m, low = (int(x) for x in np.frombuffer(data, "<u4", 2))
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + m * low))
    high = np.flatnonzero(bits)[:m] - np.arange(m)
    out = np.zeros((m, 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, m * low, 8).reshape(m, low)
    return out.view("<u8").ravel() + (high.astype(np.uint64) << np.uint64(8 * low))


def counters(items: np.ndarray, row: int, sizes: Layout) -> np.ndarray:
    return mix(items ^ _SEEDS[row]) >> np.uint64(64 - sizes.width_bits)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of bytes: exact to 15, then steps of about a tenth."""
    counts = counts.astype(np.float64)
    return np.where(counts <= 15, counts, np.minimum(255, 15 + 8 * np.log2(np.maximum(counts, 16) / 15))).astype(np.uint8)


def cut_by_slice(sorted_cells: np.ndarray, sizes: Layout) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) of the sorted counters of one row."""
    marks = np.arange(1, sizes.slices, dtype=np.uint64) << np.uint64(sizes.slice_bits)
    cuts = np.concatenate([[0], np.searchsorted(sorted_cells, marks), [len(sorted_cells)]])
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield s, int(cuts[s]), int(cuts[s + 1])


PARTIAL = pa.schema([("_slice", pa.int32()), ("_block", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("_block", pa.int32()), ("_slice", pa.int32()), ("cells", pa.binary()), ("levels", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "bigint", "binary": "binary", "string": "string", "list<element: int64>": "array<bigint>"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def partial_sketch(block: int, items: np.ndarray, sizes: Layout) -> pa.Table:
    rows = []
    mask = np.uint64((1 << sizes.slice_bits) - 1)
    for row in range(DEPTH):
        cells, counts = np.unique(counters(items, row, sizes), return_counts=True)
        for s, lo, hi in cut_by_slice(cells, sizes):
            local, n = cells[lo:hi] & mask, counts[lo:hi]
            rows.append((row * sizes.slices + s, block, encode(local[n == 1]), encode(local[n > 1]), np.minimum(n[n > 1], 65535).astype("<u2").tobytes()))
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=PARTIAL)


def merged_slice(key: tuple, table: pa.Table, sizes: Layout, with_levels: bool) -> pa.Table:
    """Adds the partial sketches of one slice; per block, its counters that reach 2 and their levels."""
    total = np.zeros(1 << sizes.slice_bits, np.uint32)
    mine = []
    for once, more, counts in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True):
        a, b = decode(once), decode(more)
        total[a] += np.uint32(1)
        total[b] += np.frombuffer(counts, "<u2")
        mine.append((a, b))
    rows = []
    for block, (a, b) in zip(table.column("_block").to_pylist(), mine, strict=True):
        hot = np.sort(np.concatenate([a[total[a] > 1], b]))
        if len(hot):
            rows.append((block, key[0].as_py(), encode(hot), levels(total[hot]).tobytes() if with_levels else b""))
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4, schema=ANSWER)


def sketch_answers(blocked: DataFrame, items_of: Callable[[pa.Table], np.ndarray], sizes: Layout, with_levels: bool = True) -> DataFrame:
    """Per block and slice: the block's counters that the merged sketch holds at 2 or more, and their levels if wanted."""

    def make(key, table):
        return partial_sketch(key[0].as_py(), items_of(table), sizes)

    partial = blocked.groupBy("_block").applyInArrow(make, ddl(PARTIAL))
    return partial.groupBy("_slice").applyInArrow(lambda key, table: merged_slice(key, table, sizes, with_levels), ddl(ANSWER))


@dataclass
class Estimates:
    """One block's view of the merged sketch."""

    sizes: Layout
    cells: list[np.ndarray]
    levels: list[np.ndarray]

    @classmethod
    def of(cls, answers: pa.Table, sizes: Layout) -> Estimates:
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("_slice", "cells", "levels")), strict=True))
        cells, found = [], []
        for row in range(DEPTH):
            own = [(s % sizes.slices, decode(c), lv) for s, c, lv in rows if s // sizes.slices == row]
            cells.append(np.concatenate([np.empty(0, np.uint64), *(c + (np.uint64(s) << np.uint64(sizes.slice_bits)) for s, c, _ in own)]))
            known = np.frombuffer(b"".join(lv for _, _, lv in own), np.uint8)
            found.append(known if len(known) == len(cells[-1]) else np.full(len(cells[-1]), 255, np.uint8))
        return cls(sizes, cells, found)

    def level(self, items: np.ndarray) -> np.ndarray:
        """The smallest level over the rows: 0 or 1 means that the item was counted once."""
        out = np.full(len(items), 255, np.uint8)
        for row in range(DEPTH):
            live = np.flatnonzero(out > 1)
            cells = self.cells[row]
            if not len(cells):
                return np.zeros(len(items), np.uint8)
            wanted = counters(items[live], row, self.sizes)
            at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            out[live] = np.minimum(out[live], np.where(cells[at] == wanted, self.levels[row][at], 0))
        return out
