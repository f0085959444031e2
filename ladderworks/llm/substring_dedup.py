"""Exact removal of repeated passages, behind a count-min prefilter.

Every run of ``window`` words is counted in partition sketches that are merged slice by slice (`sketches`). The
merged counters overestimate, so a window whose smallest counter is 1 is unique for certain. A second pass groups
only the others, by a 96-bit fingerprint, and tells each block which of its windows occur again. No window that
repeats is lost and none that is unique is removed.

Shuffled are: the documents once (each later pass reads the same exchange), about 11 bits a counter for the
sketches, and 12 bytes for each distinct window of a block that the sketch takes for repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import packed, row_field, trimmed, unpacked
from ladderworks.llm.sketches import Estimates, Layout, ddl, in_blocks, layout, sketch_answers
from ladderworks.llm.words import SPACED, covered, cut_words, pieces, sequence_hashes, spans, split_words, window_starts

_EXACT = pa.schema([("_slice", pa.int32()), ("_block", pa.int32()), ("prints", pa.binary()), ("twice", pa.binary())])
_REPEATS = pa.schema([("_block", pa.int32()), ("_slice", pa.int32()), ("cells", pa.binary()), ("levels", pa.binary())])


def _texts(table: pa.Table) -> list[bytes | None]:
    return table.column("_text").cast(pa.binary()).to_pylist()


def _windows(texts: list[bytes | None], window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every window's fingerprint, text after text."""
    one, two = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for lo, hi in pieces(texts):
        words = split_words(texts[lo:hi], SPACED, lower=False)
        at = window_starts(words, window)
        one.append(sequence_hashes(words, window)[at])
        two.append(sequence_hashes(words, window, seed=1)[at] >> np.uint64(32))
    return np.concatenate(one), np.concatenate(two)


def _suspects(one: np.ndarray, two: np.ndarray, answers: pa.Table, sizes: Layout):
    """Distinct fingerprints of a block that the sketch takes for repeated, in order; how often each; which windows have which."""
    at = np.flatnonzero(Estimates.of(answers, sizes).level(one) > 1)
    a, b = one[at], two[at]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.stack([a[new], b[new]], 1), np.bincount(which, minlength=int(new.sum())), at, which


def _slice_bounds(prints: np.ndarray, sizes: Layout) -> np.ndarray:
    bits = sizes.width_bits - sizes.slice_bits
    marks = np.arange(1, sizes.slices, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(prints[:, 0], marks), [len(prints)]])


def _to_slices(block: int, left: pa.Table, answers: pa.Table, sizes: Layout, window: int) -> pa.Table:
    trimmed()
    prints, counts, _, _ = _suspects(*_windows(_texts(left), window), answers, sizes)
    cuts = _slice_bounds(prints, sizes)
    rows = [(s, block, prints[lo:hi, 0].tobytes() + prints[lo:hi, 1].astype("<u4").tobytes(), np.packbits(counts[lo:hi] > 1).tobytes()) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4, schema=_EXACT)


def _grouped(key: tuple, table: pa.Table) -> pa.Table:
    """One slice of fingerprints of all blocks: for each block a bit per fingerprint, set if it occurs again anywhere."""
    parts = []
    for data in table.column("prints").to_pylist():
        n = len(data) // 12
        parts.append(np.stack([np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.uint64)], 1))
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)].astype(bool) for x, p in zip(table.column("twice").to_pylist(), parts, strict=True)]
    every = np.concatenate(parts)
    order = np.lexsort((every[:, 1], every[:, 0]))
    every = every[order]
    same = (every[1:] == every[:-1]).all(axis=1)
    again = np.zeros(len(every), bool)
    again[1:] |= same
    again[:-1] |= same
    out = np.empty(len(every), bool)
    out[order] = again
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(f | t).tobytes() for f, t in zip(np.split(out, ends[:-1]), twice, strict=True)]
    slice_id = -1 - key[0].as_py()  # below zero: not a slice of the sketch
    return pa.table([table.column("_block").to_pylist(), [slice_id] * len(bits), [b""] * len(bits), bits], schema=_REPEATS)


def _cut(left: pa.Table, right: pa.Table, sizes: Layout, window: int) -> pa.Table:
    trimmed()
    texts = _texts(left)
    from_sketch = pa.compute.greater_equal(right.column("_slice"), 0)
    one, two = _windows(texts, window)
    prints, _, at, which = _suspects(one, two, right.filter(from_sketch), sizes)
    repeated = np.zeros(len(prints), bool)
    cuts = _slice_bounds(prints, sizes)
    exact = right.filter(pa.compute.invert(from_sketch))
    for s, bits in zip(exact.column("_slice").to_pylist(), exact.column("levels").to_pylist(), strict=True):
        lo, hi = cuts[-1 - s], cuts[-s]
        repeated[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8))[: hi - lo]
    flags = np.zeros(len(one), bool)
    flags[at] = repeated[which]
    kept, n_words, n_removed, removed = [], [], [], []
    done = 0
    for lo, hi in pieces(texts):
        words = split_words(texts[lo:hi], SPACED, lower=False)
        starts = np.flatnonzero(window_starts(words, window))
        gone = covered(starts[flags[done : done + len(starts)]], window, len(words.starts))
        done += len(starts)
        kept += cut_words(words, gone, texts[lo:hi])
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_words += words.counts.tolist()
        n_removed += (sums[words.first[1:]] - sums[words.first[:-1]]).tolist()
        removed += [spans(gone[a:b]) if sums[b] > sums[a] else [] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return pa.table({"_row": left.column("_row"), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, pa.list_(pa.list_(pa.int64())))})


def remove_repeated_passages(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """Cuts every word that lies in a window of ``window`` words that also starts anywhere else in the corpus.

    Returns the input's columns with the text cut, and ``n_words``, ``n_removed`` and ``removed`` (word spans
    [first, past last] of the text as it was). Windows are judged on the input, not on what is left, so every copy goes.

    * A null text has no words and stays null; an empty text stays empty.
    * A text of fewer words than a window keeps all of them.
    * Repeated rows count as copies of each other, and so do overlapping windows of one text.
    * An empty table gives an empty table. Input columns of the names of the results are replaced.
    """
    sizes = layout(docs, text_col)
    blocked = in_blocks(packed(docs, text_col), [F.col("_row"), F.col("_text")] if _hashable(docs) else [F.col("_text")], sizes).repartition("_block")
    answers = sketch_answers(blocked, lambda table: _windows(_texts(table), window)[0], sizes, with_levels=False)
    exact = blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(lambda key, left, right: _to_slices(key[0].as_py(), left, right, sizes, window), ddl(_EXACT))
    repeats = exact.groupBy("_slice").applyInArrow(_grouped, ddl(_REPEATS))
    result = T.StructType([row_field(docs, text_col), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])
    cut = blocked.groupBy("_block").cogroup(answers.unionByName(repeats).groupBy("_block")).applyInArrow(lambda left, right: _cut(left, right, sizes, window), result)
    return unpacked(cut, docs, text_col, F.col("kept"), n_words=F.col("n_words"), n_removed=F.col("n_removed"), removed=F.col("removed"))


def _hashable(docs: DataFrame) -> bool:
    """Maps can't be hashed; such rows are dealt by their text alone."""
    return "map<" not in docs.schema.simpleString() and "variant" not in docs.schema.simpleString()
