"""Token counts of a piece vocabulary with ranks (a SentencePiece BPE model), by rank-synchronous merging.

A batch's texts are cut into pre-tokens at places that no piece spans. The distinct pre-tokens stand together in one
ragged array of symbol ids. In a round every sequence applies its lowest-rank pair, all sequences at once; rounds go on
until no sequence has a pair left. What survives is counted: one token for a piece, and one for each UTF-8 byte of a
character that the vocabulary lacks.

All occurrences of the pair in a sequence merge in the same round where that can't change the order of merges; where a
merged piece could form a pair of lower rank with its neighbour, only the leftmost does.

Long pre-tokens (scripts without spaces, long runs) would pay a pass over the whole array for every rank. Theirs is a ragged
array as well, with links over merged places, and the pairs stand in buckets by rank: a round takes the lowest bucket, so
it touches only the places of that rank, and the work is about linear in the length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import packed, row_field, unpacked

SPACE = "▁"
#: A worker remembers at most so many pre-tokens, of at most so many characters each.
_KNOWN, _KNOWN_CHARS = 1 << 18, 64
_LONG = 48
#: From this length on, pairs stand in buckets by rank.
_LINKED = 512
#: Texts are taken in groups of about so many characters.
_GROUP_CHARS = 1 << 21


class PieceVocabulary:
    """Pieces with ranks, the pairs that form them, and where texts can be cut."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = {library.id_to_piece(i): -library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
        ordered = sorted(self.pieces, key=self.pieces.get)
        self.id = {p: i for i, p in enumerate(ordered)}
        self.n = len(ordered)
        keys, made, self.greedy = [], [], np.ones(self.n, bool)
        for p, i in self.id.items():
            for k in range(1, len(p)):
                left, right = self.id.get(p[:k]), self.id.get(p[k:])
                for part in (left, right):
                    if part is not None and part > i:
                        self.greedy[part] = False
                if left is not None and right is not None:
                    keys.append(left * (self.n + 5) + right)
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.pairs = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        self.bigrams = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        mid_space = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        line = any("\n" in p for p in self.pieces)
        self.cut = re.compile(".+" if mid_space else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", re.DOTALL)

    def pre_tokens(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def cut_long(self, pre_token: str) -> list[str]:
        """Parts of a long pre-token, cut between characters that stand side by side in no piece."""
        if len(pre_token) <= _LONG:
            return [pre_token]
        marks = [0, *(k for k in range(1, len(pre_token)) if pre_token[k - 1 : k + 1] not in self.bigrams), len(pre_token)]
        return [pre_token[a:b] for a, b in zip(marks, marks[1:], strict=False)]

    def counts(self, sequences: list[str]) -> np.ndarray:
        """Surviving symbols of each sequence."""
        parts = [self.cut_long(s) for s in sequences]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        chars = "".join(flat)
        lookup = {c: self.id.get(c, self.n + len(c.encode())) for c in set(chars)}
        symbol = np.fromiter((lookup[c] for c in chars), np.int64, len(chars))
        sequence = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
        total = np.zeros(len(flat), np.int64)
        long = np.array([len(x) > _LINKED for x in flat], bool)
        if long.any():
            apart = long[sequence]
            np.add.at(total, sequence[apart], self._linked(symbol[apart], sequence[apart]))
            symbol, sequence = symbol[~apart], sequence[~apart]
        while len(symbol):
            made = self._pairs(symbol, sequence)
            first = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            best = np.minimum.reduceat(made, first)
            done = best == self.n
            size = np.diff(np.concatenate([first, [len(symbol)]]))
            finished = np.repeat(done, size)
            if finished.any():
                np.add.at(total, sequence[finished], np.where(symbol[finished] < self.n, 1, symbol[finished] - self.n))
                keep = ~finished
                symbol, sequence, made = symbol[keep], sequence[keep], made[keep]
                best, size = best[~done], size[~done]
                if not len(symbol):
                    break
            wanted = np.repeat(best, size)
            at = np.flatnonzero(made == wanted)
            single = ~self.greedy[made[at]]
            new = np.concatenate([[True], sequence[at[1:]] != sequence[at[:-1]]])
            at = at[new | ~single]
            at = at[self._apart(at)]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, sequence = symbol[keep], sequence[keep]
        out = np.zeros(len(sequences), np.int64)
        np.add.at(out, owner, total)
        return out

    def _linked(self, symbol: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """What each place of long sequences counts at last: 0 where it was merged into another one."""
        made, n, width = self._pairs(symbol, sequence), self.n, self.n + 5
        inside = np.concatenate([sequence[1:] == sequence[:-1], [False]])
        after = array("q", np.where(inside, np.arange(1, len(symbol) + 1), -1).tobytes())
        before = array("q", np.concatenate([[-1], np.where(inside[:-1], np.arange(len(symbol) - 1), -1)]).astype(np.int64).tobytes())
        at = array("q", symbol.astype(np.int64).tobytes())
        live = np.flatnonzero(made < n)
        live = live[np.argsort(made[live], kind="stable")]
        cuts = np.flatnonzero(np.diff(made[live], prepend=-1))
        buckets = {int(made[p[0]]): p.tolist() for p in np.split(live, cuts[1:])} if len(live) else {}
        ranks, pair = list(buckets), self.pairs.get
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            places = buckets.pop(rank, None)
            if not places:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or at[i] < 0 or at[i] >= n or at[j] >= n or pair(at[i] * width + at[j]) != rank:
                    continue
                far, near = after[j], before[i]
                at[i], at[j], after[i] = rank, -1, far
                first = False
                for place, key in ((near, at[near] * width + rank if near >= 0 and at[near] < n else -1), (i, rank * width + at[far] if far >= 0 and at[far] < n else -1)):
                    fresh = pair(key)
                    if fresh is not None:
                        if fresh not in buckets:
                            buckets[fresh] = []
                            heappush(ranks, fresh)
                        buckets[fresh].append(place)
                        first = first or fresh <= rank
                if far >= 0:
                    before[far] = i
                if first:  # a pair of lower rank, or one further left, is next
                    if rank not in buckets:
                        buckets[rank] = []
                        heappush(ranks, rank)
                    buckets[rank] += places[k + 1 :]
                    break
        left = np.frombuffer(at, np.int64)
        return np.where(left < 0, 0, np.where(left < n, 1, left - n))

    def _pairs(self, symbol: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """The piece that each symbol and the next one form, or n."""
        made = np.full(len(symbol), self.n, np.int64)
        side = np.flatnonzero(sequence[1:] == sequence[:-1])
        if len(side) and len(self.keys):
            key = np.where((symbol[side] < self.n) & (symbol[side + 1] < self.n), symbol[side] * (self.n + 5) + symbol[side + 1], -1)
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            made[side] = np.where(self.keys[k] == key, self.made[k], self.n)
        return made

    @staticmethod
    def _apart(at: np.ndarray) -> np.ndarray:
        """Of places that follow each other directly, every second one from the left."""
        run = np.concatenate([[True], np.diff(at) > 1])
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        return (np.arange(len(at)) - start) % 2 == 0


_vocabularies: dict[str, tuple[PieceVocabulary, dict[str, int]]] = {}


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in groups of bounded size; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t or "") > _GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t or "")
        size += len(t or "")
    if group:
        yield group


def _count(batches: Iterator[pa.RecordBatch], held, name: str) -> Iterator[pa.RecordBatch]:
    if name not in _vocabularies:
        _vocabularies[name] = PieceVocabulary(held.value), {}
    vocabulary, known = _vocabularies[name]
    for batch in batches:
        n_tokens, n_bytes = [], []
        for group in _groups(batch.column("_text").to_pylist()):
            cut = [vocabulary.pre_tokens(t) for t in group]
            fresh = list({p for own in cut for p in own if p not in known})
            now = dict(zip(fresh, vocabulary.counts(fresh).tolist(), strict=True))
            n_tokens += [sum([now[p] if p in now else known[p] for p in own]) for own in cut]
            n_bytes += [len(t.encode()) for t in group]
            if len(known) + len(now) > _KNOWN:
                known.clear()
            known.update((p, n) for p, n in now.items() if len(p) <= _KNOWN_CHARS)
        yield pa.RecordBatch.from_pydict({"_row": batch.column("_row"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """The documents without their text, and ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Counts are those of the model's own library: a leading space mark, no begin or end tokens, byte pieces for unknown
    characters, and strings that look like control pieces taken as text. The model file (a few MB) is broadcast.

    * Null and empty texts have 0 bytes and 0 tokens.
    * Whole texts are counted, whatever their length; repeated rows each have their own result.
    * An empty table gives an empty table. Input columns of the names of the results are replaced.
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([row_field(docs, text_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = packed(docs, text_col).mapInArrow(lambda batches: _count(batches, held, model_path), schema)
    return unpacked(counted, docs, text_col, None, n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > limit)
