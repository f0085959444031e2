"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized where they lie; longer ones are cut into pieces. How bins are filled depends on the pieces' lengths
alone, so the plan is made from the number of pieces of each length: at most ``max_tokens`` numbers, however large the corpus.
A bin is filled greedily, the longest piece that fits first; then its smallest piece gives way to two unpacked ones whose
sum fills the expanded gap more tightly, as long as there are such. The same bin is made as often as its lengths last, which
is what bin after bin would give; so a step uses up a length or at least halves what is left of it beyond one bin, and
there are at most about four steps for each length.

Pieces of one length are alike to the plan. A piece's number among them is the number in earlier tasks plus its place in its
own task, and it says which sequence and which place there the piece has. No task and no driver sees more.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import kept, packed, row_field, trimmed, unpacked

#: A worker knows twice so many words at most, each of so many bytes at most; those not met for long make way.
_WORDS, _WORD = 1 << 20, 24


@dataclass
class Plan:
    """Slots by length, in the order in which pieces of the length take them.

    Slots of length c are first[c]..first[c + 1]; slot s is for the pieces numbered from start[s] on: each[s] of them in each
    sequence from sequence[s] on, side by side from offset[s].
    """

    first: np.ndarray
    start: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their lengths and their numbers among the pieces of that length."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for c in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == c)
            lo, hi = int(self.first[c]), int(self.first[c + 1])
            slot = lo + np.searchsorted(self.start[lo:hi], numbers[own], "right") - 1
            turn = numbers[own] - self.start[slot]
            sequence[own] = self.sequence[slot] + turn // self.each[slot]
            offset[own] = self.offset[slot] + turn % self.each[slot] * c
        return sequence, offset


def _best_two(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths with pieces left that fill the room most tightly, the longer one as long as can be; None if no two hold more."""
    have = np.flatnonzero(left[:room])
    if not len(have):
        return None
    at = np.searchsorted(have, np.minimum(have, room - have), "right") - 1
    at = at - ((at >= 0) & (have[at] == have) & (left[have] < 2))
    sums = np.where(at >= 0, have + have[at], 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(have[best]), int(have[at[best]])) if sums[best] > more_than else None


def best_two_fit(counts: dict[int, int], max_tokens: int) -> Plan:
    """Packs counts[c] pieces of each length c, 1 to max_tokens, into sequences of max_tokens."""
    left = np.zeros(max_tokens + 2, np.int64)
    for c, n in counts.items():
        left[c] = n
    taken = np.zeros(max_tokens + 2, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0
    while True:
        longest = np.flatnonzero(left)
        if not len(longest):
            break
        use: dict[int, int] = {}
        gap, rest = max_tokens, left.copy()
        while gap:
            fits = np.flatnonzero(rest[: gap + 1])
            if not len(fits):
                break
            c = int(fits[-1])
            k = min(int(rest[c]), gap // c)
            use[c] = use.get(c, 0) + k
            rest[c] -= k
            gap -= k * c
        while gap:
            least = min(use)
            two = _best_two(rest, gap + least, least)
            if not two:
                break
            use[least] -= 1
            if not use[least]:
                del use[least]
            for c in two:
                use[c] = use.get(c, 0) + 1
                rest[c] -= 1
            rest[least] += 1
            gap += least - sum(two)
        times = min(int(left[c]) // k for c, k in use.items())
        offset = 0
        for c in sorted(use, reverse=True):
            slots.append((c, int(taken[c]), use[c], made, offset))
            offset += c * use[c]
            taken[c] += times * use[c]
            left[c] -= times * use[c]
        made += times
    slots.sort()
    columns = np.array(slots, np.int64).reshape(len(slots), 5).T
    return Plan(np.searchsorted(columns[0], np.arange(max_tokens + 2)), *columns[1:], made)


#: Fixed value: the pattern of tokenizer files whose words can be taken one by one. It keeps no white space, and puts neither
#: letters nor signs beside others into one piece.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters, each of them one code point in both cases, and after them signs that neither begin a clitic nor an added token.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?()]*)").fullmatch


class _Words:
    """Token ids of texts from those of their words, where the tokenizer file lets no token reach over white space."""

    def __init__(self, source: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(source)
        steps = [(n["type"], n.get("pattern")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [(p["type"], p.get("pattern"), p.get("behavior")) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        self.by_word = apart and steps == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)] and split[:1] == [("Split", {"Regex": _PATTERN}, "Removed")]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, in one text: each is one piece, so the pieces' numbers part the ids."""
        if not words:
            return []
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, piece = np.array(found.ids, "<u4"), np.array(found.word_ids)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not known: those of letters with signs after them come from the letters in lower case and the signs."""
        known, older = self.known.get, self.older.get
        parts, have, letters, others = {}, {"": b""}, set(), []
        for w in words:
            m = _PLAIN(w.decode())
            if m:
                parts[w] = own = m[1].lower(), m[2]
                letters.add(own[0])
                if own[1] not in have:
                    have[own[1]] = self._coded([own[1]])[0]
            else:
                others.append(w)
        for x in letters:
            have[x] = known(x.encode()) or older(x.encode())
        lacking = [x for x in letters if have[x] is None]
        have |= zip(lacking, self._letters(lacking), strict=True)
        out = {w: have[x] + have[y] for w, (x, y) in parts.items()}
        return out | dict(zip(others, self._coded([w.decode() for w in others]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._coded([t.decode() for t in texts])
        split = [t.split() for t in texts]  # at 09-0D and 20, which are white space to every library
        here = dict.fromkeys(chain.from_iterable(split))  # a small table of these texts' words, for many look-ups
        unknown = set()
        for w in here:
            found = here[w] = self.known.get(w)
            if found is None:
                found = here[w] = self.older.get(w)
                if found is None:
                    unknown.add(w)
                elif len(w) <= _WORD:
                    self.known[w] = found
        fresh = self._new(unknown)
        for w in unknown:
            here[w] = fresh[w]
        self.known |= {w: ids for w, ids in fresh.items() if len(w) <= _WORD}
        if len(self.known) >= _WORDS:
            self.older, self.known = self.known, {}
        return [b"".join(map(here.__getitem__, words)) for words in split]


_tokenizers: dict[str, _Words] = {}


def _pieces(batches: Iterator[pa.RecordBatch], held, name: str, max_tokens: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """A row for each piece; ``_own`` numbers the pieces of one length within the task."""
    trimmed()
    if name not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[name] = _Words(held.value)
    encode = _tokenizers[name].encode
    seen = np.zeros(max_tokens + 1, np.int64).tolist()
    tail = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = [t or b"" for t in batch.column("_text").to_pylist()]
        at, total = 0, 0
        for to, t in enumerate(texts, 1):
            total += len(t)
            if total < 1 << 22 and to < len(texts):
                continue
            rows, own, crc, start, length, ids = [], [], [], [], [], []
            for k, code in enumerate(encode(texts[at:to]), at):
                code += tail
                for lo in range(0, len(code), 4 * max_tokens):
                    part = code[lo : lo + 4 * max_tokens]
                    n = len(part) // 4
                    rows.append(k)
                    start.append(lo // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    own.append(seen[n])
                    seen[n] += 1
                    ids.append(part if with_ids else None)
            columns = {"_row": batch.column("_row").take(pa.array(rows)), "_part": batch.column("_part").take(pa.array(rows)), "_own": pa.array(own, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))
            at, total = to, 0


def _placed(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    plan = held.value
    for batch in batches:
        sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("_number").to_numpy())
        names = [n for n in batch.schema.names if n != "_number"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, model_path: str, text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """The documents without their text, a row for each piece: ``piece`` (from 0), ``start`` (its document's tokens before it),
    ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``ids`` (those bytes, if ``with_ids``), and
    ``sequence_id`` and ``offset``, its place in a sequence of at most ``max_tokens`` tokens.

    A document's tokens are those of the tokenizers library without special tokens, then ``end_id``. Only documents of more than
    ``max_tokens`` are cut. The tokenizer file and the plan are broadcast: the plan has at most about four bins for each length
    up to ``max_tokens``, and the driver gets one count for each length.

    * Null and empty texts are ``end_id`` alone. Whole texts are taken, whatever their length.
    * Repeated rows and rows without an id each have their own place. An empty table gives an empty table.
    * Input columns of the results' names are replaced; others stay, whatever their names.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    row = row_field(docs, text_col)
    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    numbers = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    schema = T.StructType([row, T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType()), *numbers, *ids])
    rows = packed(docs, text_col, _part=F.spark_partition_id()).withColumn("_text", F.col("_text").cast("binary"))
    pieces = kept(rows.mapInArrow(lambda batches: _pieces(batches, held, model_path, max_tokens, end_id, with_ids), schema))
    counts = pieces.groupBy("length", "_part").agg((F.max("_own") + 1).alias("n"))
    plan = best_two_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_tokens)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    carried = ["_row", *(f.name for f in numbers), *(f.name for f in ids)]
    numbered = pieces.join(earlier, ["length", "_part"]).select(*carried, (F.col("_before") + F.col("_own")).alias("_number"))
    places = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    sent = spark.sparkContext.broadcast(plan)
    found = numbered.mapInArrow(lambda batches: _placed(batches, sent), T.StructType([row, *numbers, *ids, *places]))
    named = ["start", "length", "ids_crc32", *(f.name for f in ids), "sequence_id", "offset"]
    return unpacked(found, docs, text_col, None, piece=(F.col("start") / max_tokens).cast("int"), **{n: F.col(n) for n in named})


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` of each sequence: its pieces' ids side by side. A sequence is of bounded size."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
