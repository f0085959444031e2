"""Groups of words that differ by one edit, found by merging errata into the words' trie.

The trie is cut along heavy paths: at every node the child with the most words is heavy, the others are light. A
light word, so one below a light child, makes errata at the node: the branching character is replaced by that of the heavy
child, skipped, or has the heavy child's character put before it. The rest of the word stays, so the light subtrees are merged
into the heavy one, small to large, and terminals that coincide are words one edit apart. Light children of one node are also
merged with each other: those of equal rest, whatever the branching character was. Two words part at exactly one node, so each
pair comes up exactly once, and a word makes errata at no more nodes than the logarithm of the number of words.

Spark deals the sorted words into ranges. A node whose words all lie in one range is merged there; the others are prefixes of
the words at the ends of ranges, and their errata are shuffled to the words. Which child of such a node is heavy follows
from the first words of the ranges (a child that holds more of them holds more words), which all tasks know.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderworks.llm.frames import kept, trimmed
from ladderworks.llm.words import LOWER

#: Words in a range, and entries of a task's table of counts before it is handed on.
_RANGE, _TABLE = 1 << 16, 1 << 18
#: After every string that begins with a prefix: words have no characters beyond U+00FF.
_PAST = "￿"


def _counts(batches: Iterator[pa.RecordBatch], min_length: int, slip_every: int) -> Iterator[pa.RecordBatch]:
    trimmed()
    runs, crc = re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall, zlib.crc32
    found: Counter[str] = Counter()
    rows = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
    for batch in batches:
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
            words = runs((text.as_py() or b"").translate(LOWER).decode())
            if slip_every:
                start, kept_words = crc(f"{key}:".encode()), []
                for w in words:
                    h = crc(w.encode(), start)
                    if not h % slip_every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_length:
                            continue
                    kept_words.append(w)
                words = kept_words
            found.update(words)
            if len(found) >= _TABLE:
                yield rows()
                found.clear()
    yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, slip_every: int = 0) -> DataFrame:
    """``word`` and ``n`` of the runs of letters in whole texts, A-Z lower-cased, of at least ``min_length`` code points that occur
    at least ``min_count`` times overall. Letters are A-Z, a-z and U+00C0 to U+00FF.

    With ``slip_every`` (31, say) runs get slips of the pen that can be told again: where that number divides the crc32 of
    ``<id>:<run>``, one code point of the run is left out; lengths and counts are those of the results.

    * Null and empty texts have no words; an empty table gives an empty table. Null ids read ``None`` in slips.
    * Repeated rows count as often as they occur. Other columns, whatever their names, are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("None")).alias("_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("_text"))
    parts = rows.mapInArrow(lambda batches: _counts(batches, min_length, slip_every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n - 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[:mid] == b[:mid] else (low, mid)
    return low


class _Range:
    """The words of one range, sorted, and the errata of their light subtrees."""

    def __init__(self, words: list[str], counts: list[int], ends: list[tuple[str, str]]):
        self.words, self.counts = words, counts
        self.place = {w: i for i, w in enumerate(words)}
        self.firsts = [first for first, _ in ends]
        at = bisect_left(self.firsts, words[0])
        self.before = ends[at - 1][1] if at else None
        self.after = self.firsts[at + 1] if at + 1 < len(ends) else None
        self.pairs: list[tuple[int, int]] = []
        self.sent: list[tuple[str, bool, int]] = []

    def parted(self) -> list[int]:
        """Lengths of the open nodes, those with words in other ranges: up to so long along the first and the last word."""
        left = -1 if self.before is None else _shared(self.before, self.words[0])
        right = -1 if self.after is None else _shared(self.words[-1], self.after)
        return [left, right]

    def merge(self) -> None:
        words, (left, right) = self.words, self.parted()
        shared = [_shared(a, b) for a, b in zip(words, words[1:], strict=False)]
        # Nodes with more than one child, each when its last word is known: [length of the prefix, where its children begin].
        stack: list[tuple[int, list[int]]] = []
        for i, depth in enumerate([*shared, -1], 1):
            start = i - 1
            while stack and stack[-1][0] > depth:
                d, starts = stack.pop()
                start = starts[0]
                if not (start == 0 and d <= left or i == len(words) and d <= right):
                    self._closed(d, [*starts, i])
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(i)
            elif depth >= 0:
                stack.append((depth, [start, i]))
        for word, most in ((words[0], left), (words[-1], right)):
            for d in range(most + 1):
                if word is words[0] or d > left or words[0][:d] != word[:d]:
                    self._open(word[:d])

    def _closed(self, d: int, starts: list[int]) -> None:
        """A node with all its words here: errata meet in the range's own table."""
        words, find, pairs = self.words, self.place.get, self.pairs
        children = list(zip(starts, starts[1:], strict=False))
        ends_here = len(words[starts[0]]) == d
        inner = children[1:] if ends_here else children
        heavy = max(inner, key=lambda c: c[1] - c[0])
        head = words[heavy[0]][: d + 1]
        prefix = head[:d]
        rest: dict[str, list[int]] | None = defaultdict(list) if len(inner) > 2 else None
        for child in inner:
            if child == heavy:
                continue
            for i in range(*child):
                word = words[i]
                tail = word[d + 1 :]
                for key in (head + tail, head + word[d:], prefix + tail):
                    j = find(key)
                    if j is not None and not words[j].startswith(word[: d + 1]):  # else they part at a later node
                        pairs.append((i, j))
                if rest is not None:
                    rest[tail].append(i)
        if ends_here and (j := find(head)) is not None:
            pairs.append((starts[0], j))
        for same in (rest or {}).values():  # at most one word for each letter
            pairs += [(i, j) for k, i in enumerate(same) for j in same[k + 1 :]]

    def _open(self, prefix: str) -> None:
        """A node with words in other ranges: the errata of its light words here are sent."""
        d = len(prefix)
        tops = Counter(f[d] for f in self.firsts[bisect_left(self.firsts, prefix) : bisect_left(self.firsts, prefix + _PAST)] if len(f) > d)
        head = prefix + min(tops, key=lambda c: (-tops[c], c))
        for i in range(bisect_left(self.words, prefix), bisect_left(self.words, prefix + _PAST)):
            word = self.words[i]
            if word.startswith(head):
                continue
            self.sent.append((head + word[d:], False, i))
            if len(word) > d:
                tail = word[d + 1 :]
                self.sent += [(head + tail, False, i), (f"{prefix}*{tail}", True, i)]
                if tail[:1] != word[d]:  # else they part at a later node
                    self.sent.append((prefix + tail, False, i))


def _errata(batches: Iterator[pa.RecordBatch], ends: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs (key null) and of errata to be met elsewhere (near null)."""
    trimmed()
    words, counts = [], []
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts += batch.column("n").to_pylist()
    if not words:
        return
    own = _Range(words, counts, ends)
    own.merge()
    for lo in range(0, len(own.pairs), 1 << 15):
        part = own.pairs[lo : lo + (1 << 15)]
        a, b = [i for i, _ in part], [j for _, j in part]
        yield _rows([None] * len(part), [False] * len(part), own, a, b)
    for lo in range(0, len(own.sent), 1 << 15):
        part = own.sent[lo : lo + (1 << 15)]
        yield _rows([k for k, _, _ in part], [s for _, s, _ in part], own, [i for _, _, i in part], None)


def _rows(keys: list, any_letter: list[bool], own: _Range, a: list[int], b: list[int] | None) -> pa.RecordBatch:
    near = [None] * len(a) if b is None else [own.words[j] for j in b]
    near_n = [None] * len(a) if b is None else [own.counts[j] for j in b]
    columns = [pa.array(keys, pa.string()), pa.array(any_letter, pa.bool_()), pa.array([own.words[i] for i in a], pa.string()), pa.array([own.counts[i] for i in a], pa.int64()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["key", "any_letter", "word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, range_words: int = _RANGE) -> DataFrame:
    """Each pair of words that differ by exactly one inserted, deleted or replaced code point, once: word, n, near, near_n.

    ``words`` has distinct words of U+00FF at most, sorted by nothing in particular, and their ``n``. The driver gets one pair of
    words for each range of ``range_words`` words.
    """
    words = words.select("word", "n")
    ranges = max(1, -(-words.count() // range_words))
    dealt = kept(words.repartitionByRange(ranges, "word").sortWithinPartitions("word"))
    ends = [(r.first, r.last) for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()]
    ends.sort()
    made = dealt.mapInArrow(lambda batches: _errata(batches, ends), "key string, any_letter boolean, word string, n bigint, near string, near_n bigint")
    if len(ends) < 2:  # all nodes are in one range
        return made.select("word", "n", "near", "near_n")
    made = kept(made)
    sent = made.where("key IS NOT NULL")
    met = sent.where("NOT any_letter").select("key", "word", "n").join(dealt.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("key") == F.col("near"))
    # Words of one key differ in one letter only, so there are at most as many as letters.
    groups = sent.where("any_letter").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w")).where(F.size("w") > 1)
    ones = groups.select("w", F.posexplode("w").alias("at", "a"))
    twos = ones.select("a", F.explode(F.slice("w", F.col("at") + 2, F.size("w"))).alias("b"))
    light = twos.select(F.col("a.word"), F.col("a.n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    return made.where("key IS NULL").select("word", "n", "near", "near_n").unionByName(met.select("word", "n", "near", "near_n")).unionByName(light)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling: a form has ten times the count, so chains are short."""
    steps = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        steps_on = kept(steps.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if not steps_on.agg(F.max("moved")).first()[0]:
            return steps
        steps = steps_on.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10, range_words: int = _RANGE) -> DataFrame:
    """For each row (``word``, ``n``) of distinct words: ``n_near``, the number of words one edit away, ``form``, ``form_n`` and ``root``.

    The form is the near word of the largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times the
    word's own; else it is null, as is form_n. The root is the last word when forms are followed, or the word itself.

    * Rows with a null word or n are left out; of a word that stands in several rows the counts are added.
    * An empty table gives an empty table. Other columns are not looked at.
    """
    words = kept(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = near_pairs(words, range_words)
    both = pairs.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
    fits = -F.col("b.less") >= F.lit(ratio) * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.less")).alias("form_n"))
    judged = kept(judged)
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
