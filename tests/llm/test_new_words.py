"""Spelling variants, whitening and packing against plain versions."""

import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ladderworks.llm.packing import best_two_fit, pack_documents, sequences
from ladderworks.llm.spelling_variants import near_pairs, spelling_variants, word_counts
from ladderworks.llm.whitening import Gram, whiten

MODEL = public_tokenizers.path("word_bpe_49k.json")
LETTERS = regex.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(docs):
    found = Counter()
    for i, t in docs:
        for run in LETTERS.findall(t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {w: min(v, key=lambda x: (-counts[x], x)) if v else None for w, v in near.items()}
    form = {w: v if v and counts[v] >= 10 * counts[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def text_rows(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("aabcé×Z") for _ in range(r.randint(6, 10))) for _ in range(60)]
    stems += [s[: (k := r.randrange(len(s)))] + r.choice(["", "a", "bc", "þ"]) + s[k + r.randint(0, 1) :] for s in stems * 3]
    weights = [10 ** r.uniform(0, 2.4) for _ in stems]
    rows = [(i, " ".join(r.choices(stems, weights, k=150)) + r.choice([".", "1", "\n"])) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "Ābcdefgh Ābcdefgh abcdefg1abcdefg"), (103, "x" * 30000 + " " + "x" * 30000 + " " + "x" * 29999 + "-" + "x" * 29999), (None, "Nullified nullified NULLIFIED"), (4, rows[4][1]), (4, rows[4][1])]


@pytest.mark.parametrize("range_words", [5, 40, 1 << 16])
def test_spelling_variants_equal_a_plain_version(spark, range_words):
    rows = text_rows(range_words)
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id bigint, text string, n int, word string").repartition(3)
    counts = word_counts(docs, slip_every=31)
    assert {r.word: r.n for r in counts.collect()} == plain_counts(rows)
    got = spelling_variants(counts, range_words=range_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_counts(rows))


def test_each_pair_comes_once_whatever_the_ranges(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(400)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    expected = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    for range_words in (7, 100, 1000):
        assert sorted(tuple(sorted((p.word, p.near))) for p in near_pairs(frame, range_words).collect()) == expected


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("zzzzzzz", 3)]
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame([*chain, (None, 5), ("nnnnnnn", None)], "word string, n bigint")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb") and got["aaabbbb"] == (None, "aaabbbb") and got["zzzzzzz"] == (None, "zzzzzzz") and len(got) == 6


def test_spelling_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants(word_counts(none)).collect() == []


def test_gram_is_exact():
    r = np.random.default_rng(1)
    for most in (100, 10**6, 2**40, 2**62):
        x, gram = r.integers(-most, most, (3000, 4)), Gram(4)
        for lo in range(0, 3000, 700):
            gram.add(x[lo : lo + 700])
        whole = x.astype(object).T @ x.astype(object)
        assert all(v == whole[i, j] for i, j, v in gram.entries())


def vectors(seed=3, n=300, d=20):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3 + 5).astype(np.float32)
    x[50:150] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1.0, 2.0]), (905, []), (906, [1e30] * d), (None, x[9].tolist())]


def plain_whitening(rows, d):
    good = [(i, [int(np.floor(64.0 * c)) + 1000000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and np.isfinite(c) and abs(c) < 2**56 for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * c - t, n) for c, t in zip(x, s, strict=True)] for x in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    return good, n, s, e[::-1], u[:, ::-1], np.trace(cov)


def test_whitening_equals_a_plain_version(spark):
    rows, d = vectors(), 20
    good, n, s, e, u, trace = plain_whitening(rows, d)
    frame = spark.createDataFrame([(i, v, "k", 1.5) for i, v in rows], "vec_id bigint, embedding array<float>, _row string, n double").repartition(3)
    got = whiten(frame).collect()
    assert len(got) == 16 * len(good) and set(got[0].asDict()) == {"vec_id", "_row", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    by = {(r.vec_id, r.component): r for r in got}
    for i, x in good:
        centred = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)])
        for k in range(16):
            r = by[i, k + 1]
            assert r.n == n and r.deviation == sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
            assert abs(abs(r.whitened) - abs(centred @ u[:, k]) / np.sqrt(e[k])) < 1e-6
            assert abs(r.explained / (e[k] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_one_sign_for_all_rows_and_unit_covariance(spark):
    rows = vectors(8, 200, 6)
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    good = plain_whitening(rows, 6)[0]
    one = {tuple(x): i for i, x in good if i is not None}.values()
    z = {(r.vec_id, r.component): r.whitened for r in got}
    m = np.array([[z[i, k] for k in range(1, 7)] for i in one])
    assert np.abs(np.cov(m.T, bias=True) - np.eye(6)).max() < 1e-9


def test_whitening_of_little(spark):
    kinds = "vec_id bigint, embedding array<float>"
    assert whiten(spark.createDataFrame([], kinds)).collect() == []
    assert whiten(spark.createDataFrame([(1, []), (2, None)], kinds)).collect() == []
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], kinds)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    huge = whiten(spark.createDataFrame([(1, [2.0**55]), (2, [-(2.0**55)])], kinds)).collect()
    assert {r.deviation for r in huge} == {None} and sorted(round(r.whitened, 9) for r in huge) == [-1, 1]
    assert len(whiten(spark.createDataFrame([([1.0, 2.0],), ([2.0, 5.0],)], "embedding array<float>")).collect()) == 4


def check_plan(lengths, capacity):
    plan = best_two_fit(Counter(lengths), capacity)
    number, seen = [], Counter()
    for c in lengths:
        number.append(seen[c])
        seen[c] += 1
    sequence, offset = plan.place(np.array(lengths), np.array(number))
    fill = Counter()
    for s, o, c in sorted(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)):
        assert fill[s] == o
        fill[s] += c
    assert max(fill.values()) <= capacity and len(fill) == plan.sequences
    return plan


def bin_after_bin(lengths, capacity):
    """The method one bin at a time, without counts of like lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own = []
        for c in list(left):
            if sum(own) + c <= capacity:
                own.append(c)
                left.remove(c)
        while sum(own) < capacity:
            room = capacity - sum(own) + min(own)
            pairs = [(a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if min(own) < a + b <= room]
            if not pairs:
                break
            _, a, b = max(pairs)
            left += [min(own)]
            own.remove(min(own))
            for c in (a, b):
                own.append(c)
                left.remove(c)
            left.sort(reverse=True)
        bins.append(own)
    return bins


def test_best_two_fit_is_the_method_bin_after_bin():
    r = random.Random(4)
    for _ in range(60):
        capacity = r.randint(3, 40)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 90))] + [r.randint(1, capacity)] * r.randint(0, 40)
        assert check_plan(lengths, capacity).sequences == len(bin_after_bin(lengths, capacity))


def test_two_fill_the_gap_of_one():
    assert check_plan([6, 3, 2, 2], 10).sequences == 2  # greedy leaves 1 beside 6 and 3
    assert sorted(map(sorted, bin_after_bin([6, 3, 2, 2], 10))) == [[2, 2, 6], [3]]


def test_plan_stays_small():
    r = np.random.default_rng(0)
    lengths = np.minimum(4096, r.lognormal(6.5, 1.2, 300000).astype(int) + 1)
    plan = best_two_fit(dict(zip(*[v.tolist() for v in np.unique(lengths, return_counts=True)], strict=True)), 4096)
    assert plan.sequences <= -(-int(lengths.sum()) // 4096) + 1 and len(plan.start) < 40000
    assert best_two_fit({}, 4096).sequences == 0


def test_packing_equals_the_library(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["Word", "naïve", "it's", "x1y", "漢字", "a b", "\x1c", "á", "<|endoftext|>", "...!"]) for _ in range(r.randint(0, 120))) for _ in range(80)]
    texts += [None, "", " \n", "z" * 3000, " <|startoftext|>\tx"] + [texts[5]] * 40
    docs = spark.createDataFrame([(i if i != 3 else None, t, "s", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, start string, _text int").repartition(3)
    got = pack_documents(docs, MODEL, max_tokens=64)
    assert got.columns == ["doc_id", "_text", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.collect()
    library = Tokenizer.from_file(MODEL)
    expected = Counter()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = struct.pack(f"<{len(ids[k : k + 64])}I", *ids[k : k + 64])
            expected[i if i != 3 else None, k // 64, k, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == expected
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(got).collect()}
    fill = Counter()
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert fill[x.sequence_id] == x.offset and whole[x.sequence_id][4 * x.offset :].startswith(bytes(x.ids))
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 64 and len(fill) == len(bin_after_bin([r.length for r in rows], 64))
    assert pack_documents(docs.where(F.lit(False)), MODEL).collect() == []
