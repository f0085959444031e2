import time

import pytest

import brute
import corpus_pipeline
from ladderworks.llm.quality_rules import measure

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, kept string, n_words string, _row string, _text string"


def good(k, n=26):
    return " ".join(f"the {w}{k} and" for w in "abcdefghijklmnopqrstuvwxyz"[:n])


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(1, good(1)), (2, good(2)), (2, good(3)), (3, good(1) + " more"), (None, good(4)), (None, good(4)), (5, None), (6, ""), (7, "short"), (8, good(8)), (8, good(8)), (9, good(2) + "\n" + good(9)), (10, "the and " * 40)]
    frame = spark.createDataFrame([(i, t, None, "s", len(t or ""), "k", "n", "r", "t") for i, t in rows], SCHEMA)
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([("b1", " ".join(good(8).split()[20:40])), (None, good(1)[:80]), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    frame.write.parquet(f"{path}/documents.parquet")
    return path


def names(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_keep_columns_and_take_odd_rows(spark, docs):
    now = spark.read.parquet(f"{docs}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = names(now)
        now = stage(spark, now, docs)
        assert now.columns == columns and all((r.kept, r.n_words, r["_row"], r["_text"]) == ("k", "n", "r", "t") and (k < 2 or r.n_chars == len(r.text)) for r in now.collect())
        after = names(now)
        if name == "quality_rules":
            assert after == sorted((x for x in before if x[0] not in (5, 6, 7, 10)), key=str)
        elif name == "ngram_join":
            assert [i for i, _ in after] == [1, 2, 2, 8, 9, None] and set(after) < set(before)
        else:
            assert [i for i, _ in after] == [i for i, _ in before] or sorted(map(str, (i for i, _ in after))) == sorted(map(str, (i for i, _ in before)))
    last = corpus_pipeline.tokens(spark, now, docs).collect()
    assert sorted(map(str, (r.doc_id for r in last))) == sorted(map(str, (i for i, _ in after))) and all(len(r.ids) == 4 * r.n_tokens for r in last)


def test_stages_take_every_row_alone(spark, docs):
    rows = spark.read.parquet(f"{docs}/documents.parquet")
    odd = rows.where("doc_id IN (5, 6, 7)")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, docs).collect()
        assert len(out) == (0 if name == "quality_rules" else 3)
        assert stage(spark, rows.limit(0), docs).collect() == []


def test_cut_texts_are_those_of_plain_versions(spark, docs):
    rows = spark.read.parquet(f"{docs}/documents.parquet").where("doc_id <> 2 AND doc_id <> 8")
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    want = brute.cut_repeats(texts)
    assert all(brute.SPACED.findall(r.text or "") == want[r.doc_id][2] for r in corpus_pipeline.passages(spark, rows, docs).collect())
    bench = [(r.item_id or "", r.text) for r in spark.read.parquet(f"{docs}/benchmark.parquet").collect()]
    found = brute.leaks(texts, bench)
    assert all(len(brute.ALNUM.findall(brute.lower(r.text))) == found[r.doc_id][0] - found[r.doc_id][1] for r in corpus_pipeline.benchmark(spark, rows, docs).collect())


def test_run_is_the_stages_in_order(spark, docs):
    now = spark.read.parquet(f"{docs}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, docs)
    key = lambda r: (str(r.doc_id), r.n_tokens, bytes(r.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, docs).collect())) == sorted(map(key, now.collect()))


def test_filters_on_verdicts_stay_above_the_metrics(spark):
    long = spark.createDataFrame([(k, " ".join(f"w{i * k % 9973} the" for i in range(20000))) for k in range(1, 5)], "doc_id bigint, text string")
    for wanted in ("kept", "n_repeat_words > 0", "doc_id > 1 AND NOT base_failed"):
        frame = measure(long).where(wanted)
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xxhash64(") == 1 and len(plan) < 20000
    began = time.time()
    measure(long).where("kept").collect()
    assert time.time() - began < 30
