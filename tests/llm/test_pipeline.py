import numpy as np
import public_tokenizers

import brute
import corpus_pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, rows, sf).select("doc_id").collect()}
    texts = [(r.doc_id, r.text) for r in rows.collect() if r.doc_id in kept]
    first = brute.components(texts)
    texts = [(i, t) for i, t in texts if first[i][1] == i]
    cut = {i: w for i, (_, _, w) in brute.cut_repeats(texts).items()}

    docs = rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 2:
            assert {r.doc_id: brute.SPACED.findall(r.text or "") for r in docs.collect()} == cut
        if k == 3:
            left = {r.doc_id: r.text for r in docs.collect()}
            before = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute.leaks(list(before.items()), bench)
    for i, text in left.items():
        n, hit, _ = found[i]
        assert len(brute.ALNUM.findall(brute.lower(text))) == n - hit
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(left[r.doc_id] or "", add_special_tokens=False).ids
    assert {r.doc_id for r in docs.collect()} == set(cut)
