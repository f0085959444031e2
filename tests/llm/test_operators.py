import datetime as dt
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from ladderworks.llm.bpe_automaton import decode_ids, encode_texts
from ladderworks.llm.components import components
from ladderworks.llm.decontaminate import decontaminate
from ladderworks.llm.license_scan import scan_licenses
from ladderworks.llm.ngram_join import near_duplicates
from ladderworks.llm.quality_rules import measure
from ladderworks.llm.site_style_tree import extract_main_text, main_text
from ladderworks.llm.substring_dedup import remove_repeated_passages
from ladderworks.llm.token_counts import count_tokens
from ladderworks.llm.toxicity import score, train
from ladderworks.llm.warc import NOT_MODIFIED, resolve_revisits

SCHEMA = "doc_id bigint, text string, kept string, _row string, n_words string"
ODD = [None, "", " ", "a", "\n\n", "É é ﬁ 漢字 <|endoftext|> </s> ▁x", "All Rights Reserved. CC BY cc-by GENERAL public license", "x" * 5000, "tab\tand  two spaces\r\nline " * 3]


def corpus(seed=5, n=60):
    """Documents with copies, near copies, shared passages, null and empty texts, and one very long text."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") * r.randint(1, 3) + str(r.randint(0, 99))
    base = [[word() for _ in range(r.randint(3, 160))] for _ in range(n // 3)]
    passage = [word() for _ in range(50)]
    texts = [" ".join(b) for b in base]
    for b in base:
        near = list(b)
        near[r.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
        texts.append(" ".join(b[: len(b) // 2] + passage + b[len(b) // 2 :]).upper() if r.random() < 0.3 else " ".join([word() for _ in range(40)] + passage))
    texts += ODD + [texts[0], texts[0].upper(), " ".join(word() for _ in range(30000))]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "r", "n") for i, t in corpus()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(docs, none):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == brute.components(corpus())
    assert near_duplicates(none).collect() == []


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(4, text), (4, text), (2, text.upper()), (None, text), (9, None)], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicates(rows).collect()), key=str) == sorted([(4, 2), (4, 2), (2, 2), (None, 2), (9, 9)], key=str)


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.choice([0, 1, 2, 5, 9])):
            w[k] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.components(texts)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (None, 1), (5, 4)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_substring_dedup(docs, none):
    want = brute.cut_repeats(corpus())
    cut = remove_repeated_passages(docs)
    assert cut.columns == ["doc_id", "text", "kept", "_row", "n_words", "n_removed", "removed"] or set(cut.columns) >= {"doc_id", "text", "kept", "_row", "n_words", "n_removed"}
    for r in cut.collect():
        n, gone, left = want[r.doc_id]
        assert (r.n_words, r.n_removed, brute.SPACED.findall(r.text or "")) == (n, gone, left)
        assert r.kept == "k" and r["_row"] == "r"
    assert remove_repeated_passages(none).collect() == []


def test_decontaminate(spark, docs, none):
    texts = dict(corpus())
    long = brute.ALNUM.findall(brute.lower(texts[0]))
    bench = [("b1", " ".join(long[:14]).title()), (None, "x"), ("b2", None), ("b3", ""), ("b4", "cc by"), ("b4", "cc by"), ("b5", " ".join(long[5:40]))]
    items = spark.createDataFrame(bench, "item_id string, text string")
    want = brute.leaks(corpus(), [b for b in bench if b[0] is not None])
    for blocks in (1 << 24, 64):
        got = decontaminate(docs, items, block_bytes=blocks).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert decontaminate(none, items, cut=True).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate(docs, items.limit(0)).collect())


def test_licences(docs, none):
    want = brute.licence_places(corpus())
    for r in scan_licenses(docs).collect():
        assert (r["n_words"], sorted((p["first"], p["label"]) for p in r.phrases)) == want[r.doc_id]
    assert scan_licenses(none).collect() == []


def test_licence_notice_is_chained(spark):
    from ladderworks.llm.license_scan import NOTICES

    words = NOTICES["mit"].split()
    text = "before " + " ".join(words[:40] + ["changed"] + words[41:]) + " after"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [s["label"] for s in r.spans] == ["mit"] and r.spans[0]["share"] > 0.8


def test_word_bpe_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coded = encode_texts(docs, path)
    for r in decode_ids(coded.withColumnRenamed("decoded", "first"), path).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want = library.encode(dict(corpus())[r.doc_id] or "", add_special_tokens=False).ids
        assert ids == want and r.n_tokens == len(want)
        assert r.first == r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode_texts(none, path).collect() == []


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in count_tokens(docs, path).collect():
        text = dict(corpus())[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
    assert count_tokens(none, path).collect() == []


def test_quality_rules(docs, none):
    for r in measure(docs).collect():
        words = brute.SPACED.findall(dict(corpus())[r.doc_id] or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 1000 else set()
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(again))
        assert not (r.base_failed and r.kept)
    assert measure(none).collect() == []


def test_revisits(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    r = [
        (1, "response", "http://www.A.org/x/?utm_a=1", at(1), 200, None, {"ETag": "a", "X": "1", "Content-Type": "t"}),
        (2, "response", "https://a.org:443/x#f", at(3), 200, None, {"ETag": "b"}),
        (3, "response", "https://a.org/x", at(4), 404, None, {"ETag": "c"}),
        (4, "revisit", "http://a.org/x", at(2), 304, NOT_MODIFIED, {"etag": "W/a", "x": "2", "content-type": "no"}),
        (5, "revisit", "http://a.org/x", at(5), 304, NOT_MODIFIED, {"etag": "a"}),
        (6, "revisit", "http://a.org/x", at(5), 304, NOT_MODIFIED, None),
        (7, "revisit", "http://b.org/", at(5), 304, NOT_MODIFIED, {"etag": "a"}),
        (8, "revisit", None, None, 304, NOT_MODIFIED, {"etag": "a"}),
        (9, "revisit", "http://a.org/x", at(1), 304, NOT_MODIFIED, {"etag": "a"}),
        (10, "revisit", "http://a.org/x", at(2), 304, "other", {"etag": "a"}),
    ]
    schema = "record_id bigint, type string, uri string, date timestamp, status int, profile string, headers map<string,string>"
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x.record_id: (x.outcome, x.refers_to, x.headers) for x in resolve_revisits(spark.createDataFrame(r, schema)).collect()}
        assert got == {4: ("resolved", 1, {"etag": "W/a", "x": "2", "content-type": "t"}), 5: ("mismatch", None, None), 6: ("unproven", None, None), 7: ("orphan", None, None), 8: ("orphan", None, None), 9: ("orphan", None, None)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert resolve_revisits(spark.createDataFrame([], schema)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(len(w))] = "vile" + r.choice("abcdefgh") * r.randint(1, 3)
        rows.append((i, " ".join(w), int(toxic)))
    rows.append((600, None, 0))
    data = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    known = data.where("doc_id < 400").select("doc_id", "toxic", F.lit(0).alias("low_quality"))
    chain = train(data, known, ["low_quality", "toxic"])
    got = score(data.drop("toxic"), chain, ["low_quality", "toxic"]).where("doc_id >= 400").collect()
    right = [(x.p_toxic >= 0.5) == (x.doc_id % 5 == 0 and x.doc_id < 600) for x in got]
    assert sum(right) >= 0.97 * len(right) and all(x.p_low_quality < 0.1 for x in got)
    assert all(x.p_toxic == 0.5 for x in score(data.drop("toxic"), train(data, known.limit(0), ["low_quality", "toxic"]), ["low_quality", "toxic"]).collect())


def test_main_text(spark):
    html = '<html><body><header class="site">S</header><div id="sidebar">x</div><main><header><h1>T &amp; U</h1></header><p>a <b>b</b>\n c</p><div class="comments"><p>no</p></div><aside>q</aside><ul><li>one<li>two</ul>tail<script>if(a<b){}</script></main><footer>f'
    assert main_text(html) == "T & U\na b c\none\ntwo\ntail"
    page = lambda i: f'<body><div class="top-line">Welcome to the site</div><div class="story">Story number {i} is here</div></body>'
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(20)] + [(50, None, None), (51, "x", ""), (52, "http://other.org/", page(1))]
    for most in (1 << 20, 0):  # low nodes are broadcast, or joined by salt
        got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_bytes=most).collect()}
        assert all(got[i] == f"Story number {i} is here" for i in range(20)) and got[50] == got[51] == ""
        assert got[52] == "Welcome to the site\nStory number 1 is here"


def test_main_text_in_wrappers_that_are_the_same_on_every_page(spark):
    menu = '<div class="links"><ul class="list"><li>Home<li>About us</ul></div>'
    shapes = {
        "a": lambda i: f'<div id="page"><div class="wrap"><article><h1>Title {i}</h1><p>Body of {i}</p></article></div></div>',
        "b": lambda i: f'<div class="story"><p>Title {i}</p><div class="text"><p>Body of {i}</p></div></div>',
        "c": lambda i: f'<div class="story">By our desk<p>Title {i}</p><p>Body of {i}</p></div>',
    }
    rows = [(1000 * k + i, f"http://{h}.org/{i}", f"<html><body>{menu}{page(i)}</body></html>") for k, (h, page) in enumerate(shapes.items()) for i in range(25)]
    for most in (1 << 20, 0):
        got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_bytes=most).collect()}
        assert got == {p: f"Title {p % 1000}\nBody of {p % 1000}" for p, _, _ in rows}


def test_a_short_line_said_twice_rejects_no_document(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"the {w}{k} and" for w in "abcdefghijklmnopqrstuvwxyz")
    again = "\n".join([text(0)] + [f"of {w} a long line to be said with the {w} twice over" for w in ("one", "one")])
    most = "\n".join(["the short one is first"] + 2 * [text(1)])
    rows = spark.createDataFrame([(1, "again\n" + text(1) + "\nagain"), (2, again), (3, most), (4, text(2))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, rows, "").collect()) == [1, 2, 4]
    assert {r.doc_id for r in measure(rows).collect() if "dup_line_ratio" in r.failed_rules} == {1, 2, 3}  # as op1's SQL says


def test_benchmark_items_without_an_id_hit(spark, docs):
    words = brute.ALNUM.findall(brute.lower(dict(corpus())[0]))
    bench = [("b1", " ".join(words[:12])), (None, " ".join(words[20:40])), (None, "cc by"), ("b2", "cc by")]
    items = spark.createDataFrame(bench, "item_id string, text string")
    want = brute.leaks(corpus(), [(i or "", t) for i, t in bench])
    for blocks in (1 << 24, 64):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, items, block_bytes=blocks).collect()}
        assert got == {d: (n, hit, [i for i in ids if i]) for d, (n, hit, ids) in want.items()}
    assert any(hit and not any(ids) for _, hit, ids in want.values()) or got[0][1] > 12


def test_licence_phrase_of_one_word(spark):
    rows = spark.createDataFrame([(1, "under the Unlicense, and again: unlicense"), (2, "unlicense"), (3, "cc by unlicense cc")], "doc_id bigint, text string")
    got = {r.doc_id: sorted(p["first"] for p in r.phrases) for r in scan_licenses(rows, phrases={"unlicense": "unlicense", "...": "none"}).collect()}
    assert got == {1: [2, 5], 2: [0], 3: [2]}


def test_main_text_goes_by_whole_names():
    story = "<h1 class='entry-header'>Title</h1><p class='notice'>Body of it</p><section id='related-work'><p>More</p></section>"
    whole = "Title\nBody of it\nMore"
    for frame in ("class='layout has-sidebar'", "id='page' class='no-sidebar'", "class='sidebar'", "id='page-header'", "class='menu nav-menu'"):
        assert main_text(f"<body><div {frame}><article>{story}</article></div></body>") == whole
    aside = "<div class='sidebar widget-2'><article>Teaser</article>x</div><div id='comments'><article class='comment'>Me too, and a lot to say about it</article></div>"
    assert main_text(f"<body><article>{story}</article>{aside}<article class='comment' id='comment-7'>I think so</article></body>") == whole
    cards = "<article class='card'>One</article><article class='card'>Two</article>"
    assert "The story of the day is long" in main_text(f"<body><div class='text'><p>The story of the day is long</p></div>{cards}</body>")
    assert main_text("<body><article><p>The text</p><div class='social-share'>Share it</div></article><div class='cookie-banner'>We use them</div></body>") == "The text"
