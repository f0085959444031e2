import random
from collections import Counter

import pytest

import brute
from ladderworks.llm.ngram_join import drop_near_duplicates, near_duplicates


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def rows_of(frame):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame).collect())


def test_several_texts_under_one_id(spark):
    rows = spark.createDataFrame([(4, words(1, 30)), (4, words(2, 50)), (9, words(2, 50)), (7, words(1, 30) + " more")], "doc_id bigint, text string")
    assert rows_of(rows) == Counter({(4, 26, 4): 1, (4, 46, 4): 1, (9, 46, 4): 1, (7, 27, 4): 1})
    left = drop_near_duplicates(rows).collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in left) == [(4, 30), (4, 50)]


def test_rows_without_ids_link_others(spark):
    near = words(3, 60).split()
    far = [*near[10:], *words(4, 10).split()]
    middle = [*near[5:], *words(4, 5).split()]
    rows = [(20, " ".join(near)), (None, " ".join(middle)), (10, " ".join(far)), (None, words(9, 8)), (None, words(9, 8).upper()), (3, None), (None, None), (None, "")]
    got = rows_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert brute.components([(20, rows[0][1]), (10, rows[2][1])])[20][1] == 20  # these two alone aren't linked
    assert got == Counter({(20, 56, 10): 1, (None, 56, 10): 1, (10, 56, 10): 1, (None, 4, None): 2, (3, 0, 3): 1, (None, 0, None): 2})


@pytest.mark.parametrize("same", [True, False])
def test_many_rows_without_ids(spark, same):
    rows = spark.range(10000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one text of some six words' AS text" if same else "concat_ws(' ', 'a', id, 'b', id % 7, 'c', id) AS text")
    got = rows_of(rows.unionByName(spark.createDataFrame([(5, "one text of some six words")], rows.schema)))
    assert sum(got.values()) == 10001 and got[5, 2, 5] == 1
    assert got[None, 2, 5 if same else None] == 10000


def test_dropping_keeps_one_of_each_class(spark):
    r = random.Random(8)
    base = [[f"b{k}w{r.randint(0, 400)}" for _ in range(r.randint(4, 90))] for k in range(25)]
    rows = []
    for k, b in enumerate(base):
        for j in range(r.randint(1, 4)):
            own = list(b)
            if j and len(own) > 40:
                own[r.randrange(len(own))] = "other"
            rows.append((100 * j + k, " ".join(own) if j % 2 else " ".join(own).upper(), j))
    rows += [(907, None, 0), (907, None, 0), (908, " \t", 1), rows[0], rows[0], (None, "alone and without an id", 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, `_row` int").repartition(3)
    found = brute.components([(i, t) for i, t, _ in rows if i is not None])
    want = sorted(i for i, t, _ in set(rows) if i is not None and found[i][1] == i and t and t.strip())
    left = drop_near_duplicates(frame).collect()
    assert sorted(x.doc_id for x in left if x.text and x.text.strip() and x.doc_id is not None) == want
    assert sum(1 for x in left if not x.text or not x.text.strip()) == 3 and sum(x.doc_id is None for x in left) == 1
    assert frame.columns == ["doc_id", "text", "_row"] == drop_near_duplicates(frame).columns
    assert drop_near_duplicates(frame.limit(0)).collect() == []


def test_frequent_passages_without_links(spark):
    common = words("c", 80)
    texts = [(i, f"{common} {words(f'u{i}', 22)}") for i in range(60)] + [(100 + i, f"{words(f'v{i}', 9)} {common}") for i in range(6)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.components(texts)
