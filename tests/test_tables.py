"""Twins, remaps, numbering, labels and segments on small rows; segments against a plain version."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ladderworks.functions import labels
from ladderworks.operators import dedupe
from ladderworks.operators.segments import segments, typical_step

MATCH = "result_id bigint, match_date date, home_club_id bigint, away_club_id bigint, home_team_goals int, away_team_goals int, league_code string"
DAY = dt.date(2024, 3, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_twins_keep_the_last_by_home_then_by_away(spark):
    rows = [(1, DAY, 10, 20, 1, 0, "UCL"), (2, DAY, 10, 21, 1, 0, "UCL"), (3, DAY, 11, 21, 1, 0, "UCL"), (4, DAY, 10, 20, 1, 0, "D3"), (5, DAY, 10, 21, 1, 0, "D3"), (6, DAY, 10, 21, 1, 0, None), (7, None, 1, 2, None, None, "UEL")]
    got = dedupe.drop_twins(spark.createDataFrame(rows, MATCH))
    assert sorted(r.result_id for r in got.collect()) == [3, 4, 5, 6, 7]
    assert dedupe.drop_twins(spark.createDataFrame([], MATCH)).count() == 0


def test_same_fixture_map(spark):
    rows = [
        (1, DAY, 10, 20, 1, 0, "D3"), (2, DAY, 10, 900, 1, 0, "D3"),  # 900 is 20
        (3, DAY, 30, 40, 2, 2, "D3"), (4, DAY, 901, 40, 2, 2, "D3"), (4, DAY, 901, 40, 2, 2, "D3"),  # 901 is 30; a repeated row
        (5, DAY, 50, 60, 3, 3, "D3"), (6, DAY, 50, 61, 3, 3, "D3"), (7, DAY, 50, 902, 3, 3, "D3"),  # two old ids: nothing follows
        (8, None, 10, 903, 1, 0, "D3"),
    ]
    created = spark.createDataFrame([(900,), (901,), (902,), (903,), (900,)], "id bigint")
    assert sorted(map(tuple, dedupe.same_fixture_map(spark.createDataFrame(rows, MATCH), created).collect())) == [(900, 20), (901, 30)]


def test_remaps(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "old bigint, new bigint")
    merged = dedupe.merged_maps([pairs((1, 2), (3, 3)), pairs((1, 9), (3, 4), (5, 6))])
    assert sorted(map(tuple, merged.collect())) == [(1, 2), (5, 6)]
    rows = spark.createDataFrame([(1, DAY, 1, 5, 0, 0, "x"), (2, DAY, None, 7, 0, 0, "x")], MATCH)
    assert sorted((r.result_id, r.home_club_id, r.away_club_id) for r in dedupe.remapped(rows, merged).collect()) == [(1, 2, 6), (2, None, 7)]


def test_numbers_go_on_over_spans(spark):
    rows = spark.range(0, 50, 3).withColumnRenamed("id", "p")
    got = dedupe.numbered(rows, "p", "n", start=5, width=7).orderBy("p").collect()
    assert [r.n for r in got] == list(range(5, 5 + len(got)))
    seen = spark.createDataFrame([("b", 4), ("a", 9), ("b", 1), (None, 0), ("c", 5)], "v string, p bigint")
    assert sorted(map(tuple, dedupe.first_seen(seen, "v", "p").collect())) == [("a", 9, 3), ("b", 1, 1), ("c", 5, 2)]


def test_new_names_follow_the_largest_id(spark):
    dim = spark.createDataFrame([("x", 3), ("y", 8)], "name string, id bigint")
    new = spark.createDataFrame([("z", 2), ("x", 1), ("w", 1), ("z", 5)], "name string, p bigint")
    assert sorted(map(tuple, dedupe.append_new(dim, new, "name", "id", "p").collect())) == [("w", 9), ("x", 3), ("y", 8), ("z", 10)]
    assert sorted(map(tuple, dedupe.append_new(dim.limit(0), new, "name", "id", "p").collect())) == [("w", 1), ("x", 2), ("z", 3)]


def test_slices(spark):
    main = spark.createDataFrame([(1, 2023, "a"), (2, 2024, "a"), (3, 2024, "a")], "k int, y int, v string")
    staged = spark.createDataFrame([(3, 2024, "b"), (4, 2024, "b")], "k int, y int, v string")
    got = dedupe.merge_slice(main, staged, F.col("y"), ["k"])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]


def test_season_labels(spark):
    f = lambda t, k: labels.season_label(F.lit(t), k)
    r = one(spark, f("24/25", "split"), f("2024/2025", "split"), f("2024", "split"), f("2024", "start_year"), f("2025", "end_year"), f("2425", "compact"), f("24", "compact"), f("2024-2025", "dashed"), f("x", "end_year"))
    assert list(r) == ["2024/2025", "2024/2025", None, "2024/2025", "2024/2025", "2024/2025", None, "2024/2025", None]
    h = lambda t: labels.history_label(F.lit(t))
    assert list(one(spark, h("2024-25"), h("2024 – 2025"), h("2024—25"), h("2024/2025"), h("1/2/3"), h("2024"), h("24-25"))) == ["2024/2025", "2024/2025", "2024/2025", "2024/2025", None, None, None]
    m = lambda t, y: labels.season_meets_year(F.lit(t), F.lit(y))
    assert list(one(spark, m("69/70", 1990), m("99/00", 2000), m("2000/2001", 1995), m("2014", 2015), m("2014", 2016), m("all", 1), m("x/2014", 1))) == [True, True, False, True, False, True, True]


def test_texts(spark):
    r = one(spark, labels.title(F.lit("saint-étienne and o'neill")), labels.signed(F.lit(-1234.56)), labels.signed(F.lit(0.0)), *labels.kickoff(F.lit(1704067199)), *labels.file_key(F.lit("https://a/9798/e0.csv")), *labels.file_key(F.lit("https://a/b c.php")))
    assert list(r) == ["Saint-Étienne And O'neill", "-1,234.6", "+0.0", dt.date(2023, 12, 31), "23:59", 2023, "9798", "E0", "misc", "b_c"]
    c = lambda t: labels.cutoffs(F.lit(t), [25, 50], 5, 500, 3)
    assert list(one(spark, c("50, 7,x,7,900,9,11"), c(""), c("a,1"))) == [[7, 9, 11], [25, 50], [25, 50]]


def _plain_segments(v, splits=4, least=8):
    def sse(x):
        m = sum(x) / len(x)
        return sum((y - m) ** 2 for y in x)

    if len(v) < 36:
        return []
    total = sse(v)
    needed, parts = max(total * 0.015, total / len(v) * 6), [(0, len(v))]
    for _ in range(splits):
        options = [(sse(v[a:b]) - sse(v[a:t]) - sse(v[t:b]), -a, -t, b) for a, b in parts for t in range(a + least, b - least)]
        if not options or max(options)[0] < needed:
            break
        _, a, t, b = max(options)
        parts = sorted([p for p in parts if p != (-a, b)] + [(-a, -t), (-t, b)])
    return parts


def test_segments_against_a_plain_version(spark):
    rng, series = random.Random(5), {}
    for k in range(12):
        level, v = 1500.0, []
        for _ in range(rng.choice([20, 36, 60, 120])):
            level += rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 120, -90])
            v.append(round(level + rng.gauss(0, 5), 3))
        series[k] = v
    series[12], series[13] = [1.0] * 40, []
    rows = spark.createDataFrame([(k, i, x) for k, v in series.items() for i, x in enumerate(v)], "k int, i int, v double")
    out = segments(rows, "k", "i", "v")
    got = {}
    for r in out.orderBy("k", "segment").collect():
        got.setdefault(r.k, []).append((r.start, r.end + 1))
    for k, v in series.items():
        if k != 12:
            assert got.get(k, []) == _plain_segments(v), k
    assert {r.k for r in typical_step(out, "k").collect()} == set(got)
