import random

import pytest
from pyspark.sql import functions as F

from ladderworks.functions import names
from ladderworks.operators import identity

#: Stated directions: spelling and the key it stands for.
PAIRS = """man city|manchester city
man utd|manchester united
man united|manchester united
bayern munchen|bayern munich
fc bayern munchen|bayern munich
atletico de madrid|ath madrid
club atletico de madrid|ath madrid
kobenhavn|copenhagen
fc kobenhavn|fc copenhagen
royale union saint gilloise|st gilloise
eintracht frankfurt|ein frankfurt
internazionale milano|inter
fc internazionale milano|inter
paris saint germain|paris sg
paris st germain|paris sg
paris sg fc|paris sg
bayer 04 leverkusen|leverkusen
1 koln|koln
queens park rangers|qpr
nottm forest|nottingham forest
nottingham forrest|nottingham forest
olympiacos|olympiakos
pae olympiakos sfp|olympiakos"""


def test_all_spellings_in_the_stated_direction():
    assert dict(line.split("|") for line in PAIRS.splitlines()) == names.ALIASES and len(names.ALIASES) == 23


def test_keys_of_known_names(spark):
    same = [("FC Bayern München", "Bayern Munich"), ("Man City", "Manchester City"), ("Paris Saint Germain", "Paris SG"), ("Queens Park Rangers", "QPR")]
    rows = spark.createDataFrame(same, "a string, b string").select(names.canonical_name(F.col("a")).alias("a"), names.canonical_name(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and rows[3].a == "qpr"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def plain_score(a, b):
    """The three comparisons as texts: what is shared, and that with what each has besides."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    left, right = (" ".join(t for t in (shared, " ".join(sorted(z))) if t) for z in (x - y, y - x))
    ratio = lambda p, q: 100 * 2 * common(p, q) / (len(p) + len(q)) if p or q else 0.0
    rest = 100 * (1 - (len(left) + len(right) - 2 * (len(shared) + (1 if shared and left != shared and right != shared else 0) + common(left[len(shared) :].strip(), right[len(shared) :].strip()))) / (len(left) + len(right)))
    return max([rest] + ([100 * 2 * len(shared) / (len(shared) + len(left)), 100 * 2 * len(shared) / (len(shared) + len(right))] if shared else []))


def some_names(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeo") for _ in range(r.choice([1, 2, 2, 3, 5, 7, 9]))) for _ in range(60)] + ["FC", "United", "City", "de"]
    base = [" ".join(r.choices(words, k=r.randint(1, 5))) for _ in range(n // 2)]
    out = list(base)
    for b in base:
        k = r.randrange(len(b))
        out.append(r.choice([b[:k] + r.choice("xyz ") + b[k + 1 :], b[:k] + b[k + 1 :], b + " " + r.choice(words), " ".join(reversed(b.split())), b[:k] + " " + b[k:]]))
    return out


def test_score_against_a_plain_version():
    rows = some_names(3, 300)
    for k, a in enumerate(rows):
        for b in rows[k % 7 :: 7]:
            assert names.token_set_score(a, b) == pytest.approx(plain_score(a, b))
    assert names.token_set_score("Queens Park Rangers", "Rangers") == 100 and names.token_set_score("", "a") == 0 == names.token_set_score(None, "a")


@pytest.mark.parametrize("least", [88.0, 70.0])
def test_no_similar_pair_is_missed(spark, least):
    rows = some_names(5, 1000)
    left, right = rows[::2], rows[1::2]
    frame = lambda x: spark.createDataFrame([(n,) for n in [*x, None, " "]], "name string")
    found = identity.similar_names(frame(left), frame(right), least)
    got = {(r.a, r.b): r.score for r in found.collect()}
    want = {(a, b): s for a in set(left) for b in set(right) if (s := names.token_set_score(a, b)) >= least}
    assert got == pytest.approx(want) and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_grow_with_the_names(spark):
    """Names of random letters meet those that a letter was changed in, and hardly any others, however many there are."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("bcdfghjklmnpaeio") for _ in range(n)).capitalize()
    known = [f"{word(9)} {word(6)}" for _ in range(1200)]
    asked = [n[:2] + "z" + n[3:] for n in known]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    assert set(zip(asked, known, strict=True)) <= (got := {(x.a, x.b) for x in identity.candidates(frame(asked), frame(known)).collect()})
    assert len(got) < 2 * len(known)


DIM = [(1, "Rangers", 7), (2, "QPR", 3), (5, "Manchester City", 3), (4, "Manchester City", 9), (6, "Olympiakos", 8), (9, "Real Sociedad", 4)]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(DIM, "club_id bigint, club_name string, country_id bigint")


def test_own_country_comes_first(spark, dim):
    asked = spark.createDataFrame([("Glasgow Rangers", 3), ("Manchester City FC", 3), ("Real Sociedadd", 1), ("Nobody", 3), (None, 3)], "name string, country_id bigint")
    got = {r.name: (r.suggestion, r.club_id) for r in identity.suggestions(asked, dim).collect()}
    assert got == {"Glasgow Rangers": ("Rangers", 1), "Manchester City FC": ("Manchester City", 4), "Real Sociedadd": ("Real Sociedad", 9)}


def test_resolve_or_create(spark, dim):
    asked = [(1, "Queens Park Rangers", 3), (2, "Man City", 3), (3, "Glasgow Rangers", 7), (4, "Zzyzx Wanderers", 2), (5, "Zzyzx Wandererss", 2), (6, "Ab", 2), (7, "FC", 2), (8, None, 2), (9, "zzyzx  wanderers", 2), (10, "OLYMPIACOS", 8)]
    frame = spark.createDataFrame(asked, "seq bigint, name string, country_id bigint")
    got = {r.name: (r.club_id, r.how) for r in identity.resolve_names(frame, dim, create=True).collect()}
    assert got == {"Queens Park Rangers": (2, "exact"), "Man City": (4, "exact"), "Glasgow Rangers": (1, "fuzzy"), "Zzyzx Wanderers": (10, "created"), "Zzyzx Wandererss": (10, "created"), "zzyzx  wanderers": (10, "created"), "Ab": (11, "created"), "FC": (None, "unresolved"), None: (None, "unresolved"), "OLYMPIACOS": (6, "exact")}
    plain = {r.name: (r.club_id, r.how) for r in identity.resolve_names(frame, dim).collect()}
    assert plain["Ab"] == (None, "unresolved") and plain["Glasgow Rangers"] == (1, "fuzzy")
    assert identity.resolve_names(frame.limit(0), dim, create=True).collect() == []


def test_first_match_decides_for_its_key(spark, dim):
    asked = spark.createDataFrame([(1, "REAL-SOCIEDADD", 4), (2, "Real Sociedadd", 4), (3, "real sociedadd", 4)], "seq bigint, name string, country_id bigint")
    got = {r.name: (r.club_id, r.how) for r in identity.resolve_names(asked, dim).collect()}
    assert got == {"REAL-SOCIEDADD": (None, "unresolved"), "Real Sociedadd": (9, "fuzzy"), "real sociedadd": (9, "fuzzy")}


def test_created_ids_led_back(spark, dim):
    made = [(100, "Man City", "Rangers", 95.0), (101, "Man City", None, None), (102, "x", "QPR", 50.0), (103, "QPR", "unknown", 90.0), (2, "QPR", None, None)]
    frame = spark.createDataFrame(made, "created_club_id bigint, club_name string, suggestion string, score double")
    assert {r.old: r.new for r in identity.created_map(frame, dim, 80.0).collect()} == {100: 1, 101: 4, 103: 2}


def test_groups(spark):
    r = random.Random(1)
    pairs = [(str(a), str(b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(45))] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)]
    top = {}
    find = lambda x: x if top.get(x, x) == x else find(top[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {x.node: x.least for x in identity.grouped(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]} | {n: find(n) for p in pairs if p[0] != p[1] for n in p}


def test_rekeying_by_steps(spark, dim):
    kind = "result_id bigint, match_date date, league_code string, country_id bigint, home_club_id bigint, away_club_id bigint, home_team_name string, away_team_name string"
    main = spark.sql("SELECT 1L AS result_id, DATE '2020-01-05' AS match_date, 'D1' AS league_code, 3L AS country_id, 2L AS home_club_id, 5L AS away_club_id, 'QPR' AS home_team_name, 'Manchester City' AS away_team_name")
    rows = [(11, "2020-01-05", "D1", 3, 70, 71, "Queens Park Rangers", "Man City"), (12, "2020-02-05", "D1", 3, 70, 71, "QPR", "Man City"), (13, "2020-02-06", "D1", None, 72, 73, "Real Sociedadd", "Rangers"), (14, "2020-02-07", "D1", 3, 74, 75, "Nobody", None)]
    from datetime import date

    staged = spark.createDataFrame([(i, date.fromisoformat(d), *rest) for i, d, *rest in rows], kind)
    got = {r.result_id: (r.home_club_id, r.home_how, r.away_club_id, r.away_how) for r in identity.rekeyed(staged, main, dim).collect()}
    assert got == {11: (2, "fixture", 5, "fixture"), 12: (2, "country", 5, "country"), 13: (9, "fuzzy", 1, "key"), 14: (74, "kept", 75, "kept")}
