import json

import pytest
from pyspark.sql import functions as F

from ladderworks.sources.pages import match_pages


def match(day, home, away, goals=(1, 0)):
    return {"utcDate": f"{day}T18:30:00Z", "homeTeam": {"id": 1, "name": home, "shortName": home[:1]}, "awayTeam": {"id": 2, "name": away}, "score": {"fullTime": {"home": goals[0], "away": goals[1]}}}


@pytest.fixture()
def replay(tmp_path):
    pages = {
        "2024-01-01_2024-01-10.json": {"matches": [match("2024-01-02", "A", "B"), match("2024-01-03", "  ", "B")], "_links": {"next": {"href": "second.json"}}},
        "second.json": {"matches": [match("2024-01-05", "C", "D", (None, None))], "_links": {"next": {"href": " third.json "}}},
        "third.json": {"matches": [match("2024-01-06", "E", "F"), {"utcDate": "x", "homeTeam": {"name": "Y"}, "awayTeam": {"name": "Z"}}], "_links": {"next": None}},
        "2024-01-11_2024-01-15.json": {"matches": [match("2024-01-06", "E", "F")], "_links": {"next": {"href": "2024-01-11_2024-01-15.json"}}},
    }
    for name, page in pages.items():
        (tmp_path / name).write_text(json.dumps(page))
    return tmp_path


def test_links_are_followed_in_every_range(spark, replay):
    rows = match_pages(spark, url=f"file://{replay}/{{first}}_{{last}}.json", first="2024-01-01", last="2024-01-15", days="10")
    got = sorted((r.at, r.home_name, r.home_short, r.away_name, r.away_short, r.home_goals) for r in rows.withColumn("at", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss")).collect())
    assert got == [("2024-01-02 18:30:00", "A", "A", "B", None, 1), ("2024-01-05 18:30:00", "C", "C", "D", None, None), ("2024-01-06 18:30:00", "E", "E", "F", None, 1)]


def test_a_failing_page_is_an_error(spark, replay):
    (replay / "third.json").write_text("{ broken")
    with pytest.raises(Exception, match="third.json"):
        match_pages(spark, url=f"file://{replay}/{{first}}_{{last}}.json", first="2024-01-01", last="2024-01-15", days="10", tries="2", wait="0").collect()
    with pytest.raises(Exception, match="options missing"):
        match_pages(spark, url="file:///x", first="2024-01-01").collect()
