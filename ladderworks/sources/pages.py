"""A paginated service of matches as a data source: ranges of dates in parallel, next links followed within each."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import urlencode, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, utc_date string, home_id bigint, home_name string, home_short string, away_id bigint, away_name string, away_short string, home_goals int, away_goals int"


@dataclass
class Span(InputPartition):
    """Days from first to last, both included."""

    first: date
    last: date


def fetch(url: str, token: str, tries: int, wait: float) -> dict:
    """The page's JSON. A page that can't be had after so many tries is an error that names it, never an empty page."""
    for k in range(1, tries + 1):
        try:
            request = urllib.request.Request(url, headers={"X-Auth-Token": token} if token else {})
            with urllib.request.urlopen(request, timeout=120) as answer:
                return json.loads(answer.read())
        except (urllib.error.URLError, ValueError, OSError) as e:
            if k == tries:
                raise RuntimeError(f"no page after {tries} tries: {url}: {e}") from e
            time.sleep(wait * k)
    raise ValueError("tries must be 1 at least")


def flat(match: dict, url: str) -> tuple:
    goals = (match.get("score") or {}).get("fullTime") or {}
    sides = [match.get(x) or {} for x in ("homeTeam", "awayTeam")]
    text = lambda t: t.strip() if isinstance(t, str) and t.strip() else None
    return (url, text(match.get("utcDate")), *[v for t in sides for v in (t.get("id"), text(t.get("name")), text(t.get("shortName")))], goals.get("home"), goals.get("away"))


class MatchPages(DataSource):
    """Options: url (``{first}`` and ``{last}`` in it stand for dates, else they are sent as dateFrom and dateTo), first, last,
    days (of a range, 31), token, tries (3), wait (seconds, 1). Answers have ``matches`` and maybe ``_links.next.href``."""

    @classmethod
    def name(cls) -> str:
        return "match_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = [k for k in ("url", "first", "last") if not options.get(k)]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        self.options = options

    def partitions(self) -> list[Span]:
        at, last, days = date.fromisoformat(self.options["first"]), date.fromisoformat(self.options["last"]), int(self.options.get("days", 31))
        out = []
        while at <= last:
            out.append(Span(at, min(last, at + timedelta(days=days - 1))))
            at += timedelta(days=days)
        return out

    def read(self, span: Span) -> Iterator[tuple]:
        o, days = self.options, {"first": span.first.isoformat(), "last": span.last.isoformat()}
        url = o["url"]
        if "{first}" in url:
            url = url.replace("{first}", days["first"]).replace("{last}", days["last"])
        else:
            url += ("&" if "?" in url else "?") + urlencode({"status": "FINISHED", "dateFrom": days["first"], "dateTo": days["last"]})
        seen = set()
        while url and url not in seen:  # a link back ends the range
            seen.add(url)
            page = fetch(url, o.get("token", ""), int(o.get("tries", 3)), float(o.get("wait", 1)))
            yield from (flat(m, url) for m in page.get("matches") or [])
            link = (page.get("_links") or {}).get("next")
            href = link.get("href") if isinstance(link, dict) else None
            url = urljoin(url, href.strip()) if isinstance(href, str) and href.strip() else None


def match_pages(spark: SparkSession, **options: str) -> DataFrame:
    """Finished matches with both names and a date: kickoff (timestamp), sides and goals; a row that two ranges give comes once."""
    spark.dataSource.register(MatchPages)
    rows = spark.read.format("match_pages").options(**options).load()
    named = rows.where("home_name IS NOT NULL AND away_name IS NOT NULL").withColumn("kickoff", F.try_to_timestamp("utc_date"))
    return named.where("kickoff IS NOT NULL").drop("url", "utc_date").distinct()
