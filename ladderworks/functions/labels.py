"""Labels as they stand in sources: seasons, kickoff seconds, lists of numbers, addresses of season files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(text: Column) -> Column:
    """A number written in digits alone, else null."""
    return F.when(F.rlike(text, F.lit(r"^\d+$")), text.try_cast("int"))


def pair(start: Column, end: Column) -> Column:
    return F.concat_ws("/", start.cast("string"), end.cast("string"))


def season_label(text: Column, form: str) -> Column:
    """A season's label as yyyy/yyyy; null where the text hasn't the form (split, start_year, end_year, compact or fbref, also called dashed)."""
    year = whole(text)
    if form == "split":
        short = F.rlike(text, F.lit(r"^[^/]{2}/[^/]{2}$"))
        return F.when(short, F.concat(F.lit("20"), F.substring(text, 1, 2), F.lit("/20"), F.substring(text, 4, 2))).when(F.contains(text, F.lit("/")), text)
    if form == "start_year":
        return F.when(year.isNotNull(), pair(year, year + 1))
    if form == "end_year":
        return F.when(year.isNotNull(), pair(year - 1, year))
    if form == "compact":
        return F.when(F.length(text) == 4, F.concat(F.lit("20"), F.substring(text, 1, 2), F.lit("/20"), F.substring(text, 3, 2)))
    if form in ("fbref", "dashed"):
        return F.replace(text, F.lit("-"), F.lit("/"))
    raise ValueError(f"unknown form: {form}")


def history_label(text: Column) -> Column:
    """yyyy-yyyy or yyyy-yy, with any of three dashes, as yyyy/yyyy; a label with one slash stays, others are null."""
    plain = F.regexp_replace(F.trim(text), "[–—]", "-")
    left, right = F.trim(F.substring_index(plain, "-", 1)), F.trim(F.regexp_extract(plain, "^[^-]*-(.*)$", 1))
    four = F.length(left) == 4
    long = F.when(four & (F.length(right) == 4), F.concat_ws("/", left, right)).when(four & (F.length(right) == 2), F.concat(left, F.lit("/20"), right))
    return F.when(F.contains(plain, F.lit("/")), F.when(F.size(F.split(plain, "/")) == 2, plain)).otherwise(long)


def year_token(text: Column) -> Column:
    """Years of two digits (below 70: 20yy) or four; others null."""
    n = whole(F.trim(text))
    return F.when(F.length(F.trim(text)) == 2, n + F.when(n < 70, 2000).otherwise(1900)).when(F.length(F.trim(text)) == 4, n)


def season_meets_year(label: Column, year: Column) -> Column:
    """Whether a season's span holds the year; labels of an unknown shape do."""
    parts = F.filter(F.transform(F.split(label, "/"), lambda p: F.trim(p)), lambda p: p != "")
    a, b = year_token(F.get(parts, F.lit(0))), year_token(F.get(parts, F.lit(1)))
    span = year.between(F.least(a, b), F.greatest(a, b))
    single = F.when(F.length(F.trim(label)) == 4, F.abs(whole(F.trim(label)) - year) <= 1)
    known = F.when(F.contains(label, F.lit("/")), F.when(a.isNotNull() & b.isNotNull(), span)).otherwise(single)
    return F.coalesce(known, F.lit(True))


def season_name(day: Column, form: str = "split") -> Column:
    """The season of a day as yyyy/yyyy: from July on the new one, or for ``end_year`` the year's own."""
    year = F.year(day)
    start = year - 1 if form == "end_year" else year - (F.month(day) < 7).cast("int")
    return pair(start, start + 1)


def kickoff(seconds: Column) -> tuple[Column, Column, Column]:
    """Date, time of day (HH:mm) and year, in UTC, of seconds since 1970, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    minute = F.floor(F.pmod(seconds, F.lit(86400)) / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return day, F.concat_ws(":", two(F.floor(minute / 60)), two(minute % 60)), F.year(day)


def cutoffs(text: Column, default: list[int], low: int, high: int, most: int) -> Column:
    """The whole numbers of a comma-separated text within the bounds, distinct, sorted, ``most`` at most; else the default."""
    found = F.filter(F.transform(F.split(text, ","), lambda p: whole(F.trim(p))), lambda n: n.between(low, high))
    listed = F.slice(F.array_sort(F.array_distinct(found)), 1, most)
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(*map(F.lit, default)))


def title(text: Column) -> Column:
    """Every word, and every part of a word with hyphens, with a capital."""
    return F.array_join(F.transform(F.split(F.initcap(text), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "-")


def signed(value: Column, places: int = 1) -> Column:
    """+1.0, -2.5, +1,234.0."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.format_number(F.abs(value), places))


def file_key(url: Column) -> tuple[Column, Column]:
    """Folder and league of a season file's address: its four-digit folder, or misc; its name, upper case if the folder is
    the file's own, with other characters than letters, digits, - and _ replaced."""
    own = F.regexp_extract(url, r"/(\d{4})/([A-Za-z0-9_-]+)\.(?i:csv)$", 2)
    folder = F.regexp_extract(url, r"/(\d{4})/", 1)
    stem = F.regexp_replace(F.regexp_extract(url, r"([^/]*?)(\.[^./]*)?$", 1), "[^A-Za-z0-9_-]+", "_")
    other = F.coalesce(F.nullif(F.regexp_replace(stem, "^_+|_+$", ""), F.lit("")), F.lit("data"))
    return F.coalesce(F.nullif(folder, F.lit("")), F.lit("misc")), F.when(own != "", F.upper(own)).otherwise(other)
