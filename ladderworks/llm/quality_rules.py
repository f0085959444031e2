"""Quality rules for documents: a table of thresholds (length, symbols, stop words, lines), compiled into projections
of built-in functions.

A rule names a metric and the range that it must stay in. All metrics are columns of one row, so the rules need no
shuffle, no join and no user function.

Repeated 3-word windows are found inside the row: the windows' hashes are sorted with their places packed into the low
bits, neighbours that agree are candidates, and the candidates' full 64-bit hashes decide. Texts of more than 2**20
words have all their windows as candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for as was on are by this "
    "der die das und ist nicht ein eine mit von zu den auf für im des dem sich "
    "le la les de des et un une du est que pour dans qui par sur pas au "
    "el los las en y una con del se por para como no su al lo más"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric must be at least ``low`` and at most ``high``, where these are given. A null metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(f"_m_{self.metric}")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= F.lit(float(self.high)))
        return F.coalesce(ok, F.lit(True))


RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", high=0.3),
    Rule("distinct_stop_words", low=2),
    Rule("dup_line_ratio", high=0.3),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("bullet_line_ratio", high=0.9),
    Rule("shouted", high=0),
    Rule("giant_word", high=0),
)
#: The same, but one short line said twice in a text of few lines is no fault: the share of the characters counts too.
CLEAN_RULES = tuple(Rule("dup_line_share", high=r.high) if r.metric == "dup_line_ratio" else r for r in RULES)
MIN_WORDS = 50
MAX_REPEATED = 50


def _metrics() -> dict[str, Column]:
    text, lines = F.col("_text"), F.col("_lines")
    n, n_lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.size(lines), F.lit(0))
    chars = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, line: a + F.length(line))
    of_lines = lambda test: F.size(F.filter(lines, test)) / n_lines
    return {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "distinct_stop_words": F.size(F.array_intersect("_words", F.array(*map(F.lit, STOP_WORDS)))),
        "dup_line_ratio": F.col("n_dup_lines") / n_lines,
        "dup_line_share": F.least(F.col("n_dup_lines") / n_lines, 1 - chars(F.array_distinct(lines)) / F.nullif(chars(lines), F.lit(0))),
        "ellipsis_line_ratio": of_lines(lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))),
        "bullet_line_ratio": of_lines(lambda x: F.ltrim(x).substr(1, 1).isin("•", "-", "*", "‣")),
        "shouted": (text == F.upper(text)) & (text != F.lower(text)),
        "giant_word": F.rlike(text, F.lit(NOT_SPACE + "{1000}")),
    }


def _repeated_positions(frame: DataFrame) -> DataFrame:
    """``_at``: the sorted places of 3-word windows that occur twice or more in the text."""
    words, hashes, packed, near = F.col("_words"), F.col("_hashes"), F.col("_packed"), F.col("_near")
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    frame = frame.withColumn("_hashes", F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    frame = frame.withColumn("_packed", F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-1048576)).bitwiseOR(i.cast("long")))))
    high = lambda x: F.shiftright(x, 20)
    close = F.filter(packed, lambda x, k: F.coalesce(high(x) == high(F.get(packed, k - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(packed, k + 1)), F.lit(False)))
    few = F.transform(close, lambda x: x.bitwiseAND(F.lit(1048575)).cast("int"))
    candidates = F.when(F.col("n_words") <= 1048576, few).otherwise(places)
    frame = frame.withColumn("_cand", candidates)
    frame = frame.withColumn("_near", F.sort_array(F.transform("_cand", lambda p: F.struct(F.get(hashes, p).alias("h"), p.alias("p")))))
    same = F.filter(near, lambda x, k: F.coalesce(x.h == F.get(near, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(near, k + 1).h, F.lit(False)))
    return frame.withColumn("_at", F.sort_array(F.transform(same, lambda x: x.p)))


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``kept``, ``failed_rules`` (names of the metrics out of range) and ``metrics``.

    * A null text has no words; null and empty texts fail the base rule of 50 words.
    * Ratios over no words or no lines are null, and null passes: such texts have failed already.
    * Each row is judged alone: repeated rows get the same verdict, an empty table gives an empty table.
    * Input columns of the names of the results are replaced.
    * Filters on the results are applied after all metrics are known; filters on the input's columns reach the scan.
    """
    at = F.col("_at")
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    frame = frame.withColumns({"_words": F.filter(F.split("_text", SPACES), lambda w: w != ""), "_lines": F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))})
    frame = frame.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    frame = _repeated_positions(frame)
    frame = frame.withColumn("n_repeat_words", F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))
    frame = frame.withColumns({"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))} | {f"_m_{n}": c.cast("double") for n, c in _metrics().items()})
    frame = frame.withColumn("failed_rules", F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.metric)) for r in rules])))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    results = {n: F.col(n) for n in new} | {"kept": ~F.col("base_failed") & (F.size("failed_rules") == 0), "failed_rules": F.col("failed_rules")}
    results["metrics"] = F.struct(*[F.col(f"_m_{n}").alias(n) for n in _metrics()])
    # One generated row: a filter on a result would else be planned below the projections, with every metric's expression in it.
    own = F.inline(F.array(F.struct(*[c.alias(n) for n, c in results.items()])))
    return frame.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in results], own)
