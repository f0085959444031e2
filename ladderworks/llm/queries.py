"""One query for each operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderworks.llm.bpe_automaton import encode_texts
from ladderworks.llm.decontaminate import decontaminate
from ladderworks.llm.license_scan import scan_licenses
from ladderworks.llm.ngram_join import near_duplicates
from ladderworks.llm.packing import pack_documents
from ladderworks.llm.quality_rules import STOP_WORDS, measure
from ladderworks.llm.site_style_tree import extract_main_text
from ladderworks.llm.spelling_variants import spelling_variants, word_counts
from ladderworks.llm.substring_dedup import remove_repeated_passages
from ladderworks.llm.token_counts import count_tokens
from ladderworks.llm.toxicity import score, train
from ladderworks.llm.warc import NOT_MODIFIED, resolve_revisits
from ladderworks.llm.whitening import whiten

_SPACES = "[\\x20\\x09-\\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of the pages: a response each, and a not-modified revisit a week later.

    A page is fetched one minute after the page of the next smaller id. Pages whose URL has a query come with a
    modification date only, others with an entity tag as well; where the URL has a fragment, the revisit has neither.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("page_id"))
    tag, since = F.md5(F.coalesce("html", F.lit(""))), F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    has = lambda c: F.coalesce(F.contains("url", F.lit(c)), F.lit(False))
    first = F.map_filter(F.create_map(F.lit("ETag"), F.when(~has("?"), tag), F.lit("Last-Modified"), since, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")), lambda _, v: v.isNotNull())
    again = F.map_filter(F.create_map(F.lit("etag"), F.when(~has("?") & ~has("#"), tag), F.lit("last-modified"), F.when(~has("#"), since), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600")), lambda _, v: v.isNotNull())
    week = at + F.expr("INTERVAL 7 DAYS")
    records = [F.struct((2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("type"), F.col("url").alias("uri"), at.alias("date"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("profile"), first.alias("headers")), F.struct((2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("type"), F.col("url").alias("uri"), week.alias("date"), F.lit(304).alias("status"), F.lit(NOT_MODIFIED).alias("profile"), again.alias("headers"))]
    return pages.select(F.inline(F.array(*records)))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value))), "; ")
    return found.select("record_id", "canonical_url", "outcome", "refers_to", lines.alias("merged_headers"))


#: The chain's order. The labels have one category of toxicity; how good the text is comes before it.
CATEGORIES = ["low_quality", "toxic"]


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    chain = train(docs, labels.select("doc_id", (F.col("quality") == 0).alias("low_quality"), "toxic"), CATEGORIES)
    scored = score(docs, chain, CATEGORIES)
    return scored.select("doc_id", (F.col("p_toxic") >= 0.5).alias("toxic"), "p_toxic", "p_low_quality")


def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.label") for c in cols]))), ",")
    share = F.coalesce(F.array_max(F.concat("phrases.share", "spans.share")), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.first").alias("last_word"),
        names("phrases").alias("base_labels"),
        names("phrases", "spans").alias("labels"),
        share.alias("score"),
    )


def op9_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), _SPACES), lambda w: w != ""), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_length=7, min_count=2, slip_every=31)
    return spelling_variants(words, ratio=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_ngram_join, op3_token_counts, op4_warc_revisits, op5_toxicity_chain, op6_site_style_tree, op7_bpe_automaton, op8_license_scan, op9_fm_decontaminate, op10_substring_dedup, op11_spelling_variants, op12_whitening, op13_best_two_fit)
    return {f.__name__: f for f in own}


_OP1 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM places),
again AS (SELECT doc_id, least(3, p - lag(p, 1, p - 3) OVER (PARTITION BY doc_id ORDER BY p)) AS fresh FROM windows WHERE c > 1),
repeats AS (SELECT doc_id, sum(fresh) AS n FROM again GROUP BY doc_id),
m AS (
  SELECT doc_id, t, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.3
    AND len(list_distinct(list_intersect(w, string_split('STOP', ' ')))) >= 2
    AND n_dup_lines / len(l) <= 0.3
    AND len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / len(l) <= 0.3
    AND len(list_filter(l, lambda x: ltrim(x)[1] IN ('•', '-', '*', '‣'))) / len(l) <= 0.9
    AND NOT (t = upper(t) AND t <> lower(t)) AND NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]{1000}') AS kept
FROM b
""".replace("STOP", " ".join(STOP_WORDS))

_OP4 = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS fetched,
    coalesce(contains(url, '?'), false) AS q, coalesce(contains(url, '#'), false) AS f,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
    list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))) AS params
  FROM p),
r AS (SELECT *, page || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM c),
responses AS (SELECT canonical_url, fetched, max(page_id) AS page_id, max_by(tag, page_id) AS tag, max_by(q, page_id) AS q FROM r WHERE canonical_url IS NOT NULL AND fetched IS NOT NULL GROUP BY canonical_url, fetched),
seen AS (
  SELECT 2 * v.page_id + 1 AS record_id, v.canonical_url, v.q, v.f, v.tag, v.fetched, s.page_id AS source, s.tag AS s_tag, s.q AS s_q, s.fetched AS s_at
  FROM r v ASOF LEFT JOIN responses s ON v.canonical_url = s.canonical_url AND v.fetched + INTERVAL 7 DAY > s.fetched),
judged AS (
  SELECT *, CASE WHEN source IS NULL THEN 'orphan' WHEN f THEN 'unproven' WHEN NOT q AND NOT s_q THEN CASE WHEN tag = s_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN fetched = s_at THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM seen)
SELECT record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN 2 * source END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600; content-type: text/html; ' || CASE WHEN NOT q THEN 'etag: ' || tag || '; ' WHEN NOT s_q THEN 'etag: ' || s_tag || '; ' ELSE '' END || 'last-modified: ' || strftime(fetched, '%Y-%m-%d %H:%M:%S') END AS merged_headers
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op4_warc_revisits": _OP4}
