"""The corpus operators as registered queries, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, linededup, packing, quality, sharding, simhash, suffix_dedup, toxicity, urlfilter
from .common import table

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Listed canonical URLs without a path, whole hosts: the unwanted ones among the hosts of the test pages, for want of a public list.
BLOCKED_URLS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"), "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a list of one's own, a canonical URL on each line, may be named by this setting
    own = spark.conf.get("spark.sessionlake.blockedUrls", None)
    listed = urlfilter.entries(spark, URL_RULES, BLOCKED_URLS if own is None else [])
    if own is not None:
        listed = listed.unionByName(urlfilter.blocked(spark.read.text(own)))
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.grouped(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_quality, op4_simhash, op5_url_filter, op6_sharding, op7_line_dedup, op8_decontamination, op9_fingerprints, op10_best_fit_packing)}


_SQL_ENTRIES = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for v, h, p in URL_RULES) + ", " + ", ".join(f"('{u}', '', 'block', NULL)" for u in BLOCKED_URLS)

OP5_SQL = rf"""
WITH parts AS (
  SELECT page_id, url, row_number() OVER () AS k,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
listed(h, p, verdict, shown) AS (VALUES {_SQL_ENTRIES}),
best AS (
  SELECT k, verdict, shown, row_number() OVER (PARTITION BY k ORDER BY shown IS NULL, length(h) + length(p) DESC) AS r
  FROM parts JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, shown AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.k = best.k AND r = 1
"""


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id < top, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op7_line_dedup": OP7_SQL}
