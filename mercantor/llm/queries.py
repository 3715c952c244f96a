"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, licenses, mixing, paragraphs, quality, sharding, tokencount, urlfilter, wavelet
from .workspace import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(table(spark, sf_dir, "documents"), _tokenizer())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"), least=paragraphs.PASSAGE_WORDS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), _tokenizer())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of two policies keeps, from one stored ledger."""
    book = quality.stored(table(spark, sf_dir, "documents"))
    both = [quality.apply_policy(book, p).groupBy("policy", "policy_version").agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows")) for p in (quality.BASE, quality.PRODUCTION)]
    return both[0].union(both[1])


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy removes, alone and with the others."""
    return quality.ablation(quality.stored(table(spark, sf_dir, "documents")), quality.PRODUCTION)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_sharding, op4_wavelet_tokens, op5_url_filters, op6_mixing, op7_jaccard_join, op8_substring_dedup, op9_token_counts, op10_license_scan, quality_policies, quality_ablation, pipeline)}

_SPACE = r"[^\x20\x09-\x0D]"
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_SPACE}+') AS w FROM d),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM win) WHERE k > 1),
cover AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover ON w.r = cover.r),
f AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 14 * n_words)::INT
    + 16 * (10 * n_symbols > 3 * n_words)::INT + 32 * (n_dup_lines > 3 AND len(lines) < 2 * n_dup_lines)::INT + 64 * (n_words > 1000000)::INT AS BIGINT) AS failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed FROM b
"""
_GENERAL = " OR ".join(f"p GLOB '{g.glob.replace(urlfilter.CUT, chr(9))}'" for g in urlfilter.GENERAL)
_OP5 = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, h, p)),
b AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict FROM s, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
g AS (SELECT *, host || chr(9) || path AS p FROM s)
SELECT g.page_id, host, path, rule, coalesce(b.verdict, CASE WHEN {_GENERAL} THEN 'block' ELSE 'allow' END) AS verdict FROM g LEFT JOIN b ON g.page_id = b.page_id
"""
_OP2 = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT r, spot.n, i, item_id FROM spot JOIN win ON spot.s = win.s AND spot.n = win.n),
n AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS o FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n ON doc.r = n.r LEFT JOIN items ON doc.r = items.r
"""
_RULES = " UNION ALL ".join(f"SELECT '{name}' AS rule, {1 << k}::BIGINT AS bit" for k, name in enumerate(quality.RULES[:6]))
_POLICIES = f"SELECT 'base' AS policy, 1 AS policy_version, count(*) FILTER (failed & 3 = 0) AS kept, count(*) AS rows FROM ({_OP1}) UNION ALL SELECT 'production', 1, count(*) FILTER (failed & 63 = 0), count(*) FROM ({_OP1})"
_ABLATION = f"""WITH f AS (SELECT n_words, failed & 63 AS own FROM ({_OP1}))
SELECT rule, count(*) FILTER (own & bit <> 0) AS n_failed, count(*) FILTER (own = bit) AS n_failed_alone, count(*) FILTER (own & ~bit = 0) AS n_kept_without, CAST(coalesce(sum(n_words) FILTER (own & ~bit = 0), 0) AS BIGINT) AS words_kept_without, count(*) FILTER (own = 0) AS n_kept FROM f, ({_RULES}) GROUP BY rule"""
ORACLES = {"quality_policies": _POLICIES, "quality_ablation": _ABLATION, "op1_quality_rules": _OP1, "op2_decontamination": _OP2, "op5_url_filters": _OP5}
