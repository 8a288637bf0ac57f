"""One query for each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import decontaminate, html_main, lm_scoring, omh_dedup, packing, pii, quality_rules, secret_scan, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(*quality_rules.schema().names)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits that follow from its length; they lie beside the text, so nothing moves."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", token_counts.proposed_edits("text").alias("_edits"))
    return token_counts.count_edited(rows)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hits")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh_dedup.classes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_warc, op4_lm_scoring, op5_html_extraction, op6_pii, op7_token_counts, op8_secret_scan, op9_decontamination, op10_order_minhash, pipeline)}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9_WORDS = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OP9 = f"""
WITH d AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_OP9_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT doc_id, i, g.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)) g JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) u(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TESTS = " UNION ALL ".join(
    f"SELECT stratum, '{rule}' AS rule, {i} AS level, count(*) AS n, count(*) FILTER (({value})::DOUBLE > {cut}) AS k FROM keyed GROUP BY 1" for rule, (value, grid) in quality_rules.RULES.items() for i, cut in enumerate(grid)
)
_VERDICT = " AND ".join(f"coalesce(({value})::DOUBLE <= ({list(map(float, grid))})[{rule} + 1]::DOUBLE, true)" for rule, (value, grid) in quality_rules.RULES.items())
_LEVELS = ", ".join(f"min(level) FILTER (rule = '{rule}') AS {rule}" for rule in quality_rules.RULES)
_SHARE = quality_rules.ALPHA
OP1 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1) r, unnest(range(i, i + 3)) u(p) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
    FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT f.*, coalesce(lang, '') AS stratum FROM f JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
own AS (SELECT stratum FROM good GROUP BY 1 HAVING count(*) >= {quality_rules.MIN_GOOD}),
keyed AS (SELECT good.* EXCLUDE (stratum), own.stratum FROM good LEFT JOIN own USING (stratum)),
tests AS ({_TESTS}),
p AS (SELECT *, CASE WHEN k >= n * {_SHARE} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_SHARE}) + (n - j) * ln(1 - {_SHARE})))) END AS pv FROM tests),
best AS (SELECT stratum, {_LEVELS} FROM p WHERE pv <= {quality_rules.DELTA} / (SELECT count(*) * {len(quality_rules.RULES)} FROM (SELECT DISTINCT stratum FROM keyed)) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_VERDICT} AS kept
FROM f LEFT JOIN own ON own.stratum = coalesce(lang, '') LEFT JOIN best ON best.stratum IS NOT DISTINCT FROM own.stratum"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((((strpos('0123456789abcdef', substr(x, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, (5 * i // 4 + 2)::INT, 1)) - 1) >> (3 - 5 * i % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p JOIN f USING (h)"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op3_warc": OP3, "op9_decontamination": OP9}
