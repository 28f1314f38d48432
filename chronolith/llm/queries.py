"""The subpackage's queries: each operator over its whole table, and SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import decontam, gam, licences, linededup, lm, packing, pii, rules, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.word_scores(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chunks", "n_removed", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_rows(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan over known licences printed in several ways, as documents hold none of them whole."""
    return licences.license_scan(licences.variants(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = gam.quality_scores(docs.select("doc_id", "text"), gam.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Query]:
    found = (
        op1_simhash, op2_lm_score, op3_warc, op4_quality_rules, op5_line_dedup, op6_decontaminate, op7_pii,
        op8_pack, op9_license_scan, op10_quality_classifier, license_variants,
    )
    return {f.__name__: f for f in found}


WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP6 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_aggregate(list_slice(w, i, i + 9), 'string_agg', ' ') AS win, least(len(w), 10) AS n
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS win
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS t(j) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h AND p.n >= 1000
"""
OP5 = f"""
WITH l AS (SELECT doc_id, i, x, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h,
             length(x) - length(replace(x, ' ', '')) + 1 >= {linededup.PASSAGE} AS long
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
e AS (SELECT *, long OR coalesce(lead(long) OVER w, false)
             OR ((coalesce(lag(h) OVER w, 0) * {linededup.BASE} + h) % {linededup.PRIME}) % {linededup.EVERY} = 0 AS ends
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
c AS (SELECT doc_id, c, string_agg(x, chr(10) ORDER BY i) AS t, bool_or(long) AS long, count(*) AS n FROM k GROUP BY 1, 2),
m AS (SELECT *, long OR (n > 1 AND length(t) - length(translate(t, ' ' || chr(10), '')) + 1 >= {linededup.LEAST}) AS may FROM c),
f AS (SELECT *, may AND row_number() OVER (PARTITION BY may, t ORDER BY doc_id, c) > 1 AS gone FROM m),
r AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY c) FILTER (NOT gone), '') AS t FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_chunks END::BIGINT AS n_chunks, n_removed::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN length(t) END::BIGINT AS n_chars, CASE WHEN text IS NOT NULL THEN md5(t) END AS text_md5
FROM r JOIN documents USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lm_score": lm.oracle(), "op3_warc": OP3, "op5_line_dedup": OP5, "op6_decontaminate": OP6, "op9_license_scan": licences.oracle(), "license_variants": licences.variants_oracle()}
