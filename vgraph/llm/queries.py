"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .brown import brown_scores
from .exact_dedup import exact_duplicates
from .html_extract import extract
from .line_dedup import line_duplicates
from .mixing import mix
from .packing import pack
from .quality import quality
from .secrets import findings, train
from .simhash import near_duplicates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || doc_id) AS o,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(source_size) OVER below, 0)::DOUBLE * 2.0::DOUBLE AS capped,
         sum(w) OVER (ORDER BY source_size / w DESC, source DESC NULLS FIRST) AS free,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM s WINDOW below AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - capped) / free) FILTER (WHERE w * ((total - capped) / free) <= cap) AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, w * coalesce(level, 1e300)) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, w * coalesce(level, 1e300)) / source_size) ELSE 0 END AS whole
  FROM r, l),
p AS (
  SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
""")
def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(toxicity.fold() != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT r, source, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         regexp_replace(array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') AS norm
  FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT r, string_agg(norm, chr(10) ORDER BY pos) AS content, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
h AS (SELECT d.source, count(DISTINCT coalesce(content, '')) AS hosted FROM d LEFT JOIN c USING (r) GROUP BY d.source),
o AS (
  SELECT l.source, norm FROM l JOIN c USING (r) JOIN h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, hosted HAVING count(DISTINCT content) >= greatest(10, 0.01 * hosted)),
g AS (SELECT r, sum(n) AS lost FROM l JOIN o ON l.norm = o.norm AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
k AS (
  SELECT r, k, count(*) OVER (PARTITION BY r, w[k], w[k + 1], w[k + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
p AS (SELECT r, count(DISTINCT k + s) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) v(s) WHERE n > 1 GROUP BY r),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost
  FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (lost > 0 AND (n_words - lost < 50 OR n_words - lost < 0.3 * n_words)) AS kept
FROM b
""")
def op4_quality_rules(spark, sf_dir):
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op6_lm_scoring(spark, sf_dir):
    scored = brown_scores(table(spark, sf_dir, "documents"), toxicity.fold(of=7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op7_line_dedup(spark, sf_dir):
    return line_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "at", "line", "class_id", "n_links", "kept")


@query()
def op8_secret_scan(spark, sf_dir):
    found = findings(table(spark, sf_dir, "documents"), train()).select("doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", "f.*", (F.col("f.probability") >= 0.5).alias("secret"))
