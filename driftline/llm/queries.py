"""The queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_repair, exact_dedup, language_id, line_dedup, mixing, packing, phrases, secret_scan, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = secret_scan.lexicon(docs)
    return secret_scan.scan(docs, secret_scan.train(secret_scan.example_findings(spark, known), known), path_col="source")


def op4_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op5_line_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that lose something: their original lengths, the spans cut and what is left of them."""
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.remove_repeats(docs, line_dedup.repeated_spans(docs)).where(F.size("removed") > 0)
    return out.select("doc_id", "original_chars", F.size("removed").alias("spans"), F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS w, 2 * source_size AS c FROM s),
r AS (
  SELECT *, c * 6 // w AS q,
    coalesce(sum(c) OVER o, 0) AS c_before, coalesce(sum(w) OVER o, 0) AS w_before,
    sum(w) OVER () AS w_all, sum(source_size) OVER () AS s_all
  FROM w WINDOW o AS (ORDER BY c * 6 // w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT 3 * s_all - 2 * c_before AS num, 2 * (w_all - w_before) AS den, q, rank FROM r
  WHERE (3 * s_all - 2 * c_before) * 6 <= 2 * (w_all - w_before) * q ORDER BY q, rank LIMIT 1),
t AS (
  SELECT r.source, r.source_size,
    CASE WHEN (r.q, r.rank) < (v.q, v.rank) THEN CAST(r.c AS DOUBLE) ELSE CAST(r.w * v.num AS DOUBLE) / CAST(v.den AS DOUBLE) END AS target
  FROM r CROSS JOIN v),
b AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.target >= t.source_size THEN 1 ELSE 0 END AS base,
    t.target - CASE WHEN t.target >= t.source_size THEN t.source_size ELSE 0 END AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, h) AS here FROM b),
x AS (SELECT *, upto - here AS below, min(CASE WHEN upto > budget THEN h END) OVER (PARTITION BY source) AS edge FROM u)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (base + CASE WHEN upto <= budget THEN 1 WHEN h = edge AND upto - budget < budget - below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
placed AS (
  SELECT doc_id, k, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS BIGINT) AS pos,
    string_split(line, ' ') AS words, string_split(lower(line), ' ') AS lowered FROM lines),
words AS (
  SELECT doc_id, k, pos, length(line) AS size, unnest(words) AS word, unnest(lowered) AS low, generate_subscripts(words, 1) AS w FROM placed WHERE len(words) > 24),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(low), 1, 15) AS BIGINT) AS h,
    sum(length(word) + 1) OVER (PARTITION BY doc_id, k ORDER BY w) - length(word) - 1 AS off FROM words),
picked AS (
  SELECT *, w > 1 AND h < coalesce(min(h) OVER (PARTITION BY doc_id, k ORDER BY w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 1::BIGINT << 61)
    AND h <= coalesce(min(h) OVER (PARTITION BY doc_id, k ORDER BY w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 1::BIGINT << 61) AS cut FROM hashed),
starts AS (SELECT doc_id, k, off AS a FROM picked WHERE cut UNION ALL SELECT doc_id, k, 0 FROM placed),
parts AS (
  SELECT doc_id, k, a, lead(a) OVER o - 1 AS b, count(*) OVER l > 1 AS cut, false AS is_line FROM starts
  WINDOW o AS (PARTITION BY doc_id, k ORDER BY a), l AS (PARTITION BY doc_id, k)
  UNION ALL SELECT DISTINCT doc_id, k, 0, NULL, true, true FROM picked WHERE cut),
spans AS (
  SELECT doc_id, k, cut, is_line, CAST(pos + a AS BIGINT) AS "start", CAST(pos + coalesce(b, length(line)) AS BIGINT) AS "end",
    substr(line, CAST(a + 1 AS BIGINT), CAST(coalesce(b, length(line)) - a AS BIGINT)) AS unit FROM parts JOIN placed USING (doc_id, k)),
clean AS (SELECT *, trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS clean FROM spans),
units AS (
  SELECT *, length(clean) - length(replace(clean, ' ', '')) + 1 AS n,
    CASE WHEN is_line THEN -1 ELSE row_number() OVER (PARTITION BY doc_id, is_line ORDER BY "start") END AS part FROM clean WHERE clean <> ''),
known AS (
  SELECT doc_id, k, part, "start", "end", n, is_line OR (NOT cut AND n >= 20) AS whole, count(*) OVER w AS occurrences, min({'d': doc_id, 's': "start"}) OVER w AS keep
  FROM units WHERE NOT is_line OR n >= 20 WINDOW w AS (PARTITION BY clean)),
later AS (
  SELECT *, max(whole) OVER (PARTITION BY doc_id, k) AS gone, part - row_number() OVER (PARTITION BY doc_id, part < 0 ORDER BY part) AS run FROM known
  WHERE occurrences > 1 AND NOT (keep.d = doc_id AND keep.s = "start")),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, part < 0, run) AS together FROM later)
SELECT doc_id, "start", "end", keep.d AS keep_doc_id, keep.s AS keep_start, occurrences, whole FROM sums WHERE whole OR (NOT gone AND together >= 20)
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_repair": op2_chat_repair,
    "op3_secret_scan": op3_secret_scan,
    "op4_phrase_fingerprints": op4_phrase_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op5_line_dedup_texts": op5_line_dedup_texts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}
ORACLES = {"op5_line_dedup": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op10_mixing": OP10_SQL}
