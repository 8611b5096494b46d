"""The text operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netdensity.llm import bpe, chat, lattice, lines, mixing, pii, quality, simhash, suffix, token_files
from netdensity.session import table


@cache
def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")
    return bpe.roundtrip(docs, path, bpe.build(docs, path))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chat(turns.unionByName(extra)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.fresh_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path, end_id=2)
    return token_files.read(spark, path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, size, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * size) OVER a, 0) AS held, coalesce(sum(weight) OVER a, 0) AS gone, sum(weight) OVER () AS total_w, (sum(size) OVER ()) * 1.5::DOUBLE AS share
  FROM w WINDOW a AS (ORDER BY 2.0 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((share - held) / (total_w - gone), 2.0::DOUBLE * size / weight) AS level FROM o WHERE (share - held) / (total_w - gone) <= 2.0::DOUBLE * size / weight),
t AS (SELECT source, size, least(2.0::DOUBLE * size, coalesce(level * weight, 2.0::DOUBLE * size)) AS target FROM w, l),
f AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM g)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, f.size AS source_size, f.target,
       CAST(d.size * (f.whole + CASE WHEN f.size > 0 AND c.upto - c.words / 2.0::DOUBLE <= f.target - f.whole * f.size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUALITY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
m AS (
  SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines, w
  FROM w),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, regexp_replace(regexp_replace(x, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') AS x FROM (SELECT r, unnest(full_lines) AS x FROM m)),
lf AS (
  SELECT r, x, length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS solid, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
    len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM ln),
lost AS (
  SELECT r, sum(CASE WHEN symbols > 0.08 * solid OR (n >= 2 AND x = upper(x) AND x <> lower(x)) OR (n < 5 AND NOT regexp_matches(x, '[.!?:;…"''”’»)\\]]$')) OR regexp_matches(lower(x), '__PHRASES__') THEN solid ELSE 0 END) AS lost
  FROM lf GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AND coalesce(lost, 0) <= 0.3 * word_chars) AS kept
FROM m LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)
""".replace("__PHRASES__", "|".join(quality.PHRASES))

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<[\\]*[|]')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

LATTICE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.id = c.root AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_suffix_array, op3_bpe_roundtrip, op4_chat_format, op5_line_dedup, op6_token_files, op7_mixing, op8_lattice, op9_quality, op10_pii)}
ORACLES: dict[str, str] = {"op4_chat_format": CHAT_SQL, "op8_lattice": LATTICE_SQL, "op7_mixing": MIX_SQL, "op9_quality": QUALITY_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
