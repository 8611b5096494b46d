"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run`` writes every stage's rows as
Parquet to the shared folder and reads them again for the next. A stage sees doc_id, text and source; all other columns go
through it as one struct, so that none can clash with a name used inside.

Defined results: a null, empty or blank text is rejected by the quality rules; rows without a doc_id are kept, except that line
dedup leaves their lines alone; rows that share a doc_id stay apart, unless their texts are alike; of rows alike in doc_id and text one
stays, whatever their other columns; texts of any length are handled whole; a null source is a source; an empty table gives an empty one; other
columns, whatever their names, come through to the last stage, which returns ids instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netdensity.llm import bpe, lines, mixing, near, quality
from netdensity.llm.common import BLANKS
from netdensity.llm.queries import tokenizer
from netdensity.session import checkpoint_dir, fewer, materialize, table


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others as the struct ``others``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(0)).alias("others"))


def unpacked(out: DataFrame, docs: DataFrame, *used: str, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, from what ``packed`` made of them; where ``text`` is given with that text and its length."""
    new: dict[str, Column] = {}
    if text is not None:
        new["text"] = text
        if "n_chars" in docs.columns:
            new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    out = fewer(out, docs)
    return out.select(*[(new[c] if c in new else F.col(c) if c in used else F.col("others").getField(c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule."""
    judged = quality.judge(packed(docs, "doc_id", "text")).where("__q.kept")
    return unpacked(judged, docs, "doc_id", "text", text=F.col("__q.clean"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common lines go from the later document; one with no word left goes."""
    cleaned = lines.dedup_lines(packed(docs, "doc_id", "text"))
    emptied = (F.col("__n_removed") > 0) & (F.btrim("text", F.lit(BLANKS)) == "")
    return unpacked(cleaned.where(~F.coalesce(emptied, F.lit(False))), docs, "doc_id", "text", text=F.col("text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: that of least doc_id, then least text hash; a null doc_id comes last."""
    key = ["none", "id", "th"]
    keyed = packed(docs, "doc_id", "text").select(
        "*", F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    )
    found = keyed.select(*key).distinct().join(near.near_duplicates(docs), "th")
    heads = materialize(fewer(found.groupBy("root").agg(F.min(F.struct(*key)).alias("head")).select("head.*"), docs))
    return unpacked(keyed.join(heads, key, "left_semi").dropDuplicates(key), docs, "doc_id", "text")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return unpacked(mixing.repeat(packed(docs, "doc_id", "text", "source")), docs, "doc_id", "text", "source")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and digests of ids and of the text decoded from them."""
    path = tokenizer("word_bpe_49k.json")
    return bpe.roundtrip(docs, path, bpe.build(docs, path), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", token_stage),
]

#: Patience diff and BPE are beyond SQL; tests compare ``run`` with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
