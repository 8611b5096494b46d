"""Mixing sources to target weights by capped water-filling.

Every source has a weight. The mix holds ``budget`` times the words of all
documents, shared by weight; a source never gives more than ``max_epochs`` times
its own words. What a clamped source cannot take is shared again among the others,
in proportion to their weights, until no source is above its cap. A document is
then repeated ``floor(epochs)`` times, and once more if it lies in the seeded
selection that fills the remaining fraction of an epoch.

The seeded selection orders a source's documents by a hash and takes a prefix of
that order whose words come nearest to the fraction. It never sorts a source as
a whole: words are first summed over 4096 hash ranges per source, and only the one range
in which the prefix ends is sorted.

Defined results: a null or blank text has size 0; a null source is a source of its
own, last in order; rows that agree in doc_id and text share a hash and are
selected together; a source without any words has target 0 and gives nothing; an
empty table gives no rows. Other columns are ignored or, in ``mix``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.llm.common import free, word_count
from netdensity.session import materialize

RANGE_BITS = 48


def seeded_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of md5 over seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (.., size, weight); one aggregate per round of redistribution.

    The driver holds two sums a round and no row of a source.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    share = total * budget
    cap = max_epochs * F.col("size")
    level, clamped = -1.0, F.lit(False)
    while True:
        free = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if not free["weight"]:
            return sources.withColumn("target", cap.cast("double"))
        raised = (share - free["held"]) / free["weight"]
        if raised <= level:
            break
        level = raised
        # A source that was clamped at a lower level stays clamped as the level only rises.
        clamped = cap < F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.lit(level) * F.col("weight")).cast("double"))


def plan(docs: DataFrame, weights=(3, 1, 2), budget=1.5, max_epochs=2.0, seed="mix-1", doc_id="doc_id", text="text", source="source") -> tuple[DataFrame, DataFrame]:
    """The sized documents and, per source, size, target, whole repetitions and the hash below which one more is due."""
    sized = materialize(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), seeded_hash(F.col(doc_id), F.col(text), seed).alias("h")))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    filled = water_fill(materialize(sources), budget, max_epochs)
    filled = filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    filled = filled.withColumn("need", F.col("target") - F.col("whole") * F.col("size")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))

    ranges = sized.groupBy("source", F.shiftright("h", RANGE_BITS).alias("r")).agg(F.sum("size").alias("words"))
    below = Window.partitionBy("source").orderBy("r")
    ranges = ranges.withColumn("upto", F.sum("words").over(below))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    last = (
        ranges.withColumn("key", key).drop("source").join(filled.select("key", "need"), "key")
        .where((F.col("upto") - F.col("words") <= F.col("need")) & (F.col("need") < F.col("upto")))
        .select("key", "r", "need", (F.col("upto") - F.col("words")).alias("before"))
    )  # at most one range a source
    groups = (
        sized.withColumn("key", key).withColumn("r", F.shiftright("h", RANGE_BITS))
        .join(last, ["key", "r"])
        .groupBy("key", "h", "need", "before").agg(F.sum("size").alias("words"))
    )
    order = Window.partitionBy("key").orderBy("h")
    groups = groups.withColumn("upto", F.col("before") + F.sum("words").over(order))
    ends = groups.groupBy("key").agg(
        F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("need"), F.col("h"))).alias("last_h"),
        F.min("h").alias("first_h"),
    )
    limits = ends.select("key", F.coalesce(F.col("last_h"), F.col("first_h") - 1).alias("limit"))
    # Without a range in which it ends the prefix is the whole source, or nothing where nothing is due.
    per_source = filled.join(limits, "key", "left").withColumn(
        "limit", F.when(F.col("size") == 0, F.lit(-1)).otherwise(F.coalesce("limit", F.when(F.col("need") > 0, F.lit((1 << 60) - 1)).otherwise(F.lit(-1))))
    )
    return sized, materialize(per_source.select("key", F.col("size").alias("source_size"), "target", "whole", "limit"))


def mix(docs: DataFrame, seed="mix-1", doc_id="doc_id", text="text", source="source", **how) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies (times the mix takes the row); columns of these names are replaced."""
    _, limits = plan(docs, seed=seed, doc_id=doc_id, text=text, source=source, **how)
    key, h, whole, limit = free(docs, "key", "h", "whole", "limit")
    keyed = docs.drop("__source_size", "__target").withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    keyed = keyed.withColumn("__size", word_count(F.col(text))).withColumn(h, seeded_hash(F.col(doc_id), F.col(text), seed))
    limits = limits.select(F.col("key").alias(key), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias(whole), F.col("limit").alias(limit))
    out = keyed.join(limits, key).withColumn("__copies", F.col(whole) + (F.col(h) <= F.col(limit)).cast("long"))
    return out.drop(key, h, whole, limit)


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it."""
    mixed = mix(docs, **how).where("__copies > 0")
    return mixed.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
