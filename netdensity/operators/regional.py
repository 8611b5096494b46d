"""Resumable regional runs: jobs are scored once, checkpointed by chunk, and left out when a run starts again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from netdensity.functions import geo
from netdensity.operators import score, sssp


def completed(spark, path: str, signature: str) -> DataFrame | None:
    """The chunks (cx, cy) that a run with this signature has finished, or none."""
    try:
        return spark.read.parquet(path).where(F.col("signature") == signature).select("cx", "cy").distinct()
    except AnalysisException:
        return None


def score_region(nodes: DataFrame, edges: DataFrame, queries: DataFrame, pois: DataFrame, path: str, signature: str, limit: int | None = None, chunk: float = geo.CHUNK) -> int:
    """Score the chunks that ``path`` lacks, at most ``limit`` of them in order, and write them by chunk.

    Returns how many were scored. A chunk's folder is replaced as a whole, so a repeated run leaves the same rows."""
    spark = queries.sparkSession
    own = sssp.owners(queries, chunk)
    todo = own.select("cx", "cy").distinct()
    done = completed(spark, path, signature)
    if done is not None:
        todo = todo.join(done, ["cx", "cy"], "left_anti")
    if limit is not None:
        todo = todo.orderBy("cx", "cy").limit(limit)
    todo = todo.cache()
    n = todo.count()
    if n:
        asked = own.join(todo, ["cx", "cy"], "left_semi")
        scored = score.chunked(nodes, edges, asked.select("qid", "x", "y"), pois, chunk)
        rows = asked.select("qid", "cx", "cy").join(scored, "qid").withColumn("signature", F.lit(signature))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cx", "cy").parquet(path)
    todo.unpersist()
    return n


def load_shard(nodes: DataFrame, edges: DataFrame, pois: DataFrame, west: float, south: float, east: float, north: float, max_nodes: int = 150_000, max_pois: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A box of the world, after a check that it fits the budget; more is an error, never a cut."""
    from netdensity.operators import graph

    inside, between = graph.inside_box(nodes, edges, west, south, east, north)
    chosen = pois.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    for what, rows, most in (("nodes", inside, max_nodes), ("destinations", chosen, max_pois)):
        if rows.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} {what} in a shard")
    return inside, between, chosen
