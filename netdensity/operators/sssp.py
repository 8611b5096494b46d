"""Truncated shortest paths from many sources, in two interchangeable forms.

``frontier`` is relational: each round joins the newly improved distances with the edges. ``halo`` partitions space:
every chunk gets the sources that it owns and the nodes and edges within reach of it, and runs a heap search for each source;
since no path longer than the limit leaves the halo, the result is exact, and there is one shuffle.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.functions import geo
from netdensity.session import materialize

PIECES = "cx long, cy long, kind string, a long, b long, x double, y double"
PAIRS = "src long, node long, d double"


def frontier(sources: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(src, node, d) for sources (column id) and directed edges (u, v, w)."""
    best = materialize(sources.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0.0).alias("d")).distinct())
    new = best
    while True:
        step = new.join(edges, new.node == edges.u).select("src", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d")).where(F.col("d") <= limit)
        step = step.groupBy("src", "node").agg(F.min("d").alias("d"))
        old = best.select(F.col("src").alias("__s"), F.col("node").alias("__n"), F.col("d").alias("__d"))
        new = materialize(step.join(old, (F.col("src") == F.col("__s")) & (F.col("node") == F.col("__n")), "left").where("__d is null or d < __d").select("src", "node", "d"))
        if not new.take(1):
            return best
        best = materialize(best.union(new).groupBy("src", "node").agg(F.min("d").alias("d")))


def owners(rows: DataFrame, chunk: float) -> DataFrame:
    return rows.withColumn("cx", F.floor(F.col("x") / chunk)).withColumn("cy", F.floor(F.col("y") / chunk))


def within_halo(rows: DataFrame, chunk: float, halo: float) -> DataFrame:
    """Rows with x, y, once for every chunk whose box widened by ``halo`` holds them."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / chunk), F.floor((F.col(c) + halo) / chunk))
    return rows.withColumn("cx", F.explode(reach("x"))).withColumn("cy", F.explode(reach("y")))


def world(nodes: DataFrame, edges: DataFrame, chunk: float, halo: float) -> DataFrame:
    """Nodes and edges of every chunk with its halo, as typed rows. An edge belongs where both ends do."""
    n = within_halo(nodes.select("id", "x", "y"), chunk, halo)
    placed = n.select("cx", "cy", F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "x", "y")
    u = n.select("cx", "cy", F.col("id").alias("u"))
    v = n.select(F.col("cx").alias("vx"), F.col("cy").alias("vy"), F.col("id").alias("__v"))
    both = edges.join(u, "u").join(v, (F.col("v") == F.col("__v")) & (F.col("cx") == F.col("vx")) & (F.col("cy") == F.col("vy")))
    return placed.union(both.select("cx", "cy", F.lit("edge"), "u", "v", F.col("w").alias("x"), F.lit(None).cast("double")))


def adjacency(edges: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["x"].tolist()):
        out.setdefault(u, []).append((v, w))
    return out


def search(start: int, near: dict[int, list[tuple[int, float]]], limit: float) -> dict[int, float]:
    """Distances up to ``limit`` from one node."""
    best, queue, done = {start: 0.0}, [(0.0, start)], set()
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        for v, w in near.get(u, ()):
            x = d + w
            if x <= limit and x < best.get(v, float("inf")):
                best[v] = x
                heapq.heappush(queue, (x, v))
    return best


def halo(sources: DataFrame, nodes: DataFrame, edges: DataFrame, limit: float, chunk: float = geo.CHUNK) -> DataFrame:
    """As ``frontier``, by chunks; sources are node ids."""
    at = nodes.join(sources.select("id").distinct(), "id", "left_semi")
    own = owners(at.select("id", "x", "y"), chunk).select("cx", "cy", F.lit("source").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "x", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = adjacency(pdf[pdf["kind"] == "edge"])
        rows = [(s, n, d) for s in sorted(pdf.loc[pdf["kind"] == "source", "a"].tolist()) for n, d in search(s, near, limit).items()]
        return pd.DataFrame(rows, columns=["src", "node", "d"])

    # A straight line is no longer than a path, so nothing within the limit lies outside this halo.
    return world(nodes, edges, chunk, limit).union(own).groupBy("cx", "cy").applyInPandas(run, PAIRS)
