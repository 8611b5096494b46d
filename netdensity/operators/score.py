"""Density scores: Euclidean, over the network with or without connectors, by chunks, along streets; and their scales."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.functions import geo
from netdensity.operators import spatial, sssp
from netdensity.operators.order import running
from netdensity.session import materialize

SCORED = "qid long, score double"


def euclid(queries: DataFrame, pois: DataFrame, key: list[str], radius: float = geo.RADIUS, kernel=geo.kernel_exp) -> DataFrame:
    """(key.., score): kernel sum over all destinations within a straight-line radius; 0 where there are none."""
    pairs = spatial.within(pois.select("x", "y"), queries.select(*key, F.col("x").alias("rx"), F.col("y").alias("ry")), radius)
    sums = pairs.groupBy(*key).agg(F.sum(kernel(F.col("d"))).alias("score"))
    return queries.select(*key).join(sums, key, "left").select(*key, F.coalesce("score", F.lit(0.0)).alias("score"))


def network(q_snap: DataFrame, p_snap: DataFrame, pairs: DataFrame, key: list[str], radius: float = geo.RADIUS, kernel=geo.kernel_exp) -> DataFrame:
    """(key.., score) for snapped queries (key.., node, d) and destinations (node, d) with path lengths (src, node, d) from destinations' nodes.

    A path is both connectors and the way between; every destination counts. Queries without a snap have no row, and a
    snapped query that reaches nothing has 0."""
    at = p_snap.select(F.col("node").alias("src"), F.col("d").alias("dp"))
    reach = pairs.join(at, "src").select(F.col("node").alias("n"), (F.col("d") + F.col("dp")).alias("far"))
    joined = q_snap.join(reach, q_snap.node == reach.n, "left").withColumn("total", F.col("d") + F.col("far"))
    return joined.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("total") <= radius, kernel(F.col("total")))), F.lit(0.0)).alias("score"))


def distinct_targets(queries: DataFrame, q_node: DataFrame, p_node: DataFrame, pairs: DataFrame, key: list[str], radius: float, kernel=geo.kernel_exp) -> DataFrame:
    """The older score: from the query's node to the destinations' nodes, each node once; a destination's node counts
    where it is within a straight-line radius of the raw query point; connectors cost nothing; 0 if nothing is reached.

    Paths are bounded already, so they lead: the straight line is only a test on them, and no pair without a path is made."""
    targets = p_node.select(F.col("id").alias("src"), F.col("x").alias("rx"), F.col("y").alias("ry")).dropDuplicates(["src"])
    paths = pairs.where(F.col("d") <= radius).join(targets, "src").select("node", F.col("d").alias("far"), "rx", "ry")
    asked = queries.select(*key, "x", "y").join(q_node.select(*key, "node"), key)
    straight = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))
    routed = asked.join(paths, "node").where(straight <= radius)
    sums = routed.groupBy(*key).agg(F.sum(kernel(F.col("far"))).alias("score"))
    return queries.select(*key).join(sums, key, "left").select(*key, F.coalesce("score", F.lit(0.0)).alias("score"))


def chunked(nodes: DataFrame, edges: DataFrame, queries: DataFrame, pois: DataFrame, chunk: float = geo.CHUNK, radius: float = geo.RADIUS, reach: float = geo.SNAP, scale: float = 120.0) -> DataFrame:
    """(qid, score) by chunks that each own their queries and see the world within the halo; null where a query has no node in reach.

    One shuffle. The result does not depend on the width of the chunks."""
    halo = radius + 2 * reach + geo.SPACING
    none = F.lit(None)
    q = sssp.owners(queries.select("qid", "x", "y"), chunk).select("cx", "cy", F.lit("query").alias("kind"), F.col("qid").alias("a"), none.cast("long").alias("b"), "x", "y")
    p = sssp.within_halo(pois.select("pid", "x", "y"), chunk, halo).select("cx", "cy", F.lit("poi").alias("kind"), F.col("pid").alias("a"), none.cast("long").alias("b"), "x", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["kind"] == "query"].sort_values("a")
        if asked.empty:
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        by_cell: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        for i, x, y in pdf[pdf["kind"] == "node"][["a", "x", "y"]].itertuples(index=False):
            by_cell.setdefault((math.floor(x / reach), math.floor(y / reach)), []).append((int(i), x, y))

        def snapped(x: float, y: float) -> tuple[float, int, float] | None:
            cx, cy = math.floor(x / reach), math.floor(y / reach)
            found = [(round(math.hypot(x - nx, y - ny), 9), i, math.hypot(x - nx, y - ny)) for a in (-1, 0, 1) for b in (-1, 0, 1) for i, nx, ny in by_cell.get((cx + a, cy + b), ())]
            found = [f for f in found if f[2] <= reach]
            return min(found) if found else None

        near = sssp.adjacency(pdf[pdf["kind"] == "edge"])
        at: dict[int, list[tuple[int, float]]] = {}
        out: dict[int, float | None] = {}
        for qid, x, y in asked[["a", "x", "y"]].itertuples(index=False):
            s = snapped(x, y)
            out[int(qid)] = None if s is None else 0.0
            if s:
                at.setdefault(s[1], []).append((int(qid), s[2]))
        offsets: dict[int, list[float]] = {}
        for x, y in pdf[pdf["kind"] == "poi"].sort_values("a")[["x", "y"]].itertuples(index=False):
            s = snapped(x, y)
            if s:
                offsets.setdefault(s[1], []).append(s[2])
        for n in sorted(offsets):
            own = sorted(offsets[n])
            for node, far in sssp.search(n, near, radius - own[0]).items():
                for qid, d in at.get(node, ()):
                    out[qid] += sum(math.exp(-(d + far + o) / scale) for o in own if d + far + o <= radius)
        return pd.DataFrame({"qid": list(out), "score": pd.Series(list(out.values()), dtype="float64")})

    rows = sssp.world(nodes, edges, chunk, halo).union(q).union(p)
    return rows.groupBy("cx", "cy").applyInPandas(run, SCORED)


# ---- scales for display


def with_bounds(df: DataFrame, v: Column) -> DataFrame:
    """``df`` with __low and __high of ``v``: one aggregate, joined back as a single row."""
    return df.crossJoin(F.broadcast(df.agg(F.min(v).alias("__low"), F.max(v).alias("__high"))))


def normalised(df: DataFrame, score: str, how: str = "log1p") -> DataFrame:
    """``df`` with ``norm``: log1p or average rank, then scaled to 0..1; equal scores stay as they are."""
    if how == "quantile":
        counts = df.groupBy(score).agg(F.count("*").alias("__n"))
        ranked = running(counts, score, "__n", "__upto")
        total = counts.agg(F.sum("__n").alias("__total"))
        ranks = ranked.crossJoin(F.broadcast(total)).select(F.col(score).alias("__s"), ((F.col("__upto") - F.col("__n") + 1 + F.col("__upto")) / 2 / F.col("__total")).alias("__v"))
        df = df.join(ranks, F.col(score).eqNullSafe(F.col("__s"))).drop("__s")
    else:
        df = df.withColumn("__v", F.log1p(score) if how == "log1p" else F.col(score))
    v, low, high = (F.col(c) for c in ("__v", "__low", "__high"))
    return with_bounds(df, v).withColumn("norm", F.when(high > low, (v - low) / (high - low)).otherwise(v)).drop("__v", "__low", "__high")


# ---- along streets


def streets(segments: DataFrame, edges: DataFrame, snapped: DataFrame, radius: float, penalty: float, scale: float) -> DataFrame:
    """(e, i, score): kernel sums along edges, from every destination outwards.

    Edges (e, u, v, w) and their segments (e, i, start_dist, end_dist) are measured from u; a destination (pid, e, along) lies on
    an edge. A lane is an edge taken in one direction. The least distance at which a destination's walk enters each lane follows
    from a frontier of lanes: each round joins it with the turns, which lead from a lane to those that go on from its end, never
    back, and cost its length, and ``penalty`` where more than two edges meet. Rounds end when no lane is entered nearer within the radius.

    A lane entered at d gives its edge's segments the kernel of d and their middle's distance from u, whichever way the lane
    goes; the destination's own edge gives what lies wholly on either side of it. Its own direction is not entered again."""
    ends = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "e", "w").union(edges.select("v", "u", "e", "w"))
    toll = ends.groupBy("a").agg(F.when(F.count("*") > 2, F.lit(float(penalty))).otherwise(F.lit(0.0)).alias("toll"))
    lanes = materialize(ends.groupBy("a", "b").agg(F.max(F.struct("e", "w")).alias("x")).select("a", "b", "x.e", "x.w"))
    onward = lanes.select(F.col("a").alias("b"), F.col("b").alias("c"))
    turns = lanes.join(toll.withColumnRenamed("a", "b"), "b").join(onward, "b").where("c <> a and c <> b").select("a", "b", "c", (F.col("w") + F.col("toll")).alias("cost"))
    turns = materialize(turns)

    own = snapped.join(edges.select("e", "u", "v", "w"), "e")
    exits = own.select("pid", F.explode(F.array(F.struct(F.col("v").alias("at"), (F.col("w") - F.col("along")).alias("d")), F.struct(F.col("u").alias("at"), F.col("along").alias("d")))).alias("x"), "u", "v")
    exits = exits.select("pid", F.col("x.at").alias("a"), F.col("x.d").alias("d"), "u", "v").join(toll, "a").join(onward.withColumnRenamed("b", "a").withColumnRenamed("c", "b"), "a")
    first = exits.where("b <> u and b <> v").select("pid", "u", "v", "a", "b", (F.col("d") + F.col("toll")).alias("d")).where(F.col("d") <= radius)
    walk = ["pid", "u", "v", "a", "b"]
    entered = frontier = materialize(first.groupBy(*walk).agg(F.min("d").alias("d")))
    while frontier.limit(1).count():
        ahead = frontier.join(turns, ["a", "b"]).select("pid", "u", "v", F.col("b").alias("a"), F.col("c").alias("b"), (F.col("d") + F.col("cost")).alias("d"))
        ahead = ahead.where((F.col("d") <= radius) & ~((F.col("a") == F.col("u")) & (F.col("b") == F.col("v")))).groupBy(*walk).agg(F.min("d").alias("d"))
        known = entered.select(*walk, F.col("d").alias("had"))
        frontier = materialize(ahead.join(known, walk, "left").where("had is null or d < had").select(*walk, "d"))
        entered = materialize(entered.union(frontier).groupBy(*walk).agg(F.min("d").alias("d")))

    middle = (F.col("start_dist") + F.col("end_dist")) / 2
    beside = own.join(segments, "e").where("start_dist >= along or end_dist <= along").select("e", "i", F.abs(middle - F.col("along")).alias("far"))
    beyond = entered.join(lanes, ["a", "b"]).join(segments, "e").select("e", "i", (F.col("d") + middle).alias("far"))
    sums = beside.union(beyond).where(F.col("far") <= radius).groupBy("e", "i").agg(F.sum(F.exp(-F.col("far") / scale)).alias("score"))
    return segments.select("e", "i").join(sums, ["e", "i"], "left").select("e", "i", F.coalesce("score", F.lit(0.0)).alias("score"))
