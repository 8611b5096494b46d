"""Distance joins, nearest neighbours and polygons.

A distance join puts one side on a lattice of cells as wide as the radius and the other side on the
nine cells around each of its points, so it is an equality join on the cell followed by the exact test;
no pair further apart than two cells is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.session import materialize


def cell(c: Column, width: float) -> Column:
    return F.floor(c / width)


def within(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs at most ``radius`` apart, with their distance ``d``. ``right`` has its coordinates as rx, ry.

    Each row of ``left`` goes to nine cells, so the smaller side belongs there."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = left.withColumn("__cx", F.explode(F.transform(around, lambda k: cell(F.col(x), radius) + k))).withColumn("__cy", F.explode(F.transform(around, lambda k: cell(F.col(y), radius) + k)))
    placed = right.withColumn("__cx", cell(F.col(rx), radius)).withColumn("__cy", cell(F.col(ry), radius))
    d = F.sqrt(F.pow(F.col(x) - F.col(rx), 2) + F.pow(F.col(y) - F.col(ry), 2))
    return spread.join(placed, ["__cx", "__cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("__cx", "__cy")


def snap(points: DataFrame, nodes: DataFrame, key: str, reach: float) -> DataFrame:
    """(key, node, d): the nearest node within ``reach``; of distances equal to nine digits the lesser id. Points out of reach have no row."""
    right = nodes.select(F.col("id").alias("node"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = within(points.select(key, "x", "y"), right, reach)
    best = near.groupBy(key).agg(F.min(F.struct(F.round("d", 9).alias("r"), "node", "d")).alias("m"))
    return best.select(key, "m.node", "m.d")


def nearest(points: DataFrame, nodes: DataFrame, key: str, width: float) -> DataFrame:
    """(key, node, d) of the nearest node however far, by rings of cells: a hit counts once it is nearer than the ring reaches."""
    left = materialize(points.select(key, "x", "y"))
    nodes = materialize(nodes.select("id", "x", "y"))
    if not nodes.take(1):
        return left.select(key, F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("d")).limit(0)
    done = None
    while True:
        found = materialize(snap(left, nodes, key, width))
        done = found if done is None else done.union(found)
        left = materialize(left.join(found, key, "left_anti"))
        if not left.take(1):
            return done
        width *= 4


def crossings(points: DataFrame, rings: DataFrame, by: list[str], slack: float = 1e-12, band: float = 250.0) -> DataFrame:
    """For points (pid, x, y) and ring edges (.., x1, y1, x2, y2): per point and ``by``, the parity of edges to the right, and whether the point is on an edge.

    Both sides meet in bands of ``band`` metres of y, which an edge is in as often as it crosses them, so the join is one of equality."""
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on = (F.abs(cross) <= slack) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    banded = rings.withColumn("__band", F.explode(F.sequence(cell(F.least(y1, y2), band), cell(F.greatest(y1, y2), band))))
    joined = points.withColumn("__band", cell(y, band)).join(banded, "__band").where((y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2)))
    return joined.groupBy("pid", *by).agg((F.count_if(hit) % 2 == 1).alias("inside"), F.bool_or(on).alias("edge"))


def covered(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(pid, poly): points in or on a polygon. Ring 0 is the outline, others are holes; a hole's edge still counts as covered."""
    per_ring = crossings(points, rings, ["poly", "ring"])
    outer = (F.col("ring") == 0) & (F.col("inside") | F.col("edge"))
    hole = (F.col("ring") > 0) & F.col("inside") & ~F.col("edge")
    return per_ring.groupBy("pid", "poly").agg(F.bool_or(outer).alias("i"), F.bool_or(hole).alias("h")).where("i and not h").select("pid", "poly")


def edge_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment, and the place of the nearest point on it from 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)))
    return F.sqrt(F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2)), t


def snap_to_edges(points: DataFrame, edges: DataFrame, key: str, reach: float, longest: float) -> DataFrame:
    """(key, e, d, along): the nearest edge within ``reach``; the first edge wins ties. Edges (e, ax, ay, bx, by) are ``longest`` at most.

    Edges go to the cells around their middle, so candidates come from an equality join."""
    width = reach + longest / 2
    mid = edges.withColumn("rx", (F.col("ax") + F.col("bx")) / 2).withColumn("ry", (F.col("ay") + F.col("by")) / 2)
    near = within(points.select(key, "x", "y"), mid, width).drop("d")
    d, t = edge_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    near = near.select(key, "e", d.alias("d"), (t * length).alias("along")).where(F.col("d") <= reach)
    best = near.groupBy(key).agg(F.min(F.struct("d", "e", "along")).alias("m"))
    return best.select(key, "m.e", "m.d", "m.along")


def ring_area(rings: DataFrame) -> DataFrame:
    """(poly, area): outline less holes."""
    each = rings.groupBy("poly", "ring").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    return each.groupBy("poly").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def pieces(rings: DataFrame, width: float) -> DataFrame:
    """Ring edges once for every piece of ``width`` at the longest, with the piece's middle as rx, ry."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    cut = rings.withColumn("__n", F.greatest(F.lit(1), F.ceil(length / width)).cast("int")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    middle = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("__i") + 0.5) / F.col("__n")
    return cut.withColumn("rx", middle("x")).withColumn("ry", middle("y")).drop("__n", "__i")


def outline_within(points: DataFrame, rings: DataFrame, reach: float, width: float = 200.0) -> DataFrame:
    """(pid, d): distance to the nearest ring edge, of the points that have one within ``reach``."""
    d, _ = edge_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    near = within(points.select("pid", "x", "y"), pieces(rings.select("x1", "y1", "x2", "y2"), width), reach + width / 2).drop("d")
    return near.groupBy("pid").agg(F.min(d).alias("d")).where(F.col("d") <= reach)


def ring_distance(points: DataFrame, rings: DataFrame, reach: float = 400.0) -> DataFrame:
    """(pid, d): distance to the nearest polygon, 0 inside; by rings of cells that widen until every point has found its edge."""
    inside = covered(points, rings).select("pid").distinct()
    left = materialize(points.select("pid", "x", "y").join(inside, "pid", "left_anti"))
    done = inside.select("pid", F.lit(0.0).alias("d"))
    if not rings.take(1):
        return done
    while left.take(1):
        found = materialize(outline_within(left, rings, reach))
        done = done.union(found)
        left = materialize(left.join(found, "pid", "left_anti"))
        reach *= 4
    return done
