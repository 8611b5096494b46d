"""Walk graphs as node and edge tables: building, cutting, filtering, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.functions import geo
from netdensity.operators.components import components
from netdensity.session import materialize

EDGE_POINTS = 65


def adjacent_pairs(ways: DataFrame) -> DataFrame:
    """(way_id, seg, a, b) for the consecutive references of each way; pairs of a node with itself are dropped."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(i.cast("int").alias("seg"), F.get("refs", i).alias("a"), F.get("refs", i + 1).alias("b")))
    return ways.where(F.size("refs") > 1).select("way_id", F.explode(pairs).alias("p")).select("way_id", "p.*").where("a <> b")


def located_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the coordinates of both ends and their length; pairs with a missing node or no length are dropped."""
    a = nodes.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return pairs.join(a, "a").join(b, "b").withColumn("len", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))).where("len > 0")


def subdivide(pairs: DataFrame, most: float = geo.SPACING) -> DataFrame:
    """The points that cut each pair into pieces of ``most`` at the longest: (way_id, seg, j, k, x, y, rank).

    An inner point's key names the ends in order and its place from the lesser one, so both directions of a pair agree."""
    cut = pairs.withColumn("n", geo.pieces_ceil(F.col("len"), most))
    at = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n"))))
    j, n, a, b = (F.col(c) for c in ("j", "n", "a", "b"))
    inner = F.concat_ws(":", F.concat(F.lit("e"), F.least(a, b).cast("string")), F.greatest(a, b), F.when(a < b, j).otherwise(n - j))
    key = F.when(j == 0, F.concat(F.lit("n"), a)).when(j == n, F.concat(F.lit("n"), b)).otherwise(inner)
    point = lambda c: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * j / n
    return at.select("way_id", "seg", "j", key.alias("k"), point("x").alias("x"), point("y").alias("y"), geo.position_key(F.col("way_id"), F.col("seg"), j).alias("rank"), "n", "len")


def vertices(points: DataFrame) -> DataFrame:
    """One row a key: the coordinates and rank of the point with the lowest rank."""
    return points.groupBy("k").agg(F.min(F.struct("rank", "x", "y")).alias("p")).select("k", "p.x", "p.y", "p.rank")


def shortest_parallel(edges: DataFrame) -> DataFrame:
    """Undirected edges (u < v) with the least length of parallel ones."""
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("length").alias("length"))


def build(nodes: DataFrame, ways: DataFrame, most: float = geo.SPACING) -> tuple[DataFrame, DataFrame]:
    """Vertices (k, x, y, rank) and edges (u, v, length) between keys, cut to pieces and without parallels."""
    points = subdivide(located_pairs(adjacent_pairs(ways), nodes), most)
    ahead = Window.partitionBy("way_id", "seg").orderBy("j")
    pieces = points.withColumn("v", F.lead("k").over(ahead)).where("v is not null").select(F.col("k").alias("u"), "v", (F.col("len") / F.col("n")).alias("length"))
    return vertices(points), shortest_parallel(pieces)


def build_from_lines(lines: DataFrame) -> DataFrame:
    """Edges from a line's first to its last coordinate: (u, v, weight). A missing length is taken from the coordinates
    in degrees; of several lines between the same ends the last given (highest ``ord``) counts."""
    c = F.col("coords")
    parts = F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.sqrt(F.pow(F.get(c, i + 1)["x"] - F.get(c, i)["x"], 2) + F.pow(F.get(c, i + 1)["y"] - F.get(c, i)["y"], 2)))
    own = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * geo.DEGREE_METRES
    ends = lines.where(F.size(c) > 1).select("ord", F.element_at(c, 1).alias("s"), F.element_at(c, -1).alias("e"), F.coalesce("length", own).alias("weight"))
    ordered = ends.select("ord", F.least("s", "e").alias("u"), F.greatest("s", "e").alias("v"), "weight")
    return ordered.groupBy("u", "v").agg(F.max(F.struct("ord", "weight"))["weight"].alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """The symmetric adjacency of undirected edges (u, v, ..)."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *rest).union(edges.select("v", "u", *rest)).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) from undirected edges; a loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) for every node; root is the least id of its component."""
    linked = components(edges, "u", "v")
    return nodes.select("id").join(linked, nodes.id == linked.node, "left").select("id", F.coalesce("root", "id").alias("root"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of the component with the most nodes; of equals the one with the least id."""
    labels = materialize(component_labels(nodes, edges))
    top = labels.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return labels.join(top, "root", "left_semi").select("id")


def segment_edges(edges: DataFrame, size: float) -> DataFrame:
    """Pieces (e, i, ends, start_dist, end_dist) of about ``size`` of edges (e, ax, ay, bx, by, len)."""
    n, i = geo.pieces_round(F.col("len"), size), F.col("i")
    cut = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * k / F.col("n")
    return cut.select("e", "i", at("x", i).alias("x1"), at("y", i).alias("y1"), at("x", i + 1).alias("x2"), at("y", i + 1).alias("y2"), (F.col("len") * i / F.col("n")).alias("start_dist"), (F.col("len") * (i + 1) / F.col("n")).alias("end_dist"))


def edge_samples(edges: DataFrame, every: float) -> DataFrame:
    """The ends of each edge, and inner points about ``every`` apart where it is longer: (e, t, x, y)."""
    n = F.when(F.col("len") > every, F.floor(F.col("len") / every)).otherwise(0).cast("int")
    inner = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: i / F.col("n"))).otherwise(F.array().cast("array<double>"))
    ts = edges.withColumn("n", n).withColumn("t", F.explode(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    return ts.select("e", "t", (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("y"))


def box_edges(boxes: DataFrame, key: str, across: list[str]) -> DataFrame:
    """Evenly spaced points on the four sides of each box."""
    w, s, e, n = (F.col(c) for c in across)
    t = F.transform(F.sequence(F.lit(0), F.lit(EDGE_POINTS - 1)), lambda i: i / float(EDGE_POINTS - 1))
    side = lambda f: F.transform(t, lambda i: F.struct(f(i)[0].alias("a"), f(i)[1].alias("b")))
    points = F.concat(side(lambda i: (w + i * (e - w), s)), side(lambda i: (w + i * (e - w), n)), side(lambda i: (w, s + i * (n - s))), side(lambda i: (e, s + i * (n - s))))
    return boxes.select(key, F.explode(points).alias("p")).select(key, "p.*")


def bounds(points: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    return points.groupBy(key).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def projected_bounds(boxes: DataFrame, key: str) -> DataFrame:
    """The box in metres around the projected sides of a box in degrees."""
    return bounds(box_edges(boxes, key, ["west", "south", "east", "north"]), key, *geo.project(F.col("a"), F.col("b")))


def acquisition_bounds(boxes: DataFrame, key: str, margin: float = geo.HALO + geo.SPACING) -> DataFrame:
    """The box in degrees that holds a box's projection with a margin in metres."""
    wide = projected_bounds(boxes, key).select(key, *[(F.col(c) + s * margin).alias(c) for c, s in (("west", -1), ("south", -1), ("east", 1), ("north", 1))])
    return bounds(box_edges(wide, key, ["west", "south", "east", "north"]), key, *geo.unproject(F.col("a"), F.col("b")))


def inside_box(nodes: DataFrame, edges: DataFrame, west: float, south: float, east: float, north: float) -> tuple[DataFrame, DataFrame]:
    """The nodes within a closed box, and the edges with both ends there."""
    inside = nodes.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    return inside, with_ends(edges, inside.select("id"))


def with_ends(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the chosen ids."""
    for end in ("u", "v"):
        ids = chosen.select(F.col("id").alias(f"__{end}"))
        edges = edges.join(ids, F.col(end) == F.col(f"__{end}"), "left_semi")
    return edges


def without_nodes(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges neither of whose ends is blocked; nothing bridges a blocked node."""
    for end in ("u", "v"):
        ids = blocked.select(F.col("id").alias(f"__{end}"))
        edges = edges.join(ids, F.col(end) == F.col(f"__{end}"), "left_anti")
    return edges


def closure(links: DataFrame, roots: DataFrame, up: bool = False, rounds: int = 64) -> DataFrame:
    """Everything reachable from the roots (column id) along links (rid, ref), or against them: (id, depth), roots at depth 0.

    One join a round over the newly found ids only; cycles end as nothing new is found."""
    step = links.select(F.col("ref").alias("__a"), F.col("rid").alias("__b")) if up else links.select(F.col("rid").alias("__a"), F.col("ref").alias("__b"))
    found = materialize(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    new = found
    for depth in range(1, rounds + 1):
        reached = new.join(step, F.col("id") == F.col("__a")).select(F.col("__b").alias("id")).distinct()
        known = found.select(F.col("id").alias("__k"))
        new = materialize(reached.join(known, F.col("id") == F.col("__k"), "left_anti").withColumn("depth", F.lit(depth)))
        if not new.take(1):
            return found
        found = materialize(found.union(new))
    raise ValueError(f"not closed after {rounds} rounds")


def member_bounds(links: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rid, west, south, east, north, complete) of relations over leaves (ref, x, y), nested ones included.

    A relation any of whose members is missing, or that lies on a cycle, is not complete and has null bounds."""
    rels = links.select("rid").distinct()
    known = leaves.select(F.col("ref"), F.col("x").alias("w"), F.col("y").alias("s"), F.col("x").alias("e"), F.col("y").alias("n"))
    known = materialize(known)
    done = None
    while True:
        joined = links.join(known, "ref", "left")
        full = joined.groupBy("rid").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.bool_and(F.col("w").isNotNull()).alias("ok")).where("ok").drop("ok")
        full = materialize(full)
        count = full.count()
        if count == done:
            return rels.join(full, "rid", "left").select("rid", F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"), F.col("w").isNotNull().alias("complete"))
        done = count
        known = materialize(leaves.select("ref", F.col("x").alias("w"), F.col("y").alias("s"), F.col("x").alias("e"), F.col("y").alias("n")).unionByName(full.withColumnRenamed("rid", "ref")))
