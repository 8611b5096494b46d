"""Map elements as JSON documents, polygon files, and rings stitched from lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.functions import geo, predicates

POINT = "struct<lon:double,lat:double>"
ELEMENT = f"struct<type:string,id:bigint,version:int,lon:double,lat:double,nodes:array<bigint>,geometry:array<{POINT}>,center:{POINT},members:array<struct<type:string,ref:bigint,role:string,geometry:array<{POINT}>>>,tags:map<string,string>>"
DOCUMENT = f"remark string, elements array<{ELEMENT}>"


def elements(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row an element. The first of several with one type and id counts; a document with a remark is incomplete and an error."""
    doc = documents.select(F.from_json(text, DOCUMENT).alias("d"), F.monotonically_increasing_id().alias("__doc"))
    whole = F.when(F.col("d.remark").isNotNull(), F.raise_error(F.lit("an incomplete response was found"))).otherwise(F.col("d.elements"))
    rows = doc.select("__doc", F.posexplode(whole).alias("__pos", "e"))
    first = rows.groupBy(F.col("e.type"), F.col("e.id")).agg(F.min_by("e", F.struct("__doc", "__pos")).alias("e"))
    return first.select("e.*")


def from_blocks(rows: DataFrame) -> DataFrame:
    """Elements of decoded blocks (kind, id, x, y, refs, tags): ways get their nodes' places, null where a node is missing.

    Relations keep their tags only."""
    place = F.struct((F.col("x") / 1e7).alias("lon"), (F.col("y") / 1e7).alias("lat"))
    none = F.lit(None)
    shape = ["type", "id", "lon", "lat", "nodes", "geometry", "center", "members", "tags"]
    empty = {"center": none.cast(POINT), "members": none.cast(f"array<struct<role:string,geometry:array<{POINT}>>>")}
    nodes = rows.where("kind = 'node'").select("id", place.alias("p"), "tags")
    refs = rows.where("kind = 'way'").select("id", F.posexplode_outer("refs").alias("i", "ref"))
    placed = refs.join(nodes.select(F.col("id").alias("ref"), "p"), "ref", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "ref", "p"))).alias("r"))
    ways = placed.join(rows.where("kind = 'way'").select("id", "tags"), "id").select(F.lit("way").alias("type"), "id", none.cast("double").alias("lon"), none.cast("double").alias("lat"), F.col("r.ref").alias("nodes"), F.col("r.p").alias("geometry"), "tags").withColumns(empty)
    lone = rows.where("kind <> 'way'").select(F.col("kind").alias("type"), "id", F.when(F.col("kind") == "node", place).alias("p"), "tags")
    others = lone.select("type", "id", "p.lon", "p.lat", none.cast("array<long>").alias("nodes"), none.cast(f"array<{POINT}>").alias("geometry"), "tags").withColumns(empty)
    return others.select(*shape).union(ways.select(*shape))


def walk_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat) and pairs (way_id, a, b) of walkable ways. A way whose geometry does not fit its references
    is left out, and pairs that touch a node on which walking is not permitted go, without a bridge over it."""
    tag = predicates.in_map("tags")
    empty = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("tags", F.coalesce("tags", empty))
    good = (F.size("nodes") > 1) & (F.size("nodes") == F.size("geometry")) & F.forall("geometry", lambda p: p.isNotNull())
    ways = rows.where((F.col("type") == "way") & predicates.walking(tag) & F.coalesce(good, F.lit(False)))
    at = ways.select(F.explode(F.arrays_zip("nodes", "geometry")).alias("p")).select(F.col("p.nodes").alias("id"), "p.geometry.lon", "p.geometry.lat").dropDuplicates(["id"])
    pairs = ways.select(F.col("id").alias("way_id"), F.explode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("a"), F.get("nodes", i + 1).alias("b")))).alias("p")).select("way_id", "p.*")
    blocked = rows.where((F.col("type") == "node") & ~predicates.permitted(tag)).select(F.col("id").alias("__n"))
    for end in ("a", "b"):
        pairs = pairs.join(blocked, F.col(end) == F.col("__n"), "left_anti")
    return at, pairs


def points(rows: DataFrame, rule: Column) -> DataFrame:
    """(type, id, lon, lat) of the elements that ``rule`` chooses: a node's place, a relation's centre, or a point inside an area."""
    chosen = rows.where(rule)
    given = chosen.where("type = 'node' or (type = 'relation' and center is not null)").select("type", "id", F.coalesce("lon", "center.lon").alias("lon"), F.coalesce("lat", "center.lat").alias("lat"))
    lines = F.when(F.col("type") == "way", F.array("geometry")).otherwise(F.transform(F.filter("members", lambda m: ~m["role"].eqNullSafe(F.lit("inner"))), lambda m: m["geometry"]))
    rest = chosen.where("type = 'way' or (type = 'relation' and center is null)").select("type", "id", lines.alias("lines"))

    @F.pandas_udf(POINT)
    def inside(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([representative([[(p["lon"], p["lat"]) for p in line] for line in lines if line is not None]) or (None, None) for lines in col], columns=["lon", "lat"])

    found = rest.withColumn("p", inside("lines")).where("p.lon is not null").select("type", "id", "p.lon", "p.lat")
    return given.union(found)


def stitched(lines: list[list[tuple[float, float]]]) -> tuple[list[list[tuple[float, float]]], bool]:
    """Closed rings from lines that meet at their ends, and whether every line went into one."""
    left = [list(x) for x in lines if len(x) > 1]
    rings, whole = [], True
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            k = next((i for i, x in enumerate(left) if ring[-1] in (x[0], x[-1])), None)
            if k is None:
                whole = False
                break
            more = left.pop(k)
            ring += (more if more[0] == ring[-1] else more[::-1])[1:]
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
        else:
            whole = False
    return rings, whole


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def representative(lines: list[list[tuple[float, float]]]) -> tuple[float, float] | None:
    """A point inside the largest ring, on its middle latitude in the middle of the widest stretch; without a ring the middle of the longest line."""
    lines = [x for x in lines if len(x) > 1]
    if not lines:
        return None
    rings, _ = stitched(lines)
    if not rings:
        line = max(lines, key=len)
        return line[len(line) // 2]
    ring = max(rings, key=area)
    ys = sorted({y for _, y in ring})
    if len(ys) < 2:
        return ring[0]
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:]) if (a[1] > y) != (b[1] > y))
    west, east = max(zip(xs[::2], xs[1::2]), key=lambda s: s[1] - s[0])
    return (west + east) / 2, y


def rings_of(lines: DataFrame) -> DataFrame:
    """Ring edges (poly, ring, seq, x1, y1, x2, y2) from lines (poly, role, ord, points); open ends are an error.

    Outlines are ring 0 of their polygon, inner rings are numbered on."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, n = [], 1
        for role in ("outer", "inner"):
            own = pdf[pdf["role"] == role].sort_values("ord")
            rings, whole = stitched([[(p["x"], p["y"]) for p in line] for line in own["points"]])
            if not whole:
                raise ValueError(f"the boundary of {key[0]} has open ends")
            for ring in rings:
                k = 0 if role == "outer" else n
                n += role == "inner"
                out += [(key[0], k, i, *a, *b) for i, (a, b) in enumerate(zip(ring, ring[1:]))]
        return pd.DataFrame(out, columns=["poly", "ring", "seq", "x1", "y1", "x2", "y2"])

    return lines.groupBy("poly").applyInPandas(run, "poly int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")


def poly_rings(lines: DataFrame) -> DataFrame:
    """(file, ring, hole, seq, lon, lat) from a polygon file's lines (file, n, line): rings run from a name to END, and ``!`` marks a hole."""
    parts = F.filter(F.split(F.btrim("line"), "\\s+"), lambda x: x != "")
    body = lines.where("n > 0").withColumn("p", parts).where(F.size("p") > 0)
    w = Window.partitionBy("file").orderBy("n")
    head = (F.size("p") == 1) & (F.get("p", F.lit(0)) != "END")
    rings = body.withColumn("ring", F.sum(head.cast("int")).over(w)).withColumn("hole", F.last(F.when(head, F.get("p", F.lit(0)).startswith("!")), ignorenulls=True).over(w))
    at = rings.where(F.size("p") == 2)
    seq = F.row_number().over(Window.partitionBy("file", "ring").orderBy("n")) - 1
    return at.select("file", F.col("ring").cast("int"), "hole", seq.alias("seq"), F.get("p", F.lit(0)).cast("double").alias("lon"), F.get("p", F.lit(1)).cast("double").alias("lat"))


def poly_lines(rings: DataFrame) -> DataFrame:
    """The lines (file, n, line) of a polygon file, from its ring points."""
    w = Window.partitionBy("file").orderBy("ring", "part", "seq")
    name = F.concat(F.when(F.col("hole"), "!").otherwise(""), F.col("ring").cast("string"))
    heads = rings.groupBy("file", "ring").agg(F.first("hole").alias("hole")).select("file", "ring", F.lit(0).alias("part"), F.lit(0).alias("seq"), name.alias("line"))
    body = rings.select("file", "ring", F.lit(1), "seq", F.format_string("   %.7f   %.7f", "lon", "lat"))
    ends = heads.select("file", "ring", F.lit(2), F.lit(0), F.lit("END"))
    numbered = heads.union(body).union(ends).select("file", F.row_number().over(w).alias("n"), "line")
    files = rings.select("file").distinct()
    last = numbered.groupBy("file").agg((F.max("n") + 1).alias("n")).select("file", "n", F.lit("END").alias("line"))
    return files.select("file", F.lit(0).alias("n"), F.col("file").cast("string").alias("line")).union(numbered).union(last)


def line_middle(col: str) -> tuple[Column, Column]:
    """The centroid of a line of points (x, y): its segments' middles weighted by their lengths."""
    p = F.col(col)
    seg = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(
        F.sqrt(F.pow(F.get(p, i + 1)["x"] - F.get(p, i)["x"], 2) + F.pow(F.get(p, i + 1)["y"] - F.get(p, i)["y"], 2)).alias("l"),
        ((F.get(p, i)["x"] + F.get(p, i + 1)["x"]) / 2).alias("x"), ((F.get(p, i)["y"] + F.get(p, i + 1)["y"]) / 2).alias("y")))
    total = lambda f: F.aggregate(seg, F.lit(0.0), lambda a, s: a + f(s))
    return tuple(total(lambda s, c=c: s["l"] * s[c]) / total(lambda s: s["l"]) for c in ("x", "y"))


def bounds_of_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cx", F.floor(F.col("x") / geo.CHUNK)).withColumn("cy", F.floor(F.col("y") / geo.CHUNK))
