"""A deterministic spatial world over the dataset's tables, in Spark and as DuckDB text.

The lattice has a node every 50 m, 100 a row, numbered by orders; orders with status P are gaps. Everything is
integer arithmetic, so both engines give equal values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netdensity.session import table

# Part types that count as destinations, and brands that do not.
KINDS, EXCLUDED = ("ECONOMY", "PROMO", "STANDARD"), ("Brand#4", "Brand#8")


def size(spark: SparkSession, d: str) -> int:
    """How many orders there are; the extent of the world follows it."""
    return table(spark, d, "orders").count()


def node(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select(k.alias("id"), (k % 100 * 50).cast("double").alias("x"), (F.floor(k / 100) * 50).cast("double").alias("y"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    """Directed 50 m edges between neighbours of a row or a column, both ways."""
    n = node(spark, d).select("id")
    ahead = n.select(F.col("id").alias("u"), F.explode(F.when(F.col("id") % 100 == 99, F.array(F.col("id") + 100)).otherwise(F.array(F.col("id") + 1, F.col("id") + 100))).alias("v"))
    one = ahead.join(n, ahead.v == n.id, "left_semi")
    return one.select("u", "v", F.lit(50.0).alias("w")).union(one.select("v", "u", F.lit(50.0)))


def poi(spark: SparkSession, d: str) -> DataFrame:
    n = size(spark, d)
    k = F.col("p_partkey")
    return table(spark, d, "part").where(F.col("p_type").isin(*KINDS) & ~F.col("p_brand").isin(*EXCLUDED)).select(
        k.alias("k"), (k * 7919 % 5000).cast("double").alias("x"), (k * 104729 % (n // 2)).cast("double").alias("y"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    rows = size(spark, d) // 50
    g = spark.range(200 * rows).select((F.col("id") % 200).cast("int").alias("ci"), F.floor(F.col("id") / 200).cast("int").alias("ri"))
    return g.select("ci", "ri", (25.0 * F.col("ci") + 12.5).alias("x"), (25.0 * F.col("ri") + 12.5).alias("y"))


def way(spark: SparkSession, d: str) -> DataFrame:
    """One way a lattice row: its nodes in order of x."""
    return node(spark, d).groupBy(F.floor(F.col("id") / 100).alias("way_id")).agg(F.sort_array(F.collect_list("id")).alias("refs"))


def place(spark: SparkSession, d: str) -> DataFrame:
    """Points with longitude and latitude."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (-72.0 + k % 1000 * 0.002).alias("lon"), (41.5 + k % 37 * 0.01 + k % 7 * 0.001).alias("lat"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Elements with tags, from order lines."""
    highway = F.element_at(F.array(*[F.lit(x) for x in ("footway", "residential", "motorway", "path", "service", "steps", "primary")]), F.col("l_linenumber") % 7 + 1)
    q = F.col("l_quantity").cast("int")
    foot = F.when(q % 5 == 0, "yes").when(q % 5 == 1, "no").when(q % 5 == 2, "designated")
    access = F.when(q % 3 == 0, "private").when(q % 3 == 1, "no")
    shop = F.when(q % 4 == 0, "bakery").when(q % 4 == 1, "vacant")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("highway", highway), ("foot", foot), ("access", access), ("shop", shop))]), lambda p: p["value"].isNotNull())
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"), F.map_from_entries(pairs).alias("tags"))


def relation(spark: SparkSession, d: str) -> DataFrame:
    """Nested relations: regions hold nations, nations hold customers."""
    nations = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("rid"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("ref"))
    people = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("rid"), F.concat(F.lit("c"), F.col("c_custkey")).alias("ref"))
    return nations.union(people)


def tile_key(spark: SparkSession, d: str) -> DataFrame:
    """Tiles at zoom 14, scattered with runs."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where("o_orderkey % 11 <> 0 and o_orderstatus <> 'P'").select(F.lit(14).cast("long").alias("z"), (4800 + k % 97).alias("x"), (6000 + F.floor(k / 97) % 61).alias("y")).distinct()


def raster(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping regions of a score raster; null is no data."""
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(F.floor(k / 120).alias("row"), (k % 120).alias("col"), F.when(F.col("o_orderstatus") == "P", None).otherwise(k % 50 / 8.0).alias("score"))
    first = cells.where("col < 80").select(F.lit(0).alias("region"), "row", "col", "score")
    return first.union(cells.where("col >= 40").select(F.lit(1), "row", "col", (F.col("score") + 0.5)))


def ring(spark: SparkSession) -> DataFrame:
    """A polygon with a hole, and an island."""
    corners = {(0, 0): [(100, 100), (4200, 150), (4300, 2800), (250, 2900)], (0, 1): [(1500, 900), (2500, 950), (2400, 1900), (1600, 1800)], (1, 0): [(4500, 100), (4900, 100), (4900, 700), (4500, 700)]}
    rows = [(p, r, i, float(x), float(y), float(xs[(i + 1) % len(xs)][0]), float(xs[(i + 1) % len(xs)][1])) for (p, r), xs in corners.items() for i, (x, y) in enumerate(xs)]
    return spark.createDataFrame(rows, "poly int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")


def job(spark: SparkSession, d: str) -> DataFrame:
    """A log of scoring jobs, one a supplier."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("job")).agg((F.sum(F.col("l_quantity").cast("long")) / 1000.0).alias("seconds"), F.count("*").alias("cells"), F.sum((F.col("l_returnflag") != "N").cast("long")).alias("reachable"))


_CORNERS = [(0, 0, 0, 100, 100, 4200, 150), (0, 0, 1, 4200, 150, 4300, 2800), (0, 0, 2, 4300, 2800, 250, 2900), (0, 0, 3, 250, 2900, 100, 100), (0, 1, 0, 1500, 900, 2500, 950), (0, 1, 1, 2500, 950, 2400, 1900), (0, 1, 2, 2400, 1900, 1600, 1800), (0, 1, 3, 1600, 1800, 1500, 900), (1, 0, 0, 4500, 100, 4900, 100), (1, 0, 1, 4900, 100, 4900, 700), (1, 0, 2, 4900, 700, 4500, 700), (1, 0, 3, 4500, 700, 4500, 100)]

#: The same views for DuckDB, by name; later ones use earlier ones.
VIEWS = {
    "node": "SELECT o_orderkey AS id, CAST(o_orderkey % 100 * 50 AS DOUBLE) AS x, CAST(o_orderkey // 100 * 50 AS DOUBLE) AS y FROM orders WHERE o_orderstatus <> 'P'",
    "edge1": "SELECT a.id AS u, b.id AS v FROM node a JOIN node b ON (b.id = a.id + 1 AND a.y = b.y) OR b.id = a.id + 100",
    "edge": "SELECT u, v, 50.0::DOUBLE AS w FROM edge1 UNION ALL SELECT v, u, 50.0::DOUBLE FROM edge1",
    "poi": "SELECT p_partkey AS k, CAST(p_partkey * 7919 % 5000 AS DOUBLE) AS x, CAST(p_partkey * 104729 % ((SELECT count(*) FROM orders) // 2) AS DOUBLE) AS y FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND p_brand NOT IN ('Brand#4', 'Brand#8')",
    "grid": "SELECT CAST(i % 200 AS INTEGER) AS ci, CAST(i // 200 AS INTEGER) AS ri, 25.0::DOUBLE * (i % 200) + 12.5 AS x, 25.0::DOUBLE * (i // 200) + 12.5 AS y FROM (SELECT unnest(range(200 * ((SELECT count(*) FROM orders) // 50))) AS i)",
    "way": "SELECT id // 100 AS way_id, list(id ORDER BY id) AS refs FROM node GROUP BY 1",
    "place": "SELECT c_custkey AS id, -72.0::DOUBLE + c_custkey % 1000 * 0.002::DOUBLE AS lon, 41.5::DOUBLE + c_custkey % 37 * 0.01::DOUBLE + c_custkey % 7 * 0.001::DOUBLE AS lat FROM customer",
    "tagged": "SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, list_extract(['footway', 'residential', 'motorway', 'path', 'service', 'steps', 'primary'], l_linenumber % 7 + 1) AS highway, CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'designated' END AS foot, CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'no' END AS access, CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'bakery' WHEN 1 THEN 'vacant' END AS shop FROM lineitem",
    "relation": "SELECT 'r' || n_regionkey AS rid, 'n' || n_nationkey AS ref FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer",
    "tile_key": "SELECT DISTINCT 14::BIGINT AS z, 4800 + o_orderkey % 97 AS x, 6000 + (o_orderkey // 97) % 61 AS y FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderstatus <> 'P'",
    "raster": "WITH c AS (SELECT o_orderkey // 120 AS row, o_orderkey % 120 AS col, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 50 / 8.0::DOUBLE END AS score FROM orders) SELECT 0 AS region, row, col, score FROM c WHERE col < 80 UNION ALL SELECT 1, row, col, score + 0.5 FROM c WHERE col >= 40",
    "ring": "SELECT * FROM (VALUES " + ", ".join(f"({p}, {r}, {s}, {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {e}.0::DOUBLE)" for p, r, s, a, b, c, e in _CORNERS) + ") AS t(poly, ring, seq, x1, y1, x2, y2)",
    "job": "SELECT l_suppkey AS job, sum(CAST(l_quantity AS BIGINT)) / 1000.0::DOUBLE AS seconds, count(*) AS cells, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS reachable FROM lineitem GROUP BY 1",
}
_NEEDS = {"edge1": ("node",), "edge": ("node", "edge1"), "way": ("node",)}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` with the named views before it."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
    head = ", ".join(f'"{n}" AS ({VIEWS[n]})' for n in names)
    # "by" names a coordinate in these texts and is a keyword there; keywords are in upper case.
    rest = re.sub(r"\bby\b", "b_y", body.lstrip())
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {head}, {rest[5:]}"
    return f"WITH {head} {rest}"
