"""Projections, tile arithmetic, kernels, colours, tag rules and row filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from netdensity.functions import geo, predicates
from netdensity.operators import graph
from netdensity.plans import fixtures as fx
from netdensity.plans.book import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
N, RECT, ALPHA, BETA, DELTA = geo.series()


def _r(e: str, n: int = 6) -> str:
    return f"round({e}, {n})"


def _round(c, n: int = 6):
    return F.round(c, n)


@BOOK.add(fx.sql("SELECT id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS BIGINT) AS epsg, CAST(CASE WHEN lat - 42 >= 0 THEN 32600 ELSE 32700 END + floor((lon * 2 + 180) / 6) + 1 AS BIGINT) AS epsg2 FROM place", "place"))
def fn_utm_zone(spark, d):
    p = fx.place(spark, d)
    return p.select("id", geo.utm_zone(p.lon, p.lat).alias("epsg"), geo.utm_zone(p.lon * 2, p.lat - 42).alias("epsg2"))


def forward_sql(lon: str, lat: str) -> str:
    """DuckDB: a table expression body giving xi and eta."""
    c = 2 * math.sqrt(N) / (1 + N)
    return f"sinh(atanh(sin(radians({lat}))) - {c!r}::DOUBLE * atanh({c!r}::DOUBLE * sin(radians({lat})))) AS t, radians({lon} - -69.0::DOUBLE) AS dl"


EAST = "500000.0::DOUBLE + {k}::DOUBLE * (eta + " + " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1)) + ")"
NORTH = "{k}::DOUBLE * (xi + " + " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1)) + ")"
EAST, NORTH = EAST.replace("{k}", repr(geo.SCALE * RECT)), NORTH.replace("{k}", repr(geo.SCALE * RECT))
FORWARD = f"WITH a AS (SELECT *, {forward_sql('lon', 'lat')} FROM place), b AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM a)"


@BOOK.add(fx.sql(f"{FORWARD} SELECT id, round({EAST}, 4) AS x, round({NORTH}, 4) AS y FROM b", "place"))
def fn_proj_fwd(spark, d):
    p = fx.place(spark, d)
    x, y = geo.project(p.lon, p.lat)
    return p.select("id", _round(x, 4).alias("x"), _round(y, 4).alias("y"))


INVERSE = (
    "WITH p AS (SELECT id, 200000.0::DOUBLE + id % 997 * 350 AS x, 4500000.0::DOUBLE + id % 613 * 600 AS y FROM place), "
    f"a AS (SELECT *, y / {geo.SCALE * RECT!r}::DOUBLE AS xi, (x - 500000.0) / {geo.SCALE * RECT!r}::DOUBLE AS eta FROM p), "
    "b AS (SELECT *, xi - " + " - ".join(f"{b!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(BETA, 1)) + " AS xi2, eta - " + " - ".join(f"{b!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(BETA, 1)) + " AS eta2 FROM a), "
    "c AS (SELECT *, asin(sin(xi2) / cosh(eta2)) AS chi FROM b) "
)


@BOOK.add(fx.sql(INVERSE + "SELECT id, round(-69.0::DOUBLE + degrees(atan2(sinh(eta2), cos(xi2))), 9) AS lon, round(degrees(chi + " + " + ".join(f"{x!r}::DOUBLE * sin({2 * j} * chi)" for j, x in enumerate(DELTA, 1)) + "), 9) AS lat FROM c", "place"))
def fn_proj_inv(spark, d):
    p = fx.place(spark, d)
    lon, lat = geo.unproject(200000.0 + p.id % 997 * 350, 4500000.0 + p.id % 613 * 600)
    return p.select("id", _round(lon, 9).alias("lon"), _round(lat, 9).alias("lat"))


@BOOK.add(fx.sql("SELECT id, round(lon - 1500.0::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))), 9) AS west, round(lat - 1500.0::DOUBLE / 111320.0::DOUBLE, 9) AS south, round(lon + 1500.0::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))), 9) AS east, round(lat + 1500.0::DOUBLE / 111320.0::DOUBLE, 9) AS north FROM place", "place"))
def fn_bbox_buffer(spark, d):
    p = fx.place(spark, d)
    dx, dy = geo.buffer_degrees(1500.0, p.lat)
    return p.select("id", _round(p.lon - dx, 9).alias("west"), _round(p.lat - dy, 9).alias("south"), _round(p.lon + dx, 9).alias("east"), _round(p.lat + dy, 9).alias("north"))


# A small box at every place, with 65 points an edge.
_BOX = "WITH e AS (SELECT id, lon + s.i / 64.0::DOUBLE * 0.05 AS a, lat AS b FROM place, (SELECT unnest(range(65)) AS i) s UNION ALL SELECT id, lon + s.i / 64.0::DOUBLE * 0.05, lat + 0.03 FROM place, (SELECT unnest(range(65)) AS i) s UNION ALL SELECT id, lon, lat + s.i / 64.0::DOUBLE * 0.03 FROM place, (SELECT unnest(range(65)) AS i) s UNION ALL SELECT id, lon + 0.05, lat + s.i / 64.0::DOUBLE * 0.03 FROM place, (SELECT unnest(range(65)) AS i) s), "
_BOX_XY = f"a AS (SELECT *, {forward_sql('a', 'b')} FROM e), b2 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM a) "


@BOOK.add(fx.sql(_BOX + _BOX_XY + f"SELECT id, round(min({EAST}), 4) AS west, round(min({NORTH}), 4) AS south, round(max({EAST}), 4) AS east, round(max({NORTH}), 4) AS north FROM b2 GROUP BY id", "place"))
def fn_projected_bounds(spark, d):
    boxes = fx.place(spark, d).select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 0.05).alias("east"), (F.col("lat") + 0.03).alias("north"))
    return graph.projected_bounds(boxes, "id").select("id", *[_round(F.col(c), 4).alias(c) for c in ("west", "south", "east", "north")])


_MARGIN = f"{geo.HALO + geo.SPACING!r}::DOUBLE"
_WIDE = f", w AS (SELECT id, min({EAST}) - {_MARGIN} AS w0, min({NORTH}) - {_MARGIN} AS s0, max({EAST}) + {_MARGIN} AS e0, max({NORTH}) + {_MARGIN} AS n0 FROM b2 GROUP BY id), side AS (SELECT w.*, s.i / 64.0::DOUBLE AS f FROM w, (SELECT unnest(range(65)) AS i) s), "
_WIDE += "p AS (SELECT id, w0 + f * (e0 - w0) AS x, s0 AS y FROM side UNION ALL SELECT id, w0 + f * (e0 - w0), n0 FROM side UNION ALL SELECT id, w0, s0 + f * (n0 - s0) FROM side UNION ALL SELECT id, e0, s0 + f * (n0 - s0) FROM side), "
_WIDE += f"m AS (SELECT id, y / {geo.SCALE * RECT!r}::DOUBLE AS xi, (x - 500000.0) / {geo.SCALE * RECT!r}::DOUBLE AS eta FROM p), "
_WIDE += "m2 AS (SELECT id, xi - " + " - ".join(f"{b!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(BETA, 1)) + " AS xi2, eta - " + " - ".join(f"{b!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(BETA, 1)) + " AS eta2 FROM m), "
_WIDE += "m3 AS (SELECT id, -69.0::DOUBLE + degrees(atan2(sinh(eta2), cos(xi2))) AS lon, asin(sin(xi2) / cosh(eta2)) AS chi FROM m2), "
_WIDE += "m4 AS (SELECT id, lon, degrees(chi + " + " + ".join(f"{x!r}::DOUBLE * sin({2 * j} * chi)" for j, x in enumerate(DELTA, 1)) + ") AS lat FROM m3)"


@BOOK.add(fx.sql(_BOX + _BOX_XY + _WIDE + " SELECT id, round(min(lon), 9) AS west, round(min(lat), 9) AS south, round(max(lon), 9) AS east, round(max(lat), 9) AS north FROM m4 GROUP BY id", "place"))
def fn_acq_bounds(spark, d):
    boxes = fx.place(spark, d).select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 0.05).alias("east"), (F.col("lat") + 0.03).alias("north"))
    return graph.acquisition_bounds(boxes, "id").select("id", *[_round(F.col(c), 9).alias(c) for c in ("west", "south", "east", "north")])


@BOOK.add(fx.sql("SELECT id, round(lon * 82000, 6) AS x, round(lat * 111000, 6) AS y FROM place", "place"))
def fn_meter_scale(spark, d):
    p = fx.place(spark, d)
    x, y = geo.scaled(p.lon, p.lat)
    return p.select("id", _round(x).alias("x"), _round(y).alias("y"))


@BOOK.add("SELECT o_orderkey AS id, round(exp(-(o_orderkey % 1500) / 120.0::DOUBLE), 9) AS k FROM orders")
def fn_kernel_exp(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), _round(geo.kernel({"type": "exponential", "lambda_m": 120.0})(F.col("o_orderkey") % 1500), 9).alias("k"))


@BOOK.add("SELECT o_orderkey AS id, round(pow(1 + (o_orderkey % 1500) / 50.0::DOUBLE, -2.0::DOUBLE), 9) AS k FROM orders")
def fn_kernel_pow(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), _round(geo.kernel({"type": "power", "p": 2.0, "d0_m": 50.0})(F.col("o_orderkey") % 1500), 9).alias("k"))


@BOOK.add("SELECT o_orderkey AS id, round(least(greatest(ln(1 + (o_orderkey % 400) / 10.0::DOUBLE) / ln(31.0::DOUBLE), 0.0), 1.0), 9) AS v FROM orders")
def fn_display(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _round(geo.display(F.col("o_orderkey") % 400 / 10.0), 9).alias("v"))


_STOPS = {c: "[" + ", ".join(f"{p[k]}.0::DOUBLE" for p in geo.PALETTE) + "]" for k, c in enumerate("rgb")}
COLOUR_SQL = ", ".join(f"CASE WHEN v IS NULL THEN 0 ELSE CAST(trunc({s}[lo + 1] * (1 - (v * 6 - lo)) + {s}[lo + 2] * (v * 6 - lo)) AS INTEGER) END AS {c}" for c, s in _STOPS.items()) + ", CASE WHEN v IS NULL THEN 0 ELSE 210 END AS a"


@BOOK.add(f"WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 384) / 384.0::DOUBLE END AS v FROM orders), t AS (SELECT id, v, CAST(least(floor(v * 6), 5) AS INTEGER) AS lo FROM s) SELECT id, {COLOUR_SQL} FROM t")
def fn_colorize(spark, d):
    v = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 384 / 384.0)
    r, g, b, a = geo.colour(F.col("v"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v")).select("id", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


_TX, _TY = "(lon + 180) / 360 * 16384.0::DOUBLE", "(1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384.0::DOUBLE"


@BOOK.add(fx.sql(f"SELECT id, round({_TX}, 6) AS x, round({_TY}, 6) AS y FROM place", "place"))
def fn_tile_coord(spark, d):
    p = fx.place(spark, d)
    x, y = geo.tile_coordinate(p.lon, p.lat, 14)
    return p.select("id", _round(x).alias("x"), _round(y).alias("y"))


@BOOK.add(fx.sql(f"SELECT id, CAST(trunc({_TX}) AS BIGINT) AS x, CAST(trunc({_TY}) AS BIGINT) AS y FROM place", "place"))
def fn_tile_at(spark, d):
    p = fx.place(spark, d)
    x, y = geo.tile_at(p.lon, p.lat, 14)
    return p.select("id", x.alias("x"), y.alias("y"))


@BOOK.add("SELECT o_orderkey AS id, round((4800 + (o_orderkey % 256 + 0.5::DOUBLE) / 256) / 16384.0::DOUBLE * 360 - 180, 9) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (6000 + (o_orderkey // 256 % 256 + 0.5::DOUBLE) / 256) / 16384.0::DOUBLE)))), 9) AS lat FROM orders")
def fn_tile_pixel(spark, d):
    k = F.col("o_orderkey")
    lon, lat = geo.pixel_centre(F.lit(4800), F.lit(6000), k % 256, F.floor(k / 256) % 256, 14)
    return fx.table(spark, d, "orders").select(k.alias("id"), _round(lon, 9).alias("lon"), _round(lat, 9).alias("lat"))


@BOOK.add(fx.sql("SELECT k, CAST(floor((y - 500) / 25) AS BIGINT) AS row, CAST(floor((x - 250) / 25) AS BIGINT) AS col, floor((y - 500) / 25) BETWEEN 0 AND 99 AND floor((x - 250) / 25) BETWEEN 0 AND 99 AS inside FROM poi", "poi"))
def fn_cell_of(spark, d):
    row, col = geo.cell_of(F.col("x"), F.col("y"), 250.0, 500.0)
    return fx.poi(spark, d).select("k", row.alias("row"), col.alias("col"), (row.between(0, 99) & col.between(0, 99)).alias("inside"))


_EDGES = "SELECT id AS e, CAST(id AS DOUBLE) AS ax, 0.0::DOUBLE AS ay, id + 60.0::DOUBLE AS bx, 80.0::DOUBLE AS by, 12.5::DOUBLE + id % 200 * 2.5 AS len FROM node"


def _edges(spark, d):
    i = F.col("id")
    return fx.node(spark, d).select(i.alias("e"), i.cast("double").alias("ax"), F.lit(0.0).alias("ay"), (i + 60.0).alias("bx"), F.lit(80.0).alias("by"), (12.5 + i % 200 * 2.5).alias("len"))


@BOOK.add(fx.sql(f"WITH e AS ({_EDGES}), n AS (SELECT *, greatest(1, CAST(round_even(len / 10, 0) AS INTEGER)) AS n FROM e), s AS (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS i FROM n) SELECT e, i, round(ax + (bx - ax) * i / n, 6) AS x1, round(ay + (by - ay) * i / n, 6) AS y1, round(ax + (bx - ax) * (i + 1) / n, 6) AS x2, round(ay + (by - ay) * (i + 1) / n, 6) AS y2, round(len * i / n, 6) AS start_dist, round(len * (i + 1) / n, 6) AS end_dist FROM s", "node"))
def fn_segment_edge(spark, d):
    s = graph.segment_edges(_edges(spark, d), 10.0)
    return s.select("e", "i", *[_round(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2", "start_dist", "end_dist")])


@BOOK.add(fx.sql("WITH w AS (SELECT way_id, refs, unnest(range(len(refs) - 1)) AS s FROM way), p AS (SELECT way_id, s, refs[s + 1] AS a, refs[s + 2] AS b FROM w), g AS (SELECT p.*, na.x AS ax, na.y AS ay, nb.x AS bx, nb.y AS by, sqrt((nb.x - na.x) ** 2 + (nb.y - na.y) ** 2) AS len FROM p JOIN node na ON na.id = a JOIN node nb ON nb.id = b), n AS (SELECT *, greatest(1, CAST(ceil(len / 25) AS INTEGER)) AS n FROM g), q AS (SELECT *, CAST(unnest(range(n + 1)) AS INTEGER) AS j FROM n) SELECT way_id, s AS seg, j, CASE WHEN j = 0 THEN 'n' || a WHEN j = n THEN 'n' || b ELSE 'e' || least(a, b) || ':' || greatest(a, b) || ':' || CASE WHEN a < b THEN j ELSE n - j END END AS k, round(ax + (bx - ax) * j / n, 6) AS x, round(ay + (by - ay) * j / n, 6) AS y, format('{:012d}:{:06d}:{:06d}', way_id, s, j) AS rank FROM q", "way"))
def fn_subdivide(spark, d):
    pairs = graph.located_pairs(graph.adjacent_pairs(fx.way(spark, d)), fx.node(spark, d))
    return graph.subdivide(pairs).select("way_id", F.col("seg").cast("long").alias("seg"), "j", "k", _round(F.col("x")).alias("x"), _round(F.col("y")).alias("y"), "rank")


@BOOK.add(fx.sql(f"WITH e AS ({_EDGES}), n AS (SELECT *, CASE WHEN len > 20 THEN CAST(floor(len / 20) AS INTEGER) ELSE 0 END AS n FROM e), t AS (SELECT e, 0.0::DOUBLE AS t, ax, ay, bx, by FROM n UNION ALL SELECT e, 1.0::DOUBLE, ax, ay, bx, by FROM n UNION ALL SELECT e, i / n::DOUBLE, ax, ay, bx, by FROM (SELECT *, unnest(range(1, n)) AS i FROM n WHERE n > 1)) SELECT e, round(t, 9) AS t, round(ax + t * (bx - ax), 6) AS x, round(ay + t * (by - ay), 6) AS y FROM t", "node"))
def fn_edge_samples(spark, d):
    s = graph.edge_samples(_edges(spark, d), 20.0)
    return s.select("e", _round(F.col("t"), 9).alias("t"), _round(F.col("x")).alias("x"), _round(F.col("y")).alias("y"))


@BOOK.add(fx.sql("SELECT way_id, round((min(x) + max(x)) / 2, 6) AS x, round((min(y) + max(y)) / 2, 6) AS y FROM (SELECT way_id, unnest(refs) AS id FROM way) JOIN node USING (id) GROUP BY way_id", "way"))
def fn_bounds_center(spark, d):
    at = fx.way(spark, d).select("way_id", F.explode("refs").alias("id")).join(fx.node(spark, d), "id")
    return at.groupBy("way_id").agg(_round((F.min("x") + F.max("x")) / 2).alias("x"), _round((F.min("y") + F.max("y")) / 2).alias("y"))


@BOOK.add("SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS q, format('{:012d}:{:06d}:{:06d}', l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER)) AS k FROM lineitem")
def fn_pos_key(spark, d):
    q = F.col("l_quantity").cast("int")
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l"), q.cast("long").alias("q"), geo.position_key(F.col("l_orderkey"), F.col("l_linenumber"), q).alias("k"))


# ---- tag rules

PERMITTED_SQL = "(coalesce(foot, '') IN ('yes', 'designated', 'permissive') OR (coalesce(foot, '') NOT IN ('no', 'private', 'use_sidepath') AND coalesce(access, '') NOT IN ('no', 'private')))"
WALK_SQL = "(" + ", ".join(f"'{x}'" for x in predicates.WALKABLE) + ")"


@BOOK.add(fx.sql(f"SELECT o, l, {PERMITTED_SQL} AS ok FROM tagged", "tagged"))
def flt_permitted(spark, d):
    return fx.tagged(spark, d).select("o", "l", predicates.permitted(predicates.in_map("tags")).alias("ok"))


@BOOK.add(fx.sql(f"SELECT o, l FROM tagged WHERE {PERMITTED_SQL} AND (coalesce(highway IN {WALK_SQL}, false) OR (highway IS NOT NULL AND coalesce(foot, '') IN ('yes', 'designated', 'permissive')))", "tagged"))
def flt_walking(spark, d):
    return fx.tagged(spark, d).where(predicates.walking(predicates.in_map("tags"))).select("o", "l")


ALLOW, DENY = {"shop": ["*"], "highway": ["steps", "path"]}, {"shop": ["vacant"], "access": ["private"]}


@BOOK.add(fx.sql("SELECT o, l FROM tagged WHERE (shop IS NOT NULL OR coalesce(highway IN ('steps', 'path'), false)) AND NOT (coalesce(shop = 'vacant', false) OR coalesce(access = 'private', false))", "tagged"))
def flt_poi_v2(spark, d):
    return fx.tagged(spark, d).where(predicates.destination(predicates.in_map("tags"), ALLOW, DENY)).select("o", "l")


@BOOK.add("SELECT p_partkey AS k FROM part WHERE (p_type IN ('ECONOMY', 'PROMO', 'STANDARD') OR p_name IS NOT NULL AND false) AND NOT coalesce(p_brand IN ('Brand#4', 'Brand#8'), false)")
def flt_poi_v1(spark, d):
    part = fx.table(spark, d, "part")
    rule = predicates.destination(F.col, {"p_type": list(fx.KINDS), "tourism": ["museum"]}, {"p_brand": list(fx.EXCLUDED), "landuse": ["industrial"]}, star_alone=True, present=set(part.columns))
    return part.where(rule).select(F.col("p_partkey").alias("k"))


@BOOK.add(fx.sql("SELECT o, l FROM tagged WHERE coalesce(access <> 'no', true)", "tagged"))
def flt_access_no(spark, d):
    return fx.tagged(spark, d).where(predicates.access_allowed(predicates.in_map("tags"))).select("o", "l")


@BOOK.add(fx.sql("SELECT u, v FROM edge JOIN node a ON a.id = u JOIN node b ON b.id = v WHERE a.x BETWEEN 500 AND 1500 AND a.y BETWEEN 200 AND 900 AND b.x BETWEEN 500 AND 1500 AND b.y BETWEEN 200 AND 900", "edge"))
def flt_bbox(spark, d):
    return graph.inside_box(fx.node(spark, d), fx.edge(spark, d), 500, 200, 1500, 900)[1].select("u", "v")


@BOOK.add(fx.sql("SELECT u, v FROM edge WHERE u % 13 <> 5 AND v % 13 <> 5", "edge"))
def flt_blocked(spark, d):
    return graph.without_nodes(fx.edge(spark, d), fx.node(spark, d).where("id % 13 = 5").select("id")).select("u", "v")


@BOOK.add(fx.sql("SELECT k, CASE WHEN x BETWEEN 1000 AND 3000 AND y BETWEEN 100 AND 700 THEN x + y END AS v FROM poi", "poi"))
def flt_tile_clip(spark, d):
    return fx.poi(spark, d).select("k", F.when(F.col("x").between(1000, 3000) & F.col("y").between(100, 700), F.col("x") + F.col("y")).alias("v"))


@BOOK.add(fx.sql("SELECT k, least(x % 2000, 2000 - x % 2000) <= 40 OR least(y % 2000, 2000 - y % 2000) <= 40 AS near FROM poi", "poi"))
def min_seam_mask(spark, d):
    near = lambda c: F.least(F.pmod(c, F.lit(2000.0)), 2000 - F.pmod(c, F.lit(2000.0))) <= 40
    return fx.poi(spark, d).select("k", (near(F.col("x")) | near(F.col("y"))).alias("near"))


@BOOK.add(fx.sql(f"{FORWARD}, q AS (SELECT id % 40 AS g, id, round({EAST}, 3) AS x, round({NORTH}, 3) AS y FROM b) SELECT g, list(x ORDER BY id) AS xs, list(y ORDER BY id) AS ys FROM q GROUP BY g", "place"))
def geo_reproject(spark, d):
    g = fx.place(spark, d).groupBy((F.col("id") % 40).alias("g")).agg(F.sort_array(F.collect_list(F.struct("id", "lon", "lat"))).alias("ps"))
    axis = lambda k: F.transform("ps", lambda p: F.round(geo.project(p["lon"], p["lat"])[k], 3))
    return g.select("g", axis(0).alias("xs"), axis(1).alias("ys"))
