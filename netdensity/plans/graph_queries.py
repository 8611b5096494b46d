"""Joins, aggregates, graphs, paths and scores over the lattice world."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.functions import geo
from netdensity.operators import graph, score, spatial, sssp
from netdensity.plans import fixtures as fx
from netdensity.plans.book import Book
from netdensity.session import materialize, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

# ---- distance joins

EUCLID = "WITH b AS (SELECT g.ci, g.ri, p.k, sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2) AS d FROM grid g JOIN (SELECT *, floor(x / 800) AS bx, floor(y / 800) AS by FROM poi) p ON p.bx BETWEEN floor(g.x / 800) - 1 AND floor(g.x / 800) + 1 AND p.by BETWEEN floor(g.y / 800) - 1 AND floor(g.y / 800) + 1)"


@BOOK.add(fx.sql(f"{EUCLID} SELECT g.ci, g.ri, round(coalesce(sum(CASE WHEN d <= 800 THEN exp(-d / 120.0::DOUBLE) END), 0), 6) AS score FROM grid g LEFT JOIN b USING (ci, ri) GROUP BY 1, 2", "grid", "poi"))
def score_euclid(spark, d):
    return score.euclid(fx.grid(spark, d), fx.poi(spark, d), ["ci", "ri"]).select("ci", "ri", F.round("score", 6).alias("score"))


@BOOK.add(fx.sql("SELECT a.k, b.k AS other, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM poi a JOIN poi b ON a.k <> b.k AND abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 120 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 120", "poi"))
def join_radius(spark, d):
    p = fx.poi(spark, d)
    near = spatial.within(p, p.select(F.col("k").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry")), 120.0)
    return near.where("k <> other").select("k", "other", F.round("d", 6).alias("d"))


@BOOK.add(fx.sql("SELECT a.k, round(sum(exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 120.0::DOUBLE)), 6) AS score FROM poi a JOIN poi b ON abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 300 GROUP BY a.k", "poi"))
def join_radius_sum(spark, d):
    p = fx.poi(spark, d)
    return score.euclid(p, p, ["k"], radius=300.0).select("k", F.round("score", 6).alias("score"))


SNAP_SQL = "SELECT p.k, min(struct_pack(r := round(sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2), 9), node := n.id, d := sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2))) AS m FROM {points} p JOIN (SELECT *, floor(x / 75) AS bx, floor(y / 75) AS by FROM node) n ON n.bx BETWEEN floor(p.x / 75) - 1 AND floor(p.x / 75) + 1 AND n.by BETWEEN floor(p.y / 75) - 1 AND floor(p.y / 75) + 1 WHERE sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) <= 75 GROUP BY p.k"


@BOOK.add(fx.sql("WITH s AS (" + SNAP_SQL.format(points="poi") + ") SELECT k, m.node AS node, round(m.d, 6) AS d FROM s", "node", "poi"))
def join_nn_snap(spark, d):
    return spatial.snap(fx.poi(spark, d), fx.node(spark, d), "k", geo.SNAP).select("k", "node", F.round("d", 6).alias("d"))


@BOOK.add(fx.sql("SELECT id AS k, (SELECT min(struct_pack(r := round(sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2), 9), node := n.k)).node FROM poi n) AS node FROM (SELECT s_suppkey AS id, s_suppkey * 7001 % 9000 * 1.0::DOUBLE AS x, s_suppkey * 3001 % 9000 * 1.0::DOUBLE AS y FROM supplier) p", "poi"))
def join_nn_node_v1(spark, d):
    at = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7001 % 9000).cast("double").alias("x"), (F.col("s_suppkey") * 3001 % 9000).cast("double").alias("y"))
    return spatial.nearest(at, fx.poi(spark, d).withColumnRenamed("k", "id"), "k", 200.0).select("k", "node")


_EDGE_XY = "WITH e AS (SELECT u * 1000000 + v AS e, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM edge1 JOIN node a ON a.id = u JOIN node b ON b.id = v)"


def edge_lines(spark, d):
    n = fx.node(spark, d)
    one = fx.edge(spark, d).where("u < v")
    a, b = n.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return one.join(a, "u").join(b, "v").withColumn("e", F.col("u") * 1000000 + F.col("v"))


_SNAP_EDGE = f"{_EDGE_XY}, c AS (SELECT k, e, CASE WHEN ay = by THEN least(greatest((x - ax) / 50, 0), 1) ELSE least(greatest((y - ay) / 50, 0), 1) END AS t, x, y, ax, ay, bx, by FROM poi JOIN e ON abs(x - (ax + bx) / 2) <= 150 AND abs(y - (ay + by) / 2) <= 150), f AS (SELECT k, e, t * 50 AS along, sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (by - ay))) ** 2) AS d FROM c), g AS (SELECT k, min(struct_pack(d := d, e := e, along := along)) AS m FROM f WHERE d <= 75 GROUP BY k)"


@BOOK.add(fx.sql(f"{_SNAP_EDGE} SELECT k, m.e AS e, round(m.d, 6) AS d, round(m.along, 6) AS along FROM g", "edge", "poi"))
def join_nn_edge(spark, d):
    s = spatial.snap_to_edges(fx.poi(spark, d), edge_lines(spark, d), "k", 75.0, 50.0)
    return s.select("k", "e", F.round("d", 6).alias("d"), F.round("along", 6).alias("along"))


SAMPLES_SQL = f"{_EDGE_XY}, s AS (SELECT ax + t.t * (bx - ax) AS sx, ay + t.t * (by - ay) AS sy FROM e, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS t(t)), g AS (SELECT DISTINCT *, floor(sx / 100) AS bx, floor(sy / 100) AS by FROM s)"


@BOOK.add(fx.sql(f"{SAMPLES_SQL} SELECT k, round(min(sqrt((x - sx) ** 2 + (y - sy) ** 2)), 6) AS d FROM poi JOIN g ON g.bx BETWEEN floor(x / 100) - 1 AND floor(x / 100) + 1 AND g.by BETWEEN floor(y / 100) - 1 AND floor(y / 100) + 1 WHERE sqrt((x - sx) ** 2 + (y - sy) ** 2) <= 100 GROUP BY k", "edge", "poi"))
def join_nn_sample(spark, d):
    samples = graph.edge_samples(edge_lines(spark, d).withColumn("len", F.lit(50.0)), 20.0).select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    return spatial.within(fx.poi(spark, d).select("k", "x", "y"), samples, 100.0).groupBy("k").agg(F.round(F.min("d"), 6).alias("d"))


@BOOK.add(fx.sql(f"{SAMPLES_SQL} SELECT k FROM poi WHERE EXISTS (SELECT 1 FROM g WHERE g.bx BETWEEN floor(x / 100) - 1 AND floor(x / 100) + 1 AND g.by BETWEEN floor(y / 100) - 1 AND floor(y / 100) + 1 AND sqrt((x - sx) ** 2 + (y - sy) ** 2) <= 20)", "edge", "poi"))
def flt_reachable(spark, d):
    samples = graph.edge_samples(edge_lines(spark, d).withColumn("len", F.lit(50.0)), 20.0).select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    return spatial.within(fx.poi(spark, d).select("k", "x", "y"), samples, 20.0).select("k").distinct()


# ---- equality, semi and anti joins


@BOOK.add(fx.sql("SELECT a.id AS a, b.id AS b, w AS length FROM edge JOIN node a ON a.id = u JOIN node b ON b.id = v", "edge"))
def join_edge_vertex(spark, d):
    n = fx.node(spark, d).select("id")
    return fx.edge(spark, d).join(n.withColumnRenamed("id", "u"), "u").join(n.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("length"))


@BOOK.add(fx.sql("SELECT u, v FROM edge WHERE u IN (SELECT id FROM node WHERE (x + y) % 300 < 200) AND v IN (SELECT id FROM node WHERE (x + y) % 300 < 200)", "edge"))
def join_selected_edges(spark, d):
    return graph.with_ends(fx.edge(spark, d), fx.node(spark, d).where("(x + y) % 300 < 200").select("id")).select("u", "v")


@BOOK.add(fx.sql("SELECT id, x, y FROM node WHERE x BETWEEN 1000 AND 2200 AND y BETWEEN 300 AND 1200", "node"))
def join_rtree(spark, d):
    return fx.node(spark, d).where("x between 1000 and 2200 and y between 300 and 1200").select("id", "x", "y")


@BOOK.add(fx.sql("SELECT p_partkey AS k, n.x, n.y, n.id IS NOT NULL AS found FROM part LEFT JOIN node n ON n.id = p_partkey * 3", "node"))
def join_coord_lookup(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    n = fx.node(spark, d)
    return p.join(n, n.id == p.k * 3, "left").select("k", "x", "y", n.id.isNotNull().alias("found"))


@BOOK.add(fx.sql("SELECT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_partkey IN (SELECT k FROM poi)", "poi"))
def join_in_sorted(spark, d):
    li, p = table(spark, d, "lineitem"), fx.poi(spark, d).select("k")
    return li.join(p, li.l_partkey == p.k, "left_semi").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))


BLOCKS_SQL = "SELECT id // 500 AS block, min(id) AS low, max(id) AS high FROM node GROUP BY 1"


@BOOK.add(fx.sql(f"WITH b AS ({BLOCKS_SQL}) SELECT p_partkey AS k, b.block FROM part LEFT JOIN b ON p_partkey * 5 BETWEEN low AND high", "node"))
def join_block_offset(spark, d):
    blocks = src_blocks(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 5).alias("id"))
    # Ranges are disjoint and sorted: each id meets the block that its own range number names, then the exact bounds.
    return p.join(blocks, (F.floor(p.id / 500) == blocks.block) & p.id.between(blocks.low, blocks.high), "left").select("k", "block")


def src_blocks(spark, d):
    return fx.node(spark, d).groupBy(F.floor(F.col("id") / 500).alias("block")).agg(F.min("id").alias("low"), F.max("id").alias("high"))


@BOOK.add(fx.sql("SELECT DISTINCT way_id FROM (SELECT way_id, unnest(refs) AS id FROM way) WHERE id IN (SELECT p_partkey * 7 FROM part)", "way"))
def join_way_refs(spark, d):
    wanted = table(spark, d, "part").select((F.col("p_partkey") * 7).alias("id"))
    return fx.way(spark, d).select("way_id", F.explode("refs").alias("id")).join(wanted, "id", "left_semi").select("way_id").distinct()


@BOOK.add(fx.sql("SELECT a.region, a.row, a.col FROM raster a JOIN raster b ON a.region = 0 AND b.region = 1 AND a.row = b.row AND a.col = b.col WHERE a.score + 0.5 IS DISTINCT FROM b.score", "raster"))
def join_known_bounds(spark, d):
    r = fx.raster(spark, d)
    a, b = r.where("region = 0"), r.where("region = 1").select("row", "col", F.col("score").alias("other"))
    return a.join(b, ["row", "col"]).where(~(F.col("score") + 0.5).eqNullSafe(F.col("other"))).select("region", "row", "col")


@BOOK.add("SELECT coalesce(a.p_name, b.p_name) AS name, a.n AS before, b.n AS after FROM (SELECT p_name, count(*) AS n FROM part WHERE p_size < 40 GROUP BY 1) a FULL JOIN (SELECT p_name, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1) b ON a.p_name = b.p_name WHERE a.n IS DISTINCT FROM b.n")
def join_inventory(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 40").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("before"))
    b = p.where("p_size > 10").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("after"))
    return a.join(b, "name", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("name", "before", "after")


@BOOK.add(fx.sql("SELECT o, l FROM tagged WHERE coalesce(access = 'private', false) AND shop IS NOT NULL AND o IN (SELECT id FROM node)", "tagged", "node"))
def anti_access_audit(spark, d):
    t = fx.tagged(spark, d).where("coalesce(try_element_at(tags, 'access') = 'private', false) and try_element_at(tags, 'shop') is not null")
    n = fx.node(spark, d).select("id")
    return t.join(n, t.o == n.id, "left_semi").select("o", "l")


# ---- aggregates


@BOOK.add("SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, min(l_quantity) AS length FROM lineitem GROUP BY 1, 2")
def agg_edge_min(spark, d):
    return graph.shortest_parallel(table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_quantity").alias("length")))


@BOOK.add("SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, max(struct_pack(a := l_orderkey * 10 + l_linenumber, b := l_quantity)).b AS length FROM lineitem GROUP BY 1, 2")
def agg_edge_last_v1(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v")).agg(F.max(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_quantity"))["l_quantity"].alias("length"))


@BOOK.add("SELECT l_partkey AS k, min(struct_pack(a := l_orderkey * 10 + l_linenumber, b := l_quantity, c := l_tax)).b AS x, min(struct_pack(a := l_orderkey * 10 + l_linenumber, b := l_quantity, c := l_tax)).c AS y, CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) AS rank FROM lineitem GROUP BY 1")
def agg_vertex_minrank(spark, d):
    return graph.vertices(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank")))


@BOOK.add(fx.sql("SELECT node, count(*) AS degree, count(*) > 2 AS crossing FROM (SELECT u AS node FROM edge1 UNION ALL SELECT v FROM edge1) GROUP BY node", "edge"))
def agg_degree(spark, d):
    return graph.degree(fx.edge(spark, d).where("u < v")).withColumn("crossing", F.col("degree") > 2)


_LABELS = "WITH RECURSIVE l(id, root) USING KEY (id) AS (SELECT id, id FROM node UNION SELECT e.v, min(l.root) FROM l JOIN edge e ON e.u = l.id JOIN recurring.l AS k ON k.id = e.v WHERE l.root < k.root GROUP BY e.v)"


@BOOK.add(fx.sql(f"{_LABELS} SELECT id, root FROM l", "edge"))
def graph_components(spark, d):
    return graph.component_labels(fx.node(spark, d), fx.edge(spark, d))


@BOOK.add(fx.sql(f"{_LABELS} SELECT id FROM l WHERE root = (SELECT root FROM l GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)", "edge"))
def agg_component(spark, d):
    return graph.largest_component(fx.node(spark, d), fx.edge(spark, d))


_LEAVES = "leaf AS (SELECT 'c' || c_custkey AS ref, c_custkey % 100 * 1.0::DOUBLE AS x, c_custkey % 37 * 1.0::DOUBLE AS y FROM customer WHERE c_custkey % 5 <> 0)"


def leaves(spark, d):
    """The members that are known; every fifth customer is missing, for the checks of completeness."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("c"), k).alias("ref"), (k % 100).cast("double").alias("x"), (k % 37).cast("double").alias("y"))


@BOOK.add(fx.sql(f"WITH {_LEAVES}, one AS (SELECT rid, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n, bool_and(x IS NOT NULL) AS ok FROM relation LEFT JOIN leaf USING (ref) GROUP BY rid), lvl AS (SELECT * FROM one WHERE ok), two AS (SELECT rid, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n, bool_and(w IS NOT NULL) AS ok FROM (SELECT r.rid, coalesce(leaf.x, lvl.w) AS w, coalesce(leaf.y, lvl.s) AS s, coalesce(leaf.x, lvl.e) AS e, coalesce(leaf.y, lvl.n) AS n FROM relation r LEFT JOIN leaf USING (ref) LEFT JOIN lvl ON lvl.rid = r.ref) GROUP BY rid) SELECT rid, CASE WHEN ok THEN w END AS west, CASE WHEN ok THEN s END AS south, CASE WHEN ok THEN e END AS east, CASE WHEN ok THEN n END AS north, ok AS complete FROM two", "relation"))
def agg_bbox(spark, d):
    return graph.member_bounds(fx.relation(spark, d), leaves(spark, d))


@BOOK.add(fx.sql("SELECT round(sum(w) / 1000, 6) AS km FROM edge WHERE u < v", "edge"))
def agg_network_km(spark, d):
    return fx.edge(spark, d).where("u < v").agg(F.round(F.sum("w") / 1000, 6).alias("km"))


@BOOK.add("SELECT p_type AS tag, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, tag LIMIT 5")
def agg_tag_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)


# ---- graphs and closures


@BOOK.add(fx.sql("SELECT u, v, w FROM edge", "edge"))
def graph_matrix(spark, d):
    return graph.both_ways(fx.edge(spark, d).where("u < v"))


@BOOK.add(fx.sql("SELECT way_id, CAST(s - 1 AS INTEGER) AS seg, refs[s] AS a, refs[s + 1] AS b FROM (SELECT way_id, refs, unnest(range(1, len(refs))) AS s FROM way)", "way"))
def win_adjacent_pairs(spark, d):
    return graph.adjacent_pairs(fx.way(spark, d))


@BOOK.add(fx.sql("WITH p AS (SELECT way_id, s, refs[s] AS a, refs[s + 1] AS b FROM (SELECT way_id, refs, unnest(range(1, len(refs))) AS s FROM way)), n AS (SELECT *, (b - a) * 2 AS n FROM p), q AS (SELECT *, unnest(range(n)) AS j FROM n), k AS (SELECT CASE WHEN j = 0 THEN 'n' || a ELSE 'e' || a || ':' || b || ':' || j END AS u, CASE WHEN j + 1 = n THEN 'n' || b ELSE 'e' || a || ':' || b || ':' || (j + 1) END AS v FROM q) SELECT least(u, v) AS u, greatest(u, v) AS v, 25.0::DOUBLE AS length FROM k", "way"))
def graph_build_v2(spark, d):
    return graph.build(fx.node(spark, d), fx.way(spark, d))[1]


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS length, [struct_pack(x := l_partkey % 30 * 1.0::DOUBLE, y := 0.0::DOUBLE), struct_pack(x := 1.0::DOUBLE, y := l_tax), struct_pack(x := l_suppkey % 30 * 1.0::DOUBLE, y := 1.0::DOUBLE)] AS c FROM lineitem"


@BOOK.add(f"WITH l AS ({_LINES}), w AS (SELECT ord, least(c[1], c[3]) AS u, greatest(c[1], c[3]) AS v, coalesce(length, (sqrt((c[2].x - c[1].x) ** 2 + (c[2].y - c[1].y) ** 2) + sqrt((c[3].x - c[2].x) ** 2 + (c[3].y - c[2].y) ** 2)) * 111320) AS weight FROM l) SELECT u.x AS ux, u.y AS uy, v.x AS vx, v.y AS vy, round(max(struct_pack(a := ord, b := weight)).b, 4) AS weight FROM w GROUP BY u, v")
def graph_build_v1(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("length"), F.array(point(F.col("l_partkey") % 30, F.lit(0)), point(F.lit(1), F.col("l_tax")), point(F.col("l_suppkey") % 30, F.lit(1))).alias("coords"))
    return graph.build_from_lines(li).select(F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.round("weight", 4).alias("weight"))


@BOOK.add(fx.sql("WITH RECURSIVE c(id, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 2 UNION SELECT ref, depth + 1 FROM c JOIN relation ON rid = id) SELECT id, min(depth) AS depth FROM c GROUP BY id", "relation"))
def graph_rel_closure_down(spark, d):
    roots = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"))
    return graph.closure(fx.relation(spark, d), roots)


@BOOK.add(fx.sql("WITH RECURSIVE c(id, depth) AS (SELECT 'c' || c_custkey, 0 FROM customer UNION SELECT rid, depth + 1 FROM c JOIN relation ON ref = id) SELECT id, min(depth) AS depth FROM c GROUP BY id", "relation"))
def graph_rel_closure_up(spark, d):
    roots = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    return graph.closure(fx.relation(spark, d), roots, up=True)


@BOOK.add(fx.sql(f"WITH RECURSIVE {_LEAVES}, c(id) AS (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT ref FROM c JOIN relation ON rid = id) SELECT id, CASE WHEN id IN (SELECT rid FROM relation) THEN 'relation' WHEN id IN (SELECT ref FROM leaf) THEN 'leaf' ELSE 'missing' END AS kind FROM c", "relation"))
def graph_rel_extract(spark, d):
    """The closure of some relations, with what each member is."""
    roots = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"))
    rel = fx.relation(spark, d)
    found = graph.closure(rel, roots).select("id")
    rids, refs = rel.select(F.col("rid").alias("__r")).distinct(), leaves(spark, d).select(F.col("ref").alias("__l"))
    joined = found.join(rids, F.col("id") == F.col("__r"), "left").join(refs, F.col("id") == F.col("__l"), "left")
    return joined.select("id", F.when(F.col("__r").isNotNull(), "relation").when(F.col("__l").isNotNull(), "leaf").otherwise("missing").alias("kind"))


@BOOK.add(fx.sql(f"WITH {_LEAVES} SELECT DISTINCT ref FROM relation WHERE ref NOT IN (SELECT rid FROM relation) AND ref NOT IN (SELECT ref FROM leaf)", "relation"))
def graph_rel_complete(spark, d):
    rel = fx.relation(spark, d)
    known = rel.select(F.col("rid").alias("k")).union(leaves(spark, d).select("ref"))
    return rel.join(known, rel.ref == F.col("k"), "left_anti").select("ref").distinct()


@BOOK.add(fx.sql("SELECT rid, count(*) AS members, count(DISTINCT ref) AS refs, CAST(count(*) FILTER (WHERE ref LIKE 'n%') AS BIGINT) AS nested, bool_or(ref = rid) AS cyclic FROM relation GROUP BY rid", "relation"))
def graph_rel_audit(spark, d):
    return fx.relation(spark, d).groupBy("rid").agg(F.count("*").alias("members"), F.count_distinct("ref").alias("refs"), F.count_if(F.col("ref").startswith("n")).alias("nested"), F.bool_or(F.col("ref") == F.col("rid")).alias("cyclic"))


# ---- paths and network scores

GRID_SNAP = "qs AS (" + SNAP_SQL.format(points="(SELECT ri * 200 + ci AS k, x, y FROM grid)") + ")"
POI_SNAP = "ps AS (" + SNAP_SQL.format(points="poi") + ")"
PATHS = "r(src, node, d) AS (SELECT DISTINCT m.node, m.node, 0 FROM ps UNION SELECT r.src, e.v, r.d + 50 FROM r JOIN edge e ON e.u = r.node WHERE r.d + 50 <= 800), sp AS (SELECT src, node, min(d) AS d FROM r GROUP BY 1, 2)"


def poi_snap(spark, d):
    return materialize(spatial.snap(fx.poi(spark, d), fx.node(spark, d), "k", geo.SNAP))


def grid_snap(spark, d):
    q = fx.grid(spark, d).select((F.col("ri") * 200 + F.col("ci")).cast("long").alias("k"), "x", "y")
    return spatial.snap(q, fx.node(spark, d), "k", geo.SNAP)


def poi_paths(spark, d, snapped, how=sssp.halo):
    src = snapped.select(F.col("node").alias("id")).distinct()
    n, e = fx.node(spark, d), fx.edge(spark, d)
    return how(src, n, e, geo.RADIUS) if how is sssp.halo else how(src, e, geo.RADIUS)


@BOOK.add(fx.sql(f"WITH RECURSIVE {POI_SNAP}, {PATHS} SELECT src, node, CAST(d AS DOUBLE) AS d FROM sp", "edge", "poi"))
def graph_dijkstra_v1(spark, d):
    return poi_paths(spark, d, poi_snap(spark, d))


@BOOK.add(fx.sql(f"WITH RECURSIVE {POI_SNAP}, {PATHS} SELECT src, node, CAST(d AS DOUBLE) AS d FROM sp", "edge", "poi"))
def graph_dijkstra_v2(spark, d):
    return poi_paths(spark, d, poi_snap(spark, d), sssp.frontier)


NET_SCORE = f"WITH RECURSIVE {POI_SNAP}, {GRID_SNAP}, {PATHS}, near AS (SELECT q.k AS qid, q.m.d + sp.d + p.m.d AS total FROM qs q JOIN sp ON sp.node = q.m.node JOIN ps p ON p.m.node = sp.src), s AS (SELECT qid, sum(exp(-total / 120.0::DOUBLE)) AS score FROM near WHERE total <= 800 GROUP BY 1)"


@BOOK.add(fx.sql(f"{NET_SCORE} SELECT CAST(q.k AS BIGINT) AS qid, round(coalesce(score, 0), 6) AS score FROM qs q LEFT JOIN s ON s.qid = q.k", "edge", "poi", "grid"))
def score_net_v2(spark, d):
    snapped = poi_snap(spark, d)
    return score.network(grid_snap(spark, d), snapped, poi_paths(spark, d, snapped), ["k"]).select(F.col("k").alias("qid"), F.round("score", 6).alias("score"))


@BOOK.add(fx.sql(f"{NET_SCORE} SELECT ri * 200 + ci AS qid, CASE WHEN q.k IS NOT NULL THEN round(coalesce(score, 0), 6) END AS score FROM grid LEFT JOIN qs q ON q.k = ri * 200 + ci LEFT JOIN s ON s.qid = q.k", "edge", "poi", "grid").replace("SELECT ri * 200 + ci AS qid, CASE", "SELECT CAST(ri * 200 + ci AS BIGINT) AS qid, CASE"))
def score_chunked(spark, d):
    q = fx.grid(spark, d).select((F.col("ri") * 200 + F.col("ci")).cast("long").alias("qid"), "x", "y")
    return score.chunked(fx.node(spark, d), fx.edge(spark, d), q, fx.poi(spark, d).withColumnRenamed("k", "pid")).select("qid", F.round("score", 6).alias("score"))


def forward_pairs(spark, d, snapped):
    """Paths from the queries' nodes rather than from the destinations'; edges run both ways, so lengths agree."""
    src = grid_snap(spark, d).select(F.col("node").alias("id")).distinct()
    found = sssp.halo(src, fx.node(spark, d), fx.edge(spark, d), geo.RADIUS)
    targets = snapped.select(F.col("node").alias("t")).distinct()
    return found.join(targets, found.node == targets.t, "left_semi").select(F.col("node").alias("src"), F.col("src").alias("node"), "d")


@BOOK.add(ORACLES["score_net_v2"])
def score_forward_oracle(spark, d):
    snapped = poi_snap(spark, d)
    return score.network(grid_snap(spark, d), snapped, forward_pairs(spark, d, snapped), ["k"]).select(F.col("k").alias("qid"), F.round("score", 6).alias("score"))


_V1 = f"WITH RECURSIVE {POI_SNAP}, {GRID_SNAP}, {PATHS}, t AS (SELECT DISTINCT m.node AS node, n.x, n.y FROM ps JOIN node n ON n.id = m.node), c AS (SELECT q.k AS qid, sp.d FROM qs q JOIN sp ON sp.node = q.m.node JOIN t ON t.node = sp.src JOIN grid g ON g.ri * 200 + g.ci = q.k WHERE sqrt((g.x - t.x) ** 2 + (g.y - t.y) ** 2) <= 800), s AS (SELECT qid, sum(exp(-d / 120.0::DOUBLE)) AS score FROM c GROUP BY 1)"


@BOOK.add(fx.sql(f"{_V1} SELECT CAST(ri * 200 + ci AS BIGINT) AS qid, round(coalesce(score, 0), 6) AS score FROM grid LEFT JOIN s ON s.qid = ri * 200 + ci", "edge", "poi", "grid"))
def score_net_v1(spark, d):
    snapped = poi_snap(spark, d)
    q = fx.grid(spark, d).select((F.col("ri") * 200 + F.col("ci")).cast("long").alias("qid"), "x", "y")
    nodes = fx.node(spark, d).join(snapped.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    return score.distinct_targets(q, grid_snap(spark, d).withColumnRenamed("k", "qid"), nodes, poi_paths(spark, d, snapped), ["qid"], geo.RADIUS).select("qid", F.round("score", 6).alias("score"))


@BOOK.add(fx.sql(NET_SCORE + ", part_s AS (SELECT qid, sum(exp(-total / 120.0::DOUBLE)) AS score FROM (SELECT q.k AS qid, q.m.d + sp.d + p.m.d AS total FROM qs q JOIN sp ON sp.node = q.m.node JOIN ps p ON p.m.node = sp.src JOIN poi o ON o.k = p.k WHERE o.x < 2500) WHERE total <= 800 GROUP BY 1) SELECT CAST(q.k AS BIGINT) AS qid, round(coalesce(s.score, 0) - coalesce(part_s.score, 0), 6) AS delta FROM qs q LEFT JOIN s ON s.qid = q.k LEFT JOIN part_s ON part_s.qid = q.k WHERE round(coalesce(s.score, 0) - coalesce(part_s.score, 0), 6) > 0", "edge", "poi", "grid"))
def score_border_delta(spark, d):
    """What destinations beyond a border add to each cell."""
    snapped = poi_snap(spark, d)
    inner = snapped.join(fx.poi(spark, d).where("x < 2500").select("k"), "k", "left_semi")
    q, paths = materialize(grid_snap(spark, d)), materialize(poi_paths(spark, d, snapped))
    full = score.network(q, snapped, paths, ["k"])
    part = score.network(q, inner, paths, ["k"]).withColumnRenamed("score", "own")
    delta = F.round(F.col("score") - F.col("own"), 6)
    return full.join(part, "k").select(F.col("k").alias("qid"), delta.alias("delta")).where("delta > 0")


CONFIGS = (("exp120", {"type": "exponential", "lambda_m": 120.0}), ("exp300", {"type": "exponential", "lambda_m": 300.0}), ("pow2", {"type": "power", "p": 2.0, "d0_m": 50.0}))


@BOOK.add(fx.sql(f"{EUCLID}, c AS (SELECT ci, ri, unnest([struct_pack(c := 'exp120', k := exp(-d / 120.0::DOUBLE)), struct_pack(c := 'exp300', k := exp(-d / 300.0::DOUBLE)), struct_pack(c := 'pow2', k := pow(1 + d / 50.0::DOUBLE, -2.0::DOUBLE))]) AS s FROM b WHERE d <= 400), t AS (SELECT ci, ri, s.c AS config, sum(s.k) AS score FROM c GROUP BY 1, 2, 3), f AS (SELECT g.ci, g.ri, n.config, coalesce(t.score, 0) AS score FROM grid g CROSS JOIN (VALUES ('exp120'), ('exp300'), ('pow2')) AS n(config) LEFT JOIN t ON t.ci = g.ci AND t.ri = g.ri AND t.config = n.config), m AS (SELECT min(ln(1 + score)) AS lo, max(ln(1 + score)) AS hi FROM f) SELECT ci, ri, config, round(CASE WHEN hi > lo THEN (ln(1 + score) - lo) / (hi - lo) ELSE 0 END, 6) AS norm FROM f, m", "grid", "poi"))
def score_compare(spark, d):
    """Several kernels over one distance join, on one shared scale."""
    q = fx.grid(spark, d)
    pairs = spatial.within(fx.poi(spark, d).select("x", "y"), q.select("ci", "ri", F.col("x").alias("rx"), F.col("y").alias("ry")), 400.0)
    sums = pairs.groupBy("ci", "ri").agg(*[F.sum(geo.kernel(spec)(F.col("d"))).alias(name) for name, spec in CONFIGS])
    each = q.select("ci", "ri").join(sums, ["ci", "ri"], "left").select("ci", "ri", F.explode(F.array(*[F.struct(F.lit(name).alias("config"), F.coalesce(name, F.lit(0.0)).alias("score")) for name, _ in CONFIGS])).alias("c")).select("ci", "ri", "c.*")
    v, low, high = F.log1p("score"), F.col("__low"), F.col("__high")
    return score.with_bounds(each, v).select("ci", "ri", "config", F.round(F.when(high > low, (v - low) / (high - low)).otherwise(0.0), 6).alias("norm"))


_WALK = f"""WITH RECURSIVE {_SNAP_EDGE[5:]},
l AS (SELECT e // 1000000 AS a, e % 1000000 AS b, e FROM e UNION ALL SELECT e % 1000000, e // 1000000, e FROM e),
toll AS (SELECT a, CASE WHEN count(*) > 2 THEN 50.0::DOUBLE ELSE 0 END AS toll FROM l GROUP BY a),
own AS (SELECT k, m.e AS e, m.along AS along, m.e // 1000000 AS u, m.e % 1000000 AS v FROM g),
out AS (SELECT k, u, v, v AS at, 50 - along AS d FROM own UNION ALL SELECT k, u, v, u, along FROM own),
walk(k, u, v, a, b, d) AS (
  SELECT k, u, v, l.a, l.b, d + toll FROM out JOIN toll ON toll.a = out.at JOIN l ON l.a = out.at WHERE l.b <> u AND l.b <> v AND d + toll <= 300
  UNION ALL SELECT k, u, v, l.a, l.b, d + 50 + toll FROM walk JOIN toll ON toll.a = walk.b JOIN l ON l.a = walk.b
  WHERE l.b <> walk.a AND d + 50 + toll <= 300 AND NOT (l.a = u AND l.b = v)),
entered AS (SELECT k, a, b, min(d) AS d FROM walk GROUP BY 1, 2, 3),
s AS (SELECT e, i, i * 10.0::DOUBLE AS low, (i + 1) * 10.0::DOUBLE AS high, i * 10.0::DOUBLE + 5 AS middle FROM e, (SELECT unnest(range(5)) AS i)),
far AS (SELECT s.e, i, abs(middle - along) AS far FROM s JOIN own ON own.e = s.e WHERE low >= along OR high <= along
  UNION ALL SELECT s.e, i, d + middle FROM entered JOIN l ON l.a = entered.a AND l.b = entered.b JOIN s ON s.e = l.e),
credit AS (SELECT e, i, sum(exp(-far / 120.0::DOUBLE)) AS score FROM far WHERE far <= 300 GROUP BY 1, 2)"""


STREETS_SQL = fx.sql(f"{_WALK} SELECT s.e, CAST(s.i AS INTEGER) AS i, round(coalesce(score, 0), 6) AS score FROM s LEFT JOIN credit ON credit.e = s.e AND credit.i = s.i", "edge", "poi")


@BOOK.add(STREETS_SQL)
def score_streets(spark, d):
    return streets_of(spark, d).select("e", "i", F.round("score", 6).alias("score"))


@BOOK.add(fx.sql(f"{_WALK} SELECT e, round(sum(score), 6) AS score FROM credit GROUP BY 1 HAVING round(sum(score), 6) > 0", "edge", "poi"))
def graph_street_walk(spark, d):
    """Edges that a street walk credits, with their totals."""
    return streets_of(spark, d).groupBy("e").agg(F.round(F.sum("score"), 6).alias("score")).where("score > 0")


def streets_of(spark, d):
    lines = edge_lines(spark, d).withColumn("len", F.lit(50.0))
    segments = graph.segment_edges(lines, 10.0).select("e", "i", "start_dist", "end_dist")
    snapped = spatial.snap_to_edges(fx.poi(spark, d), lines, "k", 75.0, 50.0).select(F.col("k").alias("pid"), "e", "along")
    return score.streets(segments, lines.select("e", "u", "v", "w", F.col("ax").alias("ux"), F.col("ay").alias("uy")), snapped, 300.0, 50.0, 120.0)


@BOOK.add(fx.sql(f"{_SNAP_EDGE}, x AS (SELECT m.e AS e, m.along AS along FROM g), s AS (SELECT e.e, i, i * 10.0::DOUBLE AS a, (i + 1) * 10.0::DOUBLE AS z FROM e, (SELECT unnest(range(5)) AS i)) SELECT s.e, CAST(s.i AS INTEGER) AS i, round(sum(exp(-abs((a + z) / 2 - along) / 120.0::DOUBLE)), 6) AS score FROM s JOIN x ON x.e = s.e WHERE a >= along OR z <= along GROUP BY 1, 2", "edge", "poi"))
def agg_segment_sum(spark, d):
    """Kernel sums onto the segments of a destination's own edge."""
    lines = edge_lines(spark, d).withColumn("len", F.lit(50.0))
    seg = graph.segment_edges(lines, 10.0)
    snapped = spatial.snap_to_edges(fx.poi(spark, d), lines, "k", 75.0, 50.0).select(F.col("e").alias("pe"), "along")
    mid = (F.col("start_dist") + F.col("end_dist")) / 2
    joined = seg.join(snapped, seg.e == snapped.pe).where("start_dist >= along or end_dist <= along")
    return joined.groupBy("e", "i").agg(F.round(F.sum(geo.kernel_exp(F.abs(mid - F.col("along")))), 6).alias("score"))


@BOOK.add(fx.sql("SELECT k, round(sum(w), 6) AS total FROM (SELECT x.k, exp(-d / 120.0::DOUBLE) AS w FROM (SELECT DISTINCT a.k, b.x, b.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM poi a JOIN poi b ON abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200) x WHERE d <= 200) GROUP BY k", "poi"))
def agg_kernel_sum_v1(spark, d):
    p = fx.poi(spark, d)
    near = spatial.within(p.select("k", "x", "y"), p.select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct(), 200.0)
    return near.groupBy("k").agg(F.round(F.sum(geo.kernel_exp(F.col("d"))), 6).alias("total"))


@BOOK.add(fx.sql(f"WITH {POI_SNAP} SELECT m.node AS node, round(sum(CASE WHEN 60 + m.d <= 100 THEN exp(-(60 + m.d) / 120.0::DOUBLE) ELSE 0 END), 6) AS total FROM ps GROUP BY 1", "node", "poi"))
def agg_kernel_sum_v2(spark, d):
    total = 60 + F.col("d")
    return poi_snap(spark, d).groupBy("node").agg(F.round(F.sum(F.when(total <= 100, geo.kernel_exp(total)).otherwise(0.0)), 6).alias("total"))


@BOOK.add(fx.sql(f"WITH {POI_SNAP} SELECT k, m.node AS node, round(sum(exp(-m.d / 120.0::DOUBLE)) OVER (PARTITION BY m.node ORDER BY m.d, k ROWS UNBOUNDED PRECEDING), 6) AS prefix FROM ps", "node", "poi"))
def win_prefix_weights(spark, d):
    w = Window.partitionBy("node").orderBy("d", "k").rowsBetween(Window.unboundedPreceding, 0)
    return poi_snap(spark, d).select("k", "node", F.round(F.sum(geo.kernel_exp(F.col("d"))).over(w), 6).alias("prefix"))


@BOOK.add(fx.sql("WITH o AS (SELECT g.ci // 80 AS cx, g.ri // 80 AS cy, g.x, g.y FROM grid g) SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, count(*) AS cells, count(DISTINCT x * 1000000 + y) AS cells_once FROM o GROUP BY 1, 2", "grid"))
def grid_chunk_key(spark, d):
    return sssp.owners(fx.grid(spark, d), geo.CHUNK).groupBy("cx", "cy").agg(F.count("*").alias("cells"), F.count_distinct("x", "y").alias("cells_once"))


@BOOK.add(fx.sql("WITH c AS (SELECT id, x, y, unnest(range(CAST(floor((x - 975) / 2000) AS BIGINT), CAST(floor((x + 975) / 2000) AS BIGINT) + 1)) AS cx FROM node), e AS (SELECT *, unnest(range(CAST(floor((y - 975) / 2000) AS BIGINT), CAST(floor((y + 975) / 2000) AS BIGINT) + 1)) AS cy FROM c) SELECT cx, cy, count(*) AS nodes FROM e GROUP BY 1, 2", "node"))
def grid_halo(spark, d):
    return sssp.within_halo(fx.node(spark, d), geo.CHUNK, geo.HALO).groupBy("cx", "cy").agg(F.count("*").alias("nodes"))


#: Every destination scored as a query: own(qid, x, y, score), null without a snap.
OWN_SQL = f"WITH RECURSIVE {POI_SNAP}, {PATHS}, near AS (SELECT q.k AS qid, q.m.d + sp.d + p.m.d AS total FROM ps q JOIN sp ON sp.node = q.m.node JOIN ps p ON p.m.node = sp.src), s AS (SELECT qid, sum(exp(-total / 120.0::DOUBLE)) AS score FROM near WHERE total <= 800 GROUP BY 1), own AS (SELECT CAST(poi.k AS BIGINT) AS qid, poi.x, poi.y, CASE WHEN q.k IS NOT NULL THEN round(coalesce(score, 0), 6) END AS score FROM poi LEFT JOIN ps q ON q.k = poi.k LEFT JOIN s ON s.qid = poi.k)"


@BOOK.add(fx.sql(f"{OWN_SQL} SELECT qid, score FROM own", "edge", "poi"))
def score_halo(spark, d):
    """Destinations scored as if they were queries, each by its own chunk and halo."""
    p = fx.poi(spark, d)
    return score.chunked(fx.node(spark, d), fx.edge(spark, d), p.select(F.col("k").alias("qid"), "x", "y"), p.withColumnRenamed("k", "pid"), chunk=1000.0).select("qid", F.round("score", 6).alias("score"))
