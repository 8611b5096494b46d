"""Windows, sorting, set operations, deduplication, summaries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.operators import score
from netdensity.operators.order import quantiles, running
from netdensity.plans import fixtures as fx
from netdensity.plans.book import Book
from netdensity.session import materialize, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def scores(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 83 / 7.0).alias("score"))


_S = "s AS (SELECT c_custkey AS id, c_custkey % 83 / 7.0::DOUBLE AS score FROM customer)"

# ---- scales


@BOOK.add(f"WITH {_S}, b AS (SELECT min(ln(1 + score)) AS lo, max(ln(1 + score)) AS hi FROM s) SELECT id, round((ln(1 + score) - lo) / (hi - lo), 9) AS norm FROM s, b")
def norm_log1p(spark, d):
    return score.normalised(scores(spark, d), "score").select("id", F.round("norm", 9).alias("norm"))


_RANK = f"WITH {_S}, r AS (SELECT id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS v FROM s)"


@BOOK.add(f"{_RANK}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM r) SELECT id, round((v - lo) / (hi - lo), 9) AS norm FROM r, b")
def norm_quantile(spark, d):
    return score.normalised(scores(spark, d), "score", "quantile").select("id", F.round("norm", 9).alias("norm"))


@BOOK.add(ORACLES["norm_quantile"])
def win_quantile(spark, d):
    return score.normalised(scores(spark, d), "score", "quantile").select("id", F.round("norm", 9).alias("norm"))


@BOOK.add(f"WITH {_S}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT id, round((score - lo) / (hi - lo), 9) AS norm FROM s, b")
def norm_none(spark, d):
    return score.normalised(scores(spark, d), "score", "none").select("id", F.round("norm", 9).alias("norm"))


@BOOK.add(ORACLES["norm_none"])
def win_minmax(spark, d):
    return score.normalised(scores(spark, d), "score", "none").select("id", F.round("norm", 9).alias("norm"))


@BOOK.add("WITH s AS (SELECT l_orderkey AS e, l_linenumber AS i, l_quantity AS score FROM lineitem), b AS (SELECT min(ln(1 + score)) AS lo, max(ln(1 + score)) AS hi FROM s) SELECT e, i, round((ln(1 + score) - lo) / (hi - lo), 9) AS norm FROM s, b")
def norm_segments(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("score"))
    return score.normalised(s, "score").select("e", "i", F.round("norm", 9).alias("norm"))


@BOOK.add(f"WITH {_S}, c AS (SELECT id, k, score * k AS score FROM s, (VALUES (1), (2), (3)) AS k(k)), b AS (SELECT min(ln(1 + score)) AS lo, max(ln(1 + score)) AS hi FROM c) SELECT id, k, round((ln(1 + score) - lo) / (hi - lo), 9) AS norm FROM c, b")
def norm_shared(spark, d):
    s = scores(spark, d).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("score", F.col("score") * F.col("k"))
    return score.normalised(s, "score").select("id", "k", F.round("norm", 9).alias("norm"))


# ---- windows


@BOOK.add("SELECT l_orderkey AS o, l_linenumber AS l, l_quantity AS q, sum(l_partkey % 9 - 4) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM lineitem")
def win_cumsum_delta(spark, d):
    """Delta decoding: each block's running sum in order."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("q"), F.sum(F.col("l_partkey") % 9 - 4).over(w).alias("value"))


@BOOK.add("SELECT block, id, prev FROM (SELECT o_custkey % 50 AS block, o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev >= id")
def win_sorted_check(spark, d):
    """Where ids fail to rise in file order."""
    w = Window.partitionBy("block").orderBy("o_orderdate", "id")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("block"), F.col("o_orderkey").alias("id"), "o_orderdate").withColumn("prev", F.lag("id").over(w)).where("prev >= id").select("block", "id", "prev")


@BOOK.add("SELECT supp, page, id FROM (SELECT l_suppkey AS supp, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) - 1) AS r, l_orderkey * 10 + l_linenumber AS id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) - 1) // 16 AS page FROM lineitem) WHERE r % 16 = 0")
def win_fence(spark, d):
    """The first id of every page of 16, within each file."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    w = Window.partitionBy("l_suppkey").orderBy(key, "l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), key.alias("id"), (F.row_number().over(w) - 1).cast("long").alias("r")).where("r % 16 = 0").select("supp", F.floor(F.col("r") / 16).alias("page"), "id")


_ZOOM = "SELECT c_nationkey AS site, CAST(c_custkey % 9 AS INTEGER) AS lo, CAST(c_custkey % 9 + c_custkey % 2 AS INTEGER) AS hi FROM customer"


def zoom_parts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), (k % 9).cast("int").alias("lo"), (k % 9 + k % 2).cast("int").alias("hi")).distinct()


@BOOK.add(f"WITH z AS (SELECT DISTINCT * FROM ({_ZOOM})), n AS (SELECT site, lo, hi, lead(lo) OVER (PARTITION BY site ORDER BY lo, hi) AS next FROM z) SELECT site, lo, hi, next FROM n WHERE next <> hi + 1")
def win_zoom_contiguity(spark, d):
    """Archive parts that do not go on where the one before ends."""
    w = Window.partitionBy("site").orderBy("lo", "hi")
    return zoom_parts(spark, d).withColumn("next", F.lead("lo").over(w)).where("next <> hi + 1")


@BOOK.add(f"WITH z AS (SELECT DISTINCT * FROM ({_ZOOM})), n AS (SELECT site, lo, hi, lead(lo) OVER (PARTITION BY site ORDER BY lo, hi) AS next FROM z) SELECT site, count(*) AS parts, min(lo) AS lo, max(hi) AS hi, bool_and(next IS NULL OR next = hi + 1) AS contiguous FROM n GROUP BY site")
def sink_archive_site(spark, d):
    w = Window.partitionBy("site").orderBy("lo", "hi")
    return zoom_parts(spark, d).withColumn("next", F.lead("lo").over(w)).groupBy("site").agg(F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("next").isNull() | (F.col("next") == F.col("hi") + 1)).alias("contiguous"))


# ---- sorting, limits, samples


@BOOK.add("SELECT s, o, l, rn FROM (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS l, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_partkey) AS rn FROM lineitem)")
def sort_rank(spark, d):
    """A stable order by rank, then key, within each shard."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.row_number().over(w).cast("long").alias("rn"))


@BOOK.add("SELECT l_suppkey AS shard, count(*) AS rows, count(*) > 55 AS over FROM lineitem GROUP BY 1")
def sort_limit_guard(spark, d):
    """Shards over a budget of rows."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count("*").alias("rows"), (F.count("*") > 55).alias("over"))


@BOOK.add(fx.sql("SELECT job, seconds FROM job ORDER BY seconds DESC, job LIMIT 20", "job"))
def topk_slowest(spark, d):
    return fx.job(spark, d).select("job", "seconds").orderBy(F.desc("seconds"), "job").limit(20)


@BOOK.add(fx.sql("SELECT id, round(sqrt((x - 1234) ** 2 + (y - 321) ** 2), 6) AS d FROM node ORDER BY sqrt((x - 1234) ** 2 + (y - 321) ** 2), id LIMIT 100", "node"))
def topk_nearest(spark, d):
    dist = F.sqrt(F.pow(F.col("x") - 1234, 2) + F.pow(F.col("y") - 321, 2))
    return fx.node(spark, d).select("id", dist.alias("d0")).orderBy("d0", "id").limit(100).select("id", F.round("d0", 6).alias("d"))


@BOOK.add(fx.sql("WITH n AS (SELECT job, row_number() OVER (ORDER BY job) - 1 AS r, count(*) OVER () AS n FROM job), k AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 7.0::DOUBLE) AS BIGINT) AS pos FROM (SELECT DISTINCT n FROM n), (SELECT unnest(range(8)) AS i)) SELECT job FROM n WHERE r IN (SELECT pos FROM k)", "job"))
def samp_even(spark, d):
    """Eight rows evenly spaced in order."""
    j = fx.job(spark, d).select("job")
    r = running(j.withColumn("one", F.lit(1)), "job", "one", "upto").withColumn("r", F.col("upto") - 1)
    n = j.agg(F.count("*").alias("n")).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(i * (F.col("n") - 1) / 7.0)))).alias("at"))
    return r.join(n, r.r == n["at"], "left_semi").select("job")


@BOOK.add("SELECT kind, id FROM (SELECT p_type AS kind, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY md5('7:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 5")
def samp_seeded(spark, d):
    """Five of each kind by a seeded hash order."""
    w = Window.partitionBy("p_type").orderBy(F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("id"))


# ---- sets


@BOOK.add("SELECT p_partkey AS k, p_name AS name, NULL::VARCHAR AS segment FROM part UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def set_union_all(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


_T2 = "SELECT z, x + 5 AS x, y FROM tile_key"


def shifted(spark, d):
    return fx.tile_key(spark, d).select("z", (F.col("x") + 5).alias("x"), "y")


@BOOK.add(fx.sql(f"SELECT z, x, y FROM tile_key INTERSECT {_T2}", "tile_key"))
def set_intersect(spark, d):
    return fx.tile_key(spark, d).intersect(shifted(spark, d))


@BOOK.add(fx.sql(f"SELECT z, x, y FROM tile_key EXCEPT {_T2}", "tile_key"))
def set_diff(spark, d):
    return fx.tile_key(spark, d).subtract(shifted(spark, d))


@BOOK.add(fx.sql(f"SELECT (SELECT count(*) FROM (SELECT * FROM tile_key EXCEPT {_T2})) + (SELECT count(*) FROM ({_T2} EXCEPT SELECT * FROM tile_key)) AS differing, false AS equal", "tile_key"))
def set_equal(spark, d):
    a, b = fx.tile_key(spark, d), shifted(spark, d)
    off = a.exceptAll(b).union(b.exceptAll(a))
    return off.agg(F.count("*").alias("differing"), (F.count("*") == 0).alias("equal"))


@BOOK.add(fx.sql("SELECT x % 3 AS part, count(*) AS tiles, 0::BIGINT AS shared FROM tile_key GROUP BY 1", "tile_key"))
def set_disjoint(spark, d):
    """Partitions of the tiles, and how many tiles each shares with another."""
    parts = fx.tile_key(spark, d).withColumn("part", F.col("x") % 3)
    owners = parts.groupBy("z", "x", "y").agg(F.count_distinct("part").alias("n"))
    return parts.join(owners, ["z", "x", "y"]).groupBy("part").agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 1).alias("shared"))


# ---- deduplication


@BOOK.add("SELECT k, o FROM (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS o, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedupe_identity(spark, d):
    """The first row of each identity in input order."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))


@BOOK.add("SELECT l_partkey AS id, count(DISTINCT l_returnflag) AS versions, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def dedupe_version(spark, d):
    """Ways that come in several versions, which is an error."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_returnflag").alias("versions"), F.count("*").alias("copies")).where("versions > 1")


@BOOK.add("SELECT l_suppkey AS s, l_partkey AS p, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2")
def dedupe_ignore(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.min("l_orderkey").alias("first"))


# ---- summaries


@BOOK.add(f"WITH {_S} SELECT min(score) AS lo, max(score) AS hi, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std FROM s")
def agg_stats(spark, d):
    return scores(spark, d).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.round(F.avg("score"), 9).alias("mean"), F.round(F.stddev_pop("score"), 9).alias("std"))


@BOOK.add(ORACLES["agg_stats"])
def sink_metadata(spark, d):
    return agg_stats(spark, d)


@BOOK.add(fx.sql("SELECT region, count(*) AS cells, count(score) AS reachable, CAST(count(*) FILTER (score > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (score = 0) AS BIGINT) AS zero FROM raster GROUP BY region", "raster"))
def agg_nonzero(spark, d):
    return fx.raster(spark, d).groupBy("region").agg(F.count("*").alias("cells"), F.count("score").alias("reachable"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("score") == 0).alias("zero"))


@BOOK.add(fx.sql("SELECT round(sum(seconds), 6) AS total, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.95), 6) AS p95, max(seconds) AS longest, count(*) AS jobs FROM job", "job"))
def agg_job_summary(spark, d):
    jobs = materialize(fx.job(spark, d))
    places = quantiles(jobs, [], "seconds", {"median": 0.5, "p95": 0.95})
    total = jobs.agg(F.round(F.sum("seconds"), 6).alias("total"), F.max("seconds").alias("longest"), F.count("*").alias("jobs"))
    return total.crossJoin(F.broadcast(places)).select("total", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "longest", "jobs")


@BOOK.add("SELECT l_linenumber AS z, count(*) AS files, CAST(sum(CAST(l_extendedprice AS BIGINT)) AS BIGINT) AS bytes, min(l_extendedprice) AS smallest, max(l_extendedprice) AS largest, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM (SELECT l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1")
def agg_zoom_stats(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("z"), F.floor("l_extendedprice").cast("double").alias("b"))
    places = quantiles(x, ["z"], "b", {"median": 0.5, "p95": 0.95}).select("z", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))
    return x.groupBy("z").agg(F.count("*").alias("files"), F.sum(F.col("b").cast("long")).alias("bytes"), F.min("b").alias("smallest"), F.max("b").alias("largest")).join(places, "z", "left")


@BOOK.add("SELECT ext, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT l_returnflag AS ext, l_orderkey AS dev, l_linenumber AS ino, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem) GROUP BY ext")
def agg_ext_inventory(spark, d):
    """Files and bytes by extension, each file identity once."""
    f = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ext"), F.col("l_orderkey").alias("dev"), F.col("l_linenumber").alias("ino"), F.col("l_quantity").cast("long").alias("bytes")).distinct()
    return f.groupBy("ext").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@BOOK.add("SELECT count(DISTINCT sha256(p_name || p_type)) AS payloads, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT p_name, p_type, length(p_name) + length(p_type) AS n FROM part GROUP BY 1, 2)")
def agg_distinct_payload(spark, d):
    raw = F.concat("p_name", "p_type")
    each = table(spark, d, "part").groupBy(F.sha2(raw, 256).alias("sha")).agg(F.min(F.length(raw)).alias("n"))
    return each.agg(F.count("*").alias("payloads"), F.sum("n").cast("long").alias("bytes"))


@BOOK.add(fx.sql("SELECT DISTINCT CAST(floor(x / 400) AS BIGINT) AS cx, CAST(floor(y / 400) AS BIGINT) AS cy, count(*) OVER (PARTITION BY floor(x / 400), floor(y / 400)) AS members FROM poi", "poi"))
def agg_unique_cells(spark, d):
    return fx.poi(spark, d).groupBy(F.floor(F.col("x") / 400).alias("cx"), F.floor(F.col("y") / 400).alias("cy")).agg(F.count("*").alias("members"))


@BOOK.add("SELECT l_shipdate IS NOT NULL AS known, l_returnflag AS stage, round(sum(l_quantity), 3) AS seconds, max(l_tax) AS most, max(struct_pack(o := l_orderkey * 10 + l_linenumber, q := l_quantity)).q AS latest FROM lineitem GROUP BY 1, 2")
def agg_stage_summary(spark, d):
    """Attempts of each stage: total seconds, largest memory, the latest one's value."""
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").isNotNull().alias("known"), F.col("l_returnflag").alias("stage")).agg(F.round(F.sum("l_quantity"), 3).alias("seconds"), F.max("l_tax").alias("most"), F.max(F.struct(order, "l_quantity"))["l_quantity"].alias("latest"))


@BOOK.add(fx.sql("WITH g AS (SELECT s_suppkey AS gap, s_suppkey * 701 % 5000 * 1.0::DOUBLE AS gx, s_suppkey * 307 % 7000 * 1.0::DOUBLE AS gy FROM supplier) SELECT gap, round(min(sqrt((x - gx) ** 2 + (y - gy) ** 2)), 6) AS nearest, CAST(count(*) FILTER (sqrt((x - gx) ** 2 + (y - gy) ** 2) <= 300) AS BIGINT) AS within FROM g, poi GROUP BY gap", "poi"))
def agg_audit_gaps(spark, d):
    """For each gap the nearest feature, however far, and how many lie within 300 m."""
    from netdensity.operators import spatial

    g = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gap"), (F.col("s_suppkey") * 701 % 5000).cast("double").alias("x"), (F.col("s_suppkey") * 307 % 7000).cast("double").alias("y"))
    p = fx.poi(spark, d)
    near = spatial.nearest(g, p.withColumnRenamed("k", "id"), "gap", 300.0).select("gap", F.round("d", 6).alias("nearest"))
    within = spatial.within(g, p.select(F.col("x").alias("rx"), F.col("y").alias("ry")), 300.0).groupBy("gap").agg(F.count("*").alias("within"))
    return near.join(within, "gap", "left").select("gap", "nearest", F.coalesce("within", F.lit(0)).cast("long").alias("within"))


# ---- provenance and limits


@BOOK.add("SELECT p_partkey AS id, sha256(p_name || '|' || p_brand) AS sha, sha256(p_name || '|' || p_brand) = sha256(p_name || '|' || CASE WHEN p_size = 7 THEN 'x' ELSE p_brand END) AS intact FROM part")
def prov_checksums(spark, d):
    sha = lambda b: F.sha2(F.concat_ws("|", "p_name", b), 256)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), sha(F.col("p_brand")).alias("sha"), (sha(F.col("p_brand")) == sha(F.when(F.col("p_size") == 7, "x").otherwise(F.col("p_brand")))).alias("intact"))


@BOOK.add("SELECT o_orderpriority AS source, count(DISTINCT o_orderdate) AS snapshots, count(DISTINCT o_orderdate) = 1 AS equal FROM orders GROUP BY 1")
def prov_snapshot_eq(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count_distinct("o_orderdate").alias("snapshots"), (F.count_distinct("o_orderdate") == 1).alias("equal"))


@BOOK.add(fx.sql("SELECT rid, count(*) AS unresolved FROM relation WHERE ref NOT IN (SELECT rid FROM relation) AND ref NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 35 <> 0) GROUP BY rid", "relation"))
def prov_unresolved_gate(spark, d):
    """Relations with members that nothing resolves; any row here blocks scoring."""
    rel = fx.relation(spark, d)
    known = rel.select(F.col("rid").alias("k")).union(table(spark, d, "customer").where("c_custkey % 35 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey"))))
    return rel.join(known, rel.ref == known.k, "left_anti").groupBy("rid").agg(F.count("*").alias("unresolved"))


@BOOK.add("SELECT p_type AS site, count(*) AS files, max(length(p_name)) AS largest, count(*) <= 20000 AND max(length(p_name)) <= 26214400 AS within FROM part GROUP BY 1")
def min_asset_limits(spark, d):
    n = F.length("p_name")
    return table(spark, d, "part").groupBy(F.col("p_type").alias("site")).agg(F.count("*").alias("files"), F.max(n).cast("long").alias("largest"), ((F.count("*") <= 20000) & (F.max(n) <= 26214400)).alias("within"))


@BOOK.add("SELECT l_suppkey AS page, sha256(string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber)) AS sha FROM lineitem GROUP BY 1")
def min_rolling_hash(spark, d):
    """A digest over each page's ids in order."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("ids"))
    return g.select("page", F.sha2(F.array_join(F.transform("ids", lambda r: F.concat_ws(":", r["l_orderkey"], r["l_linenumber"])), ","), 256).alias("sha"))


# ---- composed sites


@BOOK.add(fx.sql("SELECT x, count(*) AS tiles, CASE WHEN x % 3 = 2 THEN 'detail' ELSE 'overview' END AS part FROM tile_key GROUP BY x", "tile_key"))
def sink_pm_partition(spark, d):
    """Tiles by archive part; each tile is in one."""
    part = F.when(F.col("x") % 3 == 2, "detail").otherwise("overview")
    return fx.tile_key(spark, d).groupBy("x").agg(F.count("*").alias("tiles")).select("x", "tiles", part.alias("part"))


@BOOK.add(fx.sql("WITH RECURSIVE u(z, x, y) AS (SELECT z, x, y FROM tile_key UNION SELECT z - 1, x // 2, y // 2 FROM u WHERE z > 12) SELECT z, count(*) AS tiles, CAST(sum(100 + x % 7) AS BIGINT) AS bytes FROM u WHERE z > 12 GROUP BY z", "tile_key"))
def sink_pm_split(spark, d):
    """The detail archive split by zoom."""
    from netdensity.operators import tiles

    return tiles.parent_keys(fx.tile_key(spark, d), 1).groupBy("z").agg(F.count("*").alias("tiles"), F.sum(100 + F.col("x") % 7).alias("bytes"))


@BOOK.add("SELECT count(*) AS changed FROM (SELECT p_partkey AS path, md5(p_name) AS h FROM part) a FULL JOIN (SELECT p_partkey AS path, md5(p_name) AS h FROM part WHERE p_partkey >= 0) b USING (path) WHERE a.h IS DISTINCT FROM b.h")
def sink_multi_region(spark, d):
    """Assets that changed while two sites were combined: none."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("h"))
    b = a.where("path >= 0").withColumnRenamed("h", "h2")
    return a.join(b, "path", "full").where(~F.col("h").eqNullSafe(F.col("h2"))).agg(F.count("*").alias("changed"))


@BOOK.add(fx.sql("SELECT z, x, y, bool_or(k = 0) AND bool_or(k = 1) AS shared, min(k) AS owner FROM (SELECT z, x, y, 0 AS k FROM tile_key UNION ALL SELECT z, x + 3, y, 1 FROM tile_key) GROUP BY z, x, y", "tile_key"))
def sink_continuous(spark, d):
    """The merged inventory of two regions, with the tiles that need compositing."""
    a = fx.tile_key(spark, d).withColumn("k", F.lit(0))
    both = a.union(a.select("z", (F.col("x") + 3).alias("x"), "y", F.lit(1)))
    return both.groupBy("z", "x", "y").agg((F.count_distinct("k") == 2).alias("shared"), F.min("k").alias("owner"))


@BOOK.add(fx.sql("WITH w AS (SELECT way_id, unnest(refs) AS id FROM way), hit AS (SELECT DISTINCT way_id FROM w JOIN node USING (id) WHERE x BETWEEN 900 AND 1100) SELECT way_id, count(*) AS nodes FROM w WHERE way_id IN (SELECT way_id FROM hit) GROUP BY way_id", "way"))
def sink_gap_extract(spark, d):
    """Ways that touch a gap, with all their nodes."""
    refs = fx.way(spark, d).select("way_id", F.explode("refs").alias("id"))
    hit = refs.join(fx.node(spark, d).where("x between 900 and 1100"), "id", "left_semi").select("way_id").distinct()
    return refs.join(hit, "way_id", "left_semi").groupBy("way_id").agg(F.count("*").alias("nodes"))
