"""Sources, outputs and resumable runs as queries: most write, read back, and return what they read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from netdensity.functions import geo, predicates
from netdensity.operators import outputs, provenance, regional, tiles
from netdensity.plans import fixtures as fx
from netdensity.plans.book import Book
from netdensity.plans.graph_queries import BLOCKS_SQL, OWN_SQL, STREETS_SQL, edge_lines, streets_of
from netdensity.plans.raster_queries import rendered
from netdensity.plans.scalar_queries import DELTA, INVERSE
from netdensity.session import checkpoint_dir, materialize, table
from netdensity.sources import elements, pbf

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def fresh(spark, what):
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# ---- JSON documents


def documents(spark, d):
    """The tagged elements as JSON documents, one an order, written as a server would send them."""
    rows = fx.tagged(spark, d).dropDuplicates(["o", "l"])
    point = F.struct((F.col("o") % 100 / 1000.0).alias("lon"), (F.col("l") / 100.0).alias("lat"))
    kind = F.when(F.col("l") % 2 == 0, "node").otherwise("way")
    element = F.struct(kind.alias("type"), (F.col("o") * 10 + F.col("l")).alias("id"), point["lon"].alias("lon"), point["lat"].alias("lat"), F.array(F.col("o") * 10, F.col("o") * 10 + 1).alias("nodes"), F.array(point, point).alias("geometry"), "tags")
    return rows.groupBy("o").agg(F.collect_list(element).alias("elements")).select(F.to_json(F.struct("elements")).alias("text"))




@BOOK.add(fx.sql("WITH t AS (SELECT o, l, o * 10 + l AS id, row_number() OVER (PARTITION BY o, l) AS r FROM tagged) SELECT CASE WHEN l % 2 = 0 THEN 'node' ELSE 'way' END AS type, id FROM t WHERE r = 1", "tagged"))
def src_overpass_json(spark, d):
    return elements.elements(documents(spark, d)).select("type", "id")


# ---- PBF blocks


def blobs(spark, d):
    """The lattice's nodes as blobs of 500, with the ways of their rows."""
    n = fx.node(spark, d).select(F.floor(F.col("id") / 500).alias("block"), "id", (F.col("x") * 100).cast("long").alias("x"), (F.col("y") * 100).cast("long").alias("y"))

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = list(pdf.sort_values("id")[["id", "x", "y"]].itertuples(index=False, name=None))
        ways = [(int(w), [i for i, _, _ in nodes if i // 100 == w]) for w in sorted({i // 100 for i, _, _ in nodes})]
        return pd.DataFrame([(key[0], pbf.encode_blob(nodes, ways, [(int(key[0]), [i for i, _ in ways], [1] * len(ways))]))], columns=["block", "blob"])

    return n.groupBy("block").applyInPandas(encode, "block long, blob binary")


WAYS = ({"highway": "footway"}, {"highway": "motorway"}, {"highway": "residential"}, {"highway": "steps"}, {"highway": "footway"}, {"highway": "motorway", "foot": "yes"}, {"highway": "residential"}, {"highway": "steps"})


def tagged_blobs(spark, d):
    """The lattice's blobs with tags, out of two sources, of which the second repeats every third blob."""
    n = fx.node(spark, d).select(F.floor(F.col("id") / 500).alias("block"), "id", (F.col("x") * 100).cast("long").alias("x"), (F.col("y") * 100).cast("long").alias("y"))

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = list(pdf.sort_values("id")[["id", "x", "y"]].itertuples(index=False, name=None))
        ways = [(int(w), [i for i, _, _ in nodes if i // 100 == w]) for w in sorted({i // 100 for i, _, _ in nodes})]
        tags = {("way", w): WAYS[w % 8] for w, _ in ways}
        for i, _, _ in nodes:
            shop = {0: {"shop": "bakery"}, 1: {"shop": "vacant"}}.get(i % 11, {})
            tags["node", i] = shop | ({"access": "no"} if i % 13 == 0 else {})
        blob = pbf.encode_blob(nodes, ways, tags={k: v for k, v in tags.items() if v})
        return pd.DataFrame([(key[0], source, blob) for source in ((0, 1) if key[0] % 3 == 0 else (0,))], columns=["block", "source", "blob"])

    return n.groupBy("block").applyInPandas(encode, "block long, source int, blob binary")


@BOOK.add(fx.sql("SELECT way_id, a, b FROM (SELECT way_id, refs[s] AS a, refs[s + 1] AS b FROM (SELECT way_id, refs, unnest(range(1, len(refs))) AS s FROM way)) WHERE way_id % 8 <> 1 AND a % 13 <> 0 AND b % 13 <> 0", "way"))
def src_pbf_v1(spark, d):
    """Walk pairs of the decoded blocks' ways, without those that touch a blocked node."""
    rows = pbf.decode_blocks(tagged_blobs(spark, d).where("source = 0"))
    return elements.walk_pairs(elements.from_blocks(rows))[1].select("way_id", "a", "b")


@BOOK.add(fx.sql("SELECT 'node' AS type, id, round(x * 100 / 1e7, 7) AS lon, round(y * 100 / 1e7, 7) AS lat FROM node WHERE id % 11 = 0 AND id % 13 <> 0", "node"))
def src_pbf_regional(spark, d):
    """Destinations of two sources that overlap, imported, and imported again, by the rule of the tags, each with a point."""
    path, blobs = fresh(spark, "import"), materialize(tagged_blobs(spark, d))
    pbf.import_sources(blobs.where("source = 0"), path)
    rule = predicates.destination(predicates.in_map("tags"), {"shop": ["*"]}, {"shop": ["vacant"]}) & predicates.permitted(predicates.in_map("tags"))
    p = elements.points(elements.from_blocks(pbf.import_sources(blobs, path)), rule)
    return p.select("type", "id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@BOOK.add(fx.sql(BLOCKS_SQL, "node"))
def src_pbf_index(spark, d):
    """The blocks' ranges of node ids, from the decoded blobs."""
    return pbf.block_index(blobs(spark, d)).where("kind = 'node'").select("block", "low", "high")


@BOOK.add(fx.sql("SELECT id, CAST(x * 100 AS BIGINT) AS x, CAST(y * 100 AS BIGINT) AS y FROM node", "node"))
def src_node_decode(spark, d):
    return pbf.decode_blocks(blobs(spark, d)).where("kind = 'node'").select("id", "x", "y")


@BOOK.add(fx.sql("SELECT id FROM node WHERE (x BETWEEN 300 AND 900 AND y BETWEEN 0 AND 400) OR (x BETWEEN 2000 AND 2600 AND y BETWEEN 200 AND 700)", "node"))
def src_pbf_scan(spark, d):
    n = pbf.decode_blocks(blobs(spark, d)).where("kind = 'node'")
    return n.where("(x between 30000 and 90000 and y between 0 and 40000) or (x between 200000 and 260000 and y between 20000 and 70000)").select("id")


@BOOK.add(fx.sql("SELECT way_id AS id, CAST(len(refs) AS BIGINT) AS n FROM way", "way"))
def src_pbf_blocks(spark, d):
    """Ways out of decoded blocks; the parts of one way in several blocks are put together."""
    w = pbf.decode_blocks(blobs(spark, d)).where("kind = 'way'")
    return w.groupBy("id").agg(F.sum(F.size("refs")).alias("n"))


@BOOK.add(fx.sql("SELECT id // 1000 AS page, min(id) AS low, max(id) AS high, count(*) AS n FROM node GROUP BY 1", "node"))
def src_coord_index(spark, d):
    """Coordinates written sorted by id, read again, and summed up by page."""
    path = fresh(spark, "coordinates")
    n = pbf.decode_blocks(blobs(spark, d)).where("kind = 'node'").select("id", "x", "y")
    n.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(path).groupBy(F.floor(F.col("id") / 1000).alias("page")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))


@BOOK.add(fx.sql("SELECT (SELECT count(*) FROM node WHERE x BETWEEN 500 AND 2500 AND y BETWEEN 100 AND 700) AS nodes, (SELECT count(*) FROM poi WHERE x BETWEEN 500 AND 2500 AND y BETWEEN 100 AND 700) AS pois", "node", "poi"))
def src_sqlite_shard(spark, d):
    n, _, p = regional.load_shard(fx.node(spark, d), fx.edge(spark, d), fx.poi(spark, d), 500, 100, 2500, 700)
    return n.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(p.agg(F.count("*").alias("pois"))))


# ---- polygons


def outline(spark):
    """The polygon fixture as open lines of two points in mixed directions."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    there = F.array(p("x1", "y1"), p("x2", "y2"))
    return fx.ring(spark).select("poly", F.when(F.col("ring") == 0, "outer").otherwise("inner").alias("role"), (F.col("seq") * 7 % 4).alias("ord"), F.when(F.col("seq") % 2 == 0, there).otherwise(F.reverse(there)).alias("points"))


@BOOK.add(fx.sql("SELECT poly, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END), 4) AS area FROM (SELECT poly, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM ring GROUP BY 1, 2) GROUP BY poly", "ring"))
def geo_polygonize(spark, d):
    from netdensity.operators import spatial

    return spatial.ring_area(elements.rings_of(outline(spark))).select("poly", F.round("area", 4).alias("area"))


@BOOK.add(fx.sql("SELECT poly, ring, count(*) AS edges FROM ring GROUP BY 1, 2", "ring"))
def src_boundary(spark, d):
    return elements.rings_of(outline(spark)).groupBy("poly", "ring").agg(F.count("*").alias("edges"))


def ring_points(spark):
    return fx.ring(spark).select(F.col("poly").alias("file"), F.col("ring"), (F.col("ring") > 0).alias("hole"), "seq", (F.col("x1") / 100).alias("lon"), (F.col("y1") / 100).alias("lat"))


@BOOK.add(fx.sql("SELECT poly AS file, ring + 1 AS ring, ring > 0 AS hole, seq, x1 / 100 AS lon, y1 / 100 AS lat FROM ring", "ring"))
def src_poly(spark, d):
    """Polygon files written and read again."""
    return elements.poly_rings(elements.poly_lines(ring_points(spark)))


@BOOK.add(fx.sql("SELECT poly AS file, CAST(count(*) + 2 * count(DISTINCT ring) + 2 AS BIGINT) AS lines, CAST(sum(CASE WHEN ring > 0 AND seq = 0 THEN 1 ELSE 0 END) AS BIGINT) AS holes FROM ring GROUP BY poly", "ring"))
def sink_poly(spark, d):
    return elements.poly_lines(ring_points(spark)).groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("line").startswith("!")).alias("holes"))


@BOOK.add()
def fn_representative(spark, d):
    """A point inside each ring."""
    lines = outline(spark).where("role = 'outer'").groupBy("poly").agg(F.collect_list(F.transform("points", lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))).alias("lines"))

    @F.pandas_udf(elements.POINT)
    def inside(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([elements.representative([[(p["lon"], p["lat"]) for p in x] for x in v]) for v in col], columns=["lon", "lat"])

    return lines.select("poly", inside("lines").alias("p")).select("poly", "p.lon", "p.lat")


@BOOK.add(fx.sql("SELECT way_id, round(sum(l * mx) / sum(l), 6) AS x, round(sum(l * my) / sum(l), 6) AS y FROM (SELECT way_id, abs(b.x - a.x) AS l, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my FROM (SELECT way_id, refs[i] AS u, refs[i + 1] AS v FROM (SELECT way_id, refs, unnest(range(1, len(refs))) AS i FROM way)) s JOIN node a ON a.id = u JOIN node b ON b.id = v) GROUP BY way_id", "way"))
def fn_points_v1(spark, d):
    """The centroids of lines."""
    line = fx.way(spark, d).select("way_id", F.posexplode("refs").alias("i", "id")).join(fx.node(spark, d), "id").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p")).where(F.size("p") > 1)
    x, y = elements.line_middle("p")
    return line.select("way_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# ---- GeoJSON

FEATURE = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<score:double,score_display:double>"
LINE = "type string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<score:double,score_display:double,weight:double>"


@BOOK.add(fx.sql(INVERSE.replace("200000.0::DOUBLE + id % 997 * 350 AS x, 4500000.0::DOUBLE + id % 613 * 600 AS y", "200000.0::DOUBLE + id % 997 * 350 - 12.5 AS x, 4500000.0::DOUBLE + id % 613 * 600 - 12.5 AS y") + "SELECT id, 5 AS corners, round(-69.0::DOUBLE + degrees(atan2(sinh(eta2), cos(xi2))), 8) AS lon, round(degrees(chi + " + " + ".join(f"{x!r}::DOUBLE * sin({2 * j} * chi)" for j, x in enumerate(DELTA, 1)) + "), 8) AS lat, id % 31 / 4.0::DOUBLE AS score FROM c", "place"))
def sink_grid_geojson(spark, d):
    cells = fx.place(spark, d).select("id", (200000.0 + F.col("id") % 997 * 350).alias("x"), (4500000.0 + F.col("id") % 613 * 600).alias("y"), (F.col("id") % 31 / 4.0).alias("score"))
    f = outputs.cell_features(cells.withColumn("shown", geo.display(F.col("score")))).withColumn("f", F.from_json("feature", FEATURE))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select("id", F.size(ring).alias("corners"), F.round(ring[0][0], 8).alias("lon"), F.round(ring[0][1], 8).alias("lat"), F.col("f.properties.score").alias("score"))


@BOOK.add(fx.sql("SELECT o, l, shop AS type FROM tagged WHERE shop IS NOT NULL", "tagged"))
def sink_poi_geojson(spark, d):
    p = fx.tagged(spark, d).withColumn("lon", F.col("o") / 1000.0).withColumn("lat", F.col("l") / 10.0)
    return outputs.poi_features(p).select("o", "l", F.get_json_object("feature", "$.properties.type").alias("type"))


@BOOK.add(fx.sql("SELECT u * 1000000 + v AS e, a.x AS x1, b.y AS y2, round(50.04::DOUBLE, 1) AS weight FROM edge1 JOIN node a ON a.id = u JOIN node b ON b.id = v", "edge"))
def sink_graph_geojson(spark, d):
    f = outputs.edge_features(edge_lines(spark, d).withColumn("weight", F.lit(50.04))).withColumn("f", F.from_json("feature", LINE))
    c = F.col("f.geometry.coordinates")
    return f.select("e", c[0][0].alias("x1"), c[1][1].alias("y2"), F.col("f.properties.weight").alias("weight"))


@BOOK.add(STREETS_SQL)
def sink_streets_geojson(spark, d):
    s = streets_of(spark, d).select("e", "i", F.floor(F.col("e") / 1000000).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("e") % 1000000).cast("double").alias("x2"), F.lit(1.0).alias("y2"), "score")
    f = outputs.segment_features(s.withColumn("shown", geo.display(F.col("score")))).withColumn("f", F.from_json("feature", LINE))
    return f.select("e", "i", F.round("f.properties.score", 6).alias("score"))


# ---- packed records


def cells(spark, d):
    return fx.grid(spark, d).select("ci", "ri", ((F.col("ci") * 7 + F.col("ri") * 3) % 97 / 8.0).alias("score"))


_CELLS = "SELECT ci, ri, (ci * 7 + ri * 3) % 97 / 8.0::DOUBLE AS score FROM grid"


@BOOK.add(fx.sql(f"SELECT CAST(ri // 16 AS BIGINT) AS part, count(*) AS n, CAST(4 * count(*) AS BIGINT) AS bytes FROM ({_CELLS}) GROUP BY 1", "grid"))
def sink_grid_bin(spark, d):
    p = outputs.packed_rows(cells(spark, d), F.floor(F.col("ri") / 16), ["ri", "ci"], ("score",))
    return p.select("part", "n", F.length("payload").cast("long").alias("bytes"))


@BOOK.add(fx.sql(f"WITH c AS ({_CELLS}), m AS (SELECT max(score) AS top, max(ri) + 1 AS rows FROM c) SELECT ri * 200 + ci AS n, round(-71.2 + (ci + 0.5::DOUBLE) * 0.2 / 200, 9) AS lon, round(42.2 + (ri + 0.5::DOUBLE) * 0.2 / rows, 9) AS lat, round(ln(1 + score) / ln(1 + top), 6) AS shown FROM c, m", "grid").replace("ri * 200 + ci AS n", "CAST(ri * 200 + ci AS BIGINT) AS n"))
def read_grid_bin(spark, d):
    """Packed scores read back and placed as a viewer does."""
    rows = fx.size(spark, d) // 50
    p = outputs.packed_rows(cells(spark, d), F.floor(F.col("ri") / 16), ["ri", "ci"], ("score",))
    s = outputs.unpacked_rows(p, ("score",)).select((F.col("part") * 3200 + F.col("i")).alias("n"), F.col("score").cast("double").alias("score"))
    lon, lat = outputs.grid_places(F.col("n"), 200, rows, -71.2, 42.2, -71.0, 42.4)
    top = s.agg(F.max("score").alias("top"))
    return s.crossJoin(F.broadcast(top)).select("n", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(outputs.shown(F.col("score"), F.col("top")), 6).alias("shown"))


def records(spark, d):
    e = edge_lines(spark, d)
    return e.select("e", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), (F.col("e") % 64 / 4.0).alias("score"))


_RECORDS = "SELECT u * 1000000 + v AS e, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, (u * 1000000 + v) % 64 / 4.0::DOUBLE AS score FROM edge1 JOIN node a ON a.id = u JOIN node b ON b.id = v"


@BOOK.add(fx.sql(f"SELECT e % 4 AS part, count(*) AS n, CAST(20 * count(*) AS BIGINT) AS bytes FROM ({_RECORDS}) GROUP BY 1", "edge"))
def sink_streets_bin(spark, d):
    p = outputs.packed_rows(records(spark, d), F.col("e") % 4, ["e"], outputs.SEGMENT)
    return p.select("part", "n", F.length("payload").cast("long").alias("bytes"))


@BOOK.add(fx.sql(f"SELECT e % 4 AS part, row_number() OVER (PARTITION BY e % 4 ORDER BY e) - 1 AS i, x1, y1, x2, y2, score FROM ({_RECORDS})", "edge"))
def read_streets_bin(spark, d):
    p = outputs.packed_rows(records(spark, d), F.col("e") % 4, ["e"], outputs.SEGMENT)
    return outputs.unpacked_rows(p, outputs.SEGMENT).select("part", "i", *[F.col(c).cast("double").alias(c) for c in outputs.SEGMENT])


@BOOK.add()
def sink_pmtiles(spark, d):
    """Tiles packed into an archive by parts of the curve, and read back from its bytes."""
    t = rendered(spark, d).withColumn("id", tiles.hilbert_id(F.col("z"), F.col("x"), F.col("y")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(i), int(z), int(x), int(y), bytes(p)) for i, z, x, y, p in pdf[["id", "z", "x", "y", "png"]].itertuples(index=False)]
        found = tiles.archive_entries(tiles.archive(rows, {"name": "scores"}))
        return pd.DataFrame([(i, len(p), (i, p) in {(r[0], r[4]) for r in rows}) for i, p in found], columns=["id", "bytes", "intact"])

    return t.groupBy(F.floor(F.col("id") / 1_000_000)).applyInPandas(pack, "id long, bytes long, intact boolean").select("id", "intact")


# ---- resumable runs


def small_world(spark, d):
    q = fx.poi(spark, d).select(F.col("k").alias("qid"), "x", "y")
    return fx.node(spark, d), fx.edge(spark, d), q, fx.poi(spark, d).withColumnRenamed("k", "pid")


@BOOK.add(fx.sql(f"{OWN_SQL} SELECT qid, score, 1 AS first, 0 AS again FROM own", "edge", "poi"))
def score_region(spark, d):
    """A run that stops after one chunk, and the next that does the rest; repeating it adds nothing: the chunks of the first and last run."""
    path, w = fresh(spark, "region"), small_world(spark, d)
    first = regional.score_region(*w, path, "s1", limit=1)
    regional.score_region(*w, path, "s1")
    again = regional.score_region(*w, path, "s1")
    return spark.read.parquet(path).select("qid", F.round("score", 6).alias("score"), F.lit(first).alias("first"), F.lit(again).alias("again"))


@BOOK.add(fx.sql(f"{OWN_SQL} SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, count(*) AS cells, count(score) AS reachable FROM own GROUP BY 1, 2", "edge", "poi"))
def sink_chunk_ckpt(spark, d):
    """What each chunk's checkpoint holds."""
    path, w = fresh(spark, "region"), small_world(spark, d)
    regional.score_region(*w, path, "s1")
    return spark.read.parquet(path).groupBy(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy")).agg(F.count("*").alias("cells"), F.count("score").alias("reachable"))


@BOOK.add()
def sink_build(spark, d):
    """A build: packed scores and a manifest that names them by content, written last."""
    path = fresh(spark, "build")
    outputs.packed_rows(cells(spark, d), F.floor(F.col("ri") / 16), ["ri", "ci"], ("score",)).write.parquet(f"{path}/scores")
    parts = spark.read.parquet(f"{path}/scores")
    manifest = parts.agg(F.lit(outputs.dataset_id(parts)).alias("dataset"), F.sum("n").alias("cells"), F.count("*").alias("parts"))
    manifest.write.json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest").select("dataset", "cells", "parts")


@BOOK.add()
def sink_export_region(spark, d):
    """Blocks, tiles of two zooms and their checksums, listed in one inventory."""
    from netdensity.operators import raster
    from netdensity.plans.raster_queries import first_region

    b = raster.blocks(first_region(spark, d), 64).select(F.lit("block").alias("kind"), F.concat_ws("/", "bx", "by").alias("path"), F.length("payload").alias("bytes"), "sha256")
    t = rendered(spark, d)
    both = t.union(tiles.parents(t)).select(F.lit("tile").alias("kind"), F.concat_ws("/", "z", "x", "y").alias("path"), F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha256"))
    return b.union(both)


@BOOK.add("SELECT l_suppkey AS job, count(*) AS cells, round(sum(l_quantity), 3) AS total FROM lineitem GROUP BY 1")
def stream_jobs(spark, d):
    """Order lines as a stream of files, summed up job by job in batches that restart safely."""
    from netdensity.streaming import jobs

    path = fresh(spark, "stream")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    li.repartition(3).write.parquet(f"{path}/in")
    work = lambda df: df.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    jobs.available(spark, f"{path}/in", "l_suppkey long, l_quantity double", work, f"{path}/out", f"{path}/state")
    jobs.available(spark, f"{path}/in", "l_suppkey long, l_quantity double", work, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy(F.col("l_suppkey").alias("job")).agg(F.sum("n").alias("cells"), F.round(F.sum("q"), 3).alias("total"))


@BOOK.add(fx.sql("SELECT 'cells' AS file, count(*) AS n, count(*) AS counted FROM grid UNION ALL SELECT 'graph', count(*), count(*) FROM edge1 UNION ALL SELECT 'pois', count(*), count(*) FROM tagged WHERE shop IS NOT NULL UNION ALL SELECT 'scores', count(*), count(*) FROM grid", "grid", "edge", "tagged"))
def sink_write_output(spark, d):
    """A whole result, written and read back: what each file holds, and what the metadata say that it holds."""
    path = fresh(spark, "output")
    own = cells(spark, d).withColumn("x", F.col("ci") * 25.0 + 200_000).withColumn("y", F.col("ri") * 25.0 + 4_500_000).withColumn("shown", geo.display(F.col("score")))
    pois = fx.tagged(spark, d).withColumn("lon", F.col("o") / 1000.0).withColumn("lat", F.col("l") / 10.0)
    features = {"cells": outputs.cell_features(own), "pois": outputs.poi_features(pois), "graph": outputs.edge_features(edge_lines(spark, d).withColumn("weight", F.lit(50.0)))}
    outputs.write_output(path, features, {"scores": outputs.packed_rows(own, F.floor(F.col("ri") / 16), ["ri", "ci"], ("score",))}, {"crs": "EPSG:4326"})
    counted = spark.read.text(f"{path}/metadata.json").select(F.explode(F.from_json(F.get_json_object("value", "$.counts"), "map<string,long>")).alias("file", "counted"))
    read = None
    for name in features:
        kind = F.get_json_object("value", "$.type") == "Feature"
        one = spark.read.text(f"{path}/{name}.geojsonl").where(kind).agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n")
        read = one if read is None else read.union(one)
    scores = outputs.unpacked_rows(spark.read.parquet(f"{path}/scores.bin"), ("score",)).agg(F.count("*").alias("n")).select(F.lit("scores").alias("file"), "n")
    return read.union(scores).join(counted, "file").select("file", "n", "counted")


# ---- repairs

_ACTIONS = (*provenance.ROW_CHANGES, *provenance.SHAPE_CHANGES, "read")
_TABLES = ("edges", "member_bounds", "metadata", "vertices")


@BOOK.add("SELECT a AS action, t AS \"table\", CASE WHEN a IN ('insert', 'update', 'delete') THEN t IN ('member_bounds', 'metadata') ELSE a = 'read' END AS allowed FROM (SELECT unnest([" + ", ".join(f"'{a}'" for a in _ACTIONS) + "]) AS a) CROSS JOIN (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TABLES) + "]) AS t)")
def prov_authorizer(spark, d):
    """What a repair may do to which table."""
    asked = spark.createDataFrame([(a, t) for a in _ACTIONS for t in _TABLES], "action string, table string")
    return asked.select("action", "table", provenance.allowed(F.col("action"), F.col("table")).alias("allowed"))


def bounds_of(spark, d, known: bool):
    """Bounds of the customers that are known members, or of those that are not."""
    test = "c_custkey % 35 <> 0" if known else "c_custkey % 35 = 0"
    return table(spark, d, "customer").where(test).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("k"), (F.col("c_custkey") % 180).cast("double").alias("w"))


def unresolved_of(rel, bounds):
    """(id, ref) of relations' members that neither are relations nor have bounds."""
    known = rel.select(F.col("rid").alias("k")).union(bounds.select("k"))
    return rel.join(known, rel.ref == known.k, "left_anti").select(F.col("rid").alias("id"), "ref")


@BOOK.add(fx.sql("SELECT 'c' || c_custkey AS k, c_custkey % 35 = 0 AS added, (SELECT count(*) FROM relation) AS edges, (SELECT count(*) FROM relation WHERE ref NOT IN (SELECT rid FROM relation) AND ref NOT LIKE 'c%') AS unresolved FROM customer WHERE c_custkey % 35 <> 0 OR 'c' || c_custkey IN (SELECT ref FROM relation)", "relation"))
def prov_repair(spark, d):
    """Bounds after a repair, those that it added, the untouched relations, and what is left unresolved."""
    rel, store = fx.relation(spark, d), provenance.Store(spark, fresh(spark, "store"))
    before = store.create({"edges": rel, "member_bounds": bounds_of(spark, d, True), "metadata": spark.createDataFrame([("complete", "false")], "k string, value string")})
    lost = unresolved_of(rel, store.table(before, "member_bounds")).select(F.col("ref").alias("k")).distinct()
    found = bounds_of(spark, d, False).join(lost, "k", "left_semi")
    after = store.repair(before, {"member_bounds": store.table(before, "member_bounds").union(found), "metadata": spark.createDataFrame([("complete", "true")], "k string, value string")})
    bounds, edges = store.table(after, "member_bounds"), store.table(after, "edges")
    old = store.table(before, "member_bounds").select("k", F.lit(False).alias("old"))
    left = unresolved_of(edges, bounds).agg(F.count("*").alias("unresolved"))
    return bounds.select("k").join(old, "k", "left").select("k", F.coalesce("old", F.lit(True)).alias("added")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(left))


_CASES = {"intact": (), "another extract": ("extract",), "another import": ("identity",), "another snapshot": ("snapshot",), "a changed report": ("report", "complete"), "a root too few": ("report", "roots")}


@BOOK.add("SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{check}', {str(check not in failed).lower()})" for case, failed in _CASES.items() for check in ("complete", "extract", "identity", "report", "roots", "snapshot")) + ") AS t(\"case\", \"check\", ok)")
def prov_relation_proof(spark, d):
    """The checks of a completion's proof, as it is and after each kind of tampering."""
    extract = fx.relation(spark, d)
    unresolved = unresolved_of(extract, bounds_of(spark, d, True)).select("id").distinct()
    report = unresolved.withColumn("complete", F.lit(True))
    proof = {"report": provenance.content(report), "extract": provenance.content(extract), "identity": "i", "snapshot": "s"}
    least = report.agg(F.min("id").alias("m"))
    marked = report.crossJoin(F.broadcast(least))
    runs = {
        "intact": (report, extract, "i", "s"), "another extract": (report, extract.union(spark.createDataFrame([("r9", "x")], "rid string, ref string")), "i", "s"),
        "another import": (report, extract, "j", "s"), "another snapshot": (report, extract, "i", "t"),
        "a changed report": (marked.select("id", (F.col("id") != F.col("m")).alias("complete")), extract, "i", "s"), "a root too few": (marked.where("id <> m").select("id", "complete"), extract, "i", "s"),
    }
    out = None
    for case, (r, e, i, s) in runs.items():
        one = provenance.proof_checks(proof, r, e, unresolved, i, s).select(F.lit(case).alias("case"), "check", "ok")
        out = one if out is None else out.union(one)
    return out
