"""Grids, rasters, tiles, polygons and point lookups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.functions import geo
from netdensity.operators import raster, spatial, tiles
from netdensity.plans import fixtures as fx
from netdensity.plans.book import Book
from netdensity.plans.scalar_queries import COLOUR_SQL
from netdensity.session import materialize, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

# ---- grids and jobs


def span(spark, d):
    return 5000.0, float(fx.size(spark, d) // 2)


_SPAN = "s AS (SELECT 5000.0::DOUBLE AS w, CAST(count(*) // 2 AS DOUBLE) AS h FROM orders)"


@BOOK.add(f"WITH {_SPAN}, i AS (SELECT unnest(range(CAST(ceil(w / 40) AS BIGINT) * CAST(ceil(h / 40) AS BIGINT))) AS i, CAST(ceil(w / 40) AS BIGINT) AS cols FROM s) SELECT i // cols AS row, i % cols AS col, 300000.0::DOUBLE + i % cols * 40 AS x, 4600000.0::DOUBLE + i // cols * 40 AS y FROM i")
def grid_v1(spark, d):
    w, h = span(spark, d)
    return raster.corner_grid(spark, 300000.0, 4600000.0, 300000.0 + w, 4600000.0 + h, 40.0)


_LATTICE = f"WITH {_SPAN}, b AS (SELECT 301.0::DOUBLE AS x0, 203.0::DOUBLE AS y0, w - 77 AS x1, h - 41 AS y1 FROM s), l AS (SELECT CAST(floor(x0 / 25) AS BIGINT) AS c0, CAST(floor(y0 / 25) AS BIGINT) AS r0, CAST(ceil(x1 / 25) - floor(x0 / 25) AS BIGINT) AS cols, CAST(ceil(y1 / 25) - floor(y0 / 25) AS BIGINT) AS rows FROM b), g AS (SELECT unnest(range(rows * cols)) AS i, cols, c0, r0 FROM l), cell AS (SELECT i // cols AS row, i % cols AS col, (c0 + i % cols + 0.5::DOUBLE) * 25 AS x, (r0 + i // cols + 0.5::DOUBLE) * 25 AS y FROM g)"


def lattice(spark, d):
    w, h = span(spark, d)
    return raster.lattice(spark, 301.0, 203.0, w - 77, h - 41)


@BOOK.add(f"{_LATTICE} SELECT row, col, x, y FROM cell")
def grid_build(spark, d):
    return lattice(spark, d)


@BOOK.add(fx.sql("SELECT CAST(floor(min(x) / 25) * 25 AS DOUBLE) AS x0, CAST(floor(min(y) / 25) * 25 AS DOUBLE) AS y0, CAST(ceil(max(y) / 25) - floor(min(y) / 25) AS BIGINT) AS rows, CAST(ceil(max(x) / 25) - floor(min(x) / 25) AS BIGINT) AS cols FROM poi", "poi"))
def grid_covering(spark, d):
    low, high = lambda c: F.floor(F.min(c) / 25), lambda c: F.ceil(F.max(c) / 25)
    return fx.poi(spark, d).agg((low("x") * 25).cast("double").alias("x0"), (low("y") * 25).cast("double").alias("y0"), (high("y") - low("y")).cast("long").alias("rows"), (high("x") - low("x")).cast("long").alias("cols"))


_JOBS = f"{_LATTICE}, j AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1, count(*) AS cells FROM cell GROUP BY 1, 2)"


@BOOK.add(f"{_JOBS} SELECT cx, cy, r0, r1, c0, c1, cells FROM j")
def grid_jobs(spark, d):
    return raster.jobs(lattice(spark, d))


@BOOK.add(f"{_JOBS} SELECT row, col, x, y FROM cell WHERE floor(x / 2000) = 1 AND floor(y / 2000) = 0")
def grid_queries(spark, d):
    return lattice(spark, d).where("floor(x / 2000) = 1 and floor(y / 2000) = 0")


@BOOK.add(f"{_JOBS} SELECT (SELECT count(*) FROM cell) AS cells, (SELECT count(*) FROM cell) * 4 AS bytes, count(*) AS jobs, max(cells) AS largest, (SELECT count(*) FROM cell) * 625.0::DOUBLE AS area FROM j")
def grid_plan(spark, d):
    return raster.jobs(lattice(spark, d)).agg(F.sum("cells").alias("cells"), (F.sum("cells") * 4).alias("bytes"), F.count("*").alias("jobs"), F.max("cells").alias("largest"), (F.sum("cells") * 625.0).alias("area"))


@BOOK.add(f"{_JOBS} SELECT cx, cy FROM j ORDER BY cx, cy LIMIT 3")
def min_job_limit(spark, d):
    return raster.jobs(lattice(spark, d)).select("cx", "cy").orderBy("cx", "cy").limit(3)


@BOOK.add(fx.sql(_JOBS + ", named AS (SELECT k, CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy FROM poi) SELECT named.k, cx, cy, j.cells IS NOT NULL AS planned FROM named LEFT JOIN j USING (cx, cy)", "poi"))
def min_sample_jobs(spark, d):
    named = fx.poi(spark, d).select("k", F.floor(F.col("x") / 2000).alias("cx"), F.floor(F.col("y") / 2000).alias("cy"))
    return named.join(raster.jobs(lattice(spark, d)).select("cx", "cy", "cells"), ["cx", "cy"], "left").select("k", "cx", "cy", F.col("cells").isNotNull().alias("planned"))


# ---- rasters


def first_region(spark, d):
    return fx.raster(spark, d).where("region = 0").select("row", "col", "score")


@BOOK.add(fx.sql("SELECT row, col, score FROM raster WHERE region = 0 AND row BETWEEN 5 AND 40 AND col BETWEEN 10 AND 60", "raster"))
def src_raster(spark, d):
    return first_region(spark, d).where("row between 5 and 40 and col between 10 and 60")


@BOOK.add(fx.sql("SELECT p.k, r.score FROM poi p LEFT JOIN raster r ON r.region = 0 AND r.row = CAST(floor(p.y / 25) AS BIGINT) AND r.col = CAST(floor(p.x / 25) AS BIGINT)", "poi", "raster"))
def join_sample_raster(spark, d):
    return raster.sample(fx.poi(spark, d), first_region(spark, d), F.col("x"), F.col("y")).select("k", "score")


@BOOK.add(fx.sql("SELECT col // 64 AS bx, row // 64 AS by, CAST(count(*) AS INTEGER) AS cells FROM raster WHERE region = 0 AND score IS NOT NULL GROUP BY 1, 2", "raster").replace('"raster" AS', '"raster" AS').replace("AS b_y,", "AS b_y,").replace("SELECT col // 64 AS bx, row // 64 AS b_y", 'SELECT col // 64 AS bx, row // 64 AS "by"'))
def raster_blocks(spark, d):
    return raster.blocks(first_region(spark, d), 64).select("bx", "by", "cells")


@BOOK.add(fx.sql("SELECT row, col, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score FROM raster WHERE region = 0 AND score IS NOT NULL", "raster"))
def src_raw_block(spark, d):
    """Blocks packed, checked and read back."""
    return raster.unpacked(raster.blocks(first_region(spark, d), 64), 64).select("row", "col", F.col("score").cast("double").alias("score"))


@BOOK.add(fx.sql("SELECT col // 64 AS bx, CAST(sum(CASE WHEN score IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM raster WHERE region = 1 AND score IS NOT NULL GROUP BY 1", "raster"))
def sink_raw_parts(spark, d):
    return raster.blocks(fx.raster(spark, d).where("region = 1").select("row", "col", "score"), 64).groupBy("bx").agg(F.sum("cells").alias("cells"))


@BOOK.add()
def min_gzip_trial(spark, d):
    import zlib

    @F.pandas_udf("long")
    def packed_size(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: len(zlib.compress(x, 6)))

    return raster.blocks(first_region(spark, d), 64).select("bx", "by", F.length("payload").alias("raw"), packed_size("payload").alias("packed"))


@BOOK.add(fx.sql("SELECT row, col, coalesce(max(score) FILTER (region = 0), max(score) FILTER (region = 1)) AS score FROM raster GROUP BY 1, 2", "raster"))
def raster_assemble(spark, d):
    r = fx.raster(spark, d)
    return raster.assembled([r.where("region = 0"), r.where("region = 1")])


@BOOK.add(fx.sql("SELECT a.row, a.col FROM raster a JOIN raster b ON a.region = 0 AND b.region = 1 AND a.row = b.row AND a.col = b.col WHERE CAST(a.score * 1.1::DOUBLE AS FLOAT) IS NOT DISTINCT FROM CAST((b.score - 0.5) * 1.1::DOUBLE AS FLOAT)", "raster"))
def min_exact_f32(spark, d):
    r = fx.raster(spark, d)
    b = r.where("region = 1").select("row", "col", F.col("score").alias("other"))
    return r.where("region = 0").join(b, ["row", "col"]).where((F.col("score") * 1.1).cast("float").eqNullSafe(((F.col("other") - 0.5) * 1.1).cast("float"))).select("row", "col")


@BOOK.add(fx.sql("SELECT region, round(count(score) / count(*), 6) AS fraction, round(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) / nullif(count(score), 0), 6) AS positive FROM raster GROUP BY region", "raster"))
def min_coverage_fraction(spark, d):
    positive = F.sum((F.coalesce(F.col("score") > 0, F.lit(False))).cast("int"))
    return fx.raster(spark, d).groupBy("region").agg(F.round(F.count("score") / F.count("*"), 6).alias("fraction"), F.round(F.try_divide(positive, F.count("score")), 6).alias("positive"))


@BOOK.add(fx.sql("WITH k AS (SELECT *, CASE WHEN score IS NULL THEN 'nodata' WHEN score = 0 THEN 'zero' ELSE 'positive' END AS kind FROM raster WHERE region = 0) SELECT kind, min(row * 1000 + col) AS first FROM k GROUP BY kind", "raster"))
def min_first_by_kind(spark, d):
    kind = F.when(F.col("score").isNull(), "nodata").when(F.col("score") == 0, "zero").otherwise("positive")
    return first_region(spark, d).withColumn("kind", kind).groupBy("kind").agg(F.min(F.col("row") * 1000 + F.col("col")).alias("first"))


# ---- tiles


def sample_pixels(spark, d):
    """Pixels of zoom-14 tiles over a part of the raster, each with its cell's score: one pixel a cell."""
    r = first_region(spark, d)
    return r.select((F.floor(F.col("col") / 256) + 4800).alias("tx"), (F.floor(F.col("row") / 256) + 6000).alias("ty"), (F.col("col") % 256).cast("int").alias("px"), (F.col("row") % 256).cast("int").alias("py"), "score")


@BOOK.add(fx.sql("SELECT col // 256 + 4800 AS tx, row // 256 + 6000 AS ty, CAST(col % 256 AS INTEGER) AS px, CAST(row % 256 AS INTEGER) AS py, score FROM raster WHERE region = 0", "raster"))
def tile_sample_rows(spark, d):
    return sample_pixels(spark, d)


def rendered(spark, d):
    return materialize(tiles.render(sample_pixels(spark, d), 14))


def tile_sizes(df):
    @F.pandas_udf("long")
    def opaque(data: pd.Series) -> pd.Series:
        return data.map(lambda x: int((tiles.pixels(x)[..., 3] > 0).sum()))

    return df.select("z", "x", "y", opaque("png").alias("opaque"))


@BOOK.add(fx.sql("SELECT 14 AS z, col // 256 + 4800 AS x, row // 256 + 6000 AS y, count(score) AS opaque FROM raster WHERE region = 0 GROUP BY 2, 3 HAVING count(score) > 0", "raster"))
def tile_render(spark, d):
    """Tiles drawn and read back."""
    return tile_sizes(rendered(spark, d))


@BOOK.add()
def tile_pyramid(spark, d):
    level, out = rendered(spark, d), None
    for _ in range(3):
        level = materialize(tiles.parents(level))
        out = level if out is None else out.union(level)
    return tile_sizes(out)


@BOOK.add()
def tile_overviews(spark, d):
    level = rendered(spark, d)
    for _ in range(2):
        level = materialize(tiles.parents(level))
    return tile_sizes(tiles.parents(level))


@BOOK.add(fx.sql("SELECT x, y, unnest(list_transform(range(0, 5), lambda u: 14 - u)) AS z0 FROM tile_key", "tile_key").replace("SELECT x, y, unnest(list_transform(range(0, 5), lambda u: 14 - u)) AS z0 FROM tile_key", "SELECT DISTINCT 14 - u AS z, x // (1 << u) AS x, y // (1 << u) AS y FROM tile_key, (SELECT unnest(range(5)) AS u)"))
def tile_parents(spark, d):
    return tiles.parent_keys(fx.tile_key(spark, d), 4)


@BOOK.add(fx.sql("SELECT z, y, min(x) AS lo, max(x) AS hi FROM (SELECT z, y, x, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS run FROM tile_key) GROUP BY z, y, run", "tile_key"))
def tile_compact(spark, d):
    return tiles.compact(fx.tile_key(spark, d))


@BOOK.add(ORACLES["tile_compact"])
def win_islands(spark, d):
    return tiles.compact(fx.tile_key(spark, d))


@BOOK.add(fx.sql("SELECT z, x, y FROM tile_key", "tile_key"))
def tile_expand_check(spark, d):
    """The runs expanded again; equal to the keys that they were made of."""
    return tiles.expanded(tiles.compact(fx.tile_key(spark, d)))


_HILBERT = "h(z, x, y, cx, cy, d, k) AS (SELECT z, x, y, x, y, 0::BIGINT, z - 1 FROM tile_key UNION ALL SELECT z, x, y, CASE WHEN cy & (1 << k) = 0 THEN CASE WHEN cx & (1 << k) > 0 THEN (1 << k) - 1 - cy ELSE cy END ELSE cx END, CASE WHEN cy & (1 << k) = 0 THEN CASE WHEN cx & (1 << k) > 0 THEN (1 << k) - 1 - cx ELSE cx END ELSE cy END, d + (1 << k) * (1 << k) * xor(3 * CAST(cx & (1 << k) > 0 AS BIGINT), CAST(cy & (1 << k) > 0 AS BIGINT)), k - 1 FROM h WHERE k >= 0)"


@BOOK.add(fx.sql(f"WITH RECURSIVE {_HILBERT} SELECT z, x, y, d + 89478485 AS id FROM h WHERE k < 0", "tile_key"))
def tile_hilbert(spark, d):
    z, x, y = (F.col(c) for c in "zxy")
    return fx.tile_key(spark, d).select("z", "x", "y", tiles.hilbert_id(z, x, y).alias("id"))


@BOOK.add(fx.sql("WITH v AS (SELECT row, col, region, CASE WHEN score IS NOT NULL THEN least(greatest(ln(1 + score) / ln(31.0::DOUBLE), 0.0), 1.0) END AS v FROM raster), m AS (SELECT row, col, max(CASE WHEN region = 0 THEN v END) AS a0, max(CASE WHEN region = 1 THEN v END) AS b0 FROM v GROUP BY 1, 2), t AS (SELECT row, col, coalesce(a0, b0) AS v, CAST(least(floor(coalesce(a0, b0) * 6), 5) AS INTEGER) AS lo FROM m) SELECT row, col, " + COLOUR_SQL + " FROM t", "raster"))
def tile_composite(spark, d):
    """Pixel by pixel the first region that is not transparent, never blended."""
    r = fx.raster(spark, d).withColumn("v", geo.display(F.col("score")))
    both = r.where("region = 0").select("row", "col", *[c.alias(f"a{k}") for k, c in enumerate(geo.colour(F.col("v")))]).join(r.where("region = 1").select("row", "col", *[c.alias(f"b{k}") for k, c in enumerate(geo.colour(F.col("v")))]), ["row", "col"], "full")
    first = F.coalesce(F.col("a3") > 0, F.lit(False))
    return both.select("row", "col", *[F.coalesce(F.when(first, F.col(f"a{k}")).otherwise(F.col(f"b{k}")), F.lit(0)).alias(n) for k, n in enumerate("rgba")])


@BOOK.add(fx.sql("SELECT row, col, a FROM (SELECT row, col, CASE WHEN score IS NULL THEN 0 ELSE 210 END AS a FROM raster WHERE region = 0) ORDER BY a DESC, row, col LIMIT 1", "raster"))
def min_pixel_example(spark, d):
    return first_region(spark, d).select("row", "col", F.when(F.col("score").isNull(), 0).otherwise(210).alias("a")).orderBy(F.desc("a"), "row", "col").limit(1)


_OCC = "SELECT DISTINCT col // 64 AS x, row // 64 AS y FROM raster WHERE score IS NOT NULL"


@BOOK.add(fx.sql(f"SELECT DISTINCT col // 64 AS x, row // 64 AS y FROM raster WHERE region = 1 AND score IS NOT NULL AND (col // 64, row // 64) NOT IN (SELECT (col // 64, row // 64) FROM raster WHERE region = 0 AND score IS NOT NULL)", "raster"))
def tile_verify_cover(spark, d):
    """Cells with a value whose tile the other region lacks."""
    key = [F.floor(F.col("col") / 64).alias("x"), F.floor(F.col("row") / 64).alias("y")]
    r = fx.raster(spark, d).where("score is not null")
    return r.where("region = 1").select(*key).distinct().join(r.where("region = 0").select(*key).distinct(), ["x", "y"], "left_anti")


@BOOK.add()
def tile_verify_pixels(spark, d):
    """Tiles whose pixels differ from a second computation by column expressions: none."""
    r, g, b, a = geo.colour(F.col("v"))
    expected = sample_pixels(spark, d).withColumn("v", geo.display(F.col("score"))).select("tx", "ty", "px", "py", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))

    def read(it):
        for pdf in it:
            for x, y, data in pdf[["x", "y", "png"]].itertuples(index=False):
                p = tiles.pixels(data)
                py, px = (p[..., 3] >= 0).nonzero()
                yield pd.DataFrame({"tx": x, "ty": y, "px": px.astype("int32"), "py": py.astype("int32"), **{f"q{c}": p[py, px, k].astype("int32") for k, c in enumerate("rgba")}})

    drawn = rendered(spark, d).mapInPandas(read, "tx long, ty long, px int, py int, qr int, qg int, qb int, qa int")
    off = expected.join(drawn, ["tx", "ty", "px", "py"]).where(" or ".join(f"abs({c} - q{c}) > 1" for c in "rgba"))
    return off.groupBy("tx", "ty").agg(F.count("*").alias("wrong"))


@BOOK.add(fx.sql("SELECT x, count(*) AS tiles FROM tile_key WHERE x NOT IN (SELECT DISTINCT 4800 + p_size FROM part WHERE p_size % 3 = 0) GROUP BY x", "tile_key"))
def tile_restore(spark, d):
    """Columns of tiles that no finished checkpoint covers."""
    done = table(spark, d, "part").where("p_size % 3 = 0").select((4800 + F.col("p_size")).cast("long").alias("x")).distinct()
    return fx.tile_key(spark, d).join(done, "x", "left_anti").groupBy("x").agg(F.count("*").alias("tiles"))


_PLACE_TILE = "CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS y"


@BOOK.add(fx.sql(f"WITH p AS (SELECT id, {_PLACE_TILE} FROM place) SELECT DISTINCT x + dx.i AS x, y + dy.i AS y FROM p, (VALUES (-1), (0), (1)) AS dx(i), (VALUES (-1), (0), (1)) AS dy(i)", "place"))
def flt_tile_candidates(spark, d):
    """Tiles that a place may touch: its own and one around."""
    x, y = geo.tile_coordinate(F.col("lon"), F.col("lat"), 14)
    around = lambda c: F.explode(F.sequence(F.floor(c) - 1, F.floor(c) + 1))
    return fx.place(spark, d).select(around(x).alias("x"), y.alias("ty")).select("x", around(F.col("ty")).alias("y")).distinct()


@BOOK.add(fx.sql("SELECT col // 8 AS x, row // 8 AS y, count(score) AS n FROM raster WHERE region = 0 GROUP BY 1, 2 HAVING count(score) > 45", "raster"))
def flt_empty_tile(spark, d):
    return first_region(spark, d).groupBy(F.floor(F.col("col") / 8).alias("x"), F.floor(F.col("row") / 8).alias("y")).agg(F.count("score").alias("n")).where("n > 45")


@BOOK.add(fx.sql("SELECT p.id, p.x, p.y FROM (SELECT id, 4790 + id % 130 AS x, 5995 + id % 71 AS y FROM place) p WHERE NOT EXISTS (SELECT 1 FROM tile_key t WHERE t.x = p.x AND t.y = p.y)", "place", "tile_key"))
def min_absent_tiles(spark, d):
    asked = fx.place(spark, d).select("id", (4790 + F.col("id") % 130).alias("x"), (5995 + F.col("id") % 71).alias("y"))
    return asked.join(fx.tile_key(spark, d).select("x", "y"), ["x", "y"], "left_anti").select("id", "x", "y")


@BOOK.add(fx.sql("SELECT p.id, CASE WHEN t.z IS NULL THEN 'transparent' ELSE '14/' || p.x || '/' || p.y END AS tile FROM (SELECT id, 4790 + id % 130 AS x, 5995 + id % 71 AS y FROM place) p LEFT JOIN tile_key t ON t.x = p.x AND t.y = p.y", "place", "tile_key"))
def min_tile_available(spark, d):
    asked = fx.place(spark, d).select("id", (4790 + F.col("id") % 130).alias("x"), (5995 + F.col("id") % 71).alias("y"))
    return asked.join(fx.tile_key(spark, d), ["x", "y"], "left").select("id", F.when(F.col("z").isNull(), "transparent").otherwise(F.concat_ws("/", F.lit(14), "x", "y")).alias("tile"))


PARTS = ((5, 12, "overview"), (13, 13, "z13"), (14, 14, "z14"))
_PARTS = "(VALUES (5, 12, 'overview'), (13, 13, 'z13'), (14, 14, 'z14')) AS part(lo, hi, name)"


@BOOK.add(f"SELECT o_orderkey AS id, part.name AS part FROM (SELECT o_orderkey, o_orderkey % 20 AS zoom FROM orders) o LEFT JOIN {_PARTS} ON o.zoom BETWEEN part.lo AND part.hi")
def min_part_for_zoom(spark, d):
    z = F.col("o_orderkey") % 20
    part = F.lit(None).cast("string")
    for lo, hi, name in PARTS:
        part = F.when(z.between(lo, hi), name).otherwise(part)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), part.alias("part"))


_ASKED = "a AS (SELECT o_orderkey AS id, 14::BIGINT AS z, 4795 + o_orderkey % 110 AS x, 5998 + o_orderkey // 110 % 70 AS y FROM orders)"
_RUNS = "run AS (SELECT z, y, min(x) AS lo, max(x) AS hi FROM (SELECT z, y, x, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS r FROM tile_key) GROUP BY z, y, r)"


def asked(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.lit(14).cast("long").alias("z"), (4795 + k % 110).alias("x"), (5998 + F.floor(k / 110) % 70).alias("y"))


def routed(spark, d):
    """The runs of each row of tiles as one array."""
    return tiles.compact(fx.tile_key(spark, d)).groupBy("z", "y").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


@BOOK.add(fx.sql(f"WITH {_RUNS}, {_ASKED} SELECT id, EXISTS (SELECT 1 FROM run WHERE run.z = a.z AND run.y = a.y AND a.x BETWEEN lo AND hi) AS found FROM a", "tile_key"))
def query_has_tile(spark, d):
    joined = asked(spark, d).join(routed(spark, d), ["z", "y"], "left")
    return joined.select("id", F.coalesce(F.exists("runs", lambda r: F.col("x").between(r["lo"], r["hi"])), F.lit(False)).alias("found"))


@BOOK.add(fx.sql(f"WITH {_RUNS}, {_ASKED} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM run WHERE run.y = a.y AND a.x BETWEEN lo AND hi) THEN CASE WHEN (a.x + a.y) % 5 = 0 THEN 'composite' ELSE 'first' END WHEN EXISTS (SELECT 1 FROM tile_key t WHERE t.x = a.x - 3 AND t.y = a.y) THEN 'second' ELSE 'empty' END AS owner FROM a", "tile_key"))
def query_tile_owner(spark, d):
    """Composite tiles first, then the regions in order, then nothing."""
    keys = fx.tile_key(spark, d)
    shared = keys.where("(x + y) % 5 = 0").select("z", "x", "y", F.lit(0).alias("p"), F.lit("composite").alias("owner"))
    own = keys.select("z", "x", "y", F.lit(1).alias("p"), F.lit("first").alias("owner"))
    other = keys.select("z", (F.col("x") + 3).alias("x"), "y", F.lit(2).alias("p"), F.lit("second").alias("owner"))
    best = shared.union(own).union(other).groupBy("z", "x", "y").agg(F.min_by("owner", "p").alias("owner"))
    return asked(spark, d).join(best, ["z", "x", "y"], "left").select("id", F.coalesce("owner", F.lit("empty")).alias("owner"))


# ---- polygons and point lookups

CROSS = "c AS (SELECT p.pid, r.poly, r.ring, abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= 1e-12 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AS on_edge, ((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 AS hit FROM pt p JOIN ring r ON y BETWEEN least(y1, y2) AND greatest(y1, y2)), per AS (SELECT pid, poly, ring, count(*) FILTER (hit) % 2 = 1 AS inside, bool_or(on_edge) AS edge FROM c GROUP BY 1, 2, 3), cov AS (SELECT pid, poly FROM per GROUP BY 1, 2 HAVING bool_or(ring = 0 AND (inside OR edge)) AND NOT bool_or(ring > 0 AND inside AND NOT edge))"
_PT = "pt AS (SELECT k AS pid, x, y FROM poi)"


def points(spark, d):
    return fx.poi(spark, d).select(F.col("k").alias("pid"), "x", "y")


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS} SELECT pid, poly FROM cov", "poi", "ring"))
def flt_pip(spark, d):
    return spatial.covered(points(spark, d), fx.ring(spark))


@BOOK.add(fx.sql(f"WITH pt AS (SELECT ri * 200 + ci AS pid, x - 12.5 AS x, y - 12.5 AS y FROM grid), {CROSS} SELECT CAST(pid AS BIGINT) AS pid, count(*) AS polygons FROM cov GROUP BY pid", "grid", "ring"))
def flt_pip_js(spark, d):
    """Lattice corners, many of them right on an edge, which counts as covered."""
    p = fx.grid(spark, d).select((F.col("ri") * 200 + F.col("ci")).cast("long").alias("pid"), (F.col("x") - 12.5).alias("x"), (F.col("y") - 12.5).alias("y"))
    return spatial.covered(p, fx.ring(spark)).groupBy("pid").agg(F.count("*").alias("polygons"))


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS} SELECT p.pid, bool_or(cov.poly IS NOT NULL) AS covered FROM pt p LEFT JOIN cov USING (pid) GROUP BY p.pid", "poi", "ring"))
def geo_union(spark, d):
    p = points(spark, d)
    hit = spatial.covered(p, fx.ring(spark)).select("pid").distinct().withColumn("c", F.lit(True))
    return p.join(hit, "pid", "left").select("pid", F.coalesce("c", F.lit(False)).alias("covered"))


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS} SELECT pid FROM per WHERE poly = 0 GROUP BY pid HAVING bool_or(ring = 0 AND inside) AND NOT bool_or(ring = 1 AND (inside OR edge))", "poi", "ring"))
def geo_difference(spark, d):
    per = spatial.crossings(points(spark, d), fx.ring(spark).where("poly = 0"), ["poly", "ring"])
    return per.groupBy("pid").agg(F.bool_or((F.col("ring") == 0) & F.col("inside")).alias("i"), F.bool_or((F.col("ring") == 1) & (F.col("inside") | F.col("edge"))).alias("h")).where("i and not h").select("pid")


_DIST = "dist AS (SELECT pid, min(sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2)) AS d FROM (SELECT *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) AS t FROM pt, ring) GROUP BY pid)"


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS}, {_DIST} SELECT pid, round(CASE WHEN pid IN (SELECT pid FROM cov) THEN 0 ELSE d END, 6) AS d FROM dist", "poi", "ring"))
def geo_distance(spark, d):
    return spatial.ring_distance(points(spark, d), fx.ring(spark)).select("pid", F.round("d", 6).alias("d"))


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS}, {_DIST} SELECT pid FROM dist WHERE d <= 100 OR pid IN (SELECT pid FROM cov)", "poi", "ring"))
def geo_buffer(spark, d):
    return spatial.ring_distance(points(spark, d), fx.ring(spark)).where("d <= 100").select("pid")


@BOOK.add(fx.sql("SELECT poly, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END), 4) AS area FROM (SELECT poly, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM ring GROUP BY 1, 2) GROUP BY poly", "ring"))
def geo_area(spark, d):
    return spatial.ring_area(fx.ring(spark)).select("poly", F.round("area", 4).alias("area"))


@BOOK.add(fx.sql(f"WITH {_PT}, {CROSS} SELECT bool_and(pid IN (SELECT pid FROM cov)) AS all_covered, count(*) AS points, CAST(sum(CASE WHEN pid IN (SELECT pid FROM cov) THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM pt", "poi", "ring"))
def min_covers(spark, d):
    p = points(spark, d)
    hit = spatial.covered(p, fx.ring(spark)).select("pid").distinct().withColumn("c", F.lit(1))
    return p.join(hit, "pid", "left").agg(F.bool_and(F.col("c").isNotNull()).alias("all_covered"), F.count("*").alias("points"), F.count("c").alias("covered"))


_JOBBOX = "box AS (SELECT unnest(range(10)) AS cx, 0 AS z), jb AS (SELECT cx, cy, cx * 500.0::DOUBLE AS w, cy * 500.0::DOUBLE AS s FROM box, (SELECT unnest(range(7)) AS cy))"


def job_boxes(spark):
    return spark.range(70).select((F.col("id") % 10).alias("cx"), F.floor(F.col("id") / 10).alias("cy")).withColumn("w", F.col("cx") * 500.0).withColumn("s", F.col("cy") * 500.0)


@BOOK.add(fx.sql(f"WITH {_JOBBOX}, pt AS (SELECT cx * 100 + cy AS pid, w + a.i * 500 AS x, s + b.i * 500 AS y FROM jb, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(i)), pt2 AS (SELECT pid, x, y FROM pt), c AS (SELECT p.pid, p.x, p.y, r.poly, r.ring, ((y1 > p.y) <> (y2 > p.y)) AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1 AS hit FROM pt2 p JOIN ring r ON p.y BETWEEN least(y1, y2) AND greatest(y1, y2)), corner AS (SELECT DISTINCT pid FROM (SELECT pid, x, y, poly, bool_or(ring = 0 AND n) AS i, bool_or(ring > 0 AND n) AS h FROM (SELECT pid, x, y, poly, ring, count(*) FILTER (hit) % 2 = 1 AS n FROM c GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) WHERE i AND NOT h), side AS (SELECT DISTINCT cx * 100 + cy AS pid FROM jb, ring WHERE greatest(x1, x2) >= w AND least(x1, x2) <= w + 500 AND greatest(y1, y2) >= s AND least(y1, y2) <= s + 500) SELECT cx, CAST(cy AS BIGINT) AS cy FROM jb WHERE cx * 100 + cy IN (SELECT pid FROM corner UNION SELECT pid FROM side)", "ring"))
def flt_job_cover(spark, d):
    """Chunks that may meet the polygon: a corner inside, or a ring edge whose box meets the chunk's."""
    b = job_boxes(spark)
    corners = b.select((F.col("cx") * 100 + F.col("cy")).alias("job"), F.explode(F.array(*[F.struct((F.col("w") + i * 500).alias("x"), (F.col("s") + j * 500).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("c")).select("job", "c.x", "c.y").withColumn("pid", F.monotonically_increasing_id())
    corners = materialize(corners)
    per = spatial.crossings(corners.select("pid", "x", "y"), fx.ring(spark), ["poly", "ring"])
    inside = per.groupBy("pid", "poly").agg(F.bool_or((F.col("ring") == 0) & F.col("inside")).alias("i"), F.bool_or((F.col("ring") > 0) & F.col("inside")).alias("h")).where("i and not h")
    hit = corners.join(inside, "pid", "left_semi").select("job")
    met = lambda p, q: F.explode(F.sequence(F.ceil(F.least(p, q) / 500).cast("long") - 1, F.floor(F.greatest(p, q) / 500)))
    sides = fx.ring(spark).select(met("x1", "x2").alias("cx"), "y1", "y2").select("cx", met("y1", "y2").alias("cy")).select((F.col("cx") * 100 + F.col("cy")).alias("job"))
    jobs = hit.union(sides).distinct()
    return b.join(jobs, (F.col("cx") * 100 + F.col("cy")) == F.col("job"), "left_semi").select("cx", "cy")


@BOOK.add(fx.sql(f"WITH {_PT}, {_DIST} SELECT pid FROM dist WHERE d <= 50", "poi", "ring"))
def flt_support(spark, d):
    """Points near the outline."""
    return spatial.outline_within(points(spark, d), fx.ring(spark), 50.0).select("pid")


@BOOK.add(fx.sql("SELECT DISTINCT u, v FROM edge JOIN node a ON a.id = u JOIN node b ON b.id = v JOIN ring r ON u < v AND greatest(a.x, b.x) >= least(r.x1, r.x2) AND least(a.x, b.x) <= greatest(r.x1, r.x2) AND greatest(a.y, b.y) >= least(r.y1, r.y2) AND least(a.y, b.y) <= greatest(r.y1, r.y2) WHERE ((r.x2 - r.x1) * (a.y - r.y1) - (r.y2 - r.y1) * (a.x - r.x1)) * ((r.x2 - r.x1) * (b.y - r.y1) - (r.y2 - r.y1) * (b.x - r.x1)) <= 0 AND ((b.x - a.x) * (r.y1 - a.y) - (b.y - a.y) * (r.x1 - a.x)) * ((b.x - a.x) * (r.y2 - a.y) - (b.y - a.y) * (r.x2 - a.x)) <= 0", "edge", "ring"))
def join_seg_poly(spark, d):
    """Graph edges that cross or touch the outline."""
    from netdensity.plans.graph_queries import edge_lines

    e, r = edge_lines(spark, d), fx.ring(spark)
    side = lambda px, py, qx, qy, x, y: (F.col(qx) - F.col(px)) * (F.col(y) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(x) - F.col(px))
    apart = side("x1", "y1", "x2", "y2", "ax", "ay") * side("x1", "y1", "x2", "y2", "bx", "by") <= 0
    across = side("ax", "ay", "bx", "by", "x1", "y1") * side("ax", "ay", "bx", "by", "x2", "y2") <= 0
    # Lines that are only prolongations of each other do not meet.
    for c in ("x", "y"):
        across = across & (F.greatest(f"a{c}", f"b{c}") >= F.least(f"{c}1", f"{c}2")) & (F.least(f"a{c}", f"b{c}") <= F.greatest(f"{c}1", f"{c}2"))
    middle = e.withColumn("x", (F.col("ax") + F.col("bx")) / 2).withColumn("y", (F.col("ay") + F.col("by")) / 2)
    # Edges are 50 m and pieces too, so where they cross their middles are within 50 m.
    near = spatial.within(middle, spatial.pieces(r, 50.0), 51.0)
    return near.where(apart & across).select("u", "v").distinct()


_POINT = f"WITH pt AS (SELECT k AS pid, x, y FROM poi), {CROSS}, v AS (SELECT p.pid, bool_or(true) AS z, max(r0.score) AS s0, max(r1.score) AS s1 FROM pt p LEFT JOIN raster r0 ON r0.region = 0 AND r0.row = CAST(floor(p.y / 25) AS BIGINT) AND r0.col = CAST(floor(p.x / 25) AS BIGINT) LEFT JOIN raster r1 ON r1.region = 1 AND r1.row = CAST(floor(p.y / 25) AS BIGINT) AND r1.col = CAST(floor(p.x / 25) AS BIGINT) GROUP BY p.pid)"


@BOOK.add(fx.sql(f"{_POINT} SELECT pid, CASE WHEN pid NOT IN (SELECT pid FROM cov) THEN 'outside' WHEN coalesce(s0, s1) IS NULL THEN 'nodata' ELSE 'value' END AS status, CASE WHEN pid IN (SELECT pid FROM cov) THEN coalesce(s0, s1) END AS value, CASE WHEN pid NOT IN (SELECT pid FROM cov) OR coalesce(s0, s1) IS NULL THEN NULL WHEN s0 IS NOT NULL THEN 0 ELSE 1 END AS region FROM v", "poi", "ring", "raster"))
def query_point(spark, d):
    """What a click shows: outside the coverage, no data, or the first region's finite value (zero included)."""
    p = points(spark, d)
    inside = spatial.covered(p, fx.ring(spark)).select("pid").distinct().withColumn("c", F.lit(True))
    row, col = geo.cell_of(F.col("x"), F.col("y"))
    at = p.withColumn("row", row).withColumn("col", col)
    found = at.join(fx.raster(spark, d).where("score is not null"), ["row", "col"]).groupBy("pid").agg(F.min(F.struct("region", "score")).alias("m"))
    joined = p.join(inside, "pid", "left").join(found, "pid", "left")
    ok = F.coalesce("c", F.lit(False))
    return joined.select("pid", F.when(~ok, "outside").when(F.col("m").isNull(), "nodata").otherwise("value").alias("status"), F.when(ok, F.col("m.score")).alias("value"), F.when(ok, F.col("m.region")).alias("region"))


@BOOK.add(ORACLES["query_point"])
def min_point_oracle(spark, d):
    """The same lookup by another route: both regions joined one after the other."""
    p = points(spark, d)
    row, col = geo.cell_of(F.col("x"), F.col("y"))
    at = p.withColumn("row", row).withColumn("col", col)
    r = fx.raster(spark, d)
    for k in (0, 1):
        at = at.join(r.where(f"region = {k}").select("row", "col", F.col("score").alias(f"s{k}")), ["row", "col"], "left")
    inside = spatial.covered(p, fx.ring(spark)).select("pid").distinct().withColumn("c", F.lit(True))
    at = at.join(inside, "pid", "left")
    v = F.coalesce("s0", "s1")
    return at.select("pid", F.when(F.col("c").isNull(), "outside").when(v.isNull(), "nodata").otherwise("value").alias("status"), F.when(F.col("c"), v).alias("value"), F.when(F.col("c") & v.isNotNull(), F.when(F.col("s0").isNotNull(), 0).otherwise(1)).alias("region"))


@BOOK.add()
def geo_missing(spark, d):
    """The part of a support area that coverage lacks, by the lattice cells whose centres lie in the one and not in the other."""
    cells = fx.grid(spark, d).select((F.col("ri") * 200 + F.col("ci")).cast("long").alias("pid"), "x", "y")
    need = spatial.covered(cells, fx.ring(spark).where("ring = 0"))
    have = spatial.covered(cells, fx.ring(spark))
    return need.join(have, ["pid", "poly"], "left_anti").groupBy("poly").agg((F.count("*") * geo.SPACING**2).alias("area"))
