"""Byte formats, rings and resumable runs."""

import numpy as np
import pytest

from netdensity.functions import predicates
from netdensity.operators import outputs, raster, regional, tiles
from netdensity.sources import elements, pbf


def test_pbf_file_round_trip(spark, tmp_path):
    nodes = [(10**10 + 7 * i, -713_000_000 + i, 423_000_000 - 3 * i) for i in range(2000)]
    path = tmp_path / "x.pbf"
    with path.open("wb") as f:
        f.write(pbf.frame("OSMHeader", pbf.encode_blob([])  or b"\x0a\x00"))
        for k in range(0, 2000, 300):
            f.write(pbf.frame("OSMData", pbf.encode_blob(nodes[k : k + 300], [(5 + k, [3, 1, 2])], [(9 + k, [5, -2], [1, 0])], deflate=k % 2 == 0)))
    spark.dataSource.register(pbf.PbfSource)
    df = spark.read.format("pbf").option("blocks", "2").load(str(path))
    assert sorted((r.id, r.x, r.y) for r in df.where("kind = 'node'").collect()) == nodes
    assert {(r.id, tuple(r.refs)) for r in df.where("kind = 'way'").collect()} == {(5 + k, (3, 1, 2)) for k in range(0, 2000, 300)}
    assert df.where("kind = 'relation'").first().types == [1, 0]


def blob_rows(spark, rows):
    return spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "block long, blob binary")


def test_pbf_tags_round_trip():
    tags = {("node", 2): {"shop": "bakery", "name": "Ü"}, ("way", 7): {"highway": "footway"}, ("relation", 8): {"type": "route"}}
    blob = pbf.encode_blob([(1, 100, 200), (2, 300, 400), (3, 500, 600)], [(7, [1, 2]), (9, [])], [(8, [7], [1])], tags=tags)
    got = list(pbf.decode_block(pbf.blob_bytes(blob)))
    assert {(r[0], r[1]): r[6] for r in got} == {("node", 1): {}, ("node", 3): {}, ("way", 9): {}} | tags
    assert {r[1]: r[4] for r in got if r[0] == "way"} == {7: [1, 2], 9: []}


def test_ways_get_their_nodes_places(spark):
    walk = {("way", k): {"highway": "footway"} for k in (7, 8, 9)}
    blob = pbf.encode_blob([(1, 100, 200), (2, 300, 400), (4, 5, 6)], [(7, [2, 1, 2]), (8, [1, 3]), (9, [4])], tags=walk | {("node", 4): {"access": "no"}})
    rows = elements.from_blocks(pbf.decode_blocks(blob_rows(spark, [(0, blob)])))
    at, pairs = elements.walk_pairs(rows)
    assert sorted((r.way_id, r.a, r.b) for r in pairs.collect()) == [(7, 1, 2), (7, 2, 1)]  # 8 lacks a node, 9 has one only
    assert sorted((r.id, r.lon, r.lat) for r in at.collect()) == [(1, 1e-5, 2e-5), (2, 3e-5, 4e-5)]


def test_block_index(spark):
    blobs = [(k, pbf.encode_blob([(100 * k + i, 0, 0) for i in range(5)], [(k, [1])])) for k in range(4)]
    got = sorted((r.block, r.kind, r.low, r.high, r.offset) for r in pbf.block_index(blob_rows(spark, blobs)).collect())
    before = np.cumsum([0] + [len(b) for _, b in blobs]).tolist()
    assert got == sorted(x for k in range(4) for x in ((k, "node", 100 * k, 100 * k + 4, before[k]), (k, "way", k, k, before[k])))
    with pytest.raises(Exception, match="overlap"):
        pbf.block_index(blob_rows(spark, [(0, blobs[1][1]), (1, blobs[0][1])])).collect()


def test_import_can_start_again(spark, tmp_path):
    blob = lambda *n: bytearray(pbf.encode_blob([(i, x, x) for i, x in n]))
    one, two = ("a", blob((1, 100), (2, 200))), ("b", blob((2, 900), (3, 300)))
    source = lambda rows: spark.createDataFrame(rows, "source string, blob binary")
    path = str(tmp_path / "import")
    assert sorted((r.id, r.x) for r in pbf.import_sources(source([one]), path).collect()) == [(1, 100), (2, 200)]
    for _ in range(2):
        assert sorted((r.id, r.x) for r in pbf.import_sources(source([one, two]), path).collect()) == [(1, 100), (2, 200), (3, 300)]


@pytest.mark.parametrize("damage", [lambda b: b[:-3], lambda b: b[:20] + b"\xff" + b[21:]])
def test_pbf_damage_is_an_error(damage):
    with pytest.raises((ValueError, Exception)):
        list(pbf.decode_block(pbf.blob_bytes(damage(pbf.encode_blob([(1, 100, 200), (2, 300, 400)])))))


def test_png_and_halving():
    rgba = np.random.default_rng(1).integers(0, 256, (512, 512, 4), dtype=np.uint8)
    assert (tiles.pixels(tiles.png(rgba)) == rgba).all()
    flat = np.full((512, 512, 4), (10, 20, 30, 200), np.uint8)
    assert (tiles.lanczos_half(flat) == (10, 20, 30, 200)).all()
    assert not tiles.lanczos_half(np.zeros((512, 512, 4), np.uint8)).any()


def test_archive_round_trip():
    rows = [(i, 3, i % 8, i // 8, bytes([i % 3]) * 9) for i in range(5, 40, 3)]
    got = tiles.archive_entries(tiles.archive(rows, {"a": 1}))
    assert got == [(r[0], r[4]) for r in rows]


def test_hilbert_ids_are_the_first_numbers(spark):
    rows = [(z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)]
    df = spark.createDataFrame(rows, "z long, x long, y long")
    got = [r.i for r in df.select(tiles.hilbert_id(df.z, df.x, df.y).alias("i")).collect()]
    assert sorted(got) == list(range(len(rows)))
    at = {r.i: (r.z, r.x, r.y) for r in df.select("z", "x", "y", tiles.hilbert_id(df.z, df.x, df.y).alias("i")).collect()}
    for i in range(22, len(rows)):  # neighbours on the curve touch
        assert abs(at[i][1] - at[i - 1][1]) + abs(at[i][2] - at[i - 1][2]) == 1


def test_runs_of_tiles(spark):
    keys = spark.createDataFrame([(14, 7, 9), (14, 3, 9), (14, 4, 9), (13, 3, 9), (14, 5, 9)], "z long, x long, y long")
    assert {(r.z, r.y, r.lo, r.hi) for r in tiles.compact(keys).collect()} == {(13, 9, 3, 3), (14, 9, 3, 5), (14, 9, 7, 7)}


def test_blocks_keep_zero_and_drop_nothing(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 400, 2.5), (2, 2, None), (700, 1, float("nan"))], "row long, col long, score double")
    b = raster.blocks(df)
    assert b.count() == 2
    assert {(r.row, r.col, r.score) for r in raster.unpacked(b).collect()} == {(0, 0, 0.0), (1, 400, 2.5)}
    broken = b.withColumn("sha256", b.sha256.substr(2, 64))
    with pytest.raises(Exception, match="damaged"):
        raster.unpacked(broken).collect()


def test_rings_and_points(spark):
    square = [[(0.0, 0.0), (4.0, 0.0)], [(4.0, 4.0), (4.0, 0.0)], [(0.0, 4.0), (4.0, 4.0)], [(0.0, 4.0), (0.0, 0.0)]]
    rings, whole = elements.stitched(square)
    assert whole and len(rings) == 1 and elements.area(rings[0]) == 16
    assert elements.representative(square) == (2.0, 2.0)
    assert elements.stitched(square[:3])[1] is False
    assert elements.representative([[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]]) == (1.0, 1.0)


def test_incomplete_documents_are_an_error(spark):
    good = '{"elements":[{"type":"node","id":1,"lon":1.0,"lat":2.0},{"type":"node","id":1,"lon":9.0,"lat":9.0}]}'
    assert [(r.id, r.lon) for r in elements.elements(spark.createDataFrame([(good,)], "text string")).collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="incomplete"):
        elements.elements(spark.createDataFrame([('{"remark":"timeout","elements":[]}',)], "text string")).collect()


def test_tag_rules(spark):
    tags = [{"highway": "footway", "access": "private"}, {"highway": "footway", "access": "private", "foot": "yes"}, {"highway": "residential", "foot": "no"}, {"highway": "motorway"}, {"shop": "bakery"}, {"shop": "vacant"}, {}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    t = predicates.in_map("tags")
    assert [r.w for r in df.select(predicates.walking(t).alias("w")).collect()] == [False, True, False, False, False, False, False]
    rule = predicates.destination(t, {"shop": ["*"]}, {"shop": ["vacant"]})
    assert [r.w for r in df.select(rule.alias("w")).collect()] == [False, False, False, False, True, False, False]


def test_region_resumes(spark, tmp_path):
    nodes = spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(60)], "id long, x double, y double")
    edges = spark.createDataFrame([(a, b, 100.0) for i in range(59) for a, b in ((i, i + 1), (i + 1, i))], "u long, v long, w double")
    q = spark.createDataFrame([(i, 100.0 * i, 5.0) for i in range(60)], "qid long, x double, y double")
    p = spark.createDataFrame([(1, 250.0, 0.0), (2, 4050.0, 0.0)], "pid long, x double, y double")
    path = str(tmp_path / "out")
    assert [regional.score_region(nodes, edges, q, p, path, "a", limit=1), regional.score_region(nodes, edges, q, p, path, "a"), regional.score_region(nodes, edges, q, p, path, "a")] == [1, 2, 0]
    assert spark.read.parquet(path).count() == 60
    with pytest.raises(ValueError, match="more than 10 nodes"):
        regional.load_shard(nodes, edges, p, 0, -1, 9999, 1, max_nodes=10)


def test_signature_ignores_order():
    assert outputs.signature({"a": 1, "b": [2]}) == outputs.signature({"b": [2], "a": 1})
