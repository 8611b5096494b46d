"""Scores on small literal worlds, against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from netdensity.functions import geo
from netdensity.operators import graph, score, spatial, sssp


def world(spark, nodes, ways, most=25.0):
    n = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in nodes], "id long, x double, y double")
    w = spark.createDataFrame([(k, list(r)) for k, r in enumerate(ways)], "way_id long, refs array<long>")
    v, e = graph.build(n, w, most)
    numbered = {r.k: i for i, r in enumerate(v.orderBy("rank", "k").collect())}
    rows = [(numbered[r.k], r.x, r.y) for r in v.collect()]
    edges = [(numbered[a], numbered[b], r.length) for r in e.collect() for a, b in ((r.u, r.v), (r.v, r.u))]
    return spark.createDataFrame(rows, "id long, x double, y double"), spark.createDataFrame(edges, "u long, v long, w double")


def chunked(spark, nodes, ways, queries, pois, chunk=2000.0):
    n, e = world(spark, nodes, ways)
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(queries)], "qid long, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pois)], "pid long, x double, y double")
    return [r.score for r in score.chunked(n, e, q, p, chunk).orderBy("qid").collect()]


LINE = [(1, 0, 0), (2, 100, 0)]
CASES = {
    "every destination counts, connectors cost": (LINE, [[1, 2]], [(0, 10)], [(100, 20)] * 2, [2 * math.exp(-130 / 120)]),
    "components are kept": ([*LINE, (3, 1000, 0), (4, 1100, 0)], [[1, 2], [3, 4]], [(0, 0), (1000, 0)], [(1100, 0)], [0, math.exp(-100 / 120)]),
    "coincident nodes are not joined": ([(1, 0, 0), (2, 100, 0), (3, 100, 0), (4, 200, 0)], [[1, 2], [3, 4]], [(0, 0)], [(200, 0)], [0]),
    "no snap is not zero": (LINE, [[1, 2]], [(0, 0), (0, 100)], [(100, 100)], [0, None]),
    "the radius holds connectors": ([(1, 0, 0), (2, 800, 0)], [[1, 2]], [(0, 0), (0, 1)], [(800, 0)], [math.exp(-800 / 120), 0]),
    "bends and a way drawn twice": ([(1, 0, 0), (2, 0, 100), (3, 100, 100)], [[1, 2, 3], [3, 2, 1]], [(0, 0)], [(100, 100)], [math.exp(-200 / 120)]),
}


@pytest.mark.parametrize("name", CASES)
def test_literal(spark, name):
    *given, expected = CASES[name]
    got = chunked(spark, *given)
    assert [x is None for x in got] == [x is None for x in expected]
    assert [x for x in got if x is not None] == pytest.approx([x for x in expected if x is not None], rel=1e-12)


def test_cycle_against_a_plain_search(spark):
    nodes, ways = [(1, 0, 0), (2, 100, 0), (3, 100, 100), (4, 0, 100)], [[1, 2, 3, 4, 1]]
    n, e = world(spark, nodes, ways)
    assert n.count() == 16 and e.count() == 32
    got = chunked(spark, nodes, ways, [(10, 15), (80, 115), (30, 90)], [(100, 10)] * 2 + [(5, 100)])
    assert got == pytest.approx([1.0334603390, 1.0191839775, 1.0994865663], rel=1e-9)


def test_chunks_do_not_matter(spark):
    nodes = [(i, 100 * i, 0) for i in range(-20, 51)]
    ways = [[i for i, _, _ in nodes]]
    queries, pois = [(x, 15) for x in range(-100, 3001, 100)], [(x, 10) for x in range(-800, 3801, 137)]
    whole = chunked(spark, nodes, ways, queries, pois, 100_000.0)
    for width in (400.0, 1000.0, 2000.0):
        assert chunked(spark, nodes, ways, queries, pois, width) == pytest.approx(whole, rel=1e-12)


def test_both_path_searches_agree(spark):
    nodes = [(i * 5 + j, 50 * i, 50 * j) for i in range(5) for j in range(5)]
    ways = [[i * 5 + j for j in range(5)] for i in range(5)] + [[i * 5 + j for i in range(5)] for j in range(5)]
    n, e = world(spark, nodes, ways, 50.0)
    src = n.where("id % 4 = 0").select("id")
    a = {(r.src, r.node): r.d for r in sssp.frontier(src, e, 130.0).collect()}
    b = {(r.src, r.node): r.d for r in sssp.halo(src, n, e, 130.0, 100.0).collect()}
    assert a == b and len(a) > 50


def test_snap_ties_go_to_the_lesser_node(spark):
    n = spark.createDataFrame([(7, 0.0, 0.0), (3, 20.0, 0.0), (9, 10.0, 75.0)], "id long, x double, y double")
    p = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, 150.0), (3, 10.0, 150.1)], "k long, x double, y double")
    assert {r.k: r.node for r in spatial.snap(p, n, "k", geo.SNAP).collect()} == {1: 3, 2: 9}


def test_display_keeps_missing_apart(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (30.0,), (None,), (float("nan"),)], "s double")
    got = [r.v for r in df.select(geo.display(F.col("s")).alias("v")).collect()]
    assert got[:3] == pytest.approx([0, 0.2018490866, 1]) and got[3:] == [None, None]


def test_street_walk_by_hand(spark):
    # One straight street of two edges, a destination in the middle of the first.
    edges = spark.createDataFrame([(1, 10, 11, 50.0, 0.0, 0.0), (2, 11, 12, 50.0, 50.0, 0.0)], "e long, u long, v long, w double, ux double, uy double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0, 50.0), (2, 50.0, 0.0, 100.0, 0.0, 50.0)], "e long, ax double, ay double, bx double, by double, len double")
    segments = graph.segment_edges(lines, 10.0).select("e", "i", "start_dist", "end_dist")
    at = spark.createDataFrame([(1, 1, 25.0)], "pid long, e long, along double")
    got = {(r.e, r.i): r.score for r in score.streets(segments, edges, at, 300.0, 50.0, 120.0).collect()}
    k = lambda d: math.exp(-d / 120)
    assert got[1, 2] == 0  # its own segment gets nothing
    assert got[1, 3] == pytest.approx(k(10)) and got[1, 0] == pytest.approx(k(20))
    assert got[2, 0] == pytest.approx(k(30)) and got[2, 4] == pytest.approx(k(70))


def test_build_is_stable_under_direction(spark):
    n = spark.createDataFrame([(11, -2000.0, 0.0), (12, 2000.0, 0.0)], "id long, x double, y double")
    keys = []
    for refs in ([11, 12], [12, 11]):
        v, e = graph.build(n, spark.createDataFrame([(1, refs)], "way_id long, refs array<long>"))
        keys.append(({r.k for r in v.collect()}, {(r.u, r.v) for r in e.collect()}))
    assert keys[0] == keys[1] and len(keys[0][1]) == 160
