"""Quantiles by ranges agree with numpy, group by group."""

import numpy as np
import pytest

from netdensity.operators.order import quantiles

WANTED = {"low": 0.0, "median": 0.5, "p95": 0.95, "high": 1.0}


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in ((None, 7), (1, 400), (2, 1), (3, 50)) for v in rng.integers(0, 40, n)]
    rows += [(3, None), (4, None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", WANTED).collect()}
    assert set(got) == {None, 1, 2, 3}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        for name, q in WANTED.items():
            assert r[name] == pytest.approx(np.quantile(values, q))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert quantiles(empty, ["g"], "v", WANTED).collect() == []
    assert [r.median for r in quantiles(empty, [], "v", WANTED).collect()] == [None]
