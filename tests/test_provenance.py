"""Repairs write nothing but what they may, and leave the versions before."""

import pytest

from netdensity.operators import provenance


def test_a_repair_keeps_the_graph_and_the_versions_before(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    store = provenance.Store(spark, str(tmp_path))
    first = store.create({"edges": rows(1, 2), "member_bounds": rows(1), "metadata": rows(0)})
    second = store.repair(first, {"member_bounds": rows(1, 5)})
    assert store.versions(first)["edges"] == store.versions(second)["edges"]
    assert store.table(first, "member_bounds").count() == 1 and store.table(second, "member_bounds").count() == 2
    with pytest.raises(PermissionError):
        store.repair(second, {"edges": rows(), "metadata": rows(1)})
    assert len(list((tmp_path / "metadata").iterdir())) == 1


def test_content_ignores_order_and_sees_copies(spark):
    rows = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], "k long, t string")
    assert provenance.content(rows(1, 2, 3)) == provenance.content(rows(3, 1, 2).repartition(3))
    assert len({provenance.content(rows(*x)) for x in ((), (1,), (1, 1), (1, 2), (1, 1, 1))}) == 5
