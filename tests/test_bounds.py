"""fn_acq_bounds gives a box for every place."""

from pathlib import Path

import pytest
from netdensity.plans import fixtures as fx
from netdensity.plans import registry

DATA = Path("/root/testdata/sf0.001")


def test_every_place_has_bounds(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    places = {r.id: r for r in fx.place(spark, str(DATA)).collect()}
    got = registry.queries()["fn_acq_bounds"](spark, str(DATA)).collect()
    assert sorted(r.id for r in got) == sorted(places)
    for r in got:
        p = places[r.id]
        assert r.west < p.lon and r.east > p.lon + 0.05 and r.south < p.lat and r.north > p.lat + 0.03
