import pytest

from netdensity import config


def test_boxes():
    b = config.Box.parse("-71.08, 42.35,-71.04,42.37")
    wide = b.buffered(1500)
    assert wide.west < b.west < b.east < wide.east and wide.south == pytest.approx(42.35 - 1500 / 111320)
    for bad in ("1,2,3", "a,b,c,d", "-181,0,1,1", "0,-91,1,1", "1,0,1,1", "0,5,1,4"):
        with pytest.raises(ValueError):
            config.Box.parse(bad)


def test_kernels_and_settings():
    assert config.Kernel.parse("e:exponential:150") == ("e", config.Kernel("exponential", lambda_m=150.0))
    assert config.Kernel.parse("p:power_law:2:40")[1].d0_m == 40 and config.Kernel.parse("p:power_law:3")[1].d0_m == 50
    with pytest.raises(ValueError):
        config.Kernel.parse("x:linear:1")
    s = config.Settings(config.Kernel("power_law", p=3.0), cell_m=25.0)
    assert config.Settings.from_dict(s.to_dict()) == s
    assert config.cell_size(1e6, 100, 10, 50) == 50 and config.cell_size(1e6, 10_000, 5, 50) == 10


RULES = {"allow": {"craft": ["*"], "leisure": ["park", "pitch"]}, "deny": {}}


def test_selectors():
    assert [config.selector("craft", ["*"]), config.selector("leisure", ["park"])] == ['["craft"]', '["leisure"~"^(park)$"]']
    assert set(config.selectors(RULES)) == {'["craft"]', '["leisure"~"^(park|pitch)$"]'}


@pytest.mark.parametrize("kept", range(7))
def test_a_query_must_ask_for_every_kind_and_selector(kept):
    asked = [f"{k}{s}(47,7,48,8);" for k in config.QUERY_KINDS for s in config.selectors(RULES)]
    query = "[out:json];(" + "".join(asked[:kept]) + ");out;"
    assert len(config.asked_for(query)) == kept
    if kept == 6:
        config.check_categories({"query": query}, RULES)
    else:
        with pytest.raises(ValueError):
            config.check_categories({"query": query}, RULES)


def test_a_hash_decides_where_there_is_one():
    same = config.rules_hash({"deny": {"x": []}, "allow": dict(reversed(RULES["allow"].items()))})
    config.check_categories({config.CATEGORY_HASH: same}, RULES)
    with pytest.raises(ValueError):
        config.check_categories({config.CATEGORY_HASH: config.rules_hash({"allow": {}})}, RULES)


def test_budgets(tmp_path):
    config.check_budget("nodes", 3, 3)
    with pytest.raises(ValueError):
        config.check_budget("nodes", 4, 3)
    with pytest.raises(ValueError):
        config.check_disk(str(tmp_path), 1 << 60)
    assert config.import_identity({"b": "2", "a": "1"}, {"allow": {}}, "x", {})["sources"] == {"a": "1", "b": "2"}
