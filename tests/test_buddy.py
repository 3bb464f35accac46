import pytest
from helpers import START

from skyloom.errors import MissingError
from skyloom.operators import buddy

STEP = 0.01  # degrees of latitude, about 1.1 km


def stations(spark, rows):
    return spark.createDataFrame([(n, lat, 4.0, alt, cat) for n, lat, alt, cat in rows], "name string, lat double, lon double, altitude double, category string")


def line(spark, n=6):
    return stations(spark, [(chr(97 + i), 50 + i * STEP, 10.0 * i, "x" if i % 2 else "y") for i in range(n)])


def values(spark, numbers):
    return spark.createDataFrame([(chr(97 + i), "temp", START, float(v)) for i, v in enumerate(numbers)], "name string, obstype string, datetime timestamp, value double")


def test_pairs(spark):
    near = {(r.name, r.buddy) for r in buddy.pairs(line(spark, 4), 1_200).collect()}
    assert near == {(a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "d")) for a, b in ((a, b), (b, a))}
    assert {(r.name, r.buddy) for r in buddy.pairs(line(spark, 4), 3_000, "category").collect()} == {("a", "c"), ("c", "a"), ("b", "d"), ("d", "b")}
    assert buddy.pairs(line(spark, 4), 3_000, None, 10.0).count() == 6
    around = spark.createDataFrame([("e", 10.0, 179.999, 0.0), ("w", 10.0, -179.999, 0.0)], "name string, lat double, lon double, altitude double")
    assert buddy.pairs(around, 1_000).count() == 2
    with pytest.raises(MissingError):
        buddy.pairs(stations(spark, [("a", None, 1.0, "x")]), 1_000)


def greedy(near):
    out, member = [], set()
    lists = {}
    for a, b in near:
        lists.setdefault(a, set()).add(b)
    for name in sorted(lists):
        if name not in member:
            out += [(name, x) for x in (name, *lists[name])]
            member |= {name, *lists[name]}
    return sorted(out)


@pytest.mark.parametrize("radius, least", [(1_200, 1), (2_400, 2), (2_400, 3), (9_000, 1)])
def test_groups(spark, radius, least):
    near = buddy.with_enough(buddy.pairs(line(spark, 9), radius), least)
    assert sorted(map(tuple, buddy.groups(near).collect())) == greedy({(r.name, r.buddy) for r in near.collect()})


def test_check_and_masked_outlier(spark):
    where = line(spark, 9)
    obs = values(spark, [1, 1, 1, 1, 1, 1, 1, 40, 90])
    once = buddy.buddy_check(obs, where, 20_000, 4, z_threshold=2.0, n_iter=1)
    twice = buddy.buddy_check(obs, where, 20_000, 4, z_threshold=2.0, n_iter=2)
    assert [r.name for r in once.collect()] == ["i"] and sorted(r.name for r in twice.collect()) == ["h", "i"]
    assert "iteration 2/2" in [r.details for r in twice.collect() if r.name == "h"][0]


def test_safety_net_and_white_list(spark):
    where = stations(spark, [(c, 50 + i * STEP, 0.0, "sea" if c in "hij" else "land") for i, c in enumerate("abcdefghij")])
    obs = values(spark, [1, 1, 1, 1, 1, 1, 1, 20, 20.5, 21])
    options = {"radius_m": 8_000, "min_sample_size": 4, "z_threshold": 1.7, "n_iter": 1}
    plain = {r.name for r in buddy.buddy_check(obs, where, **options).collect()}
    net = buddy.SafetyNet("category", 20_000, 2.0, 2)
    assert plain and not buddy.buddy_check(obs, where, safety_nets=[net], **options).where("name in ('h', 'i', 'j')").count()
    few = buddy.SafetyNet("category", 20_000, 2.0, 5)
    assert {r.name for r in buddy.buddy_check(obs, where, safety_nets=[few], **options).collect()} == plain
    white = spark.createDataFrame([(n,) for n in plain], "name string")
    assert buddy.buddy_check(obs, where, white=white, **options).count() == 0
    with pytest.raises(MissingError):
        buddy.saved_by(buddy.SafetyNet("none", 1.0, 1.0, 1), obs, obs, where)


def test_lapse_rate(spark):
    out = {r.name: r.value for r in buddy.lapse_corrected(values(spark, [1.0, 1.0]), line(spark, 2), -0.0065).collect()}
    assert out == {"a": 1.0, "b": pytest.approx(1.065)}


def test_synchronised(spark):
    import datetime as dt

    rows = [("a", "temp", START + dt.timedelta(minutes=m), 1.0) for m in (0, 10, 20)] + [("b", "temp", START + dt.timedelta(minutes=m), 2.0) for m in (1, 11, 21)]
    obs = spark.createDataFrame(rows, "name string, obstype string, datetime timestamp, value double")
    out = buddy.synchronised(obs)
    assert {r.datetime.minute for r in out.collect()} == {0, 10, 20} and out.count() == 6


def test_pairs_by_hand_near_the_poles(spark):
    """Each row of cells has its own width: one station near a pole doesn't widen the others' cells, and no pair is lost."""
    import math
    import random

    r = random.Random(1)
    places = [(r.choice([89.9, 80.0, 0.0, -60.0, -89.95]) + r.uniform(-0.04, 0.04), r.choice([-180, -179.9, 0, 90, 179.9]) + r.uniform(-0.06, 0.06)) for _ in range(150)]
    places = [(a, (b + 180) % 360 - 180) for a, b in places]
    frame = spark.createDataFrame([(f"s{i}", a, b, 0.0) for i, (a, b) in enumerate(places)], "name string, lat double, lon double, altitude double")

    def distance(p, q):
        (a, b), (c, d) = (tuple(map(math.radians, x)) for x in (p, q))
        return 2 * 6371000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for radius in (2_000, 9_000):
        want = {(f"s{i}", f"s{j}") for i, p in enumerate(places) for j, q in enumerate(places) if i != j and distance(p, q) <= radius}
        got = [(x.name, x.buddy) for x in buddy.pairs(frame, radius).collect()]
        assert set(got) == want and len(got) == len(want) > 50


def test_net_verdicts_by_hand(spark):
    """A station is no buddy of its own: 20 against 10, 11 and 12 alone; few buddies, few values and far ones say so."""
    where = stations(spark, [("a", 50.0, 0.0, "x"), ("b", 50.01, 0.0, "x"), ("c", 50.02, 0.0, "x"), ("d", 50.03, 0.0, "x"), ("e", 50.0, 0.0, "y"), ("f", 50.01, 0.0, "y"), ("g", 50.0, 0.0, None)])
    obs = spark.createDataFrame([(n, "temp", START, v) for n, v in (("a", 20.0), ("b", 10.0), ("c", 11.0), ("d", 12.0), ("e", 1.0), ("f", 2.0), ("g", 3.0))], "name string, obstype string, datetime timestamp, value double")

    def verdicts(net, rows=obs):
        return {r.name: (r.saved, r.message) for r in buddy.net_verdicts(net, obs, rows, where).collect()}

    out = verdicts(buddy.SafetyNet("category", 20_000, 8.9, 3))
    assert out["a"] == (False, "category net: not saved (z=9.00)")  # mean 11, spread 1
    assert out["b"][0] and out["b"][1] is None and verdicts(buddy.SafetyNet("category", 20_000, 9.0, 3))["a"] == (True, None)
    assert out["e"] == (False, "category net: too few buddies (1 of 3)") and out["g"] == (False, "category net: too few buddies (0 of 3)")
    assert verdicts(buddy.SafetyNet("category", 20_000, 9.0, 3), obs.where("name <> 'c'"))["a"] == (False, "category net: too few values (2 of 3)")
    assert verdicts(buddy.SafetyNet("category", 20_000, 9.0, 1))["e"] == (False, "category net: not saved (no spread)")
    assert not verdicts(buddy.SafetyNet("category", 20_000, 9.0, 1)).keys() ^ set("abcdefg") and buddy.net_verdicts(buddy.SafetyNet("category", 1.0, 1.0, 1), obs.limit(0), obs, where).count() == 0


def chain_pairs(spark, n):
    """Stations in a row, each a buddy of the two next to it: each waits for the one before."""
    names = [f"{i:03d}" for i in range(n)]
    near = [(a, b) for i, a in enumerate(names) for b in names[max(i - 2, 0) : i + 3] if a != b]
    return near, spark.createDataFrame(near, "name string, buddy string")


@pytest.mark.parametrize("block", [7, 50, 1 << 21])
def test_groups_in_blocks(spark, block):
    near, frame = chain_pairs(spark, 40)
    assert sorted(map(tuple, buddy.groups(frame, block).collect())) == greedy(near)


def test_groups_of_long_chains_take_few_rounds(spark, monkeypatch):
    near, frame = chain_pairs(spark, 60)
    steps = []
    monkeypatch.setattr(buddy, "cut", lambda df, cut=buddy.cut: steps.append(1) or cut(df))
    assert sorted(map(tuple, buddy.groups(frame).collect())) == greedy(near)
    assert len(steps) < 10  # a round for each link of the chain took more than twenty
