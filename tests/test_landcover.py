import math
import random
from collections import Counter

import pytest

from skyloom.errors import ArgumentError
from skyloom.operators import landcover


def test_shares_are_of_all_pixels(spark):
    pixels = spark.createDataFrame([("a", 50, c) for c in [80, 10, 10, 10, 7, 7, 7, 7, None]], "name string, radius int, class int")
    got = {r["class"]: r.fraction for r in landcover.fractions(pixels).collect()}
    assert got == {c: 0.0 for c in landcover.LANDCOVER} | {80: 0.125, 10: 0.375, 7: 0.5}
    assert {r["class"]: r.fraction for r in landcover.fractions(pixels, {"water": [80], "none": []}).collect()} == {"water": 0.125, "none": 0.0}


def distance(a, b):
    la, lb, dlon = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(dlon / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("lat", "lon"), [(51.0, 3.7), (0.0, 179.999), (-89.98, 10.0), (89.99, -120.0), (70.0, -180.0)])
def test_buffers_equal_all_distances(spark, lat, lon):
    rnd = random.Random(lat)
    near = lambda d: (max(-90.0, min(90.0, lat + rnd.uniform(-d, d))), (lon + rnd.uniform(-d, d) / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180)
    stations = [(f"s{i}", *near(0.02)) for i in range(6)] + [("nowhere", None, 1.0)]
    pixels = [(*near(0.03), rnd.choice([10, 50, 80, None])) for _ in range(400)]
    radii = [900, 150, 2500]
    got = landcover.buffer_counts(spark.createDataFrame(stations, "name string, lat double, lon double"), spark.createDataFrame(pixels, "lat double, lon double, class int"), radii)
    want = Counter((s[0], r, p[2]) for s in stations[:-1] for p in pixels for r in radii if p[2] is not None and distance(s[1:], p[:2]) <= r)
    assert {(r.name, r.radius, r["class"]): r.n for r in got.collect()} == want and len(want) > 10


def test_buffers_need_radii(spark):
    stations = spark.createDataFrame([], "name string, lat double, lon double")
    pixels = spark.createDataFrame([], "lat double, lon double, class int")
    assert landcover.buffer_fractions(stations, pixels, [100.0]).count() == 0
    for bad in ([], [0.0], [-1.0]):
        with pytest.raises(ArgumentError):
            landcover.buffer_fractions(stations, pixels, bad)
