"""Interpolation by several anchors: smoothing splines, slopes that keep the shape, polynomials."""

import numpy as np
import pytest
from helpers import series
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError
from skyloom.operators import gapfill
from skyloom.operators.align import KEY


def filled(spark, rows, gap, method, n=2, **options):
    gaps = series(spark, [(m, None) for m in gap]).select(*KEY, F.lit(1).alias("gap_id"), "datetime")
    out = gapfill.interpolate(gaps, series(spark, rows), method, "10h", n_leading=n, n_trailing=n, **options)
    return [r.value for r in out.orderBy("datetime").collect()]


POINTS = [(0, 1.0), (10, 4.0), (40, 3.0), (60, 9.0)]


def test_smoothing_gives_one_polynomial_where_it_is_near_enough(spark):
    x, y = zip(*POINTS, strict=True)
    for order in (1, 2):
        line = np.polyfit(x, y, order)
        assert ((np.polyval(line, x) - y) ** 2).sum() < 11
        assert filled(spark, POINTS, [20, 30], "spline", order=order, smoothing=11) == pytest.approx(list(np.polyval(line, [20, 30])))


def test_smoothing_is_not_interpolation(spark):
    wild = [(0, 1.0), (10, 9.0), (20, 2.0), (50, 8.0), (60, 1.0), (70, 9.0)]
    smooth, through = filled(spark, wild, [30, 40], "spline", 3, order=2), filled(spark, wild, [30, 40], "polynomial", 3, order=2)
    assert smooth != pytest.approx(through)
    assert filled(spark, wild, [30, 40], "spline", 3, order=2, smoothing=0) == pytest.approx(through)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_residuals_fill_the_room_they_have(order):
    rng = np.random.default_rng(order)
    x, y = np.sort(rng.uniform(0, 100, 30)), rng.normal(0, 3, 30).cumsum()
    for room in (5.0, 30.0, 80.0):
        fit = gapfill.smoothing_spline(x, y, x, order, room)
        poly = ((np.polyval(np.polyfit(x - x.mean(), y, order), x - x.mean()) - y) ** 2).sum()
        assert ((fit - y) ** 2).sum() == pytest.approx(min(room, poly), rel=1e-3)
    assert ((gapfill.smoothing_spline(x, y, x, order) - y) ** 2).sum() == pytest.approx(30, rel=1e-3)  # as many as points


def test_smoothing_can_not_beat_a_straight_line_on_one():
    x = np.arange(8.0)
    assert gapfill.smoothing_spline(x, 2 * x + 1, [2.5, 6.5], 3) == pytest.approx([6.0, 14.0])


def test_pchip_keeps_the_shape(spark):
    step = [(0, 0.0), (10, 0.0), (40, 5.0), (50, 5.0)]
    got = filled(spark, step, [15, 20, 25, 30, 35], "pchip")
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 5
    u = 0.5
    assert got[2] == pytest.approx(5 * u * u * (3 - 2 * u))  # flat at both ends
    peak = [(0, 0.0), (10, 4.0), (40, 1.0), (50, 3.0)]
    assert all(1 <= v <= 4 for v in filled(spark, peak, [15, 20, 30, 35], "pchip"))


def test_akima_is_straight_on_a_line_and_local(spark):
    assert filled(spark, [(m, m / 5) for m in (0, 10, 40, 60)], [20, 30], "akima") == pytest.approx([4.0, 6.0])
    # slopes 1, 1 | gap slope 1 | 5: the end that lies on the line keeps its slope
    a = filled(spark, [(0, 0.0), (10, 10.0), (40, 40.0), (50, 90.0)], [11], "akima")
    assert a[0] == pytest.approx(11.0, abs=0.2)


def test_one_anchor_on_each_side_is_a_straight_line(spark):
    for method in ("pchip", "akima", "krogh", "barycentric"):
        assert filled(spark, [(0, 0.0), (40, 8.0)], [10, 20], method, 1) == pytest.approx([2.0, 4.0]), method


def test_polynomials_run_through_all_anchors(spark):
    cubic = [(m, (m / 10) ** 3 - m) for m in (0, 10, 40, 60)]
    want = [(m / 10) ** 3 - m for m in (20, 30)]
    for method in ("krogh", "barycentric"):
        assert filled(spark, cubic, [20, 30], method) == pytest.approx(want)


def test_labels_say_what_failed(spark):
    gaps = series(spark, [(m, None) for m in (20, 30)]).select(*KEY, F.lit(1).alias("gap_id"), "datetime")
    obs = series(spark, POINTS)
    one = lambda *a, **b: gapfill.interpolate(gaps, obs, *a, **b).first()
    assert one("spline", "10h", n_leading=2, n_trailing=2, order=2).details == "interpolated by spline of order 2"
    assert one("pchip", "5min", n_leading=2, n_trailing=2).value is None
    assert one("akima", "10h", n_leading=3, n_trailing=2).label == "failed interpolation"
    assert one("spline", "10h", order=3).details == "too few anchors for the order"
    with pytest.raises(ArgumentError, match="pchip"):
        gapfill.interpolate(gaps, obs, "no such")
