import numpy as np
import pytest
from helpers import at, series
from pyspark.sql import functions as F

from skyloom.errors import AmbiguousError, ArgumentError
from skyloom.operators import gapfill


def gaps(spark, groups):
    rows = [("a", "temp", i, at(m)) for i, stamps in groups.items() for m in stamps]
    return spark.createDataFrame(rows, "name string, obstype string, gap_id long, datetime timestamp")


def filled(df):
    return [(r.value, r.label) for r in df.orderBy("gap_id", "datetime").collect()]


def test_interpolation(spark):
    obs = series(spark, [(0, 0), (40, 8), (100, 2)])
    out = filled(gapfill.interpolate(gaps(spark, {1: [10, 30], 2: [50], 3: [110]}), obs, "time", "20min"))
    assert out == [(2, "interpolation"), (6, "interpolation"), (7, "interpolation"), (None, "failed interpolation")]
    assert [v for v, _ in filled(gapfill.interpolate(gaps(spark, {1: [10, 30]}), obs, "linear", "20min"))] == [pytest.approx(8 / 3), pytest.approx(16 / 3)]
    assert filled(gapfill.interpolate(gaps(spark, {1: [10, 30]}), obs, "time", "19min"))[0][1] == "failed interpolation"
    assert filled(gapfill.interpolate(gaps(spark, {1: [10, 30]}), obs, "time", "1h", max_trail="9min"))[0][0] is None
    assert filled(gapfill.interpolate(gaps(spark, {1: [10, 30]}), obs, "time", "1h", n_leading=2))[0][0] is None


def test_spline_reproduces_its_order():
    x = np.array([0, 1, 2.5, 4, 6, 7])
    for order in (1, 2, 3):
        f = np.poly1d([0.3, -1, 2, 1][3 - order :])
        assert np.allclose(gapfill.spline(x, f(x), [0.5, 3, 5.5], order), f(np.array([0.5, 3, 5.5])))


def test_spline_fill(spark):
    cubic = lambda m: (m / 100) ** 3 - m / 50
    obs = series(spark, [(m, cubic(m)) for m in (0, 10, 20, 60, 70, 80)])
    out = gapfill.interpolate(gaps(spark, {1: [30, 40, 50], 2: [90]}), obs, "cubicspline", "1h", n_leading=2, n_trailing=2)
    got = [v for v, _ in filled(out)]
    assert np.allclose(got[:3], [cubic(m) for m in (30, 40, 50)]) and got[3] is None


def test_raw_model(spark):
    model = series(spark, [(0, 0), (60, 60), (120, 0)])
    out = filled(gapfill.fill_with_model("raw", gaps(spark, {1: [30, 60, 90], 2: [130]}), None, model, low=40, high=50, max_gap="60min"))
    assert out == [(40, "raw modeldata fill"), (50, "raw modeldata fill"), (40, "raw modeldata fill"), (None, "failed raw modeldata fill")]
    twice = model.withColumn("modelname", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("modelvariable", F.lit("v"))
    with pytest.raises(AmbiguousError):
        gapfill.fill_with_model("raw", gaps(spark, {1: [30]}), None, twice)


def test_debiased(spark):
    model = series(spark, [(m, 10) for m in range(0, 301, 10)])
    obs = series(spark, [(m, 7) for m in range(60, 100, 10)] + [(m, 9) for m in range(130, 170, 10)])
    g = gaps(spark, {1: [100, 110, 120]})
    options = {"lead": "40min", "trail": "40min"}
    out = filled(gapfill.fill_with_model("debiased", g, obs, model, min_lead=4, min_trail=4, **options))
    assert out == [(8, "debiased modeldata fill")] * 3
    assert filled(gapfill.fill_with_model("debiased", g, obs, model, min_lead=5, min_trail=4, **options))[0][1] == "failed debiased modeldata fill"


def test_diurnal_and_weighted(spark):
    day = 1440
    model = series(spark, [(m, 10) for m in range(-2 * day, 5 * day, 60)])
    obs = series(spark, [(m, 10 + (m % day) / 60) for m in range(-2 * day, 0, 60)] + [(m, 20 + (m % day) / 60) for m in range(180, 2 * day, 60)])
    g = gaps(spark, {1: [0, 60, 120]})
    out = filled(gapfill.fill_with_model("diurnal_debiased", g, obs, model, lead="24h", trail="24h", min_sample=2))
    assert [v for v, _ in out] == [pytest.approx(15 + h) for h in range(3)]
    weighted = filled(gapfill.fill_with_model("weighted_diurnal_debiased", g, obs, model, lead="24h", trail="24h", min_lead=1, min_trail=1))
    assert [v for v, _ in weighted] == [pytest.approx(10), pytest.approx(16), pytest.approx(22)]
    single = gapfill.fill_with_model("weighted_diurnal_debiased", gaps(spark, {1: [60]}), obs, model, min_lead=1, min_trail=1)
    assert filled(single)[0][0] is None


def test_status_and_flush(spark):
    model = series(spark, [(0, 0), (60, 60)])
    out = gapfill.fill_raw(gaps(spark, {1: [30], 2: [50, 90], 3: [100]}), model)
    assert sorted((r.gap_id, r.status, r.can_be_filled) for r in gapfill.fill_status(out).collect()) == [(1, "successful gapfill", False), (2, "partially successful gapfill", True), (3, "failed gapfill", True)]
    assert {r.status for r in gapfill.fill_status(gapfill.flush(out)).collect()} == {"unfilled gap"}


def test_every_anchor_must_be_near(spark):
    obs = series(spark, [(0, 1), (170, 5), (180, 10), (240, 12), (400, 3)])
    g = gaps(spark, {1: [200, 220]})
    ask = lambda **kw: [v for v, _ in filled(gapfill.interpolate(g, obs, "time", "1h", **kw))]
    assert ask(n_leading=2, max_lead="30min") == [pytest.approx(10 + 2 / 3), pytest.approx(10 + 4 / 3)]
    assert ask(n_leading=2, max_lead="29min") == [None, None] and ask(n_leading=3, max_lead="2h") == [None, None]
    assert ask(n_leading=4) == [None, None] and ask(n_leading=3)[0] is not None
    assert ask(n_trailing=2, max_trail="179min") == [None, None] and ask(n_trailing=2, max_trail="3h")[0] is not None


def test_records_near_a_gap_however_far(spark):
    day = 1440
    obs = series(spark, [(-40 * day, 1), (-39 * day, 2), (5, None), (90 * day, 4), (91 * day, 6)])
    g = gaps(spark, {1: [10, 20], 2: [89 * day]})
    got = sorted((r.gap_id, r.side, r.value) for r in gapfill.nearest_records(g, obs, 2, 1).collect())
    assert got == [(1, "lead", 1), (1, "lead", 2), (1, "trail", 4), (2, "lead", 1), (2, "lead", 2), (2, "trail", 4)]
    assert [v for v, _ in filled(gapfill.interpolate(gaps(spark, {1: [10, 20]}), obs, "cubicspline", "1h", n_leading=2, n_trailing=2))] == [pytest.approx(v, abs=2) for v in (3, 3)]
    assert gapfill.nearest_records(g.limit(0), obs, 2, 1).count() == 0


def test_interpolation_methods(spark):
    obs = series(spark, [(0, 0), (10, 8), (50, 16), (60, 2)])
    g = gaps(spark, {1: [20, 30, 40]})
    ask = lambda method, **kw: [v for v, _ in filled(gapfill.interpolate(g, obs, method, "1h", **kw))]
    assert ask("nearest") == [8, 8, 16] and ask("zero") == [8, 8, 8] and ask("slinear") == [10, 12, 14]
    assert ask("quadratic", n_leading=2, n_trailing=1)[0] is not None
    assert ask("polynomial", order=3) == [None] * 3 and ask("cubicspline") == [pytest.approx(v) for v in (10, 12, 14)]
    for method in ("no-such-method", "Time", ""):
        with pytest.raises(ArgumentError):
            gapfill.interpolate(g, obs, method)


@pytest.mark.parametrize("fill", [gapfill.fill_debiased, gapfill.fill_diurnal, gapfill.fill_weighted_diurnal])
def test_model_meets_each_record_once_not_once_for_each_gap_near_it(spark, monkeypatch, fill):
    met, real = [], gapfill.at_stamps
    monkeypatch.setattr(gapfill, "at_stamps", lambda model, targets: met.append(targets.count()) or real(model, targets))
    obs = series(spark, [(60 * h, h) for h in range(48) if h % 4])
    model = series(spark, [(60 * h, h + 1) for h in range(-48, 97)])
    fill(gaps(spark, {i: [240 * i] for i in range(1, 12)}), obs, model, lead="24h", trail="24h")
    assert met == [36, 11]  # records, then stamps to fill


def test_a_spline_of_one_piece_is_native_and_equals_the_fitted_one(spark):
    points = [(0, 3), (7, -1), (50, 8), (90, 2)]
    out = gapfill.interpolate(gaps(spark, {1: [20, 30]}), series(spark, points), "cubicspline", "1h", n_leading=2, n_trailing=2)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    want = gapfill.spline([60 * t for t, _ in points], [v for _, v in points], [1200, 1800])
    assert [v for v, _ in filled(out)] == pytest.approx(want.tolist())


def test_records_are_numbered_once_for_the_nearest(spark):
    near = gapfill.nearest_records(gaps(spark, {1: [20, 30]}), series(spark, [(0, 3), (7, -1), (50, 8), (90, 2)]), 2, 1)
    assert "row_number" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.side, r.value) for r in near.collect()) == [("lead", -1), ("lead", 3), ("trail", 8)]
