import random

import pytest
from helpers import at, minutes, series
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError
from skyloom.operators import qc


def found(df, check):
    return minutes(qc.flagged(df, check).where("flag"))


def test_gross_value_bounds(spark):
    assert found(series(spark, [(0, -15), (1, 39), (2, -15.1), (3, 39.1), (4, None)]), qc.gross_value()) == [2, 3]


def persistent(rows, half, least):
    rows = [r for r in rows if r[1] is not None]
    out = []
    for t, _ in rows:
        w = [v for s, v in rows if abs(s - t) <= half]
        if len(w) >= least and len(set(w)) == 1:
            out.append(t)
    return out


def varied(rows, half, least, up, down):
    rows = [r for r in rows if r[1] is not None]
    out = []
    for t, _ in rows:
        w = [(v, s) for s, v in rows if abs(s - t) <= half]
        high, low = max(v for v, _ in w), min(v for v, _ in w)
        first_high, first_low = min(s for v, s in w if v == high), min(s for v, s in w if v == low)
        rises, falls = first_high > first_low, first_high < first_low
        if len(w) >= least and (rises and high - low > up * half * 2 * 60 or falls and high - low > down * half * 2 * 60):
            out.append(t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_by_hand(spark, seed):
    r = random.Random(seed)
    rows = [(m, r.choice([None, 1, 1, 1, 2, 9])) for m in sorted(r.sample(range(0, 600, 5), 60))]
    df = series(spark, rows)
    assert found(df, qc.persistence("60min", 3)) == persistent(rows, 30, 3)
    assert found(df, qc.window_variation("60min", 3, 0.001, -0.0005)) == varied(rows, 30, 3, 0.001, 0.0005)


def test_windows_over_pieces_are_the_same(spark):
    r = random.Random(9)
    rows = [(m, r.choice([1, 1, 1, 2])) for m in sorted(r.sample(range(0, 200_000, 60), 500))]
    df = series(spark, rows)
    cut = qc.windowed_outliers(df, qc.persistence, "persistence", "40h", regular=False, min_records=4)
    assert minutes(cut) == found(df, qc.persistence("40h", 4)) and minutes(cut)


def test_repetitions_run_lengths(spark):
    rows = [(0, 1), (1, 1), (2, None), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3)]
    assert found(series(spark, rows), qc.repetitions(2)) == [0, 1, 3, 4, 5, 6]
    assert found(series(spark, rows), qc.repetitions(3)) == []


def test_step_limits(spark):
    check = qc.step(1 / 60, -2 / 60)
    assert found(series(spark, [(0, 0), (1, 1), (2, 2.1), (3, 0.2), (4, -2), (5, None), (6, 0)]), check) == [2, 4]
    with pytest.raises(ArgumentError):
        qc.step(-1, -1)


def test_duplicates(spark):
    raw = series(spark, [(0, 5), (0, None), (10, 1), (20, 3), (20, 2), (20, 4)]).withColumn("o", F.monotonically_increasing_id())
    assert sorted((r.datetime, r.value) for r in qc.duplicated_timestamps(raw, "o").collect()) == [(at(0), 5), (at(20), 3)]
    assert sorted((r.datetime, r.value) for r in qc.without_duplicates(raw, "o").collect()) == [(at(0), None), (at(10), 1), (at(20), None)]


def test_chain_goes_on_with_what_is_left(spark):
    out = qc.chain(series(spark, [(0, 1), (1, 100), (2, 1), (3, 1), (4, None)]), [("gross_value", qc.gross_value(0, 50)), ("repetitions", qc.repetitions(2))])
    assert [(r.raw_value, r.value, r.label) for r in out.orderBy("datetime").collect()] == [
        (1, None, "repetitions outlier"),
        (100, None, "gross value outlier"),
        (1, None, "repetitions outlier"),
        (1, None, "repetitions outlier"),
        (None, None, None),
    ]
    stats = [tuple(r) for r in qc.statistics(out, ["gross_value", "repetitions"]).orderBy("seq").collect()]
    assert stats == [(0, "gross_value", 5, 4, 1), (1, "repetitions", 5, 3, 3)]
    assert {r.label for r in qc.outliers_to_gaps(out).collect()} == {"gap"}


def test_white_lists(spark):
    flags = qc.outliers(series(spark, [(0, 99), (1, 99)]).union(series(spark, [(0, 99)], "b")), qc.gross_value(), "gross_value")
    by_name = spark.createDataFrame([("a",)], "name string")
    by_stamp = spark.createDataFrame([("a", at(1))], "name string, datetime timestamp")
    assert [r.name for r in qc.without_white(flags, by_name).collect()] == ["b"]
    assert qc.without_white(flags, by_stamp).count() == 2
    with pytest.raises(ArgumentError):
        qc.without_white(flags, by_name.withColumnRenamed("name", "x"))


def test_view_precedence(spark):
    label = lambda df, x: df.withColumn("label", F.lit(x))
    ok, bad, gap = label(series(spark, [(0, 1), (1, 2), (2, 3)]), "ok"), label(series(spark, [(1, 2), (2, 3)]), "bad"), label(series(spark, [(2, None)]), "gap")
    assert [r.label for r in qc.long_view(ok, bad, gap).orderBy("datetime").collect()] == ["ok", "bad", "gap"]
    assert qc.window_fits("1h", 6, "10min") and not qc.window_fits("1h", 7, "10min")


def test_window_guard(spark):
    """A series whose step is too wide for the window isn't tested; irregular stamps raise."""
    fine = series(spark, [(m, 1) for m in range(0, 60, 10)])
    wide = series(spark, [(m, 1) for m in range(0, 360, 60)], "b")
    out = qc.windowed_outliers(fine.union(wide), qc.persistence, "persistence", "120min", min_records=3)
    assert {r.name for r in out.collect()} == {"a"} and out.count() == 6
    both = qc.windowed_outliers(fine.union(wide), qc.persistence, "persistence", "120min", regular=False, min_records=3)
    assert {r.name for r in both.collect()} == {"a", "b"}
    with pytest.raises(ArgumentError):
        qc.windowed_outliers(fine.union(series(spark, [(0, 1), (7, 1), (30, 1)], "c")), qc.persistence, "persistence", "1h", min_records=3)
    assert qc.windowed_outliers(fine.limit(0), qc.persistence, "persistence", "1h", min_records=3).count() == 0


def test_station_statistics(spark):
    rows = series(spark, [(0, 1), (1, 100), (2, 1), (3, 1), (4, None)]).union(series(spark, [(0, 5), (1, None)], "b"))
    out = qc.chain(rows, [("gross_value", qc.gross_value(0, 50)), ("repetitions", qc.repetitions(2))])
    got = {(r.name, r.qc_check): (r.n_all, r.n_checked, r.n_labeled) for r in qc.station_statistics(out, ["gross_value", "repetitions"]).collect()}
    assert got == {
        ("a", "ok"): (5, None, 0), ("a", "gap"): (5, None, 1), ("a", "gross value outlier"): (5, 4, 1), ("a", "repetitions outlier"): (5, 3, 3),
        ("b", "ok"): (2, None, 1), ("b", "gap"): (2, None, 1), ("b", "gross value outlier"): (2, 1, 0), ("b", "repetitions outlier"): (2, 1, 0),
    }
    assert {r.qc_check: r.n_labeled for r in qc.station_statistics(out, ["gross_value"], []).collect()} == {"ok": 1, "gap": 2, "gross value outlier": 1}
    assert [r.datetime for r in qc.invalid_rows(rows.union(series(spark, [(4, None), (9, None)]))).orderBy("datetime", "name").collect()] == [at(1), at(9)]


def test_window_variation_limit_is_rounded_once(spark):
    """A spread that is exactly rate times seconds is no outlier, nor is one a last digit below it."""
    limit = 0.0006 * 86400
    assert limit != 0.0006 * 86400_000_000 / 1_000_000  # what the limit was
    obs = series(spark, [(0, 0.0), (60, 1.0), (120, limit)])
    found = lambda more: qc.windowed_outliers(obs.withColumn("value", F.when(F.col("value") == limit, limit + more).otherwise(F.col("value"))), qc.window_variation, "window_variation", "24h", regular=False, min_records=3, max_increase_per_second=0.0006, max_decrease_per_second=-0.0007).count()
    assert found(0.0) == 0 and found(1e-9) == 3


def test_long_view_of_a_labelled_frame(spark):
    """Its rows with another label are the outliers; a gap hides both."""
    rows = [("a", "temp", at(0), 1.0, "ok"), ("a", "temp", at(1), 2.0, "ok"), ("a", "temp", at(1), 3.0, "bad"), ("a", "temp", at(2), 4.0, "bad")]
    frame = spark.createDataFrame(rows, "name string, obstype string, datetime timestamp, value double, label string")
    gap = frame.where("value = 4").withColumn("value", F.lit(None).cast("double")).withColumn("label", F.lit("gap"))
    assert [(r.value, r.label) for r in qc.long_view(frame, None, gap).orderBy("datetime").collect()] == [(1.0, "ok"), (3.0, "bad"), (None, "gap")]


def test_a_chain_is_dealt_over_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(qc, "TASK_ROWS", 5)
    obs = series(spark, [(i, i % 7) for i in range(60)])
    out = qc.chain(obs, [("gross_value", qc.gross_value(1, 5)), ("repetitions", qc.repetitions(3))])
    assert out.rdd.getNumPartitions() == 13
    assert out.count() == 60
