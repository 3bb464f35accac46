import pytest
from helpers import START, at, minutes, series
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.errors import ArgumentError
from skyloom.operators import align, ingest


def targets(spark, stamps):
    return series(spark, [(m, None) for m in stamps]).drop("value")


def matched(df):
    return {int((r.datetime - START).total_seconds() // 60): None if r.raw_datetime is None else (r.raw_datetime - START).total_seconds() / 60 for r in df.collect()}


def test_nearest_ties_and_tolerance(spark):
    raw = series(spark, [(8, 1), (12, 2), (24, 3), (100, 4)])
    assert matched(align.nearest(targets(spark, [10, 20, 28, 60]), raw, "4min")) == {10: 8, 20: 24, 28: 24, 60: None}
    assert matched(align.nearest(targets(spark, [10]), raw, "4min", later_wins=True)) == {10: 12}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 90_000), min_size=1, max_size=12, unique=True), st.lists(st.integers(0, 90_000), min_size=1, max_size=12, unique=True))
def test_nearest_by_hand(spark, grid, stamps):
    """Stamps span more than one piece of a series."""
    got = matched(align.nearest(targets(spark, grid), series(spark, [(m, m) for m in stamps]), "10d"))
    for g in grid:
        best = min(stamps, key=lambda m: (abs(m - g), m))
        assert got[g] == (best if abs(best - g) <= 14_400 else None)


def test_frequency(spark):
    obs = series(spark, [(0, 1), (10, 1), (20, 1), (31, 1), (50, 1)]).union(series(spark, [(0, 1)], "b"))
    assert [(r.name, r.freq_us) for r in align.likely_frequency(obs).collect()] == [("a", 600_000_000)]
    assert align.likely_frequency(obs, "highest", "0s").first().freq_us == 600_000_000


def test_regularise(spark):
    obs = series(spark, [(2, 1), (11, 2), (20, None), (41, 5)])
    out = {int((r.datetime - START).total_seconds() // 60): (r.value, r.status) for r in align.regularise(obs, "10min", "3min").collect()}
    assert out == {0: (1, "ok"), 10: (2, "ok"), 20: (None, "outlier"), 30: (None, "gap"), 40: (5, "ok")}


def test_one_raw_row_serves_two_stamps(spark):
    out = matched(align.regularise(series(spark, [(0, 1), (15, 2), (30, 3)]), "10min", "6min"))
    assert out[10] == out[20] == 15


def test_islands_and_overview(spark):
    missing = series(spark, [(0, None), (10, None), (30, None), (50, None), (60, None)]).drop("value").withColumn("freq_us", F.lit(600_000_000))
    gaps = align.islands(missing)
    assert sorted((r.gap_id, r.datetime) for r in gaps.collect()) == [(1, at(0)), (1, at(10)), (2, at(30)), (3, at(50)), (3, at(60))]
    over = align.gap_overview(gaps.withColumn("label", F.lit("gap")).withColumn("details", F.when(F.col("datetime") == at(60), "other")))
    rows = sorted((r.gapstart, r.gapend, r.gapsize_s, r.n_records, r.details) for r in over.collect())
    assert rows[0][1:] == (at(10), 600, 2, "unidetail gap: ") and rows[1][2:4] == (0, 1) and rows[2][4] == "multi_details gap:  -- other"


def test_synchronise_and_resample(spark):
    obs = series(spark, [(i * 10 + 1, i) for i in range(12)]).union(series(spark, [(i * 10, i) for i in range(12)], "b"))
    out = align.synchronise(obs)
    assert {r.freq_us for r in out.collect()} == {600_000_000}
    half = align.resample(obs, "20min", "2min")
    assert set(minutes(half)) == {0, 20, 40, 60, 80, 100} and half.count() == 12


def test_empty(spark):
    obs = series(spark, [(0, 1)]).limit(0)
    assert align.regularise(obs, "10min").count() == 0 and align.likely_frequency(obs).count() == 0


def test_forced_ends(spark):
    obs = series(spark, [(3, 1), (13, 2), (33, 4)])
    out = align.regularise(obs, "10min", "4min", origin=str(at(-10)), closing=str(at(40)))
    assert minutes(out) == [-10, 0, 10, 20, 30, 40] and [r.status for r in out.orderBy("datetime").collect()] == ["gap", "ok", "ok", "gap", "ok", "gap"]
    with pytest.raises(ArgumentError):
        align.grid_of(obs, "10min", origin=str(at(0)), closing=str(at(45)))


def test_resample_keeps_gaps_and_outliers(spark):
    rows = [(0, 1.0, "ok", "ok"), (10, None, "gap", "gap"), (20, None, "gap", "gap"), (30, 4.0, "ok", "ok"), (40, None, "outlier", "gross value outlier"), (50, 6.0, "ok", "ok")]
    obs = spark.createDataFrame([("a", "temp", at(m), v, s, x) for m, v, s, x in rows], "name string, obstype string, datetime timestamp, value double, status string, label string")
    out = [(r.value, r.status, r.label) for r in align.resample(obs, "20min", "2min").orderBy("datetime").collect()]
    assert out == [(1, "ok", "ok"), (None, "gap", "gap"), (None, "outlier", "gross value outlier")]


def test_ingest(spark):
    rows = [(1, 5.0), (10, 6.0), (10, 7.0), (21, None), (30, 9.0), (41, 1.0), (50, 2.0), (60, 3.0)]
    raw = spark.createDataFrame([("a", "temp", at(m), v, i) for i, (m, v) in enumerate(rows)] + [("b", "temp", at(0), 1.0, 9)], "name string, obstype string, datetime timestamp, value double, file_order long")
    out = ingest.ingest(raw).orderBy("datetime").collect()
    assert [(r.value, r.outlier_value, r.label) for r in out] == [(5, None, "ok"), (None, 6, "duplicated timestamp outlier"), (None, None, "gap"), (9, None, "ok"), (1, None, "ok"), (2, None, "ok"), (3, None, "ok")]
    assert {r.name for r in out} == {"a"} and out[0].raw_timestamp == at(1) and out[2].raw_timestamp is None
    later = spark.createDataFrame([("a", "temp", at(m), v, i) for i, (m, v) in enumerate([(50, 7.0), (60, 8.0), (70, 9.0)])], raw.schema)
    both = ingest.merge_series(ingest.ingest(raw), ingest.ingest(later)).orderBy("datetime").collect()
    assert [(r.value, r.label) for r in both] == [(5, "ok"), (6, "ok"), (None, "gap"), (9, "ok"), (1, "ok"), (2, "ok"), (3, "ok"), (9, "ok")]
    assert ingest.ingest(raw.limit(0)).count() == 0
