"""Blocked scans: cutting a series into pieces changes nothing, wherever the cuts fall."""

import random

import pytest
from helpers import at, minutes, series
from pyspark.sql import functions as F

from skyloom.functions import time as T
from skyloom.operators import align, gapfill, qc, scan
from skyloom.operators.align import KEY

MINUTE = 60 * T.SECOND
PIECES = [MINUTE, 7 * MINUTE, 10**6 * MINUTE]


def noisy(seed, n=120, values=(None, 1, 1, 1, 2)):
    rnd = random.Random(seed)
    return [(m, rnd.choice(values)) for m in sorted(rnd.sample(range(4 * n), n))]


def plain_runs(rows, max_n):
    valid, out, i = [(m, v) for m, v in rows if v is not None], [], 0
    while i < len(valid):
        j = i
        while j < len(valid) and valid[j][1] == valid[i][1]:
            j += 1
        out += [m for m, _ in valid[i:j]] if j - i > max_n else []
        i = j
    return out


@pytest.mark.parametrize("piece", PIECES)
def test_repetitions_and_steps_in_pieces(spark, piece):
    rows = noisy(1)
    obs = series(spark, rows)
    assert minutes(qc.repetition_outliers(obs, 3, piece)) == plain_runs(rows, 3)
    valid = [(m, v) for m, v in rows if v is not None]
    fast = [m for (m0, v0), (m, v) in zip(valid, valid[1:], strict=False) if v - v0 > (m - m0) * 60 * 0.002 or v - v0 < -(m - m0) * 60 * 0.003]
    assert minutes(qc.step_outliers(obs, 0.002, -0.003, piece)) == fast != []


def test_a_run_over_many_pieces(spark):
    rows = [(m, 5.0 if 3 <= m < 97 else 1.0) for m in range(100)]
    got = scan.run_lengths(series(spark, rows), KEY, 10 * MINUTE)
    assert {(r.value, r.run_length) for r in got.collect()} == {(1.0, 3), (5.0, 94)}


@pytest.mark.parametrize("piece", PIECES)
def test_neighbours_in_pieces(spark, piece):
    rows = noisy(2)
    targets = series(spark, [(m, None) for m in range(-3, 500, 4)]).drop("value")
    valid = [(m, v) for m, v in rows if v is not None]
    got = scan.neighbours(targets, series(spark, rows), KEY, piece).collect()
    assert len(got) == 126
    for r in got:
        m = (r.ts - int(T.SECOND * at(0).replace(tzinfo=__import__("datetime").UTC).timestamp())) // MINUTE
        before, after = [x for x in valid if x[0] <= m], [x for x in valid if x[0] >= m]
        assert (r.before.v if r.before else None) == (before[-1][1] if before else None)
        assert (r.after.v if r.after else None) == (after[0][1] if after else None)


@pytest.mark.parametrize("piece", PIECES)
def test_islands_and_places_in_pieces(spark, piece):
    rnd = random.Random(3)
    stamps = sorted(rnd.sample(range(0, 300), 200))
    missing = series(spark, [(m, None) for m in stamps]).drop("value").withColumn("freq_us", F.lit(MINUTE))
    want, gap, start = [], 0, None
    for i, m in enumerate(stamps):
        if i == 0 or m - stamps[i - 1] != 1:
            gap, start = gap + 1, m
        want.append((m, gap, start))
    found = scan.islands(missing, KEY, piece).collect()
    assert sorted((int((r.datetime - at(0)).total_seconds() // 60), r.gap_id, int((r.gapstart - at(0)).total_seconds() // 60)) for r in found) == want
    places = scan.numbered(missing, KEY, "place", piece).orderBy("datetime").collect()
    assert [r.place for r in places] == list(range(1, 201))


def test_frequency_is_the_median_of_counted_steps(spark):
    obs = series(spark, [(0, 1), (10, 1), (20, 1), (30, None), (45, 1), (65, 1)])  # steps 10 10 10 15 20
    assert align.likely_frequency(obs, tolerance="0s").first().freq_us == 10 * MINUTE
    obs = series(spark, [(0, 1), (10, 1), (20, 1), (40, 1), (60, 1), (60, 2)])  # steps 10 10 20 20, and none
    assert align.likely_frequency(obs, tolerance="0s").first().freq_us == 15 * MINUTE
    assert sorted((r.step // MINUTE, r.n) for r in align.step_counts(obs).collect()) == [(0, 1), (10, 2), (20, 2)]


def test_one_series_is_many_tasks(spark):
    stamps = spark.range(40_000).select(F.lit("a").alias("name"), F.lit("temp").alias("obstype"), F.timestamp_seconds(F.col("id") * 600).alias("datetime"), F.floor(F.col("id") / 3).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = qc.repetition_outliers(stamps, 2)
        assert found.groupBy(F.spark_partition_id().alias("p")).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert found.count() == 39_999  # the last run has one row
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_empty_tables(spark):
    none = series(spark, [(0, 1)]).limit(0)
    assert qc.repetition_outliers(none).count() == qc.step_outliers(none).count() == scan.islands(none.withColumn("freq_us", F.lit(1)), KEY).count() == 0
    gaps = none.select(*KEY, F.lit(1).alias("gap_id"), "datetime")
    assert gapfill.anchors(gaps, none, True).count() == 0
