"""Alignment: irregular stamps onto an equispaced grid, and what is missing there.

Frames: ``obs`` has (name, obstype, datetime, value); a grid has (name,
obstype, origin, closing, freq_us).  One series is one (name, obstype).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import time as T
from . import scan
from ..labels import GAP

KEY = ["name", "obstype"]
#: Span of the pieces into which a series is cut where only near rows matter, so that a long series is not one task.
PIECE_US = 30 * 86400 * T.SECOND


def series() -> Window:
    return Window.partitionBy(*KEY).orderBy("ts")


def step_counts(obs: DataFrame) -> DataFrame:
    """How often each step between neighbouring stamps occurs in a series: (name, obstype, step, n).

    Steps are taken in pieces of time and counted before they meet, so that a
    series is reduced to its different steps, of which a measured one has few.
    """
    stamps = obs.where("datetime IS NOT NULL").select(*KEY, "datetime", F.lit(0.0).alias("value"))
    return scan.previous(stamps, KEY).where("before IS NOT NULL").select(*KEY, (F.col("ts") - F.col("before.t")).alias("step")).groupBy(*KEY, "step").agg(F.count("*").alias("n"))


def likely_frequency(obs: DataFrame, method: str = "median", tolerance: str = "2min") -> DataFrame:
    """Rows (name, obstype, freq_us): the median (or least) positive step of each series, rounded; series of one stamp have none."""
    counts = step_counts(obs).where("step > 0")
    if method == "median":
        w = Window.partitionBy(*KEY)
        up_to = F.sum("n").over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("_to", up_to).withColumn("_all", F.sum("n").over(w))
        # the middle step, or the mean of the two in the middle
        middle = lambda place: F.min(F.when(F.col("_to") >= place, F.col("step")))
        raw = ((middle(F.floor((F.col("_all") + 1) / 2)) + middle(F.floor(F.col("_all") / 2) + 1)) / 2).cast("long")
        out = ranked.groupBy(*KEY).agg(raw.alias("freq_us"))
    else:
        out = counts.groupBy(*KEY).agg(F.min("step").alias("freq_us"))
    tol = T.micros(tolerance)
    return out.withColumn("freq_us", T.simplify(F.col("freq_us"), tol, zero_protected=True)) if tol >= T.SECOND else out


def grid_of(obs: DataFrame, freq: str | Column, origin_tolerance: str = "5min", origin: str | None = None, closing: str | None = None) -> DataFrame:
    """The grid of each series: its first stamp rounded, and the last grid stamp not after its last one.

    ``freq`` is a span, or a column of microseconds in ``obs``.  ``origin`` and
    ``closing`` (UTC stamps) are taken as they are; a closing that no whole
    number of steps reaches from the origin raises.
    """
    freq_us = F.lit(T.micros(freq)) if isinstance(freq, str) else F.first(freq)
    ts = T.to_micros(F.col("datetime"))
    ends = obs.groupBy(*KEY).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), freq_us.cast("long").alias("freq_us"))
    fixed = lambda x: T.to_micros(F.lit(x).cast("timestamp"))
    ends = ends.withColumn("origin_us", fixed(origin) if origin else T.simplify(F.col("lo"), T.micros(origin_tolerance)))
    if closing:
        if not ends.where(F.pmod(fixed(closing) - F.col("origin_us"), F.col("freq_us")) != 0).isEmpty():
            raise ArgumentError(f"no whole number of steps leads to the closing {closing}")
        last = fixed(closing)
    else:
        last = F.col("origin_us") + ((F.col("hi") - F.col("origin_us")) / F.col("freq_us")).cast("long") * F.col("freq_us")
    return ends.select(*KEY, T.to_timestamp(F.col("origin_us")).alias("origin"), T.to_timestamp(last).alias("closing"), "freq_us")


def grid_rows(grid: DataFrame) -> DataFrame:
    """One row (name, obstype, datetime) for each stamp of a grid."""
    stamps = F.explode(F.sequence(T.to_micros(F.col("origin")), T.to_micros(F.col("closing")), F.col("freq_us")))
    return grid.where("closing >= origin").select(*KEY, stamps.alias("us")).select(*KEY, T.to_timestamp(F.col("us")).alias("datetime"))


def nearest(targets: DataFrame, raw: DataFrame, tolerance: str, later_wins: bool = False, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Nearest as-of join: each target with the raw row closest in time, not farther than ``tolerance`` (inclusive).

    Of two equally near the earlier wins, or the later with ``later_wins``.
    Adds ``raw_datetime`` (null: none near enough) and the raw ``columns``.
    Series are cut into pieces of time, and raw rows near a border go to both
    sides, so that one long series is spread over many tasks.
    """
    tol = T.micros(tolerance)
    us = T.to_micros(F.col("datetime"))
    piece = lambda x: F.floor(x / F.lit(PIECE_US))
    nothing = [F.lit(None).cast(dict(raw.dtypes)[c]).alias(c) for c in columns]
    left = targets.select(*KEY, "datetime", us.alias("ts"), F.lit(1).alias("is_target"), piece(us).alias("piece"), *nothing)
    right = raw.select(*KEY, "datetime", us.alias("ts"), F.lit(0).alias("is_target"), F.explode(F.array_distinct(F.array(piece(us - tol), piece(us), piece(us + tol)))).alias("piece"), *columns)
    both = left.unionByName(right)
    found = F.when(F.col("is_target") == 0, F.struct("ts", "datetime", *columns))
    by = Window.partitionBy(*KEY, "piece")
    before = by.orderBy("ts", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    after = by.orderBy(F.col("ts").desc(), "is_target").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("b", F.last(found, ignorenulls=True).over(before)).withColumn("a", F.last(found, ignorenulls=True).over(after)).where("is_target = 1")
    down, up = F.col("ts") - F.col("b.ts"), F.col("a.ts") - F.col("ts")
    take_after = F.col("b").isNull() | (up <= down if later_wins else up < down)
    both = both.withColumn("x", F.when(take_after & F.col("a").isNotNull(), F.col("a")).otherwise(F.col("b")))
    both = both.withColumn("x", F.when(F.abs(F.col("x.ts") - F.col("ts")) <= tol, F.col("x")))
    return both.select(*KEY, "datetime", F.col("x.datetime").alias("raw_datetime"), *[F.col(f"x.{c}").alias(c) for c in columns])


def regularise(obs: DataFrame, freq: str | Column, timestamp_tolerance: str = "4min", origin_tolerance: str = "5min", origin: str | None = None, closing: str | None = None) -> DataFrame:
    """Series on their grids: (name, obstype, datetime, raw_datetime, value, status).

    ``status`` is ``ok``, ``gap`` (no raw row near enough) or ``outlier`` (a raw
    row without value).  Rows that have a ``status`` already carry it over, and
    a ``label`` too.
    """
    carried = tuple(c for c in ("status", "label") if c in obs.columns)
    grid = grid_of(obs, freq, origin_tolerance, origin, closing)
    out = nearest(grid_rows(grid), obs, timestamp_tolerance, columns=("value", *carried))
    if "status" in carried:
        status = F.coalesce("status", F.lit("gap"))
    else:
        status = F.when(F.col("raw_datetime").isNull(), "gap").when(F.col("value").isNull(), "outlier").otherwise("ok")
    out = out.withColumn("status", status)
    return out.withColumn("label", F.coalesce("label", F.lit(GAP))) if "label" in carried else out


def resample(obs: DataFrame, freq: str, shift_tolerance: str = "4min", origin_tolerance: str = "4min", origin: str | None = None) -> DataFrame:
    """Existing series (nulls included: they may be nearest) onto a new frequency; earlier fills are lost.

    What a row was stays with it: a stamp that takes over a gap's row is a gap,
    one that takes over an outlier's is one, with its label.
    """
    return regularise(obs, freq, shift_tolerance, origin_tolerance, origin)


def synchronise(obs: DataFrame, timestamp_tolerance: str = "2min", freq_tolerance: str = "1min", fixed_origin: str | None = None) -> DataFrame:
    """Every series onto a rounded frequency of its own, so that stamps of different stations meet."""
    freq = likely_frequency(obs, "median", freq_tolerance)
    with_freq = obs.join(freq, KEY)
    out = nearest(grid_rows(grid_of(with_freq, F.col("freq_us"), origin=fixed_origin)), obs, timestamp_tolerance)
    return out.join(freq, KEY)


def regular_frequency(obs: DataFrame) -> DataFrame:
    """Rows (name, obstype, freq_us): the step of each series; raises where steps differ.  Series of one stamp have none."""
    found = step_counts(obs).groupBy(*KEY).agg(F.min("step").alias("freq_us"), F.max("step").alias("most"))
    if not found.where("freq_us <> most").isEmpty():
        raise ArgumentError("a series has no regular stamps; align it first")
    return found.select(*KEY, "freq_us")


def islands(missing: DataFrame) -> DataFrame:
    """Gaps-and-islands over (name, obstype, datetime, freq_us): adds ``gap_id`` (its number in the series, from 1) and ``gapstart``."""
    return scan.islands(missing, KEY)


def gap_overview(gaps: DataFrame) -> DataFrame:
    """One row for each gap of (…, gap_id, datetime, label, details): start, end, size, label and details."""
    by = gaps.groupBy(*KEY, "gap_id").agg(F.min("datetime").alias("gapstart"), F.max("datetime").alias("gapend"), F.count("*").alias("n_records"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("label"), F.array_sort(F.collect_set(F.coalesce("details", F.lit("")))).alias("d"))
    text = F.when(F.size("d") == 1, F.concat(F.lit("unidetail gap: "), F.col("d")[0])).otherwise(F.concat(F.lit("multi_details gap: "), F.array_join("d", " -- ")))
    size = (T.to_micros(F.col("gapend")) - T.to_micros(F.col("gapstart"))) / T.SECOND
    return by.select(*KEY, "gapstart", "gapend", size.cast("long").alias("gapsize_s"), "n_records", "label", text.alias("details"))
