"""Blocked scans: what a row needs of all rows before (or after) it, without a task that holds a whole series.

A series is cut into pieces of time.  Each piece is reduced to a small state by
a partial aggregation, the states of a series are scanned in order (one row for
each piece), and every piece gets the carry of those before or after it.  Rows
are shuffled by series and piece, so one long series is spread over as many
tasks as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T

#: Span of a piece: a row of one second's series has 86,400 neighbours, and a century has 36,525 states.
PIECE_US = 86400 * T.SECOND


def in_pieces(df: DataFrame, piece_us: int | None = None) -> DataFrame:
    """``df`` with ``ts`` (its datetime in microseconds) and ``piece``."""
    ts = T.to_micros(F.col("datetime"))
    return df.withColumn("ts", ts).withColumn("piece", F.floor(ts / F.lit(piece_us or PIECE_US)))


def rows_of(keys: list[str]) -> Window:
    """The rows of a piece."""
    return Window.partitionBy(*keys, "piece")


def with_carry(df: DataFrame, keys: list[str], states: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """``df`` of pieces with columns made from the states of other pieces.

    ``states`` are aggregates of a piece's rows, ``carries`` window expressions
    over them, with ``earlier`` or ``later`` as their window.
    """
    scanned = df.groupBy(*keys, "piece").agg(*[c.alias(n) for n, c in states.items()]).select(*keys, "piece", *[c.alias(n) for n, c in carries.items()])
    return df.join(scanned, [*keys, "piece"])


def earlier(keys: list[str]) -> Window:
    """The states of all earlier pieces of the series."""
    return Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)


def later(keys: list[str]) -> Window:
    """The states of all later pieces, the nearest last."""
    return Window.partitionBy(*keys).orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], name: str, piece_us: int | None = None) -> DataFrame:
    """``df`` with its rows' place in time order, from 1, as ``name``."""
    rows = in_pieces(df, piece_us).withColumn("_own", F.row_number().over(rows_of(keys).orderBy("ts")))
    out = with_carry(rows, keys, {"_n": F.count("*")}, {"_before": F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0))})
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own", "ts", "piece")


def neighbours(targets: DataFrame, known: DataFrame, keys: list[str], piece_us: int | None = None) -> DataFrame:
    """``targets`` with ``ts``, and structs (t, v) ``before`` and ``after``: the last known row not after each, and the first not before it.

    ``known`` has (keys, datetime, value); rows without a value are passed over.
    """
    left = targets.withColumn("_target", F.lit(1)).withColumn("_k", F.lit(None).cast("struct<t:bigint,v:double>"))
    right = known.where("value IS NOT NULL").select(*keys, "datetime", F.lit(0).alias("_target"), F.struct(T.to_micros(F.col("datetime")).alias("t"), F.col("value").cast("double").alias("v")).alias("_k"))
    both = in_pieces(left.unionByName(right, allowMissingColumns=True), piece_us)
    whole = Window.unboundedPreceding
    for name, order in (("_b", F.col("ts")), ("_a", F.col("ts").desc())):
        both = both.withColumn(name, F.last("_k", ignorenulls=True).over(rows_of(keys).orderBy(order, "_target").rowsBetween(whole, 0)))
    out = with_carry(both, keys, {"_first": F.min("_k"), "_last": F.max("_k")}, {"_cb": F.last("_last", ignorenulls=True).over(earlier(keys)), "_ca": F.last("_first", ignorenulls=True).over(later(keys))})
    return out.where("_target = 1").select(*targets.columns, "ts", F.coalesce("_b", "_cb").alias("before"), F.coalesce("_a", "_ca").alias("after"))


def previous(df: DataFrame, keys: list[str], piece_us: int | None = None) -> DataFrame:
    """The rows of ``df`` that have a value, with ``ts`` and ``before``: the struct (t, v) of the one before, null for the first of a series."""
    rows = in_pieces(df.where("value IS NOT NULL"), piece_us).withColumn("_k", F.struct(F.col("ts").alias("t"), F.col("value").alias("v")))
    rows = rows.withColumn("_b", F.lag("_k").over(rows_of(keys).orderBy("ts")))
    out = with_carry(rows, keys, {"_last": F.max("_k")}, {"_cb": F.last("_last").over(earlier(keys))})
    return out.withColumn("before", F.coalesce("_b", "_cb")).drop("_k", "_b", "_cb", "piece")


def run_lengths(df: DataFrame, keys: list[str], piece_us: int | None = None) -> DataFrame:
    """The rows of ``df`` that have a value, with ``run_length``: how many rows with that value stand in its run.

    Runs are counted in pieces; of a piece only its first and last run can go
    on beyond it, so those alone are joined across pieces, two rows for each.
    """
    own = rows_of(keys)
    rows = in_pieces(df.where("value IS NOT NULL"), piece_us)
    rows = rows.withColumn("_new", F.coalesce((F.col("value") != F.lag("value").over(own.orderBy("ts"))).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(own.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    runs = rows.groupBy(*keys, "piece", "_run").agg(F.count("*").alias("n"), F.first("value").alias("v"))
    ends = runs.groupBy(*keys, "piece").agg(F.min(F.struct("_run", "n", "v")).alias("head"), F.max(F.struct("_run", "n", "v")).alias("tail"))
    ends = ends.withColumn("_on", F.coalesce(F.col("head.v") == F.lag("tail.v").over(Window.partitionBy(*keys).orderBy("piece")), F.lit(False)))
    one = F.col("head._run") == F.col("tail._run")
    borders = ends.select(*keys, "piece", F.explode(F.filter(F.array(F.struct(F.col("head._run").alias("_run"), F.col("head.n").alias("n"), (~F.col("_on")).cast("int").alias("new")), F.when(~one, F.struct(F.col("tail._run").alias("_run"), F.col("tail.n").alias("n"), F.lit(1).alias("new")))), lambda x: x.isNotNull())).alias("b")).select(*keys, "piece", "b.*")
    borders = borders.withColumn("_whole", F.sum("new").over(Window.partitionBy(*keys).orderBy("piece", "_run").rowsBetween(Window.unboundedPreceding, 0)))
    borders = borders.select(*keys, "piece", "_run", F.sum("n").over(Window.partitionBy(*keys, "_whole")).alias("_across"))
    inner = rows.withColumn("_within", F.count("*").over(Window.partitionBy(*keys, "piece", "_run")))
    return inner.join(borders, [*keys, "piece", "_run"], "left").withColumn("run_length", F.coalesce("_across", "_within")).drop("_run", "_within", "_across", "piece")


def islands(df: DataFrame, keys: list[str], piece_us: int | None = None) -> DataFrame:
    """``df`` of (keys, datetime, freq_us) with ``gap_id``, the number of its run of stamps that follow each other by ``freq_us``, and ``gapstart``, that run's first stamp."""
    by = rows_of(keys).orderBy("ts")
    rows = in_pieces(df, piece_us).withColumn("_p", F.lag("ts").over(by))
    rows = rows.withColumn("_new", (F.col("ts") - F.col("_p") != F.col("freq_us")).cast("int"))  # null for a piece's first row
    inside = F.when(F.col("_new") == 1, F.col("ts"))
    states = {"_lo": F.min("ts"), "_hi": F.max("ts"), "_f": F.min_by("freq_us", "ts"), "_n": F.coalesce(F.sum("_new"), F.lit(0)), "_s": F.max(inside)}
    scanned = rows.groupBy(*keys, "piece").agg(*[c.alias(n) for n, c in states.items()])
    border = F.coalesce((F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("piece")) != F.col("_f")).cast("int"), F.lit(1))
    scanned = scanned.withColumn("_b", border)
    last = scanned.withColumn("_s", F.coalesce("_s", F.when(F.col("_b") == 1, F.col("_lo"))))
    carried = last.select(*keys, "piece", (F.coalesce(F.sum(F.col("_n") + F.col("_b")).over(earlier(keys)), F.lit(0)) + F.col("_b")).alias("_from"), F.when(F.col("_b") == 1, F.col("_lo")).otherwise(F.last("_s", ignorenulls=True).over(earlier(keys))).alias("_open"))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_k", F.coalesce(F.sum("_new").over(so_far), F.lit(0))).withColumn("_at", F.last(inside, ignorenulls=True).over(so_far))
    out = rows.join(carried, [*keys, "piece"])
    return out.select(*df.columns, (F.col("_from") + F.col("_k")).alias("gap_id"), T.to_timestamp(F.coalesce("_at", "_open")).alias("gapstart"))
