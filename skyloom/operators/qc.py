"""Quality control of single series.

Each check is a column expression over the same partitioning and order, so a
chain of checks needs one shuffle and one sort.  Nulls are earlier outliers or
gaps; they are passed over.  A check gives a flag column; ``chain`` runs checks
in order, each on the values that the earlier ones left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import time as T
from ..labels import CHECKS, GAP, LABELS, OK
from . import scan
from .align import KEY, PIECE_US, regular_frequency, series

#: Rows of a task that runs a chain of checks, if no series has more.
TASK_ROWS = 200_000
Check = Callable[[Column], Column]


def gross_value(lower: float = -15.0, upper: float = 39.0) -> Check:
    """Values below ``lower`` or above ``upper``."""
    return lambda v: F.coalesce((v < lower) | (v > upper), F.lit(False))


def _centred(window_us: int, by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("ts").rangeBetween(-(window_us // 2), window_us // 2)


def persistence(window: str = "60min", min_records: int = 5, by: list[str] = KEY) -> Check:
    """Rows in the middle of a window (ends included) that has enough values, all equal."""
    w = _centred(T.micros(window), by)
    return lambda v: F.coalesce(v.isNotNull() & (F.count(v).over(w) >= min_records) & (F.min(v).over(w) == F.max(v).over(w)), F.lit(False))


def repetitions(max_n: int = 5) -> Check:
    """All rows of a run of more than ``max_n`` equal values."""

    def check(v: Column) -> Column:
        previous = F.last(v, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
        return F.when(v.isNotNull(), (previous.isNull() | (v != previous)).cast("int")).otherwise(0)

    def flag(df: DataFrame, column: str, out: str) -> DataFrame:
        run = df.withColumn("_start", check(F.col(column))).withColumn("_run", F.sum("_start").over(series()))
        return run.withColumn(out, F.col(column).isNotNull() & (F.count(column).over(Window.partitionBy(*KEY, "_run")) > max_n)).drop("_start", "_run")

    flag.frame = True
    return flag


def _rates(increase: float, decrease: float) -> None:
    if increase < 0 or decrease > 0:
        raise ArgumentError("the increase must not be negative, the decrease not positive")


def step(max_increase_per_second: float = 8 / 3600, max_decrease_per_second: float = -10 / 3600) -> Check:
    """Values that rise or fall too fast since the one before (strict); the first never."""
    _rates(max_increase_per_second, max_decrease_per_second)
    w = series().rowsBetween(Window.unboundedPreceding, -1)

    def check(v: Column) -> Column:
        before = F.last(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("ts").alias("t"))), ignorenulls=True).over(w)
        seconds = (F.col("ts") - before["t"]) / T.SECOND
        change = v - before["v"]
        return F.coalesce((change > F.lit(max_increase_per_second) * seconds) | (change < F.lit(max_decrease_per_second) * seconds), F.lit(False))

    return check


def window_variation(window: str = "1h", min_records: int = 3, max_increase_per_second: float = 0.0022, max_decrease_per_second: float = -0.0027, by: list[str] = KEY) -> Check:
    """Rows in the middle of a window whose extremes differ too much for the way between them; the first of equal extremes counts."""
    us = T.micros(window)
    w = _centred(us, by)
    seconds = us / T.SECOND  # first: rate times microseconds would be rounded twice
    up, down = abs(max_increase_per_second) * seconds, abs(max_decrease_per_second) * seconds

    def check(v: Column) -> Column:
        high = F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("ts")).alias("t")))).over(w)
        low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("ts").alias("t")))).over(w)
        spread = high["v"] - low["v"]
        rising, falling = -high["t"] > low["t"], -high["t"] < low["t"]
        return F.coalesce(v.isNotNull() & (F.count(v).over(w) >= min_records) & (((spread > up) & rising) | ((spread > down) & falling)), F.lit(False))

    return check


def window_fits(window: str, min_records: int, freq: str | Column):
    """Whether a window can hold enough records at all; if not, the check finds nothing.  ``freq`` is a span or a column of microseconds."""
    return T.micros(window) / (T.micros(freq) if isinstance(freq, str) else freq) >= min_records


def flagged(obs: DataFrame, check: Check, name: str = "flag") -> DataFrame:
    """``obs`` with ``ts`` and the check's flag column."""
    df = obs.withColumn("ts", T.to_micros(F.col("datetime")))
    return check(df, "value", name) if getattr(check, "frame", False) else df.withColumn(name, check(F.col("value")))


def outliers(obs: DataFrame, check: Check, check_name: str) -> DataFrame:
    """The flagged rows (name, obstype, datetime, value, label)."""
    return flagged(obs, check).where("flag").select(*KEY, "datetime", "value", F.lit(CHECKS[check_name]).alias("label"))


def repetition_outliers(obs: DataFrame, max_n: int = 5, piece_us: int | None = None) -> DataFrame:
    """What ``repetitions`` flags, found in pieces of time whose border runs are joined: no task holds a series."""
    return scan.run_lengths(obs.select(*KEY, "datetime", "value"), KEY, piece_us).where(F.col("run_length") > max_n).select(*KEY, "datetime", "value", F.lit(CHECKS["repetitions"]).alias("label"))


def step_outliers(obs: DataFrame, max_increase_per_second: float = 8 / 3600, max_decrease_per_second: float = -10 / 3600, piece_us: int | None = None) -> DataFrame:
    """What ``step`` flags, found in pieces of time that carry their last value on: no task holds a series."""
    _rates(max_increase_per_second, max_decrease_per_second)
    rows = scan.previous(obs.select(*KEY, "datetime", "value"), KEY, piece_us)
    seconds, change = (F.col("ts") - F.col("before.t")) / T.SECOND, F.col("value") - F.col("before.v")
    fast = (change > F.lit(max_increase_per_second) * seconds) | (change < F.lit(max_decrease_per_second) * seconds)
    return rows.where(fast).select(*KEY, "datetime", "value", F.lit(CHECKS["step"]).alias("label"))


def windowed_outliers(obs: DataFrame, make: Callable[..., Check], check_name: str, window: str, regular: bool = True, **options) -> DataFrame:
    """A centred-window check over series cut into pieces of time: rows near a border are in both pieces, and count in their own.

    Series must have regular stamps, else it raises; those whose step is too
    wide for ``min_records`` in a window are left alone.  ``regular=False``
    takes any stamps and tests every series.
    """
    if regular:
        steps = regular_frequency(obs)
        obs = obs.join(steps.where(~window_fits(window, options["min_records"], F.col("freq_us"))).select(*KEY), KEY, "left_anti")
    half = T.micros(window) // 2
    us = T.to_micros(F.col("datetime"))
    piece = lambda x: F.floor(x / F.lit(PIECE_US))
    cut = obs.select(*KEY, "datetime", "value", piece(us).alias("own"), F.explode(F.array_distinct(F.array(piece(us - half), piece(us), piece(us + half)))).alias("piece"))
    return flagged(cut, make(window, by=[*KEY, "piece"], **options)).where("flag AND own = piece").select(*KEY, "datetime", "value", F.lit(CHECKS[check_name]).alias("label"))


def duplicated_timestamps(raw: DataFrame, order: str) -> DataFrame:
    """One row for each stamp that occurs more than once, with the value that is first by ``order``."""
    return raw.groupBy(*KEY, "datetime").agg(F.count("*").alias("n"), F.min_by("value", order).alias("value")).where("n > 1").select(*KEY, "datetime", "value", F.lit(CHECKS["duplicated_timestamp"]).alias("label"))


def without_duplicates(raw: DataFrame, order: str) -> DataFrame:
    """One row for each stamp; the value is null where the stamp was repeated."""
    return raw.groupBy(*KEY, "datetime").agg(F.when(F.count("*") == 1, F.min_by("value", order)).alias("value"))


def invalid_rows(raw: DataFrame) -> DataFrame:
    """Stamps (name, obstype, datetime) with one row that has no number; repeated stamps are outliers instead."""
    return raw.groupBy(*KEY, "datetime").agg(F.count("*").alias("n"), F.count("value").alias("v")).where("n = 1 AND v = 0").select(*KEY, "datetime")


def chain(obs: DataFrame, checks: list[tuple[str, Check]]) -> DataFrame:
    """All checks in order: (name, obstype, datetime, raw_value, value, label); ``value`` is null where a check flagged it.

    Series are dealt over as many tasks as the rows need, as each check sorts a task's rows anew.
    """
    n = max(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + obs.count() // TASK_ROWS)
    df = obs.repartition(n, *KEY).withColumn("ts", T.to_micros(F.col("datetime"))).withColumn("_v", F.col("value")).withColumn("label", F.when(F.col("value").isNull(), F.lit(None)).otherwise(F.lit(OK)))
    for check_name, check in checks:
        df = check(df, "_v", "_flag") if getattr(check, "frame", False) else df.withColumn("_flag", check(F.col("_v")))
        df = df.withColumn("label", F.when(F.col("_flag"), F.lit(CHECKS[check_name])).otherwise(F.col("label"))).withColumn("_v", F.when(~F.col("_flag"), F.col("_v"))).drop("_flag")
    return df.select(*KEY, "datetime", F.col("value").alias("raw_value"), F.col("_v").alias("value"), "label")


def statistics(labelled: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """For each check in order: rows in all, rows it saw (not rejected before it) and rows it flagged; for each group ``by``, if named."""
    by = by or []
    total = labelled.groupBy(*by).agg(F.count("*").alias("n_all"), F.count_if(F.col("label") == OK).alias("n_ok"), F.count_if(F.col("label").isNull() | (F.col("label") == GAP)).alias("n_gap"), *[F.count_if(F.col("label") == CHECKS[c]).alias(c) for c in order])
    rows, rejected = [], F.col("n_gap")
    for i, c in enumerate(order):
        rows.append(F.struct(F.lit(i).alias("seq"), F.lit(c).alias("qc_check"), F.col("n_all").alias("n_all"), (F.col("n_all") - rejected).alias("n_checked"), F.col(c).alias("n_labeled")))
        rejected = rejected + F.col(c)
    return total.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def station_statistics(labelled: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows (name, qc_check, n_all, n_checked, n_labeled) for each station: good rows, gaps and each check in order, by label.

    ``n_checked`` is null for good rows and gaps, which no check gives.  With
    ``by=[]`` the counts are summed over stations.
    """
    by = ["name"] if by is None else by
    nothing = F.lit(None).cast("long")
    counts = labelled.groupBy(*by).agg(F.count("*").alias("n_all"), F.count_if(F.col("label") == OK).alias("n_ok"), F.count_if(F.col("label").isNull() | (F.col("label") == GAP)).alias("n_gap"))
    plain = F.array(*[F.struct(F.lit(label).alias("qc_check"), F.col("n_all"), nothing.alias("n_checked"), F.col(c).alias("n_labeled")) for label, c in ((OK, "n_ok"), (GAP, "n_gap"))])
    labels = F.create_map(*[F.lit(x) for c in order for x in (c, CHECKS[c])])
    checked = statistics(labelled, order, by).select(*by, F.element_at(labels, F.col("qc_check")).alias("qc_check"), "n_all", "n_checked", "n_labeled")
    return counts.select(*by, F.explode(plain).alias("r")).select(*by, "r.*").unionByName(checked)


def effectiveness(stats: DataFrame) -> DataFrame:
    """Shares of each check: not seen, fine and flagged rows."""
    return stats.select("qc_check", (F.col("n_all") - F.col("n_checked")).alias("unchecked"), (F.col("n_checked") - F.col("n_labeled")).alias("ok"), F.col("n_labeled").alias("outlier"))


def outliers_to_gaps(labelled: DataFrame) -> DataFrame:
    """Outliers become missing: null value, and the gap's label."""
    out = F.col("label").isNull() | (F.col("label") != OK)
    return labelled.select(*KEY, "datetime", F.when(~out, F.col("value")).alias("value"), F.when(out, F.lit(LABELS[11])).otherwise(F.lit(OK)).alias("label"))


def white_list(white: DataFrame) -> DataFrame:
    """A white list that is checked: some of the columns name, obstype and datetime (a time stamp) and no other, each row once."""
    types = dict(white.dtypes)
    if not types or set(types) - {*KEY, "datetime"}:
        raise ArgumentError("a white list has the columns name, obstype and datetime or some of them, and no other")
    if "datetime" in types and not types["datetime"].startswith("timestamp"):
        raise ArgumentError("a white list's datetime must be a time stamp")
    return white.distinct()


def without_white(found: DataFrame, white: DataFrame) -> DataFrame:
    """Flags without those that a white list names.

    The list has any of the columns name, obstype and datetime; a column that
    isn't there matches everything.  Stamps without zone count as the session's.
    """
    white = white_list(white)
    levels = white.columns
    if "datetime" in levels:
        white = white.withColumn("datetime", F.col("datetime").cast("timestamp"))
    return found.join(white, levels, "left_anti")


def outlier_view(*found: DataFrame) -> DataFrame:
    """Outliers of several checks in one view (name, obstype, datetime, value, label, details), the checks in their order.

    A row that several checks flag has the first one's label; ``details`` are
    empty where a check has none.
    """
    if not found:
        raise ArgumentError("no outliers to show")
    rows = None
    for i, f in enumerate(found):
        details = F.coalesce(F.col("details"), F.lit("")) if "details" in f.columns else F.lit("")
        part = f.select(*KEY, "datetime", F.struct(F.lit(i).alias("i"), "value", "label", details.alias("details")).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*KEY, "datetime").agg(F.min("x").alias("x")).select(*KEY, "datetime", "x.value", "x.label", "x.details")


def long_view(ok: DataFrame, outlier_rows: DataFrame | None, gap_rows: DataFrame) -> DataFrame:
    """One row for each stamp of (name, obstype, datetime, value, label): a gap hides an outlier, an outlier a good row.

    A labelled frame may stand for ``ok`` with no ``outlier_rows``: its rows
    with another label than that of good rows are the outliers, and it is
    computed once.  Rows are dealt by stamp before they meet, so the tasks of
    the checks before don't sort them as well.
    """
    ranked = ok.withColumn("rank", (F.col("label") != OK).cast("int") if outlier_rows is None else F.lit(0))
    if outlier_rows is not None:
        ranked = ranked.unionByName(outlier_rows.withColumn("rank", F.lit(1)))
    ranked = ranked.unionByName(gap_rows.withColumn("rank", F.lit(2))).repartition(*KEY, "datetime")
    return ranked.groupBy(*KEY, "datetime").agg(F.max_by(F.struct("value", "label"), "rank").alias("x")).select(*KEY, "datetime", "x.value", "x.label")
