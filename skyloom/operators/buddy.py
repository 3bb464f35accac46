"""Spatial quality control: stations against their neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import ArgumentError, MissingError
from ..functions.values import haversine
from ..labels import CHECKS
from . import places
from .align import KEY
from .qc import without_white

#: Pairs of stations that a task decides groups of, in a round.
BLOCK = 1 << 21


def pairs(stations: DataFrame, radius_m: float, same: str | None = None, max_altitude_difference: float | None = None) -> DataFrame:
    """Ordered pairs (name, buddy, distance) of stations within ``radius_m``.

    Stations meet in cells of the radius' size, so only near ones are paired.
    ``same`` names a category that both must share (null matches nothing).
    Raises if a station lacks coordinates, or altitude where it is needed.
    """
    if not stations.where("lat IS NULL OR lon IS NULL").isEmpty():
        raise MissingError("a station has no coordinates")
    if max_altitude_difference is not None and not stations.where("altitude IS NULL").isEmpty():
        raise MissingError("a station has no altitude")
    columns = ["name", "lat", "lon", "altitude", *([same] if same else [])]
    base = stations.select(*columns)
    a = places.in_near_cells(base, radius_m)
    b = places.in_cell(base, radius_m).select(*[F.col(c).alias(f"b_{c}") for c in columns], "cy", "cx")
    near = a.join(b, ["cy", "cx"]).where("name <> b_name")
    if same:
        near = near.where(F.col(same) == F.col(f"b_{same}"))
    if max_altitude_difference is not None:
        near = near.where(F.abs(F.col("altitude") - F.col("b_altitude")) <= max_altitude_difference)
    near = near.withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")))
    return near.where(F.col("distance") <= radius_m).select("name", F.col("b_name").alias("buddy"), "distance")


def with_enough(near: DataFrame, min_sample_size: int) -> DataFrame:
    """Pairs of stations that have enough buddies (not counting themselves)."""
    return near.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where(F.col("n") >= min_sample_size).drop("n")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, opens) of the stations that can be decided, from rows (block, y, x, x_opens) in order of block and y.

    As an earlier station's row comes first, one pass settles all that hangs
    on stations of the block; what is kept is a flag for each of them.
    """
    known: dict[str, bool] = {}
    name, blocked, waits = None, False, False

    def settle() -> tuple[list[str], list[bool]]:
        if name is None or (waits and not blocked):
            return [], []
        known[name] = not blocked
        return [name], [not blocked]

    for batch in batches:
        names: list[str] = []
        opens: list[bool] = []
        for y, x, x_opens in zip(*(batch.column(c).to_pylist() for c in ("y", "x", "x_opens")), strict=True):
            if y != name:
                done = settle()
                names += done[0]
                opens += done[1]
                name, blocked, waits = y, False, False
            if x_opens is None:
                x_opens = known.get(x)
            blocked = blocked or x_opens is True
            waits = waits or x_opens is None
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(opens, pa.bool_())], names=["name", "opens"])
    done = settle()
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.bool_())], names=["name", "opens"])


def groups(near: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (group_id, name): greedy groups in order of name.

    A station opens a group with its buddies unless it is in an earlier one's.
    Stations are cut into blocks by name, of some ``block`` pairs each.  In a
    round every block decides what the other blocks' stations decided so far
    allow: a station opens once all earlier stations whose groups could hold it
    are decided against opening, and never once one of them opens.  As a
    station waits for earlier ones only, each round ends the first block that
    is left: there are as many rounds as blocks at most, however long the
    chains of stations that wait for each other.
    """
    lists = cut(near.select("name", "buddy").distinct())
    # an earlier station x keeps y from opening if y is among x's buddies
    before = lists.where("name < buddy").select(F.col("name").alias("x"), F.col("buddy").alias("y"))
    # a station with less buddies than others are asked for has no list, and so no group
    before = before.join(lists.select(F.col("name").alias("y")).distinct(), "y", "left_semi")
    n = max(1, -(-before.count() // block))
    left = cut(before.repartitionByRange(n, "y").withColumn("block", F.spark_partition_id()))
    state = cut(lists.select("name").distinct().join(left.select(F.col("y").alias("name")), "name", "left_anti").withColumn("opens", F.lit(True)))
    while not left.isEmpty():
        rows = left.join(state.select(F.col("name").alias("x"), F.col("opens").alias("x_opens")), "x", "left").select("block", "y", "x", "x_opens")
        new = cut(rows.repartition(n, "block").sortWithinPartitions("block", "y").mapInArrow(_decided, "name string, opens boolean"))
        state = state.union(new)
        left = cut(left.join(new.select(F.col("name").alias("y")), "y", "left_anti"))
    refs = state.where("opens").select("name")
    members = lists.join(refs, "name").select(F.col("name").alias("group_id"), F.col("buddy").alias("name"))
    return members.union(refs.select(F.col("name").alias("group_id"), "name"))


def lapse_corrected(obs: DataFrame, stations: DataFrame, lapse_rate: float) -> DataFrame:
    """Values brought to the lowest station's altitude: v - (altitude - lowest) * lapse_rate."""
    lowest = stations.agg(F.min("altitude").alias("lowest"))
    heights = stations.select("name", "altitude").crossJoin(F.broadcast(lowest))  # one row
    return obs.join(heights, "name").withColumn("value", F.col("value") - (F.col("altitude") - F.col("lowest")) * lapse_rate).select(obs.columns)


def group_outliers(obs: DataFrame, members: DataFrame, z_threshold: float, min_sample_size: int, min_std: float) -> DataFrame:
    """Per group and stamp, the member farthest from the mean, if it is beyond the threshold: (obstype, datetime, name, group_id, chi, details).

    Ties: the first by name.
    """
    rows = obs.where("value IS NOT NULL").join(members, "name")
    by = ["group_id", "obstype", "datetime"]
    stats = rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n")).where(F.col("n") >= min_sample_size)
    stats = stats.withColumn("sd", F.when(F.col("sd") < min_std, F.lit(float(min_std))).otherwise(F.col("sd")))
    scored = rows.join(stats, by).withColumn("chi", F.abs(F.col("value") - F.col("mean")) / F.col("sd")).where(F.col("chi") > z_threshold)
    # every member over the threshold is here, so the largest of these is the group's largest
    worst = scored.groupBy(*by).agg(F.min_by(F.struct("name", "value", "chi", "mean", "sd", "n"), F.struct((-F.col("chi")).alias("c"), "name")).alias("x")).select(*by, "x.*")
    # rounded first to what sums in any order agree on
    two = [F.round(F.round(c, 6), 2) for c in ("chi", "mean", "sd")]
    details = F.format_string("outlier in buddy group of %s: chi=%.2f, mean=%.2f, std=%.2f, n=%d", F.col("group_id"), *two, F.col("n"))
    return worst.select(*KEY, "datetime", "value", "group_id", "chi", details.alias("details"))


@dataclass(frozen=True)
class SafetyNet:
    """A second opinion: stations of the same category within a radius."""

    category: str
    radius_m: float
    z_threshold: float
    min_sample_size: int
    min_std: float = 1.0
    max_altitude_difference: float | None = None


def net_pairs(net: SafetyNet, stations: DataFrame) -> DataFrame:
    """The pairs of stations of a safety net."""
    if net.category not in stations.columns:
        raise MissingError(f"no station column {net.category!r}")
    return pairs(stations, net.radius_m, net.category, net.max_altitude_difference)


def net_verdicts(net: SafetyNet, found: DataFrame, obs: DataFrame, stations: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """What a safety net says of flagged rows: (name, obstype, datetime, saved, message).

    A row is compared with its station's buddies of the same category, the
    station itself excluded.  ``message`` says why a row stays: too few
    buddies, too few of them with a value, or too far from them; null if it is
    saved.  ``near`` are the net's pairs, if they are known.
    """
    near = net_pairs(net, stations) if near is None else near
    own = [*KEY, "datetime"]
    asked = found.select(*own, "value").distinct()
    sizes = near.groupBy("name").agg(F.count("*").alias("k"))
    others = obs.where("value IS NOT NULL").select(F.col("name").alias("buddy"), "obstype", "datetime", F.col("value").alias("v"))
    met = asked.join(near.select("name", "buddy"), "name").join(others, ["buddy", "obstype", "datetime"])
    stats = met.groupBy(*own).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))
    rows = asked.join(sizes, "name", "left").join(stats, own, "left").withColumns({"k": F.coalesce("k", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    sd = F.when(F.col("sd") < net.min_std, F.lit(float(net.min_std))).otherwise(F.col("sd"))
    few, gaps = F.col("k") < net.min_sample_size, F.col("n") < net.min_sample_size
    rows = rows.withColumn("z", F.abs(F.col("value") - F.col("mean")) / sd)
    rows = rows.withColumn("saved", F.coalesce(~few & ~gaps & (F.col("z") <= net.z_threshold), F.lit(False)))
    says = lambda text, *values: F.format_string(f"{net.category} net: {text}", *values)
    least = F.lit(net.min_sample_size)
    # rounded first to what sums in any order agree on
    far = says("not saved (z=%.2f)", F.round(F.round("z", 6), 2))
    message = F.when(F.col("saved"), None).when(few, says("too few buddies (%d of %d)", F.col("k"), least)).when(gaps, says("too few values (%d of %d)", F.col("n"), least))
    return rows.select(*own, "saved", message.when(F.col("z").isNull(), says("not saved (no spread)")).otherwise(far).alias("message"))


def saved_by(net: SafetyNet, found: DataFrame, obs: DataFrame, stations: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The flagged rows (name, obstype, datetime) that a safety net clears; ``near`` are its pairs, if they are known."""
    return net_verdicts(net, found, obs, stations, near).where("saved").select(*KEY, "datetime")


def buddy_check(
    obs: DataFrame,
    stations: DataFrame,
    radius_m: float = 10_000,
    min_sample_size: int = 4,
    max_altitude_difference: float | None = None,
    min_std: float = 1.0,
    z_threshold: float = 3.1,
    n_iter: int = 2,
    lapse_rate: float | None = None,
    safety_nets: list[SafetyNet] | None = None,
    white: DataFrame | None = None,
) -> DataFrame:
    """Flagged rows (name, obstype, datetime, value, label, details) of synchronised series.

    Each iteration hides the outliers found so far, flags the worst member of
    each group and stamp, and lets safety nets (in order) and the white list clear some;
    those are tested again in the next iteration.  ``details`` say for each
    net why it left a row flagged.
    """
    if n_iter < 1:
        raise ArgumentError("at least one iteration")
    if lapse_rate is not None:
        if not stations.where("altitude IS NULL").isEmpty():
            raise MissingError("a station has no altitude")
        values = lapse_corrected(obs, stations, lapse_rate)
    else:
        values = obs
    near = with_enough(pairs(stations, radius_m, None, max_altitude_difference), min_sample_size)
    members = cut(groups(near))
    nets = [(net, cut(net_pairs(net, stations))) for net in safety_nets or []]
    values = cut(values) if n_iter > 1 else values
    out = None
    for i in range(1, n_iter + 1):
        left = values if out is None else values.join(out.select(*KEY, "datetime").distinct(), [*KEY, "datetime"], "left_anti")
        found = group_outliers(left, members, z_threshold, min_sample_size, min_std)
        for net, own in nets:
            said = net_verdicts(net, found, left, stations, own).where("NOT saved").drop("saved")
            found = found.join(said, [*KEY, "datetime"]).withColumn("details", F.concat_ws("; ", "details", "message")).drop("message")
        if white is not None:
            found = without_white(found, white)
        found = cut(found.withColumn("details", F.concat("details", F.lit(f" (iteration {i}/{n_iter})"))))
        out = found if out is None else cut(out.unionByName(found))
    label = CHECKS["buddy_check_with_safetynets" if safety_nets else "buddy_check"]
    merged = out.groupBy(*KEY, "datetime").agg(F.array_join(F.array_sort(F.collect_set("details")), " | ").alias("details"))
    return merged.join(obs, [*KEY, "datetime"]).select(*KEY, "datetime", "value", F.lit(label).alias("label"), "details")


def synchronised(obs: DataFrame, tolerance: str = "4min", freq: str | None = None) -> DataFrame:
    """Series of all stations on common stamps, nearest within the tolerance; of two equally near, the later."""
    from .align import grid_of, grid_rows, likely_frequency, nearest

    with_freq = obs if freq else obs.join(likely_frequency(obs), KEY)
    grid = grid_of(with_freq, freq or F.col("freq_us"), tolerance)
    common = grid.groupBy("obstype").agg(F.min("origin").alias("origin"), F.max("closing").alias("closing"), F.min("freq_us").alias("freq_us"))
    stamps = grid_rows(grid.select(*KEY).join(common, "obstype"))
    return nearest(stamps, obs.where("value IS NOT NULL"), tolerance, later_wins=True).where("value IS NOT NULL").select(*KEY, "datetime", "value")


