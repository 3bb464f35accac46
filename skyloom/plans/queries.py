"""Named queries over the driver's tables: events stand in for observations, users for stations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, folder
from ..functions import time as T
from ..functions import units
from ..functions import values as V
from ..labels import CHECKS, OK
from ..operators import align, analysis, buddy, gapfill, ingest, landcover, merge, qc
from ..operators.align import KEY
from ..sources import models, readers, sinks
from ..sources.template import Template

SIX_HOURS = 6 * 3600 * T.SECOND
NETS = [buddy.SafetyNet("category", 20_000, 1.5, 3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("name"), F.lit("value").alias("obstype"), F.col("ts").cast("timestamp").alias("datetime"), V.no_nan(F.col("value")).alias("value"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i = F.col("user_id")
    return u.select(i.cast("string").alias("name"), (50 + (i % 50) * 0.02).alias("lat"), (4 + F.floor(i / 50) * 0.02).alias("lon"), ((i * 37) % 300).cast("double").alias("altitude"), (i % 5).alias("category"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with values in steps of 20, so that equal ones follow each other."""
    return observations(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20).cast("double"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.regularise(observations(spark, sf_dir), "6h", "3h")


def _gaps_and_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gaps with their ids, and valid rows on the grid."""
    a = cut(aligned(spark, sf_dir))
    gaps = align.islands(a.where("status = 'gap'").select(*KEY, "datetime", F.lit(SIX_HOURS).alias("freq_us"))).select(*KEY, "gap_id", "datetime")
    gaps = cut(gaps)  # their rows and spans are met several times
    return gaps, a.where("status = 'ok'").select(*KEY, "datetime", "value")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gaps, records, and a model: the network's mean of every six hours."""
    gaps, obs = _gaps_and_records(spark, sf_dir)
    us = T.to_micros(F.col("datetime"))
    network = cut(observations(spark, sf_dir).groupBy((us - F.pmod(us, F.lit(SIX_HOURS))).alias("us")).agg(F.avg("value").alias("value")))
    # one row for each six hours: as many as the period has, whatever the number of stations
    lo, hi = network.agg(F.min("us"), F.max("us")).first()
    slots = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(SIX_HOURS))) if lo is not None else F.lit(None).cast("long")
    names = observations(spark, sf_dir).select(*KEY).distinct()
    model = names.select(*KEY, slots.alias("us")).join(network, "us").select(*KEY, T.to_timestamp(F.col("us")).alias("datetime"), "value")
    return gaps, obs, model


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ["value"]})


def gross_value(spark, sf_dir):
    return qc.outliers(observations(spark, sf_dir), qc.gross_value(1.0, 39.0), "gross_value")


def duplicated_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = T.to_micros(F.col("ts").cast("timestamp"))
    raw = e.select(F.col("user_id").cast("string").alias("name"), F.lit("value").alias("obstype"), T.to_timestamp(us - F.pmod(us, F.lit(SIX_HOURS))).alias("datetime"), "value", "event_id")
    return qc.duplicated_timestamps(raw, "event_id")


def persistence(spark, sf_dir):
    return qc.windowed_outliers(coarse(spark, sf_dir), qc.persistence, "persistence", "48h", regular=False, min_records=5)


def repetitions(spark, sf_dir):
    return qc.repetition_outliers(coarse(spark, sf_dir), 3)


def step(spark, sf_dir):
    return qc.step_outliers(observations(spark, sf_dir), 8 / 3600, -10 / 3600)


def window_variation(spark, sf_dir):
    return qc.windowed_outliers(observations(spark, sf_dir), qc.window_variation, "window_variation", "24h", regular=False, min_records=3, max_increase_per_second=0.0006, max_decrease_per_second=-0.0007)


CHAIN = ["gross_value", "persistence", "repetitions", "step", "window_variation"]


def chained(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 5).cast("double"))
    return qc.chain(obs, list(zip(CHAIN, [qc.gross_value(0.0, 12.0), qc.persistence("48h", 4), qc.repetitions(4), qc.step(1 / 3600, -1 / 3600), qc.window_variation("24h", 3, 0.00005, -0.00006)], strict=True)))


def qc_pipeline(spark, sf_dir):
    return chained(spark, sf_dir)


def qc_stats(spark, sf_dir):
    return qc.statistics(chained(spark, sf_dir), CHAIN)


def qc_effectiveness(spark, sf_dir):
    return qc.effectiveness(qc.statistics(chained(spark, sf_dir), CHAIN))


def label_counts(spark, sf_dir):
    return analysis.label_counts(chained(spark, sf_dir))


def whitelist_antijoin(spark, sf_dir):
    found = qc.outliers(observations(spark, sf_dir), qc.gross_value(1.0, 39.0), "gross_value")
    white = stations(spark, sf_dir).where("category = 0").select("name")
    return qc.without_white(found, white)


def outliers_to_gaps(spark, sf_dir):
    return qc.outliers_to_gaps(chained(spark, sf_dir).select(*KEY, "datetime", F.col("raw_value").alias("value"), "label"))


def long_view(spark, sf_dir):
    c = chained(spark, sf_dir)
    a = aligned(spark, sf_dir)
    labelled = c.select(*KEY, "datetime", F.col("raw_value").alias("value"), F.coalesce("label", F.lit(OK)).alias("label"))
    return qc.long_view(labelled, None, a.where("status = 'gap'").select(*KEY, "datetime", F.lit(None).cast("double").alias("value"), F.lit("gap").alias("label")))


def likely_frequency(spark, sf_dir):
    return align.likely_frequency(observations(spark, sf_dir))


def simplify_time(spark, sf_dir):
    us = T.to_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", T.simplify(us, T.micros("5min")).alias("simple_us"))


def regularise_asof(spark, sf_dir):
    return aligned(spark, sf_dir)


def resample(spark, sf_dir):
    return align.resample(aligned(spark, sf_dir).select(*KEY, "datetime", "value"), "12h", "1h")


def synchronise(spark, sf_dir):
    return align.synchronise(observations(spark, sf_dir), "30min")


def gap_islands(spark, sf_dir):
    a = aligned(spark, sf_dir).where("status = 'gap'").select(*KEY, "datetime", F.lit(SIX_HOURS).alias("freq_us"))
    return align.islands(a).select(*KEY, "datetime", "gap_id", "gapstart")


def gap_overview(spark, sf_dir):
    gaps, _ = _gaps_and_records(spark, sf_dir)
    return align.gap_overview(gaps.select("*", F.lit("gap").alias("label"), F.lit("no details").alias("details")))


def interpolate_time(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return _rounded(gapfill.interpolate(gaps, obs, "time", "24h"))


def interpolate_linear(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return _rounded(gapfill.interpolate(gaps, obs, "linear", "24h", max_lead="6h"))


def interpolate_spline(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    out = gapfill.interpolate(gaps, obs, "cubicspline", "24h", n_leading=2, n_trailing=2, max_lead="3d", max_trail="3d")
    return _rounded(out.withColumn("value", F.col("value") + 1e-9))  # many values end in a 5 at the seventh digit


def _by_anchors(spark, sf_dir, method: str, **options) -> DataFrame:
    gaps, obs = _gaps_and_records(spark, sf_dir)
    out = gapfill.interpolate(gaps, obs, method, "24h", n_leading=2, n_trailing=2, max_lead="3d", max_trail="3d", **options)
    return _rounded(out.withColumn("value", F.col("value") + 1e-9))


def interpolate_pchip(spark, sf_dir):
    return _by_anchors(spark, sf_dir, "pchip")


def interpolate_akima(spark, sf_dir):
    return _by_anchors(spark, sf_dir, "akima")


def interpolate_krogh(spark, sf_dir):
    return _by_anchors(spark, sf_dir, "krogh")


def interpolate_smoothing(spark, sf_dir):
    """Order 1 with so much room that the straight line of least squares is smooth enough."""
    return _by_anchors(spark, sf_dir, "spline", order=1, smoothing=1e9)


def fill_raw_model(spark, sf_dir):
    gaps, _, model = _parts(spark, sf_dir)
    return _rounded(gapfill.fill_with_model("raw", gaps, None, model, low=5.0, high=30.0))


def fill_debiased(spark, sf_dir):
    gaps, obs, model = _parts(spark, sf_dir)
    return _rounded(gapfill.fill_with_model("debiased", gaps, obs, model, lead="48h", trail="48h", min_lead=2, min_trail=2))


def fill_diurnal(spark, sf_dir):
    gaps, obs, model = _parts(spark, sf_dir)
    return _rounded(gapfill.fill_with_model("diurnal_debiased", gaps, obs, model, lead="120h", trail="120h", min_sample=3))


def fill_weighted_diurnal(spark, sf_dir):
    gaps, obs, model = _parts(spark, sf_dir)
    return _rounded(gapfill.fill_with_model("weighted_diurnal_debiased", gaps, obs, model, lead="120h", trail="120h", min_lead=1, min_trail=1))


def fill_status(spark, sf_dir):
    gaps, _, model = _parts(spark, sf_dir)
    return gapfill.fill_status(gapfill.fill_raw(gaps, model, "12h"))


def leading_trailing_period(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return gapfill.period(gaps, obs, "24h", "24h")


def model_at_stamps(spark, sf_dir):
    _, obs, model = _parts(spark, sf_dir)
    return _rounded(gapfill.at_stamps(model, obs), "value", "model_value")


def haversine_pairs(spark, sf_dir):
    return buddy.pairs(stations(spark, sf_dir), 5_000).withColumn("distance", F.round("distance", 3))


def category_pairs(spark, sf_dir):
    return buddy.pairs(stations(spark, sf_dir), 30_000, "category", 150).withColumn("distance", F.round("distance", 3))


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Six-hourly means of each station, on common stamps."""
    obs = observations(spark, sf_dir)
    us = T.to_micros(F.col("datetime"))
    means = obs.groupBy(*KEY, (us - F.pmod(us, F.lit(SIX_HOURS))).alias("us")).agg(F.round(F.avg("value"), 6).alias("value"))
    return means.select(*KEY, T.to_timestamp(F.col("us")).alias("datetime"), "value"), stations(spark, sf_dir)


def _members(spark, sf_dir) -> DataFrame:
    return buddy.groups(buddy.with_enough(buddy.pairs(stations(spark, sf_dir), 10_000), 4))


def buddy_groups(spark, sf_dir):
    return _members(spark, sf_dir)


def buddy_check_iter1(spark, sf_dir):
    obs, _ = _network(spark, sf_dir)
    return _rounded(buddy.group_outliers(obs, _members(spark, sf_dir), 1.8, 4, 1.0).select(*KEY, "datetime", "value", "group_id", "chi"), "chi")


def buddy_check(spark, sf_dir):
    obs, where = _network(spark, sf_dir)
    return buddy.buddy_check(obs, where, z_threshold=1.8, n_iter=2, max_altitude_difference=200, lapse_rate=-0.0065)


def safety_net(spark, sf_dir):
    obs, where = _network(spark, sf_dir)
    found = buddy.group_outliers(obs, _members(spark, sf_dir), 1.8, 4, 1.0)
    return buddy.saved_by(NETS[0], found, obs, where)


def safety_net_messages(spark, sf_dir):
    """What the net says of each row that groups flag."""
    obs, where = _network(spark, sf_dir)
    found = buddy.group_outliers(obs, _members(spark, sf_dir), 1.8, 4, 1.0)
    return buddy.net_verdicts(NETS[0], found, obs, where)


def buddy_check_safetynets(spark, sf_dir):
    obs, where = _network(spark, sf_dir)
    white = where.where("category = 4").select("name")
    return buddy.buddy_check(obs, where, z_threshold=1.8, n_iter=2, safety_nets=NETS, white=white)


def lapse_correction(spark, sf_dir):
    obs, where = _network(spark, sf_dir)
    return _rounded(buddy.lapse_corrected(obs, where, 0.0065))


def _wide(spark, sf_dir) -> DataFrame:
    """Daily means of each kind of event and user, a column for each kind."""
    e = table(spark, sf_dir, "events")
    us = T.to_micros(F.col("ts").cast("timestamp"))
    means = e.groupBy(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("obstype"), (us - F.pmod(us, F.lit(SIX_HOURS))).alias("us")).agg(F.avg("value").alias("value"))
    return analysis.wide(means.select("name", "obstype", T.to_timestamp(F.col("us")).alias("datetime"), "value"), KINDS)


KINDS = ["click", "error", "purchase", "signup", "view"]


def pivot_wide(spark, sf_dir):
    return _rounded(_wide(spark, sf_dir).select("name", "datetime", *KINDS), *KINDS)


def time_derivatives(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in T.derivatives(F.col("ts").cast("timestamp")).items()])


def order_seasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(T.season(F.dayofyear(F.col("o_orderdate").cast("timestamp"))).alias("season"), "o_totalprice")
    return o.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def filter_records(spark, sf_dir):
    kept = analysis.filter_records(_wide(spark, sf_dir), 'click >= 3 & (season=="winter" | season=="autumn") & ~(hour == 0)')
    return _rounded(kept.select("name", "datetime", "click"), "click")


def filter_metadata(spark, sf_dir):
    return analysis.filter_metadata(observations(spark, sf_dir), stations(spark, sf_dir), "altitude > 100 & category == 2 | lat < 50.1")


def subset_period(spark, sf_dir):
    return analysis.subset_period(observations(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-06 12:00:00")


def subset_stations(spark, sf_dir):
    return analysis.subset_stations(observations(spark, sf_dir), ["1", "2", "17", "no such"])


def stations_without_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("obstype"))
    return analysis.having(e, "signup", has=False).select("name").distinct()


def stations_without_high_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 150").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("obstype"))
    return analysis.having(e, "signup", has=False).select("name").distinct()


def aggregate_hour(spark, sf_dir):
    return _rounded(analysis.aggregate(_wide(spark, sf_dir), "click", ["season", "hour"]), "click")


def aggregate_category(spark, sf_dir):
    return _rounded(analysis.aggregate(_wide(spark, sf_dir), "view", ["category", "hour"], "median", stations(spark, sf_dir)), "view")


def diurnal_cycle(spark, sf_dir):
    cycle = analysis.diurnal_cycle(_wide(spark, sf_dir), "view", "category", stations(spark, sf_dir))
    return _rounded(analysis.on_one_day(cycle))


def diurnal_cycle_wide(spark, sf_dir):
    cycle = analysis.diurnal_cycle(_wide(spark, sf_dir), "view", "category", stations(spark, sf_dir)).withColumn("category", F.concat(F.lit("c"), "category"))
    names = [f"c{i}" for i in range(5)]
    return _rounded(analysis.cycle_columns(cycle, names, "category"), *names)


def diurnal_vs_reference(spark, sf_dir):
    return _rounded(analysis.diurnal_cycle_against(_wide(spark, sf_dir), "view", "1", "category", stations(spark, sf_dir)))


def period_bounds(spark, sf_dir):
    return analysis.period(observations(spark, sf_dir), ["name"])


def kinds_present(spark, sf_dir):
    return analysis.kinds_present(table(spark, sf_dir, "events").withColumnRenamed("event_type", "obstype"))


def station_extent(spark, sf_dir):
    return _rounded(analysis.extent(stations(spark, sf_dir)), "lat_min", "lat_max", "lon_min", "lon_max")


def hide_labels(spark, sf_dir):
    return analysis.hide_labels(chained(spark, sf_dir).select(*KEY, "datetime", F.col("raw_value").alias("value"), "label"), [CHECKS["step"], CHECKS["gross_value"]])


def filter_modeldata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    model = e.select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("obstype"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("modelname"), F.concat(F.lit("b"), F.col("event_id") % 2).alias("modelvariable"), F.col("ts").cast("timestamp").alias("datetime"), "value")
    return analysis.select_model(model, "click", modelvariable="b1")


def wide_to_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return readers.wide_to_long(li, ["l_orderkey", "l_linenumber"], "amount")


def unit_convert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = F.col("p_retailprice")
    pairs = {"kelvin": ("kelvin", "celsius"), "fahrenheit": ("degF", "degC"), "hpa": ("Pa", "hPa"), "ms": ("km/h", "m/s"), "knots": ("m/s", "kt")}
    return p.select("p_partkey", *[F.round(units.convert(v, a, b), 6).alias(n) for n, (a, b) in pairs.items()])


def vector_wind(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    u, v = F.col("l_quantity") - 25, F.floor(F.col("l_extendedprice") / 1000) - 25
    return li.select("l_orderkey", "l_linenumber", F.round(V.amplitude(u, v), 6).alias("speed"), F.round(V.direction(u, v), 6).alias("direction"))


def numeric_cast_comma(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")))
    return c.select("c_custkey", V.number(text).alias("value"))


def combine_first(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("value"))
    b = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0 OR c_custkey % 4 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("value"))
    return merge.combine_first(a, b, ["c_custkey"], ["value"])


def dataset_merge(spark, sf_dir):
    s = stations(spark, sf_dir).select("name", "lat", "lon", "altitude")
    a = s.where("altitude < 200").withColumn("altitude", F.when(F.col("altitude") > 50, F.col("altitude")))
    b = s.where("altitude > 20").withColumn("altitude", F.col("altitude") + 1)
    return _rounded(merge.merge_sites(a, b), "lat", "lon", "altitude")


def dedupe_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return merge.dedupe_first(o, "o_custkey", "o_orderkey")


def rename_stations(spark, sf_dir):
    s = stations(spark, sf_dir).select("name", "category")
    return merge.rename_stations(s, {"1": "first", "2": "3", "no such": "x"})


def upsert_series(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    return merge.upsert(s, new, ["s_suppkey"], force=True)


def _pixels(spark, sf_dir) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in landcover.LANDCOVER])
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 50).cast("string").alias("name"), F.lit(100).alias("radius"), F.get(classes, (F.col("l_partkey") % 11).cast("int")).alias("class"))


def landcover_fractions(spark, sf_dir):
    return _rounded(landcover.fractions(_pixels(spark, sf_dir)), "fraction")


def landcover_groups(spark, sf_dir):
    return _rounded(landcover.fractions(_pixels(spark, sf_dir), landcover.LANDCOVER_GROUPS), "fraction")


def landcover_partial(spark, sf_dir):
    """Groups that don't name every class: shares are of all pixels."""
    return _rounded(landcover.fractions(_pixels(spark, sf_dir), {"water": [80], "built": [50, 7]}), "fraction")


def landcover_buffers(spark, sf_dir):
    """Pixels of a raster around stations, in three radii at once."""
    classes = F.array(*[F.lit(c) for c in landcover.LANDCOVER], F.lit(7))
    pixels = table(spark, sf_dir, "lineitem").select((F.lit(50.0) + F.pmod(F.col("l_partkey") * 37 + F.col("l_linenumber"), F.lit(1000)) * 0.001).alias("lat"), (F.lit(4.0) + F.pmod(F.col("l_orderkey") * 11 + F.col("l_suppkey"), F.lit(600)) * 0.0001).alias("lon"), F.get(classes, (F.col("l_partkey") % 12).cast("int")).alias("class"))
    return _rounded(landcover.buffer_fractions(stations(spark, sf_dir), pixels, [1000.0, 2500.0, 400.0]), "fraction")


def filter_expression(spark, sf_dir):
    """Chained comparisons, arithmetic, membership and precedence."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    text = '5 < value <= 25 & event_type in ["click", "error", "say \\"hi\\""] & ~(user_id // 2 == 3) & user_id % 7 != 2 | value ** 2 > 10000 and not event_type == "view" & `event_id` - 1 >= 2 * 50'
    return analysis.filter_records(e, text).select("event_id", "event_type", "value")


def unit_compound(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = F.col("p_retailprice")
    pairs = {"rain": ("mm/h", "inch/day"), "energy": ("kJ/m**2", "J/cm^2"), "mercury": ("inHg", "hPa"), "density": ("kg*m**-3", "g/cm³"), "work": ("kW*hour", "megajoule"), "area": ("km²", "hectare"), "flux": ("W m-2", "kJ/m2/day")}
    return p.select("p_partkey", *[F.round(units.convert(v, a, b), 6).alias(n) for n, (a, b) in pairs.items()])


def lcz_points(spark, sf_dir):
    s = stations(spark, sf_dir)
    raster = s.where("category <> 3").select("name", (F.col("altitude") % 17 + 1).cast("int").alias("value"))
    return landcover.lcz(s, raster)


def stacked_labels(spark, sf_dir):
    return sinks.stacked(chained(spark, sf_dir).select(*KEY, "datetime", F.col("raw_value").alias("value"), "label"))


def interpolate_anchored(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return _rounded(gapfill.interpolate(gaps, obs, "time", "24h", n_leading=2, n_trailing=3, max_lead="24h", max_trail="48h"))


def interpolate_nearest(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return _rounded(gapfill.interpolate(gaps, obs, "nearest", "24h"))


def leading_period_records(spark, sf_dir):
    gaps, obs = _gaps_and_records(spark, sf_dir)
    return gapfill.nearest_records(gaps, obs, 3, 2, "36h", None)


def qc_stats_station(spark, sf_dir):
    return qc.station_statistics(chained(spark, sf_dir), CHAIN)


def qc_stats_total(spark, sf_dir):
    return qc.station_statistics(chained(spark, sf_dir), CHAIN, [])


def window_guard(spark, sf_dir):
    """Regular series of two steps: in windows of a day only the six-hourly ones can hold three values."""
    fine = aligned(spark, sf_dir).select(*KEY, "datetime", F.floor(F.col("value") / 20).cast("double").alias("value"))
    coarse_ = fine.where(F.pmod(T.to_micros(F.col("datetime")), F.lit(4 * SIX_HOURS)) == 0).withColumn("obstype", F.lit("daily"))
    return qc.windowed_outliers(fine.unionByName(coarse_), qc.persistence, "persistence", "24h", min_records=3)


def resample_labelled(spark, sf_dir):
    return align.resample(aligned(spark, sf_dir).select(*KEY, "datetime", "value", "status"), "12h", "6h")


def align_forced(spark, sf_dir):
    return align.regularise(observations(spark, sf_dir), "12h", "6h", origin="2024-01-03 00:00:00", closing="2024-01-13 12:00:00")


def synchronise_fixed(spark, sf_dir):
    return align.synchronise(aligned(spark, sf_dir).select(*KEY, "datetime", "value"), "1h", fixed_origin="2024-01-02 00:00:00")


def synchronise_stations(spark, sf_dir):
    return buddy.synchronised(observations(spark, sf_dir), "2h", "12h")


def _raw_rows(spark, sf_dir) -> DataFrame:
    """Events by the hour, so that stamps repeat; errors have no number."""
    e = table(spark, sf_dir, "events")
    us = T.to_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("name"), F.lit("value").alias("obstype"), T.to_timestamp(us - F.pmod(us, F.lit(3600 * T.SECOND))).alias("datetime"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_id")


def ingest_labels(spark, sf_dir):
    return ingest.ingest(_raw_rows(spark, sf_dir), "event_id", timestamp_tolerance="2h")


def ingest_forced(spark, sf_dir):
    return ingest.ingest(_raw_rows(spark, sf_dir), "event_id", "6h", timestamp_tolerance="3h", origin="2024-01-02 00:00:00")


def series_merge(spark, sf_dir):
    """Two datasets that share stations and a period, merged and aligned anew."""
    raw = _raw_rows(spark, sf_dir)
    half = lambda low, high, factor: ingest.ingest(raw.where(F.col("datetime").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))).withColumn("value", F.col("value") * factor), "event_id", "6h", timestamp_tolerance="3h")
    return ingest.merge_series(half("2024-01-01 00:00:00", "2024-01-15 00:00:00", 1.0), half("2024-01-10 00:00:00", "2024-02-10 00:00:00", 2.0), freq="12h", timestamp_tolerance="6h")


def _written(spark) -> str:
    """A new folder that the driver and all executors see."""
    return f"{folder(spark)}/files-{uuid.uuid4().hex}"


def import_long_csv(spark, sf_dir):
    """Events written as a CSV file of local times and read by a template: repeated stamps and texts that are no number leave no value."""
    e = table(spark, sf_dir, "events")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.round("value", 3).cast("string"))
    path = _written(spark) + ".csv"
    e.select(F.concat(F.lit("s"), "user_id").alias("station"), F.date_format(local, "yyyy-MM-dd").alias("day"), F.date_format(local, "HH:mm:ss").alias("clock"), text.alias("t")).write.csv(path, header=True)
    template = Template.build(name_column="station", timezone="Asia/Tokyo", date_column="day", date_format="%Y-%m-%d", time_column="clock", time_format="%H:%M:%S", obstypes={"temp": ("t", "degF", None)})
    return _rounded(readers.import_data(spark, template, path)["obs"])


def import_wide_csv(spark, sf_dir):
    li = table(spark, sf_dir, "orders")
    path = _written(spark) + ".csv"
    li.select(F.date_format(F.timestamp_seconds(F.col("o_orderkey") * 60), "yyyyMMdd HH:mm:ss").alias("when"), F.col("o_totalprice").cast("string").alias("st a"), F.col("o_custkey").cast("string").alias("st-b")).write.csv(path, header=True, sep=";")
    template = Template.build(structure="wide", datetime_column="when", datetime_format="%Y%m%d %H:%M:%S", obstypes={"pressure": (None, "hPa", None)})
    return _rounded(readers.observations(readers.read(spark, path), template).select(*KEY, "datetime", "value"))


def import_json(spark, sf_dir):
    path = _written(spark) + ".json"
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.json(path)
    return readers.read(spark, path)


def import_metadata(spark, sf_dir):
    path = _written(spark) + ".csv"
    table(spark, sf_dir, "supplier").select(F.col("s_name").alias("station"), (F.col("s_suppkey") % 90).cast("string").alias("north"), F.concat((F.col("s_suppkey") % 180).cast("string"), F.lit(",5")).alias("east"), F.col("s_nationkey").cast("string").alias("nation")).write.csv(path, header=True, sep=";")
    t = Template.build(structure="single_station", datetime_column="x", meta_name_column="station", meta_lat_column="north", meta_lon_column="east", meta_extra=("nation",))
    return readers.stations(readers.read(spark, path), t).select("name", "lat", "lon", F.col("extra")["nation"].alias("nation"))


def saved_dataset(spark, sf_dir):
    """Tables saved with a manifest and loaded again."""
    path = _written(spark)
    sinks.save({"obs": observations(spark, sf_dir), "stations": stations(spark, sf_dir)}, path)
    back = sinks.load(spark, path)
    return back["obs"].join(back["stations"], "name").select("name", "datetime", "value", "category")


def model_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    export = o.select(F.col("o_custkey").cast("string").alias("name"), F.date_format(F.timestamp_seconds(F.col("o_orderkey") * 60), "yyyyMMddHHmmss").alias("datetime"), (F.col("o_totalprice") / 1000 + 200).alias("t2m"), (F.col("o_orderkey") % 7 - 3).alias("u"), (F.col("o_orderkey") % 5 - 2).alias("v"))
    return _rounded(readers.model_series(export, "m", {"temp": ("t2m", "kelvin"), "pressure": ("absent", "Pa")}, ("u", "v")))


def aggregate_callable(spark, sf_dir):
    """A function of the user's own: the mean without the least and the greatest value."""
    trimmed = lambda v: (v.sum() - v.min() - v.max()) / (len(v) - 2) if len(v) > 2 else None
    return _rounded(analysis.aggregate(_wide(spark, sf_dir), "view", ["category", "hour"], trimmed, stations(spark, sf_dir)), "view")


def aggregate_percentile(spark, sf_dir):
    return _rounded(analysis.aggregate(_wide(spark, sf_dir), "view", ["category", "season"], 0.9, stations(spark, sf_dir)), "view")


def import_files_in_order(spark, sf_dir):
    """Two files with other columns and the same stamps, the larger one second: a repeated stamp keeps the value of the first file."""
    e = table(spark, sf_dir, "events").where("event_id < 3000").select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("station"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("event_id") % 500) * 600), "yyyy-MM-dd HH:mm:ss").alias("when"), F.round("value", 3).alias("t"), "event_id")
    path = _written(spark)
    e.where("event_id < 900").orderBy("event_id").select("station", "when", "t").coalesce(1).write.csv(f"{path}/a.csv", header=True)
    e.where("event_id >= 900").orderBy("event_id").select(F.lit("a longer line " * 5).alias("remark"), "when", "t", "station").coalesce(1).write.csv(f"{path}/b.csv", header=True, sep=";")
    template = Template.build(name_column="station", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": ("t", "degC", None)})
    return _rounded(readers.import_data(spark, template, f"{path}/*.csv")["outliers"])


def rejected_rows(spark, sf_dir):
    """Rows of a file whose stamp fits no format, or that name no station, with their text."""
    path = _written(spark) + ".csv"
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    o.select(F.when(F.col("o_orderkey") % 70 != 0, F.concat(F.lit("s"), "o_custkey")).alias("station"), F.when(F.col("o_orderkey") % 30 == 0, F.lit("31/02")).otherwise(F.lit("2024-01-01 00:00:00")).alias("when"), F.col("o_orderkey").cast("string").alias("t")).write.csv(path, header=True)
    template = Template.build(name_column="station", datetime_column="when", datetime_format="%Y-%m-%d %H:%M:%S", obstypes={"temp": ("t", "degC", None)})
    return readers.rejected(readers.read(spark, path), template).select("reason", "text")


def _grid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.timestamp_seconds(F.lit(1704067200) + (F.col("l_orderkey") % 240) * 3600).alias("time"), (F.lit(50.0) + (F.col("l_partkey") % 11) * 0.1).alias("lat"), (F.lit(4.0) + (F.col("l_suppkey") % 3) * 0.1).alias("lon"), F.when(F.col("l_linenumber") % 2 == 0, "t2m").otherwise("sp").alias("band"), (F.col("l_quantity") + 250).alias("value"))


def model_grid(spark, sf_dir):
    """A raster of cells sampled at stations."""
    return _rounded(readers.sample_model(_grid(spark, sf_dir), readers.Raster(50.0, 4.0, 0.1, 0.1), stations(spark, sf_dir), "m", {"temp": ("t2m", "K"), "pressure": ("sp", "kPa"), "pressure_at_sea_level": ("sp", "inHg")}, "2024-01-02 00:00:00", "2024-01-04 00:00:00"))


def model_source(spark, sf_dir):
    """The same grid by a table of kinds: a temperature, a kind of the user's own, and a wind from two bands."""
    model = models.Model("m", readers.Raster(50.0, 4.0, 0.1, 0.1)).add("temp", "t2m", "K").add("snow", "sp", "kg/m**2", "g/m**2").add_vector("wind", "t2m", "sp", "km/h").add("pressure", "unused", "hPa")
    return _rounded(model.sample(_grid(spark, sf_dir), stations(spark, sf_dir), "2024-01-02 00:00:00", "2024-01-04 00:00:00", ["temp", "snow", "wind"]))


def outlier_view(spark, sf_dir):
    """Outliers of three checks in one view, with details."""
    return qc.outlier_view(gross_value(spark, sf_dir), step(spark, sf_dir), buddy_check_safetynets(spark, sf_dir))


def fill_raw_units(spark, sf_dir):
    """A model of two units, turned into the kind's own before it fills."""
    gaps, _, model = _parts(spark, sf_dir)
    model = model.withColumn("unit", F.when(F.col("name").cast("int") % 2 == 0, "degF").otherwise("K"))
    return _rounded(gapfill.fill_with_model("raw", gaps, None, model, {"value": "degC"}))


def invalid_rows(spark, sf_dir):
    """Stamps whose only row has no number: no records, and gaps once aligned."""
    return qc.invalid_rows(_raw_rows(spark, sf_dir))


def single_station(spark, sf_dir):
    return analysis.one_series(observations(spark, sf_dir), "7", "value")


def union_of_frames(spark, sf_dir):
    return merge.union_all(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey"))


def shared_keys(spark, sf_dir):
    return merge.shared(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def only_left_keys(spark, sf_dir):
    return merge.only_left(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def update_dimension(spark, sf_dir):
    s = stations(spark, sf_dir).select("name", "altitude")
    new = s.where("altitude > 100").select("name", (F.col("altitude") * 2).alias("altitude"))
    return merge.update_dimension(s, new, "altitude")


def landcover_absent(spark, sf_dir):
    """Fractions of a region where three classes have no pixel at all, and one class is unknown."""
    p = _pixels(spark, sf_dir).withColumn("class", F.when(F.col("class") == 20, F.lit(7)).when(F.col("class") > 80, F.lit(10)).otherwise(F.col("class")))
    return _rounded(landcover.fractions(p), "fraction")


QUERIES = {
    f.__name__: f
    for f in (
        gross_value, duplicated_timestamp, persistence, repetitions, step, window_variation, qc_pipeline, qc_stats, qc_effectiveness,
        label_counts, whitelist_antijoin, outliers_to_gaps, long_view, likely_frequency, simplify_time, regularise_asof, resample,
        synchronise, gap_islands, gap_overview, interpolate_time, interpolate_linear, interpolate_spline, fill_raw_model, fill_debiased,
        fill_diurnal, fill_weighted_diurnal, fill_status, leading_trailing_period, model_at_stamps, haversine_pairs, category_pairs,
        buddy_groups, buddy_check_iter1, buddy_check, safety_net, buddy_check_safetynets, lapse_correction, pivot_wide, time_derivatives,
        order_seasons, filter_records, filter_metadata, subset_period, subset_stations, stations_without_kind, aggregate_hour,
        aggregate_category, diurnal_cycle, diurnal_cycle_wide, diurnal_vs_reference, period_bounds, kinds_present, station_extent,
        hide_labels, filter_modeldata, wide_to_long, unit_convert, vector_wind, numeric_cast_comma, combine_first, dataset_merge,
        dedupe_metadata, rename_stations, upsert_series, landcover_fractions, landcover_groups, lcz_points, stacked_labels,
        stations_without_high_kind, interpolate_anchored, interpolate_nearest, leading_period_records, qc_stats_station, qc_stats_total,
        window_guard, resample_labelled, align_forced, synchronise_fixed, synchronise_stations, ingest_labels, ingest_forced, series_merge,
        import_long_csv, import_wide_csv, import_json, import_metadata, saved_dataset, model_export, invalid_rows, single_station,
        union_of_frames, shared_keys, only_left_keys, update_dimension, landcover_absent, interpolate_pchip, interpolate_akima,
        interpolate_krogh, interpolate_smoothing, landcover_partial, landcover_buffers, filter_expression, unit_compound,
        aggregate_callable, aggregate_percentile, import_files_in_order, rejected_rows, model_grid,
        safety_net_messages, model_source, outlier_view, fill_raw_units,
    )
}
