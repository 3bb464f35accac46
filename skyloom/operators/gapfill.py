"""Gap filling: every gap of every series in one plan.

``gaps`` has (name, obstype, gap_id, datetime), ``obs`` the valid rows (name,
obstype, datetime, value), ``model`` one model series for each (name,
obstype).  A filled frame has (…, value, label, details).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import AmbiguousError, ArgumentError, UnitError
from ..functions import time as T
from ..functions import units
from ..functions.values import clip
from ..labels import FAILED, FILLS
from . import scan
from .align import KEY

GAP = [*KEY, "gap_id"]
DAY_US = 86400 * T.SECOND
#: Pairs of kind and unit that a model may have.
MOST_UNITS = 1000


def _us(column: str = "datetime") -> Column:
    return T.to_micros(F.col(column))


def _spans(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy(*GAP).agg(F.min(_us()).alias("gap_lo"), F.max(_us()).alias("gap_hi"), F.count("*").alias("gap_n"))


def _labelled(df: DataFrame, method: str, details: Column) -> DataFrame:
    label = F.when(F.col("value").isNotNull(), F.lit(FILLS[method])).otherwise(F.lit(FAILED[method]))
    return df.select(*GAP, "datetime", "value", label.alias("label"), details.alias("details"))


def anchors(gaps: DataFrame, obs: DataFrame, place: bool = False, piece_us: int | None = None) -> DataFrame:
    """Gap rows with the valid record before (v0, t0) and after (v1, t1), and with ``place`` their place in the gap."""
    rows = gaps.select(*GAP, "datetime")
    rows = scan.numbered(rows, GAP, "place", piece_us) if place else rows
    found = scan.neighbours(rows, obs.select(*KEY, "datetime", "value"), KEY, piece_us)
    sides = (("before", 0), ("after", 1))
    return found.select(*rows.columns, "ts", *[F.col(f"{side}.{c}").alias(f"{c}{i}") for side, i in sides for c in "vt"])


#: Orders of the piecewise polynomials that run through all anchors.
SPLINES = {"quadratic": 2, "cubic": 3, "cubicspline": 3, "polynomial": None}
#: Methods with slopes from the anchors near the gap, and those with one polynomial through all anchors.
LOCAL, WHOLE = ("pchip", "akima"), ("krogh", "barycentric")
#: Methods that look at the nearest record on each side only.
PAIRWISE = ("time", "linear", "slinear", "nearest", "zero")


def nearest_records(gaps: DataFrame, obs: DataFrame, n_leading: int, n_trailing: int, max_lead: str | None = None, max_trail: str | None = None) -> DataFrame:
    """The last valid records before each gap and the first after it, however far: (…, gap_id, side, datetime, value).

    With ``max_lead`` or ``max_trail``, those of them that are not farther from
    the gap (inclusive).  Records are numbered in their series, so gaps meet
    them by number, not by time.
    """
    return _nearest(gaps, obs, n_leading, n_trailing, max_lead, max_trail).select(*GAP, "side", "datetime", "value")


def _nearest(gaps: DataFrame, obs: DataFrame, n_leading: int, n_trailing: int, max_lead: str | None, max_trail: str | None) -> DataFrame:
    """``nearest_records`` with the gap's first and last stamp, gap_lo and gap_hi."""
    ends = ["gap_lo", "gap_hi"]
    valid = obs.where("value IS NOT NULL").select(*KEY, "datetime", "value", _us().alias("ts"))
    marks = _spans(gaps).select(*GAP, *ends, F.explode(F.array(F.struct(F.lit("lead").alias("side"), (F.col("gap_lo") - 1).alias("ts")), F.struct(F.lit("trail").alias("side"), F.col("gap_hi").alias("ts")))).alias("m")).select(*GAP, *ends, "m.*")
    numbered = cut(scan.numbered(valid, KEY, "number").withColumn("ts", _us()))
    # how many records lie up to each mark: those of earlier pieces, and of its own
    both = scan.in_pieces(numbered.select(*KEY, "datetime", "number").unionByName(marks.withColumn("datetime", T.to_timestamp(F.col("ts"))).drop("ts"), allowMissingColumns=True))
    own = F.max("number").over(scan.rows_of(KEY).orderBy("ts", F.col("number").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    carried = scan.with_carry(both.withColumn("_own", own), KEY, {"_last": F.max("number")}, {"_before": F.max("_last").over(scan.earlier(KEY))})
    seen = carried.where("side IS NOT NULL").withColumn("seen", F.coalesce("_own", "_before", F.lit(0).cast("long"))).select(*GAP, *ends, "side", "seen")
    lead = F.col("side") == "lead"
    wanted = F.when(lead, F.sequence(F.col("seen") - (n_leading - 1), F.col("seen"))).otherwise(F.sequence(F.col("seen") + 1, F.col("seen") + n_trailing))
    found = seen.select(*GAP, *ends, "side", F.explode(wanted).alias("number")).join(numbered, [*KEY, "number"])
    if max_lead:
        found = found.where(~lead | (F.col("gap_lo") - F.col("ts") <= T.micros(max_lead)))
    if max_trail:
        found = found.where(lead | (F.col("ts") - F.col("gap_hi") <= T.micros(max_trail)))
    return found.select(*GAP, *ends, "side", "datetime", "value")


def _anchored(gaps: DataFrame, obs: DataFrame, n_leading: int, n_trailing: int, max_lead: str | None, max_trail: str | None) -> DataFrame:
    """The gaps that have as many anchors as asked for on both sides."""
    sides = nearest_records(gaps, obs, n_leading, n_trailing, max_lead, max_trail).groupBy(*GAP).agg(F.count_if(F.col("side") == "lead").alias("nl"), F.count_if(F.col("side") == "trail").alias("nt"))
    return sides.where((F.col("nl") >= n_leading) & (F.col("nt") >= n_trailing)).select(*GAP)


def interpolate(
    gaps: DataFrame, obs: DataFrame, method: str = "time", max_gap: str = "3h", n_leading: int = 1, n_trailing: int = 1, max_lead: str | None = None, max_trail: str | None = None, order: int = 3, smoothing: float | None = None
) -> DataFrame:
    """Interpolate inside gaps, between valid records only (neither outliers nor earlier fills).

    ``time`` and ``slinear`` follow the clock, ``linear`` the rows; ``nearest``
    takes the nearer record (the earlier of two), ``zero`` the one before;
    ``quadratic``, ``cubic``, ``cubicspline`` and ``polynomial`` (of ``order``)
    are splines through all anchors, ``krogh`` and ``barycentric`` one
    polynomial through them; ``pchip`` keeps the anchors' rise and fall,
    ``akima`` follows the slopes nearby; ``spline`` (of ``order``) smooths: its
    squared residuals sum up to ``smoothing`` at most, the number of anchors
    unless it is given.  A gap longer than ``max_gap`` fails, and one without as
    many anchors as asked for, each within ``max_lead`` or ``max_trail`` of the
    gap.
    """
    if n_leading < 1 or n_trailing < 1:
        raise ArgumentError("at least one anchor on each side")
    if method in (*SPLINES, *LOCAL, *WHOLE, "spline"):
        return _interpolate_anchors(gaps, obs, method, SPLINES.get(method) or order, max_gap, n_leading, n_trailing, max_lead, max_trail, smoothing)
    if method not in PAIRWISE:
        raise ArgumentError(f"no interpolation method {method!r}; there are {', '.join((*PAIRWISE, *SPLINES, *LOCAL, *WHOLE, 'spline'))}")
    df = anchors(gaps, obs, method == "linear").join(_spans(gaps), GAP)
    down, up = F.col("ts") - F.col("t0"), F.col("t1") - F.col("ts")
    share = {"linear": F.col("place") / (F.col("gap_n") + 1), "nearest": F.when(up < down, 1.0).otherwise(0.0), "zero": F.lit(0.0)}.get(method, down / (down + up))
    size_ok = F.col("gap_hi") - F.col("gap_lo") <= T.micros(max_gap)
    if n_leading == 1 and n_trailing == 1:
        anchored = F.col("t0").isNotNull() & F.col("t1").isNotNull()
        if max_lead:
            anchored &= F.col("gap_lo") - F.col("t0") <= T.micros(max_lead)
        if max_trail:
            anchored &= F.col("t1") - F.col("gap_hi") <= T.micros(max_trail)
    else:  # the farthest anchor asked for must be near enough too
        df = df.join(_anchored(gaps, obs, n_leading, n_trailing, max_lead, max_trail).withColumn("anchored", F.lit(True)), GAP, "left")
        anchored = F.coalesce("anchored", F.lit(False))
    df = df.withColumn("value", F.when(size_ok & anchored, F.col("v0") + (F.col("v1") - F.col("v0")) * share))
    return _labelled(df, "interpolation", F.when(~size_ok, "gap too long").when(~F.coalesce(anchored, F.lit(False)), "not enough anchors").otherwise(f"interpolated by {method}"))


def _basis(x, knots, order: int):
    """B-spline basis functions of ``order`` at ``x``, one column each."""
    import numpy as np

    x = np.asarray(x, float)
    n = len(knots) - order - 1
    last = np.flatnonzero(np.diff(knots) > 0)[-1]
    b = np.array([((knots[i] <= x) & (x < knots[i + 1])) | ((i == last) & (x == knots[i + 1])) for i in range(len(knots) - 1)], float)
    for k in range(1, order + 1):
        rows = []
        for i in range(len(knots) - k - 1):
            left, right = knots[i + k] - knots[i], knots[i + k + 1] - knots[i + 1]
            zero = np.zeros_like(x)
            rows.append((b[i] * (x - knots[i]) / left if left else zero) + (b[i + 1] * (knots[i + k + 1] - x) / right if right else zero))
        b = np.array(rows)
    return b[:n].T


def spline(x, y, at, order: int = 3):
    """The interpolating spline through (x, y), evaluated at ``at``: odd orders skip knots at the ends, even ones put knots between the points."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    order = min(order, len(x) - 1)
    half = (order + 1) // 2
    inner = x[half : len(x) - half] if order % 2 else ((x[1:] + x[:-1]) / 2)[order // 2 : len(x) - 1 - order // 2]
    knots = np.concatenate([[x[0]] * (order + 1), inner, [x[-1]] * (order + 1)])
    return _basis(at, knots, order) @ np.linalg.solve(_basis(x, knots, order), y)


def period(gaps: DataFrame, obs: DataFrame, lead: str, trail: str) -> DataFrame:
    """Valid records near gaps: (…, gap_id, side, datetime, value) with side ``lead`` or ``trail``, bounds included.

    A range join made equal by bins of time, so that a long series is not paired with each of its gaps.
    """
    return _period(gaps, obs.select(*KEY, "datetime", "value"), lead, trail)


def _period(gaps: DataFrame, obs: DataFrame, lead: str, trail: str) -> DataFrame:
    """``period`` with all columns of ``obs``; a bin is a day, or as long as the longer side, so that a side lies in two of them at most."""
    spans = _spans(gaps)
    windows = spans.select(*GAP, F.explode(F.array(F.struct(F.lit("lead").alias("side"), (F.col("gap_lo") - T.micros(lead)).alias("lo"), (F.col("gap_lo") - 1).alias("hi")), F.struct(F.lit("trail").alias("side"), (F.col("gap_hi") + 1).alias("lo"), (F.col("gap_hi") + T.micros(trail)).alias("hi")))).alias("w")).select(*GAP, "w.*")
    at = lambda c: F.floor(F.col(c) / F.lit(max(DAY_US, T.micros(lead), T.micros(trail))))
    windows = windows.where("hi >= lo").withColumn("bin", F.explode(F.sequence(at("lo"), at("hi"))))
    rows = obs.where("value IS NOT NULL").withColumn("ts", _us()).withColumn("bin", at("ts"))
    return windows.join(rows, [*KEY, "bin"]).where("ts BETWEEN lo AND hi").select(*GAP, "side", *[c for c in obs.columns if c not in KEY])


def _jumps(knots, order: int):
    """The jumps of the highest derivative at the inner knots, as rows of weights of the basis functions."""
    import numpy as np

    n = len(knots) - order - 1
    weights, t = np.eye(n), np.asarray(knots, float)
    for k in range(order, 0, -1):
        t = t[1:-1]
        width = t[k : k + len(weights) - 1] - t[: len(weights) - 1]
        weights = k * np.diff(weights, axis=0) / width[:, None]
    return np.diff(weights, axis=0)


def smoothing_spline(x, y, at, order: int = 3, smoothing: float | None = None):
    """A spline that is as smooth as it can be with squared residuals of at most ``smoothing`` (the number of points if None), at ``at``.

    Where one polynomial of ``order`` is near enough it is that polynomial.
    Else knots are put, one after another, among the points of the part that
    fits worst, until a least-squares spline is near enough; of the splines
    with these knots the one is taken whose highest derivative jumps least
    while its residuals sum up to ``smoothing``.
    """
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    limit = float(len(x) if smoothing is None else smoothing)
    first, last, scale = x[0], x[-1], (x[-1] - x[0]) or 1.0
    x, at = (x - first) / scale, (np.asarray(at, float) - first) / scale
    inner: list[float] = []
    while True:
        knots = np.array([0.0] * (order + 1) + inner + [1.0] * (order + 1))
        b = _basis(x, knots, order)
        c = np.linalg.lstsq(b, y, rcond=None)[0]
        residual = (b @ c - y) ** 2
        if residual.sum() <= limit or len(inner) >= len(x) - order - 1:
            break
        # the part with the largest residuals that still has a point inside for a knot
        edges, parts = np.array([0.0, *inner, 1.0]), []
        for lo, hi in zip(edges, edges[1:], strict=False):
            within = np.flatnonzero((x > lo) & (x < hi))
            if len(within):
                parts.append((residual[(x >= lo) & (x <= hi)].sum(), x[within[len(within) // 2]]))
        if not parts:
            break
        inner = sorted([*inner, max(parts)[1]])
    if len(inner) >= len(x) - order - 1 and residual.sum() > limit:
        return spline(x, y, at, order)  # nothing but a spline through all points is near enough
    if inner:
        d = _jumps(knots, order)
        d = d / (np.abs(d).max() or 1.0)
        fit = lambda p: np.linalg.lstsq(np.vstack([b, d / np.sqrt(p)]), np.concatenate([y, np.zeros(len(d))]), rcond=None)[0]
        low, high = -40.0, 40.0  # powers of e: from one polynomial nearly to the least-squares spline
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (low, middle) if ((b @ fit(np.exp(middle)) - y) ** 2).sum() <= limit else (middle, high)
        c = fit(np.exp(high))
    return _basis(np.clip(at, 0.0, 1.0), knots, order) @ c


def _slope(h: list[Column], d: list[Column], i: int, method: str) -> Column:
    """The slope at point i, from the widths ``h`` and slopes ``d`` of the parts between points."""
    if len(d) == 1:
        return d[0]
    if method == "akima":
        # two more slopes on each side, on a parabola
        m = [2 * (2 * d[0] - d[1]) - d[0], 2 * d[0] - d[1], *d, 2 * d[-1] - d[-2], 2 * (2 * d[-1] - d[-2]) - d[-1]]
        far, near, right, beyond = m[i : i + 4]
        left, after = F.abs(beyond - right), F.abs(near - far)
        return F.when(left + after > 1e-9 * F.greatest(F.abs(far), F.abs(beyond), F.lit(1e-300)), (left * near + after * right) / (left + after)).otherwise((near + right) / 2)
    if 0 < i < len(d):
        a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        return F.when(d[i - 1] * d[i] > 0, (a + b) / (a / d[i - 1] + b / d[i])).otherwise(F.lit(0.0))
    h0, h1, d0, d1 = (h[0], h[1], d[0], d[1]) if i == 0 else (h[-1], h[-2], d[-1], d[-2])
    end = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(end) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(end) > 3 * F.abs(d0)), 3 * d0).otherwise(end)


def _between(method: str, x: Column, t: list[Column], v: list[Column], i: int) -> Column:
    """The value at ``x`` between points i and i + 1 of (t, v), as native expressions."""
    if method in WHOLE:
        terms = []
        for j in range(len(t)):
            term = v[j]
            for k in range(len(t)):
                term = term * ((x - t[k]) / (t[j] - t[k])) if k != j else term
            terms.append(term)
        return sum(terms[1:], terms[0])
    h = [b - a for a, b in zip(t, t[1:], strict=False)]
    d = [(b - a) / w for a, b, w in zip(v, v[1:], h, strict=False)]
    s0, s1 = _slope(h, d, i, method), _slope(h, d, i + 1, method)
    u = (x - t[i]) / h[i]
    return v[i] * ((1 + 2 * u) * (1 - u) * (1 - u)) + h[i] * s0 * (u * (1 - u) * (1 - u)) + v[i + 1] * (u * u * (3 - 2 * u)) + h[i] * s1 * (u * u * (u - 1))


def _interpolate_anchors(gaps, obs, method, order, max_gap, n_leading, n_trailing, max_lead, max_trail, smoothing) -> DataFrame:
    """Interpolation by all anchors of a gap; a gap is one row until its stamps are written."""
    near = _nearest(gaps, obs, n_leading, n_trailing, max_lead, max_trail)
    sides = near.groupBy(*GAP, "gap_lo", "gap_hi").agg(F.count_if(F.col("side") == "lead").alias("nl"), F.count_if(F.col("side") == "trail").alias("nt"), F.array_sort(F.collect_list(F.struct(_us().alias("t"), F.col("value").cast("double").alias("v")))).alias("known"))
    # fewer points than the order needs lower it for cubicspline, and fail else
    # a spline of one piece is the polynomial through all anchors
    native = method in (*LOCAL, *WHOLE) or method in SPLINES and n_leading + n_trailing <= order + 1
    enough = method in (*LOCAL, *WHOLE) or n_leading + n_trailing > order or method == "cubicspline"
    fits = F.lit(enough) & (F.col("nl") >= n_leading) & (F.col("nt") >= n_trailing) & (F.col("gap_hi") - F.col("gap_lo") <= T.micros(max_gap))
    known = sides.where(fits).select(*GAP, "known")
    if native:
        rows = gaps.select(*GAP, "datetime").join(known, GAP, "left")
        seconds = lambda us: (us - F.col("known")[0]["t"]) / T.SECOND
        points = range(n_leading + n_trailing)
        done = rows.withColumn("value", F.when(F.col("known").isNotNull(), _between(method if method in LOCAL else WHOLE[0], seconds(_us()), [seconds(F.col("known")[i]["t"]) for i in points], [F.col("known")[i]["v"] for i in points], n_leading - 1)))
    else:

        @F.pandas_udf("array<double>")
        def through(t, v, at):
            # a row is one gap: its stamps within max_gap, and a fixed number of anchors
            curve = (lambda *a: smoothing_spline(*a, order, smoothing)) if method == "spline" else (lambda *a: spline(*a, order))
            return pd.Series([None if x is None else curve((x - x[0]) / 1e6, y, (z - x[0]) / 1e6) for x, y, z in zip(t, v, at, strict=True)])

        # stamps are gathered of gaps that fit, which max_gap bounds
        fitting = gaps.select(*GAP, "datetime").join(known, GAP)
        lists = fitting.groupBy(*GAP).agg(F.array_sort(F.collect_list(_us())).alias("at"), F.first("known").alias("known"))
        part = lambda c: F.transform("known", lambda x: x[c])
        filled = lists.withColumn("fill", through(part("t"), part("v"), "at")).select(*GAP, F.explode(F.arrays_zip("at", "fill")).alias("x")).select(*GAP, T.to_timestamp(F.col("x.at")).alias("datetime"), F.col("x.fill").alias("value"))
        done = gaps.select(*GAP, "datetime").join(filled, [*GAP, "datetime"], "left")
    text = f"interpolated by {method}" + (f" of order {order}" if method in ("spline", "polynomial") else "")
    return _labelled(done, "interpolation", F.when(F.col("value").isNull(), "gap too long or not enough anchors" if enough else "too few anchors for the order").otherwise(text))


def at_stamps(model: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``model_value``: the model series in linear time between its records, null outside."""
    both = scan.neighbours(targets, model.select(*KEY, "datetime", "value"), KEY)
    b, a = F.col("before"), F.col("after")
    value = F.when(a["t"] == b["t"], b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * ((F.col("ts") - b["t"]) / (a["t"] - b["t"])))
    return both.withColumn("model_value", value).select(*targets.columns, "model_value")


def require_single_model(model: DataFrame) -> None:
    """Raise if a station and kind have several model series, told apart by modelname and modelvariable."""
    names = [c for c in ("modelname", "modelvariable") if c in model.columns]
    if names and not model.groupBy(*KEY).agg(F.countDistinct(*names).alias("n")).where("n > 1").isEmpty():
        raise AmbiguousError("several model series for one station and observation kind")


def fill_raw(gaps: DataFrame, model: DataFrame, max_gap: str = "12h", low: float | None = None, high: float | None = None) -> DataFrame:
    """Model values at the gap's stamps, within bounds."""
    df = at_stamps(model, gaps.select(*GAP, "datetime")).join(_spans(gaps), GAP)
    fits = F.col("gap_hi") - F.col("gap_lo") <= T.micros(max_gap)
    df = df.withColumn("value", F.when(fits, clip(F.col("model_value"), low, high)))
    return _labelled(df, "raw", F.when(~fits, "gap too long").when(F.col("value").isNull(), "no model value").otherwise("model value"))


def _deviations(obs: DataFrame, model: DataFrame) -> DataFrame:
    """Valid records with ``bias``, the model's deviation at their stamp (null outside the model), found once for each, not for each gap near it."""
    return at_stamps(model, obs.where("value IS NOT NULL").select(*KEY, "datetime", "value")).withColumn("bias", F.col("model_value") - F.col("value")).drop("model_value")


def _sides() -> list[Column]:
    return [F.count_if(F.col("side") == side).alias(name) for side, name in (("lead", "nl"), ("trail", "nt"))]


def _clock() -> list[Column]:
    return [F.hour("datetime").alias("h"), F.minute("datetime").alias("m"), F.second("datetime").alias("s")]


def _covered(gaps: DataFrame, model: DataFrame, lead: str, trail: str) -> DataFrame:
    """Gap spans, and whether their leading and trailing periods lie inside the model series."""
    ends = model.where("value IS NOT NULL").groupBy(*KEY).agg(F.min(_us()).alias("m_lo"), F.max(_us()).alias("m_hi"))
    inside = (F.col("m_lo") <= F.col("gap_lo") - T.micros(lead)) & (F.col("m_hi") >= F.col("gap_hi") + T.micros(trail))
    return _spans(gaps).join(ends, KEY, "left").select(*GAP, "gap_lo", "gap_hi", F.coalesce(inside, F.lit(False)).alias("covered"))


def _fill(gaps: DataFrame, model: DataFrame, method: str, bias: DataFrame, keys: list[str], max_gap: str, lead: str, trail: str, value: Column) -> DataFrame:
    df = at_stamps(model, gaps.select(*GAP, "datetime")).select("*", *_clock()).join(_covered(gaps, model, lead, trail), GAP)
    df = df.join(bias, keys, "left")
    fits = F.col("gap_hi") - F.col("gap_lo") <= T.micros(max_gap)
    df = df.withColumn("value", F.when(fits & F.col("covered"), value))
    return _labelled(df, method, F.when(~fits, "gap too long").when(F.col("value").isNull(), "no model value or too few records for a bias").otherwise("debiased model value"))


def fill_debiased(gaps: DataFrame, obs: DataFrame, model: DataFrame, max_gap: str = "12h", lead: str = "24h", trail: str = "24h", min_lead: int = 60, min_trail: int = 60, low: float | None = None, high: float | None = None) -> DataFrame:
    """Model minus its mean deviation from the records before and after the gap."""
    by = _period(gaps, _deviations(obs, model), lead, trail).groupBy(*GAP).agg(F.avg("bias").alias("bias"), *_sides())
    bias = by.where((F.col("nl") >= min_lead) & (F.col("nt") >= min_trail)).select(*GAP, "bias")
    return _fill(gaps, model, "debiased", bias, GAP, max_gap, lead, trail, clip(F.col("model_value") - F.col("bias"), low, high))


def fill_diurnal(gaps: DataFrame, obs: DataFrame, model: DataFrame, max_gap: str = "12h", lead: str = "24h", trail: str = "24h", min_sample: int = 6, low: float | None = None, high: float | None = None) -> DataFrame:
    """Model minus its mean deviation at the same time of day around the gap."""
    near = _period(gaps, _deviations(obs, model).select("*", *_clock()), lead, trail)
    by = cut(near.groupBy(*GAP, "h", "m", "s").agg(F.avg("bias").alias("bias"), F.count("bias").alias("n"), *_sides()))
    enough = by.groupBy(*GAP).agg(F.sum("nl").alias("nl"), F.sum("nt").alias("nt")).where((F.col("nl") >= min_sample) & (F.col("nt") >= min_sample)).select(*GAP)
    bias = by.where(F.col("n") >= min_sample).select(*GAP, "h", "m", "s", "bias").join(enough, GAP, "left_semi")
    return _fill(gaps, model, "diurnal_debiased", bias, [*GAP, "h", "m", "s"], max_gap, lead, trail, clip(F.col("model_value") - F.col("bias"), low, high))


def fill_weighted_diurnal(gaps: DataFrame, obs: DataFrame, model: DataFrame, max_gap: str = "12h", lead: str = "24h", trail: str = "24h", min_lead: int = 2, min_trail: int = 2, low: float | None = None, high: float | None = None) -> DataFrame:
    """Like ``fill_diurnal`` with a bias of each side, the nearer side weighing more; a gap of one stamp has no weights and fails."""
    near = _period(gaps, _deviations(obs, model).select("*", *_clock()), lead, trail)
    by = near.groupBy(*GAP, "h", "m", "s").agg(*[f(F.when(F.col("side") == s, F.col("bias"))).alias(f"{n}_{s}") for s in ("lead", "trail") for n, f in (("bias", F.avg), ("n", F.count))])
    bias = by.where((F.col("n_lead") >= min_lead) & (F.col("n_trail") >= min_trail))
    weight = 1 - (_us() - F.col("gap_lo")) / F.nullif(F.col("gap_hi") - F.col("gap_lo"), F.lit(0))
    value = F.col("model_value") - (weight * F.col("bias_lead") + (1 - weight) * F.col("bias_trail"))
    return _fill(gaps, model, "weighted_diurnal_debiased", bias, [*GAP, "h", "m", "s"], max_gap, lead, trail, clip(value, low, high))


def in_standard_units(model: DataFrame, standards: dict[str, str] | None = None) -> DataFrame:
    """``model`` without its column ``unit``, values turned from it into the kinds' standard units.

    ``standards`` adds kinds, or other units for known ones.  A unit that is
    unknown, missing or of another dimension raises, and so does a kind without
    a standard.
    """
    known = {kind: unit for kind, (unit, _) in units.KINDS.items()} | (standards or {})
    kinds = model.select("obstype", "unit").distinct().limit(MOST_UNITS + 1).collect()
    if len(kinds) > MOST_UNITS:
        raise UnitError(f"more than {MOST_UNITS} pairs of kind and unit")
    value = F.lit(None).cast("double")
    for kind, unit in sorted(kinds, key=str):
        if kind not in known:
            raise UnitError(f"{kind!r} has no standard unit")
        if unit is None:
            raise UnitError(f"a model row of {kind!r} has no unit")
        value = F.when((F.col("obstype") == kind) & (F.col("unit") == unit), units.convert(F.col("value"), unit, known[kind])).otherwise(value)
    return model.withColumn("value", value).drop("unit")


def fill_with_model(method: str, gaps: DataFrame, obs: DataFrame, model: DataFrame, standards: dict[str, str] | None = None, **options) -> DataFrame:
    """Fill by the named method: raw, debiased, diurnal_debiased or weighted_diurnal_debiased.

    Where ``model`` has a column ``unit``, its values are turned into the
    standard units of their kinds first, see ``in_standard_units``.
    """
    require_single_model(model)
    if "unit" in model.columns:
        model = in_standard_units(model, standards)
    if method == "raw":
        return fill_raw(gaps, model, **options)
    methods = {"debiased": fill_debiased, "diurnal_debiased": fill_diurnal, "weighted_diurnal_debiased": fill_weighted_diurnal}
    if method not in methods:
        raise ArgumentError(f"no fill method {method!r}")
    return methods[method](gaps, obs, model, **options)


def fill_status(filled: DataFrame) -> DataFrame:
    """The state of each gap by its rows' values and labels."""
    tried = F.bool_or(F.col("label").isin(*FILLS.values(), *FAILED.values()))
    some, every = F.bool_or(F.col("value").isNotNull()), F.bool_and(F.col("value").isNotNull())
    status = F.when(~F.col("tried"), "unfilled gap").when(F.col("full"), "successful gapfill").when(F.col("some"), "partially successful gapfill").otherwise("failed gapfill")
    return filled.groupBy(*GAP).agg(tried.alias("tried"), some.alias("some"), every.alias("full")).select(*GAP, status.alias("status"), (status != "successful gapfill").alias("can_be_filled"))


def flush(filled: DataFrame) -> DataFrame:
    """Gaps as they were before any fill."""
    return filled.select(*GAP, "datetime", F.lit(None).cast("double").alias("value"), F.lit("gap").alias("label"), F.lit("no details").alias("details"))
