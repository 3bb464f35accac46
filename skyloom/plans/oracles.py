"""DuckDB SQL for the named queries: the same rows, stated on their own."""

from __future__ import annotations

# Fixed values, written out here and not taken from the code under test.
ROUND_TO = (86400, 3600, 1800, 600, 300, 60, 30)
CHECKS = {
    "duplicated_timestamp": "duplicated timestamp outlier",
    "gross_value": "gross value outlier",
    "persistence": "persistence outlier",
    "repetitions": "repetitions outlier",
    "step": "in step outlier group",
    "window_variation": "in window variation outlier group",
}
FILLS = {
    "interpolation": "interpolation",
    "raw": "raw modeldata fill",
    "debiased": "debiased modeldata fill",
    "diurnal_debiased": "diurnal debiased modeldata fill",
    "weighted_diurnal_debiased": "Weighted diurnal debiased modeldata fill",
}
FAILED = {
    "interpolation": "failed interpolation",
    "raw": "failed raw modeldata fill",
    "debiased": "failed debiased modeldata fill",
    "diurnal_debiased": "failed diurnal debiased modeldata fill",
    "weighted_diurnal_debiased": "failed Weighted diurnal debiased modeldata fill",
}
NUMBERS = {
    "ok": 0,
    "gross value outlier": 3,
    "persistence outlier": 4,
    "repetitions outlier": 5,
    "in step outlier group": 6,
    "in window variation outlier group": 7,
}
LANDCOVER = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
LANDCOVER_GROUPS = {"water": [70, 80, 90, 95], "pervious": [10, 20, 30, 40, 60, 100], "impervious": [50]}
# Local climate zones, 1 first.
LCZ = [
    "Compact highrise", "Compact midrise", "Compact lowrise", "Open highrise", "Open midrise", "Open lowrise",
    "Lightweight lowrise", "Large lowrise", "Sparsely built", "Heavy industry", "Dense Trees (LCZ A)",
    "Scattered Trees (LCZ B)", "Bush, scrub (LCZ C)", "Low plants (LCZ D)", "Bare rock or paved (LCZ E)",
    "Bare soil or sand (LCZ F)", "Water (LCZ G)",
]

H = 3_600_000_000
_NUM = "::DOUBLE"


def ts(us: str) -> str:
    return f"make_timestamp(({us})::BIGINT)"


def simplified(us: str, tolerance: int, zero: bool = False) -> str:
    """SQL of the rounding to the roundest near time."""
    out = []
    for seconds in ROUND_TO:
        s = seconds * 1_000_000
        near = f"(({us}) - ({us}) % {s} + CASE WHEN 2 * (({us}) % {s}) > {s} OR (2 * (({us}) % {s}) = {s} AND ((({us}) // {s}) % 2) = 1) THEN {s} ELSE 0 END)"
        if zero:
            near = f"(CASE WHEN {near} = 0 THEN {s} ELSE {near} END)"
        out.append(f"WHEN abs(({us}) - {near}) < {tolerance} THEN {near}")
    return f"CASE {' '.join(out)} ELSE ({us}) END"


def num(x: float) -> str:
    return f"{x!r}{_NUM}"


OBS = "obs AS (SELECT CAST(user_id AS VARCHAR) AS name, 'value' AS obstype, ts AS datetime, epoch_us(ts) AS us, value FROM events)"
STATIONS = "stations AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS name, 50 + (user_id % 50) * 0.02::DOUBLE AS lat, 4 + (user_id // 50) * 0.02::DOUBLE AS lon, ((user_id * 37) % 300)::DOUBLE AS altitude, user_id % 5 AS category FROM events)"


def nearest(target: str, raw: str, out: str, tolerance: int, later: bool = False) -> str:
    """CTEs of the nearest as-of join of (name, us) targets with (name, us, value) rows."""
    less = "<=" if later else "<"
    return f"""{out}_b AS (SELECT g.name, g.us, o.us AS b_us, o.value AS b_value FROM {target} g ASOF LEFT JOIN {raw} o ON g.name = o.name AND g.us >= o.us),
{out}_a AS (SELECT g.name, g.us, o.us AS a_us, o.value AS a_value FROM {target} g ASOF LEFT JOIN {raw} o ON g.name = o.name AND g.us <= o.us),
{out}_x AS (SELECT b.name, b.us, CASE WHEN b_us IS NULL OR a_us - b.us {less} b.us - b_us THEN a_us ELSE b_us END AS r_us, CASE WHEN b_us IS NULL OR a_us - b.us {less} b.us - b_us THEN a_value ELSE b_value END AS r_value
  FROM {out}_b b JOIN {out}_a a ON a.name = b.name AND a.us = b.us),
{out} AS (SELECT name, us, CASE WHEN abs(r_us - us) <= {tolerance} THEN r_us END AS raw_us, CASE WHEN abs(r_us - us) <= {tolerance} THEN r_value END AS value FROM {out}_x)"""


def grid(raw: str, out: str, freq: str, tolerance: int) -> str:
    return f"""{out}_o AS (SELECT *, {simplified("lo", tolerance)} AS origin FROM (SELECT name, MIN(us) AS lo, MAX(us) AS hi, {freq} AS freq FROM {raw} GROUP BY name)),
{out} AS (SELECT name, unnest(generate_series(origin, origin + trunc((hi - origin) / freq)::BIGINT * freq, freq)) AS us FROM {out}_o)"""


ALIGNED = f"""{grid("obs", "grid", str(6 * H), 300_000_000)},
{nearest("grid", "obs", "near", 3 * H)},
aligned AS (SELECT name, us, raw_us, value, CASE WHEN raw_us IS NULL THEN 'gap' WHEN value IS NULL THEN 'outlier' ELSE 'ok' END AS status FROM near)"""

GAPS = f"""gap_f AS (SELECT name, us, CASE WHEN us - LAG(us) OVER w = {6 * H} THEN 0 ELSE 1 END AS n FROM aligned WHERE status = 'gap' WINDOW w AS (PARTITION BY name ORDER BY us)),
gaps AS (SELECT name, us, SUM(n) OVER (PARTITION BY name ORDER BY us)::BIGINT AS gap_id FROM gap_f),
good AS (SELECT name, us, value FROM aligned WHERE status = 'ok'),
spans AS (SELECT name, gap_id, MIN(us) AS lo, MAX(us) AS hi, COUNT(*) AS n FROM gaps GROUP BY name, gap_id)"""

MODEL = f"""network AS (SELECT us - us % {6 * H} AS us, AVG(value) AS value FROM obs GROUP BY 1),
model AS (SELECT n.name, network.us, network.value FROM (SELECT DISTINCT name FROM obs) n, network)"""


def at_model(target: str, out: str) -> str:
    """CTEs that give (name, us) targets the model's value in linear time."""
    return f"""{out}_b AS (SELECT t.*, m.us AS mb, m.value AS vb FROM {target} t ASOF LEFT JOIN model m ON t.name = m.name AND t.us >= m.us),
{out}_a AS (SELECT t.*, m.us AS ma, m.value AS va FROM {out}_b t ASOF LEFT JOIN model m ON t.name = m.name AND t.us <= m.us),
{out} AS (SELECT * EXCLUDE (mb, vb, ma, va), CASE WHEN ma = mb THEN vb ELSE vb + (va - vb) * ((us - mb)::DOUBLE / (ma - mb)) END AS mv FROM {out}_a)"""


PERIOD = """near_gap AS (SELECT s.name, s.gap_id, 'lead' AS side, g.us, g.value FROM spans s JOIN good g ON g.name = s.name AND g.us >= s.lo - {lead} AND g.us < s.lo
UNION ALL SELECT s.name, s.gap_id, 'trail', g.us, g.value FROM spans s JOIN good g ON g.name = s.name AND g.us > s.hi AND g.us <= s.hi + {trail})"""

COVERED = """covered AS (SELECT s.* FROM spans s JOIN (SELECT name, MIN(us) AS m_lo, MAX(us) AS m_hi FROM model GROUP BY name) m ON m.name = s.name WHERE m_lo <= s.lo - {lead} AND m_hi >= s.hi + {trail})"""


def with_(*ctes: str, then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + then


def flags(check: str, condition: str, source: str = "obs", ctes: tuple[str, ...] = (OBS,)) -> str:
    return with_(*ctes, then=f"SELECT name, obstype, datetime, value, '{CHECKS[check]}' AS label FROM {source} WHERE {condition}")


COARSE = "coarse AS (SELECT name, obstype, datetime, us, floor(value / 20) AS value FROM obs)"


def centred(source: str, us: int, v: str = "value") -> str:
    return f"SELECT *, COUNT({v}) OVER w AS n, MIN({v}) OVER w AS lo, MAX({v}) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY name ORDER BY us RANGE BETWEEN {us // 2} PRECEDING AND {us // 2} FOLLOWING)"


def variation(source: str, us: int, v: str, up: float, down: float, least: int) -> str:
    """SQL of the window-variation flag, from the first of each extreme."""
    w = f"(PARTITION BY name ORDER BY us RANGE BETWEEN {us // 2} PRECEDING AND {us // 2} FOLLOWING)"
    seconds = us / 1e6
    return f"""SELECT *, COALESCE({v} IS NOT NULL AND cnt >= {least} AND ((h.v - l.v > {num(up * seconds)} AND h.t > l.t) OR (h.v - l.v > {num(down * seconds)} AND h.t < l.t)), FALSE) AS flag FROM (
  SELECT *, COUNT({v}) OVER {w} AS cnt,
    {{'v': MAX({v}) OVER {w}, 't': -((MAX(CASE WHEN {v} IS NOT NULL THEN {{'v': {v}, 't': -us}} END) OVER {w}).t)}} AS h, MIN(CASE WHEN {v} IS NOT NULL THEN {{'v': {v}, 't': us}} END) OVER {w} AS l FROM {source})"""


def too_fast(source: str, v: str, up: float, down: float) -> str:
    w = "(PARTITION BY name ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT *, COALESCE({v} - pv > {num(up)} * ((us - pu)::DOUBLE / 1000000) OR {v} - pv < {num(down)} * ((us - pu)::DOUBLE / 1000000), FALSE) AS flag FROM (
  SELECT *, LAST_VALUE({v} IGNORE NULLS) OVER {w} AS pv, LAST_VALUE(CASE WHEN {v} IS NOT NULL THEN us END IGNORE NULLS) OVER {w} AS pu FROM {source})"""


def runs(source: str, v: str, most: int) -> str:
    return f"""SELECT *, {v} IS NOT NULL AND COUNT({v}) OVER (PARTITION BY name, run) > {most} AS flag FROM (SELECT *, SUM(st) OVER (PARTITION BY name ORDER BY us) AS run FROM (
  SELECT *, CASE WHEN {v} IS NULL THEN 0 WHEN pv IS NULL OR {v} <> pv THEN 1 ELSE 0 END AS st FROM (SELECT *, LAST_VALUE({v} IGNORE NULLS) OVER (PARTITION BY name ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM {source})))"""


def _next(i: int, check: str, source: str) -> str:
    return f"c{i} AS (SELECT name, obstype, datetime, us, raw_value, CASE WHEN NOT flag THEN v END AS v, CASE WHEN flag THEN '{CHECKS[check]}' ELSE label END AS label FROM ({source}))"


CHAIN = (
    OBS,
    "c0 AS (SELECT name, obstype, datetime, us, floor(value / 5) AS raw_value, floor(value / 5) AS v, 'ok' AS label FROM obs)",
    _next(1, "gross_value", "SELECT *, COALESCE(v < 0 OR v > 12, FALSE) AS flag FROM c0"),
    _next(2, "persistence", f"SELECT *, COALESCE(v IS NOT NULL AND n >= 4 AND lo = hi, FALSE) AS flag FROM ({centred('c1', 48 * H, 'v')})"),
    _next(3, "repetitions", runs("c2", "v", 4)),
    _next(4, "step", too_fast("c3", "v", 1 / 3600, -1 / 3600)),
    _next(5, "window_variation", variation("c4", 24 * H, "v", 0.00005, 0.00006, 3)),
)
ORDER = ["gross_value", "persistence", "repetitions", "step", "window_variation"]


def _stats() -> str:
    parts, rejected = [], "COUNT(*) FILTER (label IS NULL)"
    for i, c in enumerate(ORDER):
        n = f"COUNT(*) FILTER (label = '{CHECKS[c]}')"
        parts.append(f"SELECT {i} AS seq, '{c}' AS qc_check, COUNT(*) AS n_all, COUNT(*) - ({rejected}) AS n_checked, {n} AS n_labeled FROM c5")
        rejected += f" + {n}"
    return "\nUNION ALL ".join(parts)


def filled(method: str, value: str, details: str) -> str:
    return f"SELECT name, 'value' AS obstype, gap_id, {ts('us')} AS datetime, round({value}, 6) AS value, CASE WHEN ({value}) IS NOT NULL THEN '{FILLS[method]}' ELSE '{FAILED[method]}' END AS label, {details} AS details"


ANCHORED = """anchored AS (SELECT g.name, g.us, g.gap_id, ROW_NUMBER() OVER (PARTITION BY g.name, g.gap_id ORDER BY g.us) AS place, s.lo, s.hi, s.n, b.us AS t0, b.value AS v0 FROM gaps g JOIN spans s ON s.name = g.name AND s.gap_id = g.gap_id
  ASOF LEFT JOIN good b ON b.name = g.name AND g.us >= b.us),
both_sides AS (SELECT a.*, f.us AS t1, f.value AS v1 FROM anchored a ASOF LEFT JOIN good f ON f.name = a.name AND a.us <= f.us)"""


def _interpolated(share: str, method: str, extra: str = "") -> str:
    ok = f"hi - lo <= {24 * H} AND COALESCE(t0 IS NOT NULL AND t1 IS NOT NULL{extra}, FALSE)"
    value = f"CASE WHEN {ok} THEN v0 + (v1 - v0) * ({share}) END"
    details = f"CASE WHEN hi - lo > {24 * H} THEN 'gap too long' WHEN NOT COALESCE(t0 IS NOT NULL AND t1 IS NOT NULL{extra}, FALSE) THEN 'not enough anchors' ELSE 'interpolated by {method}' END"
    return with_(OBS, ALIGNED, GAPS, ANCHORED, then=filled("interpolation", value, details) + " FROM both_sides")


CLOCK = "(us // 1000000) % 86400 AS clock"
_MODEL_DETAILS = f"CASE WHEN hi - lo > {12 * H} THEN 'gap too long' WHEN %s IS NULL THEN 'no model value or too few records for a bias' ELSE 'debiased model value' END"


def _debiased(method: str, lead: int, bias: str, keys: str, value: str) -> str:
    ctes = (OBS, ALIGNED, GAPS, MODEL, PERIOD.format(lead=lead, trail=lead), COVERED.format(lead=lead, trail=lead), at_model("near_gap", "near_m"), f"dev AS (SELECT name, gap_id, side, {CLOCK}, mv - value AS bias FROM near_m WHERE mv IS NOT NULL)", at_model("gaps", "gap_m"), bias)
    v = f"CASE WHEN hi - lo <= {12 * H} THEN {value} END"
    join = " AND ".join(f"bias.{k} = g.{k}" for k in keys.split())
    return with_(*ctes, then=filled(method, v, _MODEL_DETAILS % f"({value})").replace("SELECT name,", "SELECT g.name,").replace(" gap_id,", " g.gap_id,", 1) + f" FROM (SELECT *, {CLOCK} FROM gap_m) g JOIN (SELECT name AS sn, gap_id AS sg, lo, hi FROM spans) s ON sn = g.name AND sg = g.gap_id LEFT JOIN bias ON {join}")


HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
NETWORK = f"net AS (SELECT name, us - us % {6 * H} AS us, round(AVG(value), 6) AS value FROM obs GROUP BY ALL)"
GROUPS = f"""near_s AS (SELECT a.name, b.name AS buddy FROM stations a JOIN stations b ON a.name <> b.name WHERE {HAVERSINE} <= 10000),
lists AS (SELECT name, list(buddy) AS buddies, ROW_NUMBER() OVER (ORDER BY name) AS i FROM near_s GROUP BY name HAVING COUNT(*) >= 4),
greedy AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS marked, []::VARCHAR[] AS refs
  UNION ALL SELECT l.i, CASE WHEN list_contains(g.marked, l.name) THEN g.marked ELSE list_concat(list_append(g.marked, l.name), l.buddies) END, CASE WHEN list_contains(g.marked, l.name) THEN g.refs ELSE list_append(g.refs, l.name) END FROM greedy g JOIN lists l ON l.i = g.i + 1),
refs AS (SELECT unnest(refs) AS group_id FROM (SELECT refs FROM greedy ORDER BY i DESC LIMIT 1)),
members AS (SELECT group_id, unnest(list_append(buddies, group_id)) AS name FROM refs JOIN lists ON lists.name = group_id)"""
WORST = """gstat AS (SELECT group_id, us, AVG(value) AS mean, CASE WHEN stddev_samp(value) < 1 THEN 1.0 ELSE stddev_samp(value) END AS sd FROM net JOIN members USING (name) GROUP BY group_id, us HAVING COUNT(value) >= 4),
gchi AS (SELECT group_id, us, name, value, abs(value - mean) / sd AS chi FROM net JOIN members USING (name) JOIN gstat USING (group_id, us)),
worst AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id, us ORDER BY chi DESC, name) AS r FROM gchi WHERE chi > 1.8) WHERE r = 1)"""

WIDE = f"""wide AS (SELECT CAST(user_id AS VARCHAR) AS name, {ts(f"epoch_us(ts) - epoch_us(ts) % {6 * H}")} AS datetime, {", ".join(f"AVG(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view"))} FROM events GROUP BY ALL)"""
SEASON = "CASE WHEN {d} > 336 OR {d} <= 61 THEN 'winter' WHEN {d} <= 153 THEN 'spring' WHEN {d} <= 245 THEN 'summer' ELSE 'autumn' END"
PIXELS = f"pixels AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS name, 100 AS radius, ([{', '.join(map(str, LANDCOVER))}])[(l_partkey % 11 + 1)::INT] AS class FROM lineitem)"


_CYCLE = f"cycle AS (SELECT category, hour(datetime)::INT AS hour, minute(datetime)::INT AS minute, second(datetime)::INT AS second, AVG(view) AS value FROM wide JOIN stations USING (name) GROUP BY ALL)"
_FAKE = "make_timestamp(1990, 1, 1, hour, minute, second)"
_PAIRS = "SELECT a.name, b.name AS buddy, round({h}, 3) AS distance FROM stations a JOIN stations b ON a.name <> b.name WHERE {h} <= {r}"



def _shares(source: str) -> str:
    known = f"SELECT p.name, p.radius, c.class FROM {source} p, (SELECT unnest([{', '.join(map(str, LANDCOVER))}]) AS class) c"
    every = f"(SELECT name, radius, class FROM {source} UNION {known})"
    return f"SELECT e.name, e.radius, e.class, round(COUNT(p.class) / SUM(COUNT(p.class)) OVER (PARTITION BY e.name, e.radius), 6) AS fraction FROM {every} e LEFT JOIN {source} p ON p.name = e.name AND p.radius = e.radius AND p.class = e.class GROUP BY e.name, e.radius, e.class"


#: Valid records near gaps by their number in the series.
RECORDS = """numbered AS (SELECT name, us, value, ROW_NUMBER() OVER (PARTITION BY name ORDER BY us) AS i FROM good),
ends AS (SELECT s.*, (SELECT COUNT(*) FROM good g WHERE g.name = s.name AND g.us < s.lo) AS before FROM spans s),
by_number AS (SELECT e.name, e.gap_id, e.lo, e.hi, CASE WHEN n.i <= e.before THEN 'lead' ELSE 'trail' END AS side, n.us, n.value FROM ends e JOIN numbered n ON n.name = e.name AND n.i BETWEEN e.before - {lead} + 1 AND e.before + {trail})"""
RAW = f"""raw AS (SELECT CAST(user_id AS VARCHAR) AS name, epoch_us(ts) - epoch_us(ts) % {H} AS us, CASE WHEN event_type <> 'error' THEN value END AS value, event_id FROM events)"""
LAGRANGE = " + ".join("y{0} * ({1})".format(i, " * ".join(f"(x - x{j}) / (x{i} - x{j})" for j in range(1, 5) if j != i)) for i in range(1, 5))


def _by_anchors(value: str, method: str, *more: str) -> str:
    """A curve through (or near) two anchors on each side, not farther than three days; ``more`` are CTEs after ``placed``, the last one with the rows."""
    used = f"used AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, gap_id ORDER BY us) AS k FROM by_number WHERE CASE WHEN side = 'lead' THEN lo - us ELSE us - hi END <= {72 * H})"
    four = "four AS (SELECT name, gap_id, " + ", ".join(f"MAX((us - lo) / 1e6::DOUBLE) FILTER (k = {i}) AS x{i}, MAX(value) FILTER (k = {i}) AS y{i}" for i in range(1, 5)) + " FROM used GROUP BY name, gap_id HAVING COUNT(*) = 4)"
    placed = "placed AS (SELECT g.name, g.gap_id, g.us, s.lo, s.hi, (g.us - s.lo) / 1e6::DOUBLE AS x, f.* EXCLUDE (name, gap_id) FROM gaps g JOIN spans s ON s.name = g.name AND s.gap_id = g.gap_id LEFT JOIN four f ON f.name = g.name AND f.gap_id = g.gap_id)"
    source = more[-1].split(" AS ", 1)[0] if more else "placed"
    details = f"CASE WHEN hi - lo <= {24 * H} AND x4 IS NOT NULL THEN 'interpolated by {method}' ELSE 'gap too long or not enough anchors' END"
    return with_(OBS, ALIGNED, GAPS, RECORDS.format(lead=2, trail=2), used, four, placed, *more, then=filled("interpolation", f"CASE WHEN hi - lo <= {24 * H} THEN {value} + 1e-9::DOUBLE END", details) + f" FROM {source}")


# four points: widths and slopes between them, then slopes at the second and third, then Hermite's cubic
_PARTS4 = "parts AS (SELECT *, x2 - x1 AS h1, x3 - x2 AS h2, x4 - x3 AS h3, (y2 - y1) / (x2 - x1) AS d1, (y3 - y2) / (x3 - x2) AS d2, (y4 - y3) / (x4 - x3) AS d3 FROM placed)"
_HERMITE = "(y2 + (x - x2) * s2 + power(x - x2, 2) * (3 * d2 - 2 * s2 - s3) / h2 + power(x - x2, 3) * (s2 + s3 - 2 * d2) / (h2 * h2))"
_HARMONIC = "CASE WHEN {a} * {b} > 0 THEN 3 * ({g} + {h}) / ((2 * {h} + {g}) / {a} + ({h} + 2 * {g}) / {b}) ELSE 0 END"
_PCHIP = f"slopes AS (SELECT *, {_HARMONIC.format(a='d1', b='d2', g='h1', h='h2')} AS s2, {_HARMONIC.format(a='d2', b='d3', g='h2', h='h3')} AS s3 FROM parts)"
# before the first slope lies 2 d1 - d2, behind the last 2 d3 - d2
_AKIMA = "slopes AS (SELECT *, CASE WHEN abs(d3 - d2) + abs(d1 - (2 * d1 - d2)) > 0 THEN (abs(d3 - d2) * d1 + abs(d2 - d1) * d2) / (abs(d3 - d2) + abs(d2 - d1)) ELSE (d1 + d2) / 2 END AS s2, CASE WHEN abs(d3 - d2) + abs(d2 - d1) > 0 THEN (abs(d3 - d2) * d2 + abs(d2 - d1) * d3) / (abs(d3 - d2) + abs(d2 - d1)) ELSE (d2 + d3) / 2 END AS s3 FROM parts)"
_LINE = "line AS (SELECT *, (x1 + x2 + x3 + x4) / 4 AS mx, (y1 + y2 + y3 + y4) / 4 AS my FROM placed)"
_LEAST_SQUARES = "(my + (x - mx) * (" + " + ".join(f"(x{i} - mx) * (y{i} - my)" for i in range(1, 5)) + ") / (" + " + ".join(f"power(x{i} - mx, 2)" for i in range(1, 5)) + "))"


def _ingested(out: str, source: str, freq: str | None, tolerance: int, origin: str | None = None) -> str:
    """CTEs of the whole import of (name, us, value, event_id)."""
    step = simplified("f", 120_000_000, True) if freq is None else freq
    start = f"epoch_us(TIMESTAMP '{origin}')" if origin else simplified("lo", 300_000_000)
    return f"""{out}_k AS (SELECT name, us, CASE WHEN COUNT(*) = 1 THEN arg_min(value, event_id) END AS value, CASE WHEN COUNT(*) > 1 THEN FIRST(value ORDER BY event_id) END AS outlier_value, CASE WHEN COUNT(*) > 1 THEN 'duplicated timestamp outlier' ELSE 'ok' END AS label FROM {source} GROUP BY name, us HAVING COUNT(*) > 1 OR COUNT(value) = 1),
{out}_s AS (SELECT name, us - LAG(us) OVER (PARTITION BY name ORDER BY us) AS st FROM {out}_k),
{out}_m AS (SELECT name, trunc(median(st))::BIGINT AS f FROM {out}_s WHERE st > 0 GROUP BY name),
{out}_f AS (SELECT name, ({step})::BIGINT AS freq FROM {'(SELECT DISTINCT name, 0 AS f FROM ' + out + '_k)' if freq else out + '_m'}),
{out}_o AS (SELECT name, freq, hi, ({start})::BIGINT AS origin FROM (SELECT name, MIN(us) AS lo, MAX(us) AS hi FROM {out}_k GROUP BY name) JOIN {out}_f USING (name)),
{out}_g AS (SELECT name, freq, unnest(generate_series(origin, origin + trunc((hi - origin) / freq)::BIGINT * freq, freq)) AS us FROM {out}_o),
{nearest(out + "_g", out + "_k", out + "_n", tolerance)},
{out} AS (SELECT n.name, n.us, n.raw_us, n.value, k.outlier_value, COALESCE(k.label, 'gap') AS label, f.freq FROM {out}_n n JOIN {out}_f f ON f.name = n.name LEFT JOIN {out}_k k ON k.name = n.name AND k.us = n.raw_us)"""


_INGESTED = f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_timestamp, value, outlier_value, label, freq AS freq_us FROM "
_HALVES = "left_raw AS (SELECT * FROM raw WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-01') AND epoch_us(TIMESTAMP '2024-01-15')), right_raw AS (SELECT name, us, value * 2 AS value, event_id FROM raw WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-02-10'))"
_MERGED = "merged AS (SELECT name, us, arg_min(value, side) AS value, 0 AS event_id FROM (SELECT name, COALESCE(raw_us, us) AS us, COALESCE(value, outlier_value) AS value, 0 AS side FROM part_a UNION ALL SELECT name, COALESCE(raw_us, us), COALESCE(value, outlier_value), 1 FROM part_b) WHERE value IS NOT NULL GROUP BY name, us)"


def _station_stats(by: str) -> str:
    """SQL of good rows, gaps and checks, of each group."""
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = [f"SELECT {key}'{label}' AS qc_check, COUNT(*) AS n_all, NULL::BIGINT AS n_checked, COUNT(*) FILTER ({test}) AS n_labeled FROM c5{group}" for label, test in (("ok", "label = 'ok'"), ("gap", "label IS NULL"))]
    rejected = "COUNT(*) FILTER (label IS NULL)"
    for c in ORDER:
        n = f"COUNT(*) FILTER (label = '{CHECKS[c]}')"
        parts.append(f"SELECT {key}'{CHECKS[c]}', COUNT(*), COUNT(*) - ({rejected}), {n} FROM c5{group}")
        rejected += f" + {n}"
    return "\nUNION ALL ".join(parts)


def _iteration(i: int, net: str, saved: str = "", white: str = "FALSE") -> str:
    """CTEs of one iteration of the buddy check over ``net``: found{i}, and left{i}, what it leaves."""
    judged = f" JOIN (SELECT name, us, message FROM verdict{i} WHERE message IS NOT NULL) USING (name, us)" if saved else ""
    message = "'; ' || message" if saved else "''"
    return f"""stat{i} AS (SELECT group_id, us, AVG(value) AS mean, CASE WHEN stddev_samp(value) < 1 THEN 1.0 ELSE stddev_samp(value) END AS sd, COUNT(value) AS n FROM {net} JOIN members USING (name) GROUP BY group_id, us HAVING COUNT(value) >= 4),
worst{i} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id, us ORDER BY chi DESC, name) AS r FROM (SELECT group_id, us, name, value, mean, sd, n, abs(value - mean) / sd AS chi FROM {net} JOIN members USING (name) JOIN stat{i} USING (group_id, us)) WHERE chi > 1.8) WHERE r = 1),
{saved.format(i=i, net=net)}found{i} AS (SELECT name, us, format('outlier in buddy group of {{}}: chi={{}}, mean={{}}, std={{}}, n={{}}{{}} (iteration {i}/2)', group_id, {', '.join(f'CAST(round(CAST(round({c}, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR)' for c in ('chi', 'mean', 'sd'))}, n, {message}) AS details FROM worst{i}{judged} WHERE NOT {white}),
left{i} AS (SELECT * FROM {net} WHERE (name, us) NOT IN (SELECT (name, us) FROM found{i}))"""


_SAME = f"same AS (SELECT a.name, b.name AS buddy FROM stations a JOIN stations b ON a.name <> b.name AND a.category = b.category WHERE {HAVERSINE} <= 20000)"
_SAVED = """verdict{i} AS (SELECT *, CASE WHEN k < 3 THEN format('category net: too few buddies ({{}} of 3)', k) WHEN m < 3 THEN format('category net: too few values ({{}} of 3)', m) WHEN z IS NULL THEN 'category net: not saved (no spread)'
  WHEN z > 1.5 THEN format('category net: not saved (z={{}})', CAST(round(CAST(round(z, 6) AS DECIMAL(18, 6)), 2) AS VARCHAR)) END AS message
  FROM (SELECT w.name, w.us, COUNT(s.buddy) AS k, COUNT(n.value) AS m, abs(ANY_VALUE(w.value) - AVG(n.value)) / CASE WHEN stddev_samp(n.value) < 1 THEN 1.0 ELSE stddev_samp(n.value) END AS z
    FROM (SELECT DISTINCT name, us, value FROM worst{i}) w LEFT JOIN same s ON s.name = w.name LEFT JOIN {net} n ON n.name = s.buddy AND n.us = w.us GROUP BY w.name, w.us)),
"""
_VERDICTS = [_SAME, _SAVED.format(i="", net="net").rstrip().rstrip(",")]


def _checked(label: str) -> str:
    return f"SELECT f.name, 'value' AS obstype, {ts('f.us')} AS datetime, net.value, '{label}' AS label, f.details FROM (SELECT name, us, string_agg(details, ' | ' ORDER BY details) AS details FROM (SELECT * FROM found1 UNION SELECT * FROM found2) GROUP BY name, us) f JOIN net ON net.name = f.name AND net.us = f.us"


#: A raster made of order lines, and its cells that hold stations.
_CELLS = (
    "cells AS (SELECT make_timestamp((1704067200 + (l_orderkey % 240) * 3600) * 1000000) AS datetime, l_partkey % 11 AS i, l_suppkey % 3 AS j, CASE WHEN l_linenumber % 2 = 0 THEN 't2m' ELSE 'sp' END AS band, l_quantity + 250 AS v FROM lineitem)",
    "found AS (SELECT * FROM cells c JOIN stations s ON round((s.lat - 50) * 10) = c.i AND round((s.lon - 4) * 10) = c.j WHERE datetime >= TIMESTAMP '2024-01-02' AND datetime < TIMESTAMP '2024-01-04 01:00:00')",
)


ORACLES = {
    "gross_value": flags("gross_value", "value < 1 OR value > 39"),
    "duplicated_timestamp": with_(then=f"SELECT CAST(user_id AS VARCHAR) AS name, 'value' AS obstype, {ts(f'epoch_us(ts) - epoch_us(ts) % {6 * H}')} AS datetime, arg_min(value, event_id) AS value, '{CHECKS['duplicated_timestamp']}' AS label FROM events GROUP BY ALL HAVING COUNT(*) > 1").removeprefix("WITH \n"),
    "persistence": flags("persistence", "n >= 5 AND lo = hi", "w", (OBS, COARSE, f"w AS ({centred('coarse', 48 * H)})")),
    "repetitions": flags("repetitions", "flag", "w", (OBS, COARSE, f"w AS ({runs('coarse', 'value', 3)})")),
    "step": flags("step", "flag", "w", (OBS, f"w AS ({too_fast('obs', 'value', 8 / 3600, -10 / 3600)})")),
    "window_variation": flags("window_variation", "flag", "w", (OBS, f"w AS ({variation('obs', 24 * H, 'value', 0.0006, 0.0007, 3)})")),
    "qc_pipeline": with_(*CHAIN, then="SELECT name, obstype, datetime, raw_value, v AS value, label FROM c5"),
    "qc_stats": with_(*CHAIN, then=_stats()),
    "qc_effectiveness": with_(*CHAIN, then=f"SELECT qc_check, n_all - n_checked AS unchecked, n_checked - n_labeled AS ok, n_labeled AS outlier FROM ({_stats()})"),
    "label_counts": with_(*CHAIN, then="SELECT label, COUNT(*) AS n FROM c5 GROUP BY label"),
    "whitelist_antijoin": flags("gross_value", "(value < 1 OR value > 39) AND name NOT IN (SELECT name FROM stations WHERE category = 0)", "obs", (OBS, STATIONS)),
    "outliers_to_gaps": with_(*CHAIN, then="SELECT name, obstype, datetime, CASE WHEN label = 'ok' THEN raw_value END AS value, CASE WHEN label = 'ok' THEN 'ok' ELSE 'gap' END AS label FROM c5"),
    "long_view": with_(*CHAIN, ALIGNED, then=f"""SELECT name, 'value' AS obstype, datetime, value, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, datetime ORDER BY r DESC) AS k FROM (
  SELECT name, datetime, raw_value AS value, label, CASE WHEN label = 'ok' THEN 0 ELSE 1 END AS r FROM c5 UNION ALL SELECT name, {ts('us')}, NULL, 'gap', 2 FROM aligned WHERE status = 'gap')) WHERE k = 1"""),
    "likely_frequency": with_(OBS, "steps AS (SELECT name, us - LAG(us) OVER (PARTITION BY name ORDER BY us) AS st FROM obs)", "med AS (SELECT name, trunc(median(st))::BIGINT AS f FROM steps WHERE st > 0 GROUP BY name)", then=f"SELECT name, 'value' AS obstype, {simplified('f', 120_000_000, True)} AS freq_us FROM med"),
    "simplify_time": with_("e AS (SELECT event_id, epoch_us(ts) AS us FROM events)", then=f"SELECT event_id, {simplified('us', 300_000_000)} AS simple_us FROM e"),
    "regularise_asof": with_(OBS, ALIGNED, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_datetime, value, status FROM aligned"),
    "resample": with_(OBS, ALIGNED, grid("aligned", "grid2", str(12 * H), 240_000_000), nearest("grid2", "aligned", "near2", H), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_datetime, value, CASE WHEN raw_us IS NULL THEN 'gap' WHEN value IS NULL THEN 'outlier' ELSE 'ok' END AS status FROM near2"),
    "resample_labelled": with_(OBS, ALIGNED, grid("aligned", "grid2", str(12 * H), 240_000_000), nearest("grid2", "aligned", "near2", 6 * H), then=f"SELECT n.name, 'value' AS obstype, {ts('n.us')} AS datetime, {ts('n.raw_us')} AS raw_datetime, n.value, COALESCE(a.status, 'gap') AS status FROM near2 n LEFT JOIN aligned a ON a.name = n.name AND a.us = n.raw_us"),
    "synchronise": with_(OBS, "steps AS (SELECT name, us - LAG(us) OVER (PARTITION BY name ORDER BY us) AS st FROM obs)", "med AS (SELECT name, trunc(median(st))::BIGINT AS f FROM steps WHERE st > 0 GROUP BY name)", f"fr AS (SELECT name, {simplified('f', 60_000_000, True)} AS freq_us FROM med)", "of AS (SELECT obs.*, freq_us FROM obs JOIN fr USING (name))", grid("of", "grid2", "MIN(freq_us)", 300_000_000), nearest("grid2", "obs", "near2", H // 2), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_datetime, value, freq_us FROM near2 JOIN fr USING (name)"),
    "gap_islands": with_(OBS, ALIGNED, GAPS, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, gap_id, {ts('MIN(us) OVER (PARTITION BY name, gap_id)')} AS gapstart FROM gaps"),
    "gap_overview": with_(OBS, ALIGNED, GAPS, then=f"SELECT name, 'value' AS obstype, {ts('lo')} AS gapstart, {ts('hi')} AS gapend, (hi - lo) // 1000000 AS gapsize_s, n AS n_records, 'gap' AS label, 'unidetail gap: no details' AS details FROM spans"),
    "interpolate_time": _interpolated("(us - t0)::DOUBLE / (t1 - t0)", "time"),
    "interpolate_linear": _interpolated("place::DOUBLE / (n + 1)", "linear", f" AND lo - t0 <= {6 * H}"),
    "fill_raw_model": with_(OBS, ALIGNED, GAPS, MODEL, at_model("gaps", "gap_m"), then=filled("raw", f"CASE WHEN hi - lo <= {12 * H} THEN CASE WHEN mv < 5 THEN 5 WHEN mv > 30 THEN 30 ELSE mv END END", f"CASE WHEN hi - lo > {12 * H} THEN 'gap too long' WHEN mv IS NULL THEN 'no model value' ELSE 'model value' END") + " FROM gap_m JOIN spans USING (name, gap_id)"),
    "fill_raw_units": with_(OBS, ALIGNED, GAPS, MODEL, at_model("gaps", "gap_m"), "converted AS (SELECT gap_m.* EXCLUDE (mv), CASE WHEN gap_m.name::INT % 2 = 0 THEN (mv - 32) / 1.8::DOUBLE ELSE mv - 273.15::DOUBLE END AS mv FROM gap_m)", then=filled("raw", f"CASE WHEN hi - lo <= {12 * H} THEN mv END", f"CASE WHEN hi - lo > {12 * H} THEN 'gap too long' WHEN mv IS NULL THEN 'no model value' ELSE 'model value' END") + " FROM converted JOIN spans USING (name, gap_id)"),
    "fill_debiased": _debiased("debiased", 48 * H, "bias AS (SELECT name, gap_id, AVG(bias) AS bias FROM dev WHERE (name, gap_id) IN (SELECT (name, gap_id) FROM near_gap GROUP BY name, gap_id HAVING COUNT(*) FILTER (side = 'lead') >= 2 AND COUNT(*) FILTER (side = 'trail') >= 2) AND (name, gap_id) IN (SELECT (name, gap_id) FROM covered) GROUP BY name, gap_id)", "name gap_id", "mv - bias"),
    "fill_diurnal": _debiased("diurnal_debiased", 120 * H, "bias AS (SELECT name, gap_id, clock, AVG(bias) AS bias FROM dev WHERE (name, gap_id) IN (SELECT (name, gap_id) FROM near_gap GROUP BY name, gap_id HAVING COUNT(*) FILTER (side = 'lead') >= 3 AND COUNT(*) FILTER (side = 'trail') >= 3) AND (name, gap_id) IN (SELECT (name, gap_id) FROM covered) GROUP BY name, gap_id, clock HAVING COUNT(*) >= 3)", "name gap_id clock", "mv - bias"),
    "fill_weighted_diurnal": _debiased("weighted_diurnal_debiased", 120 * H, "bias AS (SELECT name, gap_id, clock, AVG(bias) FILTER (side = 'lead') AS bl, AVG(bias) FILTER (side = 'trail') AS bt FROM dev WHERE (name, gap_id) IN (SELECT (name, gap_id) FROM covered) GROUP BY name, gap_id, clock HAVING COUNT(*) FILTER (side = 'lead') >= 1 AND COUNT(*) FILTER (side = 'trail') >= 1)", "name gap_id clock", "mv - ((1 - (us - lo)::DOUBLE / nullif(hi - lo, 0)) * bl + ((us - lo)::DOUBLE / nullif(hi - lo, 0)) * bt)"),
    "fill_status": with_(OBS, ALIGNED, GAPS, MODEL, at_model("gaps", "gap_m"), f"st AS (SELECT name, gap_id, COUNT(CASE WHEN hi - lo <= {12 * H} THEN mv END) AS k, COUNT(*) AS c FROM gap_m JOIN spans USING (name, gap_id) GROUP BY ALL)", then="SELECT name, 'value' AS obstype, gap_id, CASE WHEN k = c THEN 'successful gapfill' WHEN k > 0 THEN 'partially successful gapfill' ELSE 'failed gapfill' END AS status, k < c AS can_be_filled FROM st"),
    "leading_trailing_period": with_(OBS, ALIGNED, GAPS, PERIOD.format(lead=24 * H, trail=24 * H), then=f"SELECT name, 'value' AS obstype, gap_id, side, {ts('us')} AS datetime, value FROM near_gap"),
    "model_at_stamps": with_(OBS, ALIGNED, GAPS, MODEL, at_model("good", "good_m"), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, round(value, 6) AS value, round(mv, 6) AS model_value FROM good_m"),
    "haversine_pairs": with_(STATIONS, then=_PAIRS.format(h=HAVERSINE, r=5000)),
    "category_pairs": with_(STATIONS, then=_PAIRS.format(h=HAVERSINE, r=30000) + " AND a.category = b.category AND abs(a.altitude - b.altitude) <= 150"),
    "buddy_groups": with_(STATIONS, GROUPS, then="SELECT group_id, name FROM members", recursive=True),
    "buddy_check_iter1": with_(OBS, STATIONS, GROUPS, NETWORK, WORST, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, value, group_id, round(chi, 6) AS chi FROM worst", recursive=True),
    "safety_net": with_(OBS, STATIONS, GROUPS, NETWORK, WORST, *_VERDICTS, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime FROM verdict WHERE message IS NULL", recursive=True),
    "safety_net_messages": with_(OBS, STATIONS, GROUPS, NETWORK, WORST, *_VERDICTS, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, message IS NULL AS saved, message FROM verdict", recursive=True),
    "lapse_correction": with_(OBS, STATIONS, NETWORK, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, round(value - (altitude - (SELECT MIN(altitude) FROM stations)) * 0.0065::DOUBLE, 6) AS value FROM net JOIN stations USING (name)"),
    "pivot_wide": with_(WIDE, then="SELECT name, datetime, round(click, 6) AS click, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup, round(view, 6) AS view FROM wide"),
    "time_derivatives": f"SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, dayofyear(ts)::INT AS day_of_year, {SEASON.format(d='dayofyear(ts)')} AS season FROM events",
    "order_seasons": f"SELECT {SEASON.format(d='dayofyear(o_orderdate)')} AS season, COUNT(*) AS n, round(AVG(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1",
    "filter_records": with_(WIDE, then="SELECT name, datetime, round(click, 6) AS click FROM wide WHERE click >= 3 AND hour(datetime) <> 0"),
    "filter_expression": "SELECT event_id, event_type, value FROM events WHERE value > 5 AND value <= 25 AND event_type IN ('click', 'error') AND NOT floor(user_id / 2) = 3 AND user_id % 7 <> 2 OR value * value > 10000 AND event_type <> 'view' AND event_id >= 101",
    "unit_compound": "SELECT p_partkey, round(v * 24 / 25.4::DOUBLE, 6) AS rain, round(v / 10, 6) AS energy, round(v * 33.86388640341::DOUBLE, 6) AS mercury, round(v / 1000, 6) AS density, round(v * 3.6::DOUBLE, 6) AS work, round(v * 100, 6) AS area, round(v * 86.4::DOUBLE, 6) AS flux FROM (SELECT p_partkey, p_retailprice AS v FROM part)",
    "filter_metadata": with_(OBS, STATIONS, then="SELECT name, obstype, datetime, value FROM obs WHERE name IN (SELECT name FROM stations WHERE altitude > 100 AND category = 2 OR lat < 50.1::DOUBLE)"),
    "subset_period": with_(OBS, then="SELECT name, obstype, datetime, value FROM obs WHERE datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'"),
    "subset_stations": with_(OBS, then="SELECT name, obstype, datetime, value FROM obs WHERE name IN ('1', '2', '17')"),
    "stations_without_kind": "SELECT CAST(user_id AS VARCHAR) AS name FROM events GROUP BY user_id HAVING COUNT(*) FILTER (event_type = 'signup') = 0",
    "aggregate_hour": with_(WIDE, then=f"SELECT {SEASON.format(d='dayofyear(datetime)')} AS season, hour(datetime)::INT AS hour, round(AVG(click), 6) AS click FROM wide GROUP BY 1, 2"),
    "aggregate_category": with_(WIDE, STATIONS, then="SELECT category, hour(datetime)::INT AS hour, round(median(view), 6) AS view FROM wide JOIN stations USING (name) GROUP BY 1, 2"),
    "aggregate_callable": with_(WIDE, STATIONS, then="SELECT category, hour(datetime)::INT AS hour, round(CASE WHEN COUNT(view) > 2 THEN (SUM(view) - MIN(view) - MAX(view)) / (COUNT(view) - 2) END, 6) AS view FROM wide JOIN stations USING (name) GROUP BY 1, 2"),
    "aggregate_percentile": with_(WIDE, STATIONS, then=f"SELECT category, {SEASON.format(d='dayofyear(datetime)')} AS season, round(quantile_cont(view, 0.9), 6) AS view FROM wide JOIN stations USING (name) GROUP BY 1, 2"),
    "import_files_in_order": """WITH r AS (SELECT 's' || (user_id % 20) AS name, make_timestamp((1704067200 + (event_id % 500) * 600) * 1000000) AS datetime, round(value, 3) AS value, event_id FROM events WHERE event_id < 3000)
SELECT name, 'temp' AS obstype, datetime, round(arg_min(value, event_id), 6) AS value, 'duplicated timestamp outlier' AS label FROM r WHERE name IN (SELECT name FROM r GROUP BY name HAVING COUNT(*) >= 3) GROUP BY name, datetime HAVING COUNT(*) > 1""",
    "rejected_rows": """SELECT CASE WHEN o_orderkey % 30 = 0 THEN 'no stamp' ELSE 'no name' END AS reason, '{' || CASE WHEN o_orderkey % 70 <> 0 THEN '"station":"s' || o_custkey || '",' ELSE '' END || '"when":"' || CASE WHEN o_orderkey % 30 = 0 THEN '31/02' ELSE '2024-01-01 00:00:00' END || '","t":"' || o_orderkey || '"}' AS text
FROM orders WHERE o_orderkey % 10 = 0 AND (o_orderkey % 30 = 0 OR o_orderkey % 70 = 0)""",
    "model_grid": with_(
        STATIONS, *_CELLS,
        then="\nUNION ALL ".join(f"SELECT name, '{kind}' AS obstype, 'm' AS modelname, band AS modelvariable, datetime, round({value}, 6) AS value FROM found WHERE band = '{band}'" for kind, band, value in (("temp", "t2m", "v - 273.15::DOUBLE"), ("pressure", "sp", "v * 10"), ("pressure_at_sea_level", "sp", "v * 33.86388640341::DOUBLE"))),
    ),
    "model_source": with_(
        STATIONS, *_CELLS,
        "wind AS (SELECT name, datetime, u, w FROM (SELECT name, datetime, MAX(v) FILTER (band = 't2m') AS u, MAX(v) FILTER (band = 'sp') AS w FROM found GROUP BY ALL) WHERE u IS NOT NULL AND w IS NOT NULL)",
        then="SELECT name, 'temp' AS obstype, 'm' AS modelname, band AS modelvariable, datetime, round(v - 273.15::DOUBLE, 6) AS value FROM found WHERE band = 't2m' UNION ALL SELECT name, 'snow', 'm', band, datetime, round(v * 1000, 6) FROM found WHERE band = 'sp'"
        " UNION ALL SELECT name, 'wind_speed', 'm', 't2m+sp', datetime, round(sqrt(u * u + w * w) / 3.6::DOUBLE, 6) FROM wind UNION ALL SELECT name, 'wind_direction', 'm', 't2m+sp', datetime, round(degrees(atan2(u, w)), 6) FROM wind",
    ),
    "diurnal_cycle": with_(WIDE, STATIONS, _CYCLE, then=f"SELECT category, hour, minute, second, round(value, 6) AS value, {_FAKE} AS fake_datetime FROM cycle"),
    "diurnal_cycle_wide": with_(WIDE, STATIONS, _CYCLE, then=f"SELECT {_FAKE} AS fake_datetime, {', '.join(f'round(MAX(value) FILTER (category = {i}), 6) AS c{i}' for i in range(5))} FROM cycle GROUP BY ALL"),
    "diurnal_vs_reference": with_(WIDE, STATIONS, then="SELECT category, hour(w.datetime)::INT AS hour, minute(w.datetime)::INT AS minute, second(w.datetime)::INT AS second, round(AVG(w.view - r.view), 6) AS value FROM wide w LEFT JOIN wide r ON r.name = '1' AND r.datetime = w.datetime JOIN stations ON stations.name = w.name GROUP BY ALL"),
    "period_bounds": with_(OBS, then="SELECT name, MIN(datetime) AS start, MAX(datetime) AS \"end\" FROM obs GROUP BY name"),
    "kinds_present": "SELECT DISTINCT event_type AS obstype FROM events",
    "station_extent": with_(STATIONS, then="SELECT round(MIN(lat) - (MAX(lat) - MIN(lat)) * 0.05::DOUBLE, 6) AS lat_min, round(MAX(lat) + (MAX(lat) - MIN(lat)) * 0.05::DOUBLE, 6) AS lat_max, round(MIN(lon) - (MAX(lon) - MIN(lon)) * 0.05::DOUBLE, 6) AS lon_min, round(MAX(lon) + (MAX(lon) - MIN(lon)) * 0.05::DOUBLE, 6) AS lon_max FROM stations"),
    "hide_labels": with_(*CHAIN, then=f"SELECT name, obstype, datetime, CASE WHEN label NOT IN ('{CHECKS['step']}', '{CHECKS['gross_value']}') THEN raw_value END AS value, label FROM c5"),
    "filter_modeldata": "WITH m AS (SELECT CAST(user_id AS VARCHAR) AS name, event_type AS obstype, 'm' || (user_id % 3) AS modelname, 'b' || (event_id % 2) AS modelvariable, ts AS datetime, value FROM events WHERE event_type = 'click' AND event_id % 2 = 1) SELECT * FROM m WHERE modelname = (SELECT MIN(modelname) FROM m)",
    "wide_to_long": "SELECT l_orderkey, l_linenumber, name, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (amount FOR name IN (l_quantity, l_discount, l_tax))",
    "unit_convert": "SELECT p_partkey, round(v - 273.15::DOUBLE, 6) AS kelvin, round((v - 32) * 5::DOUBLE / 9, 6) AS fahrenheit, round(v / 100, 6) AS hpa, round(v / 3.6::DOUBLE, 6) AS ms, round(v * 3600 / 1852::DOUBLE, 6) AS knots FROM (SELECT p_partkey, p_retailprice AS v FROM part)",
    "vector_wind": "SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v), 6) AS speed, CASE WHEN u <> 0 OR v <> 0 THEN round(CASE WHEN atan2(u, v) < 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END, 6) END AS direction FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS u, floor(l_extendedprice / 1000) - 25 AS v FROM lineitem)",
    "numeric_cast_comma": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal::DECIMAL(12, 2)::DOUBLE END AS value FROM customer",
    "combine_first": "SELECT COALESCE(a.c_custkey, b.c_custkey) AS c_custkey, COALESCE(a.v, b.v) AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey, -c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0) b ON a.c_custkey = b.c_custkey",
    "dataset_merge": with_(STATIONS, then="SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN altitude > 50 AND altitude < 200 THEN altitude WHEN altitude > 20 THEN altitude + 1 END AS altitude FROM stations WHERE altitude < 200 OR altitude > 20"),
    "dedupe_metadata": "SELECT o_custkey, MIN(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "rename_stations": with_(STATIONS, then="SELECT CASE WHEN name = '1' THEN 'first' ELSE name END AS name, category FROM stations"),
    "upsert_series": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "landcover_fractions": with_(PIXELS, then=_shares("pixels")),
    "landcover_absent": with_(PIXELS, "changed AS (SELECT name, radius, CASE WHEN class = 20 THEN 7 WHEN class > 80 THEN 10 ELSE class END AS class FROM pixels)", then=_shares("changed")),
    "landcover_partial": with_(PIXELS, then="SELECT name, radius, 'water' AS class, round(COUNT(*) FILTER (class = 80) / COUNT(*), 6) AS fraction FROM pixels GROUP BY name, radius UNION ALL SELECT name, radius, 'built', round(COUNT(*) FILTER (class = 50) / COUNT(*), 6) FROM pixels GROUP BY name, radius"),
    "landcover_buffers": with_(
        STATIONS,
        f"raster AS (SELECT 50 + ((l_partkey * 37 + l_linenumber) % 1000) * 0.001::DOUBLE AS lat, 4 + ((l_orderkey * 11 + l_suppkey) % 600) * 0.0001::DOUBLE AS lon, ([{', '.join(map(str, LANDCOVER))}, 7])[(l_partkey % 12 + 1)::INT] AS class FROM lineitem)",
        f"distances AS (SELECT a.name, b.class, {HAVERSINE} AS d FROM stations a JOIN raster b ON b.lat BETWEEN a.lat - 0.05 AND a.lat + 0.05)",
        "pixels AS (SELECT name, radius, class FROM distances, (SELECT unnest([400, 1000, 2500])::DOUBLE AS radius) WHERE d <= radius)",
        then=_shares("pixels"),
    ),
    "landcover_groups": with_(PIXELS, then="\nUNION ALL ".join(f"SELECT name, radius, '{g}' AS class, round(COUNT(*) FILTER (class IN ({', '.join(map(str, c))})) / COUNT(*), 6) AS fraction FROM pixels GROUP BY name, radius" for g, c in LANDCOVER_GROUPS.items())),
    "lcz_points": with_(STATIONS, then=f"SELECT name, CASE WHEN category <> 3 THEN ([{', '.join(repr(x) for x in LCZ)}])[(altitude::INT % 17) + 1] ELSE '{LCZ[16]}' END AS lcz FROM stations"),
    "stacked_labels": with_(*CHAIN, then="SELECT name, obstype, datetime, 'obs' AS kind, raw_value AS value FROM c5 UNION ALL SELECT name, obstype, datetime, 'label', (MAP {" + ", ".join(f"'{k}': {v}" for k, v in NUMBERS.items()) + "})[label]::DOUBLE FROM c5"),
    "stations_without_high_kind": "SELECT CAST(user_id AS VARCHAR) AS name FROM events WHERE value > 150 GROUP BY user_id HAVING COUNT(*) FILTER (event_type = 'signup') = 0",
    "interpolate_anchored": with_(OBS, ALIGNED, GAPS, ANCHORED, RECORDS.format(lead=2, trail=3), f"enough AS (SELECT name, gap_id FROM by_number WHERE CASE WHEN side = 'lead' THEN lo - us <= {24 * H} ELSE us - hi <= {48 * H} END GROUP BY name, gap_id HAVING COUNT(*) FILTER (side = 'lead') >= 2 AND COUNT(*) FILTER (side = 'trail') >= 3)", "found AS (SELECT b.*, e.name IS NOT NULL AS fits FROM both_sides b LEFT JOIN enough e ON e.name = b.name AND e.gap_id = b.gap_id)", then=filled("interpolation", f"CASE WHEN hi - lo <= {24 * H} AND fits THEN v0 + (v1 - v0) * ((us - t0)::DOUBLE / (t1 - t0)) END", f"CASE WHEN hi - lo > {24 * H} THEN 'gap too long' WHEN NOT fits THEN 'not enough anchors' ELSE 'interpolated by time' END") + " FROM found"),
    "interpolate_nearest": _interpolated("CASE WHEN t1 - us < us - t0 THEN 1 ELSE 0 END", "nearest"),
    "interpolate_spline": _by_anchors(LAGRANGE, "cubicspline"),
    "interpolate_pchip": _by_anchors(_HERMITE, "pchip", _PARTS4, _PCHIP),
    "interpolate_akima": _by_anchors(_HERMITE, "akima", _PARTS4, _AKIMA),
    "interpolate_krogh": _by_anchors(LAGRANGE, "krogh"),
    "interpolate_smoothing": _by_anchors(_LEAST_SQUARES, "spline of order 1", _LINE),
    "leading_period_records": with_(OBS, ALIGNED, GAPS, RECORDS.format(lead=3, trail=2), then=f"SELECT name, 'value' AS obstype, gap_id, side, {ts('us')} AS datetime, value FROM by_number WHERE side = 'trail' OR lo - us <= {36 * H}"),
    "qc_stats_station": with_(*CHAIN, then=_station_stats("name")),
    "qc_stats_total": with_(*CHAIN, then=_station_stats("")),
    "window_guard": with_(OBS, ALIGNED, "fine AS (SELECT name, us, floor(value / 20) AS value FROM aligned)", f"w AS ({centred('fine', 24 * H)})", then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, value, 'persistence outlier' AS label FROM w WHERE value IS NOT NULL AND n >= 3 AND lo = hi"),
    "align_forced": with_(OBS, f"grid AS (SELECT name, us FROM (SELECT DISTINCT name FROM obs), (SELECT unnest(generate_series(epoch_us(TIMESTAMP '2024-01-03'), epoch_us(TIMESTAMP '2024-01-13 12:00:00'), {12 * H})) AS us))", nearest("grid", "obs", "near", 6 * H), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_datetime, value, CASE WHEN raw_us IS NULL THEN 'gap' WHEN value IS NULL THEN 'outlier' ELSE 'ok' END AS status FROM near"),
    "synchronise_fixed": with_(OBS, ALIGNED, f"grid2 AS (SELECT name, unnest(generate_series(o, o + trunc((hi - o) / {6 * H})::BIGINT * {6 * H}, {6 * H})) AS us FROM (SELECT name, MAX(us) AS hi, epoch_us(TIMESTAMP '2024-01-02') AS o FROM aligned GROUP BY name HAVING COUNT(*) > 1))", nearest("grid2", "aligned", "near2", H), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, {ts('raw_us')} AS raw_datetime, value, {6 * H}::BIGINT AS freq_us FROM near2"),
    "synchronise_stations": with_(OBS, f"own AS (SELECT name, {simplified('lo', 2 * H)} AS origin, hi FROM (SELECT name, MIN(us) AS lo, MAX(us) AS hi FROM obs GROUP BY name))", f"common AS (SELECT MIN(origin) AS o, MAX(origin + trunc((hi - origin) / {12 * H})::BIGINT * {12 * H}) AS c FROM own)", f"stamps AS (SELECT name, us FROM (SELECT DISTINCT name FROM obs), (SELECT unnest(generate_series(o, c, {12 * H})) AS us FROM common))", nearest("stamps", "obs", "near", 2 * H, True), then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime, value FROM near WHERE value IS NOT NULL"),
    "ingest_labels": with_(RAW, _ingested("done", "raw", None, 2 * H), then=_INGESTED + "done"),
    "ingest_forced": with_(RAW, _ingested("done", "raw", str(6 * H), 3 * H, "2024-01-02"), then=_INGESTED + "done"),
    "series_merge": with_(RAW, _HALVES, _ingested("part_a", "left_raw", str(6 * H), 3 * H), _ingested("part_b", "right_raw", str(6 * H), 3 * H), _MERGED, _ingested("done", "merged", str(12 * H), 6 * H), then=_INGESTED + "done"),
    "import_long_csv": "WITH r AS (SELECT 's' || user_id AS name, date_trunc('second', ts) AS datetime, CASE WHEN event_type <> 'error' THEN (round(value, 3) - 32) * 5::DOUBLE / 9 END AS value FROM events), k AS (SELECT name FROM r GROUP BY name HAVING COUNT(*) >= 3 AND COUNT(value) > 0) SELECT name, 'temp' AS obstype, datetime, round(CASE WHEN COUNT(*) = 1 THEN MAX(value) END, 6) AS value FROM r WHERE name IN (SELECT name FROM k) GROUP BY name, datetime HAVING COUNT(*) > 1 OR COUNT(value) = 1",
    "import_wide_csv": "SELECT name, 'pressure' AS obstype, make_timestamp(o_orderkey * 60000000) AS datetime, round(v, 6) AS value FROM (SELECT 'st a' AS name, o_orderkey, o_totalprice AS v FROM orders UNION ALL SELECT 'st-b', o_orderkey, o_custkey FROM orders)",
    "import_json": "SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
    "import_metadata": "SELECT s_name AS name, (s_suppkey % 90)::DOUBLE AS lat, (s_suppkey % 180) + 0.5::DOUBLE AS lon, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
    "saved_dataset": with_(OBS, STATIONS, then="SELECT obs.name, datetime, value, category FROM obs JOIN stations USING (name)"),
    "model_export": "WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS name, make_timestamp(o_orderkey * 60000000) AS datetime, o_totalprice / 1000 + 200 AS t, o_orderkey % 7 - 3 AS u, o_orderkey % 5 - 2 AS v FROM orders) SELECT name, obstype, 'm' AS modelname, modelvariable, datetime, round(value, 6) AS value FROM (SELECT name, 'temp' AS obstype, 't2m' AS modelvariable, datetime, t - 273.15::DOUBLE AS value FROM e UNION ALL SELECT name, 'wind_speed', 'u+v', datetime, sqrt(u * u + v * v) FROM e UNION ALL SELECT name, 'wind_direction', 'u+v', datetime, CASE WHEN u <> 0 OR v <> 0 THEN CASE WHEN atan2(u, v) < 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END END FROM e)",
    "invalid_rows": with_(RAW, then=f"SELECT name, 'value' AS obstype, {ts('us')} AS datetime FROM raw GROUP BY name, us HAVING COUNT(*) = 1 AND COUNT(value) = 0"),
    "single_station": with_(OBS, then="SELECT name, obstype, datetime, value FROM obs WHERE name = '7'"),
    "union_of_frames": "SELECT n_name AS name, n_regionkey, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region",
    "shared_keys": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "only_left_keys": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "update_dimension": with_(STATIONS, then="SELECT name, CASE WHEN altitude > 100 THEN altitude * 2 ELSE altitude END AS altitude FROM stations"),
    "buddy_check": with_(OBS, STATIONS, GROUPS.replace("<= 10000)", "<= 10000 AND abs(a.altitude - b.altitude) <= 200)"), NETWORK, "net0 AS (SELECT name, us, value - (altitude - (SELECT MIN(altitude) FROM stations)) * -0.0065::DOUBLE AS value FROM net JOIN stations USING (name))", _iteration(1, "net0"), _iteration(2, "left1"), then=_checked("buddy check outlier"), recursive=True),
    "buddy_check_safetynets": with_(OBS, STATIONS, GROUPS, NETWORK, _SAME, _iteration(1, "net", _SAVED, "name IN (SELECT name FROM stations WHERE category = 4)"), _iteration(2, "left1", _SAVED, "name IN (SELECT name FROM stations WHERE category = 4)"), then=_checked("buddy check (with safetynets) outlier"), recursive=True),
}
ORACLES["outlier_view"] = f"""SELECT name, obstype, datetime, arg_min(value, i) AS value, arg_min(label, i) AS label, arg_min(details, i) AS details FROM (
SELECT name, obstype, datetime, value, label, '' AS details, 0 AS i FROM ({ORACLES["gross_value"]}) UNION ALL SELECT name, obstype, datetime, value, label, '', 1 FROM ({ORACLES["step"]})
UNION ALL SELECT name, obstype, datetime, value, label, details, 2 FROM ({ORACLES["buddy_check_safetynets"]})) GROUP BY name, obstype, datetime"""
