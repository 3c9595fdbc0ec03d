"""DuckDB SQL with the expected results of ``sloflow.queries.series``.

Ranges are moving ROWS frames over a dense one-minute grid, not differences of running sums.
"""

from oracle.events_sql import DEFINED, E

RANGES = {"5m": 300, "30m": 1800, "1h": 3600, "2h": 7200, "6h": 21600, "1d": 86400, "3d": 259200, "4w": 2419200}
STEPS = {"5m": 60, "30m": 60, "1h": 60, "2h": 180, "6h": 180, "1d": 180, "3d": 180, "4w": 900}
SLO = "namespace, slo_class, slo_domain, slo_type, slo_version"
SERIES = SLO + ", result"

CEIL_MINUTE = "CAST(ceil(epoch_us(event_time) / 60000000.0) AS BIGINT) * 60"


def daily(keys: str, source: str, value: str = "value", where: str = "") -> str:
    """The per-day report; infinities and NaN are counted apart."""
    lead = f"{keys}, " if keys else ""
    finite = f"CASE WHEN isfinite({value}) THEN {value} END"
    return f"""SELECT {lead}sec // 86400 AS day, count(*) AS points, count(*) FILTER (isinf({value})) AS infinite,
  count(*) FILTER (isnan({value})) AS undefined, round(sum({finite}), 4) AS total, round(max({finite}), 6) AS peak,
  round(sum({finite} * (sec % 86400 // 60)), 3) AS moment
FROM {source} {where} GROUP BY {lead}day"""


INCREMENTS = E + r""",
increments AS (
  SELECT event_id, event_time, CASE WHEN event_type IN ('purchase', 'view') THEN 'test' ELSE 'production' END AS namespace,
    slo_class, event_type AS slo_domain, 'availability' AS slo_type, '1' AS slo_version, result,
    CAST(1 + k % 7 AS DOUBLE) AS quantity, http_path, http_method
  FROM e
)"""

# Counters scraped every minute with events, restarting every seventh day, and their growth.
CELLS = INCREMENTS + f""",
per_minute AS (SELECT {SERIES}, {CEIL_MINUTE} AS sec, sum(quantity) AS growth FROM increments GROUP BY ALL),
counters AS (
  SELECT {SERIES}, sec, sum(growth) OVER (PARTITION BY {SERIES}, sec // 604800 ORDER BY sec) AS value FROM per_minute
),
cells AS (
  SELECT {SERIES}, sec, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta
  FROM (SELECT *, lag(value) OVER (PARTITION BY {SERIES} ORDER BY sec) AS prev FROM counters)
),
bounds AS (SELECT min(sec) AS lo, max(sec) AS hi FROM cells),
times AS (SELECT unnest(range(lo, hi + 1, 60)) AS sec FROM bounds)"""


def dense(keys: str, source: str = "cells", times: str = "times") -> str:
    """All grid times of each group, with growth 0 and no sample where there is no cell."""
    return f"""
dense AS (
  SELECT {keys}, t.sec, coalesce(c.delta, 0) AS d, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT {keys} FROM {source}) k CROSS JOIN {times} t
  LEFT JOIN (SELECT {keys}, sec, sum(delta) AS delta, count(*) AS n FROM {source} GROUP BY ALL) c
    USING ({keys}, sec)
)"""


def rolled(keys: str, ranges, steps, step: int = 60, source: str = "dense") -> str:
    """One SELECT per range: sums over the last range, where there was a sample."""
    parts = [
        f"""SELECT * FROM (
  SELECT {keys}, '{r}' AS slo_time_range, sec, sum(d) OVER w AS value, sum(n) OVER w AS n FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY sec ROWS BETWEEN {RANGES[r] // step - 1} PRECEDING AND CURRENT ROW)
) WHERE n > 0 AND sec % {steps[r]} = 0"""
        for r in ranges
    ]
    return " UNION ALL ".join(parts)


def eot(ranges=tuple(RANGES)) -> str:
    """Events over time; the four-week range is carried from a 15-minute to a 3-minute grid."""
    short = [r for r in ranges if r != "4w"]
    parts = []
    if short:
        parts.append(f"SELECT {SERIES}, slo_time_range, sec, value FROM ({rolled(SERIES, short, STEPS)})")
    if "4w" in ranges:
        parts.append(
            f"""SELECT {', '.join('s.' + c for c in SERIES.split(', '))}, '4w' AS slo_time_range, t.sec, s.value
FROM sparse s JOIN times t ON t.sec // 900 * 900 = s.sec WHERE t.sec % 180 = 0"""
        )
    return f"""{CELLS}, {dense(SERIES)},
sparse AS ({rolled(SERIES, ['4w'], STEPS)}),
eot AS ({' UNION ALL '.join(parts)})"""


def ratio(ranges=tuple(RANGES)) -> str:
    return f"""{eot(ranges)},
ratio AS (
  SELECT {SLO}, slo_time_range, sec,
    CASE WHEN sum(value) = 0 THEN 0 ELSE coalesce(sum(value) FILTER (result = 'fail'), 0) / sum(value) END AS value
  FROM eot GROUP BY ALL
)"""


def div(a: str, b: str) -> str:
    """IEEE division."""
    return (
        f"CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 OR isnan({a}) THEN CAST('nan' AS DOUBLE) "
        f"WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END ELSE {a} / {b} END"
    )


BURN = f"""
burned AS (
  SELECT r.* REPLACE ({div('r.value', '(1 - t.value)')} AS value)
  FROM ratio r JOIN thresholds t USING ({SLO})
)"""


def coefficient(ranges) -> str:
    scale = " ".join(f"WHEN '{r}' THEN {RANGES['4w'] / RANGES[r]!r}" for r in ranges)
    scaled = f"(a.value * CASE a.slo_time_range {scale} END)"
    return f"""
totals AS (SELECT {SLO}, slo_time_range, sec, sum(value) AS value FROM eot GROUP BY ALL),
coefficient AS (
  SELECT a.* REPLACE ({div(scaled, 'm.value')} AS value)
  FROM totals a JOIN totals m USING ({SLO}, sec)
  WHERE m.slo_time_range = '4w' AND a.slo_time_range IN ({', '.join(repr(r) for r in ranges)})
)"""


BUDGET = f"""
budget AS (
  SELECT r.* REPLACE ({div('r.value', '(t.value - 1)')} + 1 AS value)
  FROM ratio r JOIN stable s USING (slo_domain, slo_version, namespace) JOIN thresholds t USING ({SLO})
  WHERE slo_time_range = '4w'
)"""

_ALERTS = {
    "alert_1h_low": ("1h", "5m", "'warning'", "fails <= 5"),
    "alert_1h": ("1h", "5m", "'critical'", "fails > 5"),
    "alert_6h_low": ("6h", "30m", "CASE WHEN sec % 86400 // 3600 BETWEEN 8 AND 15 THEN 'critical' ELSE 'warning' END", "fails <= 10"),
    "alert_6h": ("6h", "30m", "'critical'", "fails > 10"),
    "alert_1d": ("1d", "2h", "'warning'", "true"),
    "alert_3d": ("3d", "6h", "'warning'", "true"),
}

_PERIODS = {
    "alert_1h_low": "last hour, low traffic",
    "alert_1h": "last hour",
    "alert_6h_low": "6 hours, low traffic",
    "alert_6h": "6 hours",
    "alert_1d": "24 hours",
    "alert_3d": "3 days",
}


def fired(name: str) -> str:
    """Join of the long and the short range, as the alert rules are written."""
    long, short, severity, fails = _ALERTS[name]
    key = f"{SLO}, sec"
    return f"""{ratio((long, short, '4w'))}, {DEFINED}, {BURN}, {coefficient((long,))},
effective AS (
  SELECT b.* REPLACE (b.value * c.value AS value), team, coalesce(escalate, '') AS escalate
  FROM burned b JOIN (SELECT {key}, value FROM coefficient) c USING ({key})
  JOIN (SELECT slo_domain, slo_version, namespace, team, escalate FROM stable WHERE enabled <> 'false') s
    USING (slo_domain, slo_version, namespace)
),
above AS (
  SELECT e.* FROM effective e JOIN burn_limits l USING ({SLO})
  WHERE l.slo_time_range = '{long}' AND NOT isnan(e.value) AND e.value > l.value
),
failed AS (SELECT {key}, value AS fails FROM eot WHERE slo_time_range = '{long}' AND result = 'fail'),
{name} AS (
  SELECT a.*, {severity} AS severity FROM above a LEFT JOIN failed USING ({key})
  WHERE a.slo_time_range = '{long}' AND {fails}
    AND ({key}) IN (SELECT ({key}) FROM above WHERE slo_time_range = '{short}')
)"""


ALERT_KEYS = SLO + ", slo_time_range, severity, team, escalate"


def islands(source: str, keys: str, step: int, hold: int) -> str:
    """Rows of a condition that held for a while."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
numbered AS (SELECT *, sec - row_number() OVER ({part}ORDER BY sec) * {step} AS island FROM {source}),
held AS (SELECT * FROM (SELECT *, min(sec) OVER (PARTITION BY {lead}island) AS since FROM numbered) WHERE sec - since >= {hold})"""


SPENT = f"""
spent AS (
  SELECT b.*, team, coalesce(escalate, '') AS escalate
  FROM budget b JOIN (SELECT * EXCLUDE (value) FROM stable WHERE enabled <> 'false') s USING (slo_domain, slo_version, namespace)
  WHERE b.value <= 0 AND NOT isnan(b.value)
)"""

GAUGE = E + r""",
gauge AS (SELECT event_type, event_time, value, CAST(ceil(epoch_us(event_time) / 600000000.0) AS BIGINT) * 600 AS cell FROM e),
grid AS (SELECT unnest(range((SELECT min(cell) FROM gauge), (SELECT max(cell) FROM gauge) + 1, 600)) AS sec)"""


def over_time(expression: str, having: str = "true", seconds: int = 3600, extra: str = "") -> str:
    return f"""WITH {GAUGE},
inside AS (
  SELECT event_type, sec, value, event_time FROM gauge JOIN grid
    ON epoch_us(event_time) > (sec - {seconds}) * 1000000 AND epoch_us(event_time) <= sec * 1000000
)
SELECT event_type, sec{extra} AS sec, round({expression}, 6) AS value FROM inside GROUP BY event_type, sec HAVING {having}"""


def over_month(expression: str, having: str = "true") -> str:
    """Cells of a minute, and frames of 40,320 rows over a dense grid."""
    return f"""WITH {E},
mcells AS (
  SELECT event_type, {CEIL_MINUTE} AS sec, sum(x) AS s, count(*) AS n, min(x) AS lo, max(x) AS hi,
    arg_min(x, event_time) AS head, arg_max(x, event_time) AS tail
  FROM (SELECT *, round(value * 100) AS x FROM e) GROUP BY ALL
),
mgrid AS (SELECT unnest(range((SELECT min(sec) FROM mcells), (SELECT max(sec) FROM mcells) + 1, 60)) AS sec),
mdense AS (SELECT * FROM (SELECT DISTINCT event_type FROM mcells) CROSS JOIN mgrid LEFT JOIN mcells USING (event_type, sec)),
framed AS (
  SELECT event_type, sec, sum(n) OVER w AS many, {expression} AS value FROM mdense
  WINDOW w AS (PARTITION BY event_type ORDER BY sec ROWS BETWEEN {RANGES['4w'] // 60 - 1} PRECEDING AND CURRENT ROW)
),
found AS (SELECT * FROM framed WHERE many > 0 AND {having})
{daily('event_type', 'found')}"""


HOURLY = INCREMENTS + """,
hourly AS (
  SELECT slo_domain, slo_class, result, CAST(ceil(epoch_us(event_time) / 3600000000.0) AS BIGINT) * 3600 AS sec,
    sum(quantity) AS value FROM increments GROUP BY ALL
)"""

MAP_SAMPLES = E + f""",
per_minute AS (SELECT event_type, result, {CEIL_MINUTE} AS sec, count(*) AS growth FROM e GROUP BY ALL),
samples AS (
  SELECT event_type, result, sec,
    CAST(sum(growth) OVER (PARTITION BY event_type, result, sec // 604800 ORDER BY sec) AS DOUBLE) AS value FROM per_minute
)"""


def polled(poll: int, staleness: int) -> str:
    return f"""WITH {MAP_SAMPLES},
linked AS (
  SELECT *, CAST(ceil(sec / {poll}.0) AS BIGINT) * {poll} AS poll, lag(value) OVER w AS pv, lag(sec) OVER w AS ps
  FROM samples WINDOW w AS (PARTITION BY event_type, result ORDER BY sec)
),
grown AS (
  SELECT event_type AS type, result, poll AS sec, sum(CASE
    WHEN pv IS NULL THEN 0
    WHEN CAST(ceil(ps / {poll}.0) AS BIGINT) * {poll} <> poll AND poll - ps > {staleness} THEN 0
    WHEN value < pv THEN value ELSE value - pv END) AS quantity
  FROM linked GROUP BY ALL
)
SELECT * FROM grown WHERE quantity > 0"""


def increase(r: str) -> str:
    keys = "slo_domain, result"
    return f"""WITH {CELLS}, {dense(keys)},
rolled AS ({rolled(keys, [r], {r: 60})})
{daily(keys, 'rolled')}"""


_ODD_RANGES = ("5m", "1h", "1d", "4w")
_ODD_SUM = (
    "CASE WHEN nans > 0 OR (ups > 0 AND downs > 0) THEN CAST('nan' AS DOUBLE) WHEN ups > 0 THEN CAST('inf' AS DOUBLE) "
    "WHEN downs > 0 THEN CAST('-inf' AS DOUBLE) ELSE plain + large * pow(2, 60) END"
)
NONFINITE = f"""WITH {INCREMENTS},
odd AS (
  SELECT slo_domain, {CEIL_MINUTE} AS sec, count(*) AS n, coalesce(sum(quantity + 0.25) FILTER (event_id % 997 > 3), 0) AS plain,
    count(*) FILTER (event_id % 997 = 0) AS ups, count(*) FILTER (event_id % 997 = 1) AS nans,
    count(*) FILTER (event_id % 997 = 2) AS downs, count(*) FILTER (event_id % 997 = 3) AS large
  FROM increments GROUP BY ALL
),
ogrid AS (SELECT unnest(range((SELECT min(sec) FROM odd), (SELECT max(sec) FROM odd) + 1, 60)) AS sec),
odense AS (SELECT * FROM (SELECT DISTINCT slo_domain FROM odd) CROSS JOIN ogrid LEFT JOIN odd USING (slo_domain, sec)),
oframes AS (
  {" UNION ALL ".join(f"""SELECT slo_domain, '{r}' AS slo_time_range, sec, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('n', 'plain', 'ups', 'nans', 'downs', 'large'))}
  FROM odense WINDOW w AS (PARTITION BY slo_domain ORDER BY sec ROWS BETWEEN {RANGES[r] // 60 - 1} PRECEDING AND CURRENT ROW)""" for r in _ODD_RANGES)}
),
ovalues AS (SELECT slo_domain, slo_time_range, sec, {_ODD_SUM} AS value FROM oframes WHERE n > 0),
okinds AS (
  SELECT slo_domain, slo_time_range, 'plain' AS kind, sec, value FROM ovalues WHERE NOT (isfinite(value) AND value >= pow(2, 50))
  UNION ALL SELECT slo_domain, slo_time_range, 'large', sec, 1 FROM ovalues WHERE isfinite(value) AND value >= pow(2, 50)
)
{daily('slo_domain, slo_time_range, kind', 'okinds')}"""

_COUNTERS = {
    "lines_read_total": "CASE WHEN k < 50 THEN 1 ELSE 0 END",
    "file_size_bytes": "cents * 100",
    "file_offset_bytes": "CASE WHEN k < 80 THEN cents * 100 ELSE 0 END",
    "malformed_lines_total": "CASE WHEN k >= 50 THEN k ELSE 0 END",
    "unsupported_results_total": "CASE WHEN k >= 90 THEN k - 85 ELSE 0 END",
    "query_fails_total": "k % 20",
    "events_not_matching_any_rule": "CASE WHEN k >= 97 THEN 1 ELSE 0 END",
    "unclassified_total": "k % 2",
}
HEALTH = (
    E
    + ",\nhcells AS (SELECT event_type AS instance, "
    + CEIL_MINUTE
    + " AS sec, "
    + ", ".join(f"sum({sql}) AS {name}" for name, sql in _COUNTERS.items())
    + ", CASE WHEN max(k) >= 95 THEN 0 ELSE 1 END AS up, CASE WHEN max(k) >= 98 THEN 0 ELSE 1 END AS ready, "
    + "max(user_id % 10) AS event_keys FROM e GROUP BY ALL),\n"
    + "hgrid AS (SELECT unnest(range((SELECT min(sec) FROM hcells), (SELECT max(sec) FROM hcells) + 1, 60)) AS sec),\n"
    + "hfirst AS (SELECT instance, min(sec) AS first_sec FROM hcells GROUP BY 1),\n"
    # growth since the previous sample: none for the first one
    + "hdense AS (SELECT k.instance, g.sec, c.sec IS NOT NULL AS here, c.up, c.ready, c.event_keys, "
    + ", ".join(
        f"CAST(CASE WHEN g.sec = f.first_sec THEN 0 ELSE coalesce(c.{n}, 0) END AS DOUBLE) AS d_{n}, "
        f"CAST(sum(coalesce(c.{n}, 0)) OVER (PARTITION BY k.instance ORDER BY g.sec) AS DOUBLE) AS {n}"
        for n in _COUNTERS
    )
    + ", max(c.sec) OVER (PARTITION BY k.instance ORDER BY g.sec) AS last_sec"
    + ", last_value(c.ready IGNORE NULLS) OVER (PARTITION BY k.instance ORDER BY g.sec) AS last_ready"
    + ", last_value(c.event_keys IGNORE NULLS) OVER (PARTITION BY k.instance ORDER BY g.sec) AS last_keys"
    + " FROM (SELECT DISTINCT instance FROM hcells) k CROSS JOIN hgrid g JOIN hfirst f ON f.instance = k.instance "
    + "LEFT JOIN hcells c ON c.instance = k.instance AND c.sec = g.sec)"
)


def _grew(check: str, metric: str, minutes: int, limit: int) -> str:
    return f"""SELECT '{check}' AS "check", instance, sec, value FROM (
  SELECT instance, sec, sum(d_{metric}) OVER w AS value, count(*) FILTER (here) OVER w AS n FROM hdense
  WINDOW w AS (PARTITION BY instance ORDER BY sec ROWS BETWEEN {minutes - 1} PRECEDING AND CURRENT ROW)
) WHERE n > 0 AND value > {limit}"""


def _held(source: str, check: str, hold: int) -> str:
    return f"""SELECT '{check}' AS "check", instance, sec, value FROM (
  SELECT *, min(sec) OVER (PARTITION BY instance, island) AS since FROM (
    SELECT *, sec - row_number() OVER (PARTITION BY instance ORDER BY sec) * 60 AS island FROM {source})
) WHERE sec - since >= {hold}"""


HEALTH_CHECKS = f"""{HEALTH},
low AS (
  SELECT * FROM (SELECT instance, sec, last_ready, last_sec, avg(up) OVER w AS value FROM hdense
    WINDOW w AS (PARTITION BY instance ORDER BY sec ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  WHERE value < 0.9 AND last_ready = 1 AND sec - last_sec <= 300
),
behind AS (
  SELECT instance, sec, file_size_bytes - file_offset_bytes AS value FROM hdense
  WHERE sec - last_sec <= 300 AND file_size_bytes - file_offset_bytes > 1048576
),
idle AS (SELECT instance, sec, 0.0 AS value FROM hdense WHERE here AND d_lines_read_total = 0),
checks AS (
  {_held('low', 'target_down', 600)}
  UNION ALL {_held('idle', 'no_new_lines', 600)}
  UNION ALL {_held('behind', 'behind_short', 600)}
  UNION ALL {_held('behind', 'behind_long', 7200)}
  UNION ALL {_grew('malformed_lines', 'malformed_lines_total', 10, 100)}
  UNION ALL {_grew('unsupported_results', 'unsupported_results_total', 10, 10)}
  UNION ALL {_grew('query_fails', 'query_fails_total', 10, 10)}
  UNION ALL {_grew('unmatched_events', 'events_not_matching_any_rule', 1, 0)}
  UNION ALL SELECT 'event_key_limit', instance, sec, last_keys FROM hdense WHERE sec - last_sec <= 300 AND last_keys >= 9
  UNION ALL SELECT 'unclassified_events', '', sec, sum(unclassified_total) FROM hdense
    WHERE sec - last_sec <= 300 AND instance <> 'error' GROUP BY sec
),
named AS (
  SELECT *, CASE WHEN "check" IN ('target_down', 'behind_long', 'unsupported_results', 'query_fails') THEN 'critical'
    ELSE 'warning' END AS severity FROM checks
)"""

# The estimate of monitoring systems: growth between the first and the last sample of the range,
# stretched to its edges.
EXTRAPOLATED = f"""WITH {CELLS},
grid10 AS (SELECT unnest(range(CAST(ceil(lo / 600.0) AS BIGINT) * 600, CAST(ceil(hi / 600.0) AS BIGINT) * 600 + 1, 600)) AS t FROM bounds),
pairs AS (
  SELECT {', '.join('c.' + k for k in SERIES.split(', '))}, t, count(*) AS n, min(c.sec) AS f, max(c.sec) AS l,
    arg_min(c.value, c.sec) AS fv, sum(x.delta) - arg_min(x.delta, c.sec) AS grown
  FROM counters c JOIN cells x USING ({SERIES}, sec) JOIN grid10 ON c.sec > t - 21600 AND c.sec <= t
  GROUP BY ALL HAVING count(*) >= 2
),
edges AS (
  SELECT *, (l - f) AS sampled, (l - f) / (n - 1) AS spacing,
    CASE WHEN grown > 0 AND fv >= 0 AND (l - f) * fv / grown < f - (t - 21600) THEN (l - f) * fv / grown
         ELSE f - (t - 21600) END AS to_start, t - l AS to_end FROM pairs
),
stretched AS (
  SELECT slo_domain, result, t AS sec, sum(grown * (sampled
    + CASE WHEN to_start < spacing * 1.1 THEN to_start ELSE spacing / 2 END
    + CASE WHEN to_end < spacing * 1.1 THEN to_end ELSE spacing / 2 END) / sampled) AS value
  FROM edges GROUP BY ALL
)
{daily('slo_domain, result', 'stretched')}"""

UP = E + f""",
up AS (SELECT 'app-' || event_type AS slo_domain, {CEIL_MINUTE} AS sec, min(result) = 'success' AS good FROM e GROUP BY ALL),
times AS (SELECT unnest(range((SELECT min(sec) FROM up), (SELECT max(sec) FROM up) + 1, 60)) AS sec),
good AS (SELECT slo_domain, sec, 1 AS delta FROM up WHERE good)"""

_UP_RANGES = RANGES
_UP_STEP = {name: 180 for name in RANGES}

UPTIME = f"""WITH {UP}, {dense('slo_domain', 'good')},
counted AS ({rolled('slo_domain', _UP_RANGES, _UP_STEP)}),
wanted AS (
  SELECT slo_domain, r AS slo_time_range, sec FROM times,
    (VALUES ('app-click'), ('app-view'), ('app-idle')) AS d(slo_domain), (VALUES {', '.join(f"('{r}')" for r in RANGES)}) AS r(r)
  WHERE sec % 180 = 0
),
success AS (
  SELECT slo_domain, slo_time_range, sec, value FROM counted
  UNION ALL
  SELECT slo_domain, slo_time_range, sec, 0 FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.slo_domain = w.slo_domain AND c.slo_time_range = w.slo_time_range AND c.sec = w.sec)
),
both_results AS (
  SELECT 'production' AS namespace, slo_domain, 'uptime' AS slo_class, '6' AS slo_version, 'success' AS result,
    slo_time_range, sec, CAST(value AS DOUBLE) AS value FROM success
  UNION ALL
  SELECT 'production', slo_domain, 'uptime', '6', 'fail', slo_time_range, sec,
    CASE slo_time_range {' '.join(f"WHEN '{r}' THEN {s // 60}" for r, s in RANGES.items())} END - value FROM success
)
{daily('namespace, slo_domain, slo_class, slo_version, result, slo_time_range', 'both_results')}"""


def _query_rolled(metric: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT instance, '{r}' AS slo_time_range, sec, sum(d_{metric}) OVER w AS value,
  count(*) FILTER (here) OVER w AS n FROM hdense
  WINDOW w AS (PARTITION BY instance ORDER BY sec ROWS BETWEEN {RANGES[r] // 60 - 1} PRECEDING AND CURRENT ROW)"""
        for r in RANGES
    )


QUERY_SLI = f"""WITH {HEALTH},
allq AS ({_query_rolled('file_size_bytes')}),
failq AS ({_query_rolled('file_offset_bytes')}),
joined AS (
  SELECT 'production' AS namespace, 'app-' || instance AS slo_domain, 'queries' AS slo_class, 'availability' AS slo_type,
    slo_time_range, sec, a.value - f.value AS success, f.value AS fail
  FROM allq a JOIN failq f USING (instance, slo_time_range, sec) WHERE sec % 180 = 0 AND a.n > 0
),
both_results AS (
  SELECT * EXCLUDE (success, fail), 'success' AS result, success AS value FROM joined
  UNION ALL SELECT * EXCLUDE (success, fail), 'fail', fail FROM joined
)
{daily('namespace, slo_domain, slo_class, slo_type, result, slo_time_range', 'both_results')}"""

_HIST = E + r""",
hcells AS (
  SELECT event_type, CAST(ceil(epoch_us(event_time) / 300000000.0) AS BIGINT) * 300 AS sec,
    count(*) FILTER (value <= 10) AS b1, count(*) FILTER (value <= 50) AS b2, count(*) FILTER (value <= 100) AS b3,
    count(*) AS b4 FROM e GROUP BY ALL
),
linked AS (
  SELECT *, CAST(ceil(sec / 900.0) AS BIGINT) * 900 AS poll, lag(sec) OVER (PARTITION BY event_type ORDER BY sec) AS ps FROM hcells
),
usable AS (
  SELECT *, ps IS NOT NULL AND (CAST(ceil(ps / 900.0) AS BIGINT) * 900 = poll OR poll - ps <= 86400) AS ok FROM linked
),
polls AS (
  SELECT event_type, poll, sum(CASE WHEN ok THEN b1 ELSE 0 END) AS b1, sum(CASE WHEN ok THEN b2 ELSE 0 END) AS b2,
    sum(CASE WHEN ok THEN b3 ELSE 0 END) AS b3, sum(CASE WHEN ok THEN b4 ELSE 0 END) AS b4 FROM usable GROUP BY ALL
),
alone AS (
  SELECT event_type AS type, '-Inf' AS low, '10' AS high, poll AS sec, b1 AS quantity FROM polls
  UNION ALL SELECT event_type, '10', '50', poll, b2 - b1 FROM polls
  UNION ALL SELECT event_type, '50', '100', poll, b3 - b2 FROM polls
  UNION ALL SELECT event_type, '100', '+Inf', poll, b4 - b3 FROM polls
)"""

MISSING_BURN = f"""WITH {eot(('5m',))}, {DEFINED},
present AS (
  SELECT DISTINCT slo_domain, sec FROM eot JOIN thresholds USING ({SLO})
),
active AS (
  SELECT DISTINCT slo_domain, sec FROM (
    SELECT slo_domain, slo_class, sec, sum(value) AS value FROM eot GROUP BY ALL) WHERE value > 0
),
silent AS (
  SELECT s.slo_domain, s.slo_version, s.namespace, s.team, coalesce(s.escalate, '') AS escalate, a.sec, 1.0 AS value
  FROM stable s JOIN active a USING (slo_domain)
  WHERE s.enabled = 'true' AND NOT EXISTS (SELECT 1 FROM present p WHERE p.slo_domain = s.slo_domain AND p.sec = a.sec)
), {islands('silent', 'slo_domain', 60, 300)}
{daily('slo_domain, slo_version, namespace, team, escalate', 'held')}"""

# The hours in which the counters with gaps record nothing.
_GAP = "(epoch_us(event_time) // 86400000000 % 3 = 0 AND epoch_us(event_time) % 86400000000 // 3600000000 BETWEEN 6 AND 17)"

ORACLE = {
    "counter_increase": polled(300, 7 * 86400),
    "counter_stale": polled(600, 1800),
    "histogram_increase": f"WITH {_HIST} SELECT type, low, high, sec, CAST(quantity AS DOUBLE) AS quantity FROM alone WHERE quantity > 0",
    **{f"increase_{r}": increase(r) for r in RANGES},
    "increase_extrapolated": EXTRAPOLATED,
    "rate_1m": f"""WITH {CELLS}, rates AS (SELECT slo_domain, sec, sum(delta) / 60 AS value FROM cells GROUP BY ALL)
{daily('slo_domain', 'rates')}""",
    "increase_nonfinite": NONFINITE,
    "avg_4w": over_month("sum(s) OVER w / sum(n) OVER w"),
    "min_4w": over_month("min(lo) OVER w"),
    "max_4w": over_month("max(hi) OVER w"),
    "delta_4w": over_month("last_value(tail IGNORE NULLS) OVER w - first_value(head IGNORE NULLS) OVER w", "many > 1"),
    "last_ot": over_time("arg_max(value, event_time)", seconds=1800),
    "count_ot": over_time("CAST(count(*) AS DOUBLE)"),
    "sum_ot": over_time("sum(value)"),
    "avg_ot": over_time("avg(value)"),
    "min_ot": over_time("min(value)"),
    "max_ot": over_time("max(value)"),
    "delta_r": over_time("arg_max(value, event_time) - arg_min(value, event_time)", "count(*) > 1"),
    "offset_r": over_time("sum(value)", extra=" + 86400"),
    "absent_r": f"""WITH {E},
viewed AS (SELECT DISTINCT CAST(ceil(epoch_us(event_time) / 600000000.0) AS BIGINT) * 600 AS sec FROM e WHERE event_type = 'view'),
grid AS (SELECT unnest(range((SELECT min(sec) FROM viewed), (SELECT max(sec) FROM viewed) + 1, 600)) AS sec)
SELECT sec, 1.0 AS value FROM grid WHERE sec NOT IN (SELECT sec FROM viewed)""",
    "held_for": f"""{over_time('avg(value)', 'avg(value) > 50').replace('SELECT event_type, sec AS sec', ', busy AS (SELECT event_type, sec AS sec')}),
{islands('busy', 'event_type', 600, 3600)} SELECT event_type, sec, value FROM held""",
    "v_one_to_one": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, sec, round(sum(value) FILTER (result = 'fail') / sum(value), 6) AS value
FROM hourly GROUP BY ALL HAVING count(*) FILTER (result = 'fail') > 0""",
    "v_group_left": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result, 'k-' || substr(slo_domain, 1, 1) AS kind, sec,
  round(value / sum(value) OVER (PARTITION BY slo_domain, sec), 6) AS value FROM hourly""",
    "v_group_right": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result, sec, max(value) OVER (PARTITION BY slo_domain, sec) - value AS value FROM hourly""",
    "v_and": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result, sec, value FROM hourly h
WHERE EXISTS (SELECT 1 FROM hourly f WHERE f.result = 'fail' AND f.value > 3 AND f.slo_domain = h.slo_domain
  AND f.slo_class = h.slo_class AND f.sec = h.sec)""",
    "v_unless": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result, sec, value FROM hourly h
WHERE NOT EXISTS (SELECT 1 FROM hourly f WHERE f.result = 'fail' AND f.slo_domain = h.slo_domain AND f.sec = h.sec)""",
    "v_or": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, 'fail' AS result, sec, value FROM hourly WHERE result = 'fail'
UNION ALL
SELECT slo_domain, slo_class, '', sec, 0 FROM hourly GROUP BY ALL HAVING count(*) FILTER (result = 'fail') = 0""",
    "v_compare": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result, sec, value FROM (
  SELECT *, avg(value) OVER (PARTITION BY slo_domain, sec) AS mean FROM hourly) WHERE value >= mean""",
    "v_without": f"WITH {HOURLY} SELECT slo_class, slo_domain, sec, sum(value) AS value FROM hourly GROUP BY ALL",
    "v_aggregates": f"""WITH {HOURLY},
agg AS (SELECT slo_domain, sec, sum(value) AS s, max(value) AS hi, min(value) AS lo, count(*) AS n FROM hourly GROUP BY ALL)
SELECT 'sum' AS function, slo_domain, sec, s AS value FROM agg UNION ALL SELECT 'max', slo_domain, sec, hi FROM agg
UNION ALL SELECT 'min', slo_domain, sec, lo FROM agg UNION ALL SELECT 'count', slo_domain, sec, n FROM agg
UNION ALL SELECT 'group', slo_domain, sec, 1 FROM agg""",
    "label_replace": f"""WITH {HOURLY}
SELECT slo_domain, slo_class, result,
  CASE WHEN slo_domain LIKE 'cl%' OR slo_domain LIKE 'si%' THEN substr(slo_domain, 1, 2) || '-' || substr(slo_domain, 3) ELSE '' END AS short,
  sec, least(value, 5) AS value FROM hourly""",
    "label_values": f"WITH {E} SELECT DISTINCT event_type AS type FROM e WHERE result = 'fail'",
    "events_over_time": f"WITH {eot()} {daily(SERIES + ', slo_time_range', 'eot')}",
    "eot_sparse_4w": f"""WITH {CELLS}, {dense(SERIES)},
sparse AS ({rolled(SERIES, ['4w'], STEPS)}) {daily(SERIES + ', slo_time_range', 'sparse')}""",
    "violation_ratio": f"WITH {ratio()} {daily(SLO + ', slo_time_range', 'ratio')}",
    "burn_rate": f"WITH {ratio()}, {DEFINED}, {BURN} {daily(SLO + ', slo_time_range', 'burned')}",
    "rate_coefficient": f"""WITH {eot(('1h', '6h', '1d', '3d', '4w'))}, {coefficient(('1h', '6h', '1d', '3d'))}
{daily(SLO + ', slo_time_range', 'coefficient')}""",
    "error_budget": f"WITH {ratio(('4w',))}, {DEFINED}, {BUDGET} {daily(SLO, 'budget')}",
    "effective_burn": f"""WITH {ratio(('1h', '6h', '1d', '3d', '4w'))}, {DEFINED}, {BURN}, {coefficient(('1h', '6h', '1d', '3d'))},
effective AS (
  SELECT b.* REPLACE (b.value * c.value AS value) FROM burned b JOIN coefficient c USING ({SLO}, sec, slo_time_range)
  UNION ALL
  SELECT b.* REPLACE (b.value * c.value AS value) FROM burned b JOIN coefficient c USING ({SLO}, sec)
  WHERE b.slo_time_range = '4w' AND c.slo_time_range = '6h'
) {daily(SLO + ', slo_time_range', 'effective')}""",
    "uptime_sli": UPTIME,
    "query_sli": QUERY_SLI,
    **{name: f"WITH {fired(name)} {daily(ALERT_KEYS, name)}" for name in _ALERTS},
    "alert_budget": f"""WITH {ratio(('4w',))}, {DEFINED}, {BUDGET}, {SPENT}, {islands('spent', SLO, 180, 600)}
{daily(SLO + ', team, escalate', 'held')}""",
    "alert_missing_burn": MISSING_BURN,
    "alert_expired_correction": f"""WITH {E},
samples AS (SELECT event_type AS incident, {CEIL_MINUTE} AS sec, sum(CASE WHEN k < 30 THEN 1 ELSE 0 END) AS on_count FROM e GROUP BY ALL),
times AS (SELECT unnest(range((SELECT min(sec) FROM samples), (SELECT max(sec) FROM samples) + 1, 60)) AS sec),
filled AS (
  SELECT i.incident, t.sec, s.on_count FROM (SELECT DISTINCT incident FROM samples) i CROSS JOIN times t
  LEFT JOIN samples s ON s.incident = i.incident AND s.sec = t.sec
),
unused AS (
  SELECT incident, sec, 0.0 AS value FROM (
    SELECT incident, sec, sum(on_count) OVER w AS total FROM filled
    WINDOW w AS (PARTITION BY incident ORDER BY sec ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE total = 0
), {islands('unused', 'incident', 60, 600)} {daily('incident', 'held')}""",
    "alert_health": f"""WITH {HEALTH_CHECKS} {daily('"check", severity, instance', 'named')}""",
    "alert_rows": " UNION ALL ".join(
        f"""(WITH {fired(name)}
SELECT 'alert="{name}",alert_type="slo:high_burnrate",' || CASE WHEN escalate <> '' THEN 'escalate="' || escalate || '",' ELSE '' END
  || 'namespace="' || namespace || '",severity="' || severity || '",slo_class="' || slo_class || '",slo_domain="' || slo_domain
  || '",slo_time_range="' || slo_time_range || '",slo_type="availability",slo_version="1",team="' || team || '"' AS labels,
  slo_domain || ': availability budget burns too fast over {period}' AS title,
  'Burn rate ' || CASE WHEN isinf(value) THEN '+Inf' ELSE printf('%.1f', value) END
  || ' over {period} for availability of class ' || slo_class || ' in ' || slo_domain AS description, count(*) AS points
FROM {name} GROUP BY ALL)"""
        for name, period in _PERIODS.items()
    ),
    "budget_alert_rows": f"""WITH {ratio(('4w',))}, {DEFINED}, {BUDGET}, {SPENT}, {islands('spent', SLO, 180, 600)}
SELECT 'alert_type="slo:error_budget_exhausted",' || CASE WHEN escalate <> '' THEN 'escalate="' || escalate || '",' ELSE '' END
  || 'namespace="' || namespace || '",severity="warning",slo_class="' || slo_class || '",slo_domain="' || slo_domain
  || '",slo_time_range="4w",slo_type="availability",slo_version="1",team="' || team || '"' AS labels,
  'Budget spent' AS title, 'No availability budget is left in ' || slo_domain AS description, count(*) AS points
FROM held GROUP BY ALL""",
    "sli_percent": f"""WITH {ratio(('1h',))},
worst AS (
  SELECT {', '.join('r.' + c for c in SLO.split(', '))}, t.sec, 1 - max(r.value) AS value
  FROM times t JOIN ratio r ON r.sec > t.sec - 300 AND r.sec <= t.sec GROUP BY ALL
) {daily(SLO, 'worst')}""",
    "budget_remaining": f"""WITH {ratio(('1d',))}, {DEFINED},
worst AS (
  SELECT {', '.join('r.' + c for c in SLO.split(', '))}, t.sec, max(r.value) AS value
  FROM times t JOIN ratio r ON r.sec > t.sec - 900 AND r.sec <= t.sec WHERE t.sec % 180 = 0 GROUP BY ALL
),
remaining AS (SELECT w.* REPLACE ({div('w.value', '(t.value - 1)')} + 1 AS value) FROM worst w JOIN thresholds t USING ({SLO}))
{daily(SLO, 'remaining')}""",
    "worst_budget": f"""WITH {ratio(('4w',))}, {DEFINED}, {BUDGET},
worst AS (SELECT slo_domain, sec, min(value) AS value FROM budget GROUP BY ALL) {daily('slo_domain', 'worst')}""",
    "budget_delta": f"""WITH {ratio(('4w',))}, {DEFINED}, {BUDGET},
moved AS (
  SELECT * REPLACE (value - first_value(value) OVER w AS value), count(*) OVER w AS n FROM budget
  WINDOW w AS (PARTITION BY {SLO} ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)
) {daily(SLO, 'moved', where='WHERE n > 1')}""",
    "totals_range": f"""WITH {CELLS},
moved AS (SELECT * REPLACE (sec + 3600 AS sec) FROM cells), {dense(SERIES, 'moved')},
rolled AS ({rolled(SERIES, ['6h'], {'6h': 60})}) {daily(SERIES, 'rolled')}""",
    "team_of": f"""WITH {INCREMENTS}, {DEFINED}
SELECT slo_domain, team, coalesce(escalate, '') AS escalate, (SELECT sum(quantity) FROM increments i WHERE i.slo_domain = s.slo_domain) AS value
FROM stable s""",
    "top_failing_apps": f"""WITH {INCREMENTS}, m AS (SELECT *, {CEIL_MINUTE} AS sec FROM increments)
SELECT {SLO}, http_method AS slo_app, sum(quantity) AS value FROM m
WHERE result = 'fail' AND sec > (SELECT max(sec) FROM m) - 604800 GROUP BY ALL""",
    "top_failing_keys": f"""WITH {INCREMENTS}, m AS (SELECT *, {CEIL_MINUTE} AS sec FROM increments)
SELECT {SLO}, http_method AS slo_app, http_path AS event_key, sum(quantity) AS value FROM m
WHERE result = 'fail' AND sec > (SELECT max(sec) FROM m) - 2419200 GROUP BY ALL
ORDER BY value DESC, {SLO}, slo_app, event_key LIMIT 25""",
    "max_coefficient": f"""WITH {eot(('1h', '6h', '1d', '3d', '4w'))}, {coefficient(('1h', '6h', '1d', '3d'))},
highest AS (
  SELECT slo_domain, slo_class, sec, max(value) AS value FROM coefficient GROUP BY ALL
) {daily('slo_domain, slo_class', 'highest')}""",
    "alert_missing_all": f"""WITH {eot(('5m',)).replace("FROM increments GROUP BY ALL", f"FROM increments WHERE NOT {_GAP} GROUP BY ALL")}, {DEFINED},
seen AS (
  SELECT sec, eot.value FROM eot JOIN stable USING (slo_domain, slo_version, namespace) WHERE enabled <> 'false'
),
rare AS (SELECT DISTINCT sec FROM seen),
alive_sum AS (SELECT sec, least(sum(value), 1) AS value FROM seen GROUP BY sec),
hc AS (SELECT event_type AS instance, {CEIL_MINUTE} AS sec, sum(cents) AS c FROM e GROUP BY ALL),
hd AS (SELECT instance, sec, CASE WHEN row_number() OVER (PARTITION BY instance ORDER BY sec) = 1 THEN 0 ELSE c END AS c FROM hc),
growing AS (SELECT DISTINCT t.sec FROM times t JOIN hd ON hd.sec > t.sec - 300 AND hd.sec <= t.sec WHERE c > 0),
state AS (
  SELECT sec, 0.0 AS value FROM growing WHERE sec NOT IN (SELECT sec FROM rare)
  UNION ALL SELECT sec, value FROM alive_sum
),
filled AS (
  SELECT t.sec, avg(s.value) OVER w AS value FROM times t LEFT JOIN state s USING (sec)
  WINDOW w AS (ORDER BY t.sec ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
),
missing AS (SELECT sec, 1 - value AS value FROM filled WHERE 1 - value = 1), {islands('missing', '', 60, 600)}
{daily('', 'held')}""",
}
