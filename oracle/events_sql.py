"""DuckDB SQL with the expected results of ``sloflow.queries.events``."""

E = r"""
e AS (
  SELECT *,
    CASE WHEN k >= 95 THEN '503' WHEN k >= 90 THEN '404' ELSE '200' END AS status_code,
    CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS http_method,
    '/api/' || event_type || '/' || CAST(user_id AS VARCHAR) AS http_path,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms,
    CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'low' END AS slo_class,
    CASE WHEN k >= 95 THEN 'fail' ELSE 'success' END AS result
  FROM (SELECT event_id, ts AS event_time, user_id, event_type, value,
               CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)
)"""

RAW = E + r""",
raw AS (
  SELECT event_id, event_time, k, event_type, value, status_code, http_method, http_path, user_id, duration_ms,
    CAST(cents // 10000 AS VARCHAR) || '.' || lpad(CAST(cents % 10000 AS VARCHAR), 4, '0') AS request_duration,
    CASE WHEN k % 5 <> 0 THEN 'ref' || CAST(k % 7 AS VARCHAR) END AS referer,
    http_method || ':/api/' || event_type AS event_key,
    event_type = 'purchase' AND k % 3 = 0 AS own,
    slo_class
  FROM e
)"""

# Classification: own, learned, exact, regular expression.
CLASSIFIED = RAW + r""",
learned AS (
  SELECT *,
    last_value(CASE WHEN own THEN slo_class END IGNORE NULLS) OVER before AS learned_class,
    count(*) OVER before > 0 AS seen
  FROM raw
  WINDOW before AS (PARTITION BY event_key ORDER BY event_time, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
staged AS (
  SELECT *,
    CASE WHEN own THEN 'own'
         WHEN learned_class IS NOT NULL THEN 'learned'
         WHEN event_key IN ('POST:/api/signup', 'POST:/api/error') THEN 'exact'
         WHEN http_method = 'GET' THEN 'regexp' ELSE '' END AS src
  FROM learned
),
classified AS (
  SELECT event_id, event_time, event_key, src, k, event_type, value, status_code, http_method, request_duration,
    duration_ms, http_path, referer,
    CASE src WHEN 'own' THEN NULL WHEN 'learned' THEN 'exact' WHEN 'exact' THEN 'exact'
      WHEN 'regexp' THEN CASE WHEN seen THEN 'exact' ELSE 'regexp' END ELSE '' END AS classified_by,
    CASE src WHEN 'own' THEN 'shop' WHEN 'learned' THEN 'shop'
      WHEN 'exact' THEN CASE event_type WHEN 'signup' THEN 'signup' ELSE 'shop' END
      WHEN 'regexp' THEN 'browse' END AS domain,
    CASE src WHEN 'own' THEN 'api' WHEN 'learned' THEN 'api' WHEN 'exact' THEN 'web' WHEN 'regexp' THEN 'web' END AS app,
    CASE src WHEN 'own' THEN slo_class WHEN 'learned' THEN learned_class
      WHEN 'exact' THEN CASE event_type WHEN 'signup' THEN 'critical' ELSE 'low' END
      WHEN 'regexp' THEN 'low' END AS class
  FROM staged
)"""

# Rules: one SELECT per rule; labels as text pieces in the order of their names.
SLO = CLASSIFIED + r""",
slo AS (
  SELECT *, 0 AS rule, CASE WHEN CAST(status_code AS DOUBLE) > 499 THEN 'fail' ELSE 'success' END AS result,
    '' AS le, 'production' AS namespace, 'availability' AS slo_type
  FROM classified WHERE domain IS NOT NULL
  UNION ALL
  SELECT *, 1, CASE WHEN duration_ms > 3000 OR status_code = '503' THEN 'fail' ELSE 'success' END,
    'le="3.0",', 'production', 'latency90'
  FROM classified WHERE class = 'critical' AND http_method = 'POST'
  UNION ALL
  SELECT *, 2, CASE WHEN CAST(request_duration AS DOUBLE) >= 4.5 THEN 'fail' ELSE 'success' END,
    '', 'test', 'latency99'
  FROM classified WHERE domain = 'browse' AND class = 'low'
)"""

CAPPED = SLO + r""",
first_seen AS (SELECT event_key AS fk, min((event_time, event_id, rule)) AS f FROM slo GROUP BY 1),
admitted AS (SELECT fk FROM first_seen ORDER BY f LIMIT 4),
capped AS (
  SELECT slo.* REPLACE (CASE WHEN fk IS NULL THEN 'cardinalityLimitExceeded' ELSE event_key END AS event_key),
    fk IS NULL AS key_capped
  FROM slo LEFT JOIN admitted ON event_key = fk
)"""


def _levels(source: str = "slo") -> str:
    """Counter rows: sums per level, both results, labels as text sorted by name."""
    parts = []
    names = ["domain", "class", "app", "event_key"]
    metric = ["slo_domain", "slo_class", "slo_app", "event_key"]
    for level in range(1, 5):
        keys = ", ".join(names[:level])
        text = []
        if level >= 4:
            text.append("'event_key=\"' || event_key || '\",'")
        text.append("le || 'namespace=\"' || namespace || '\",result=\"' || r || '\"'")
        if level >= 3:
            text.append("',slo_app=\"' || app || '\"'")
        if level >= 2:
            text.append("',slo_class=\"' || class || '\"'")
        text.append("',slo_domain=\"' || domain || '\",slo_type=\"' || slo_type || '\",slo_version=\"1\"'")
        parts.append(
            f"SELECT {level} AS level, '{'_'.join(metric[:level])}:slo_events_total' AS metric, "
            f"{' || '.join(text)} AS labels, CAST(count(*) FILTER (result = r) AS DOUBLE) AS value, r, "
            f"{keys}, le, namespace, slo_type "
            f"FROM {source}, (VALUES ('success'), ('fail')) AS results(r) "
            f"GROUP BY {keys}, le, namespace, slo_type, r"
        )
    return " UNION ALL ".join(f"(SELECT level, metric, labels, value FROM ({p}))" for p in parts)


_COUNTERS = f"counters AS ({_levels()})"


_SHOWN = "'httpPath=\"' || x.http_path || '\"' || coalesce(',referer=\"' || x.referer || '\"', '')"


def _exemplars(source: str = "slo", shown: str = _SHOWN) -> str:
    """Per level the counters with the latest event of each label set and result."""
    parts = []
    for level in range(1, 5):
        keys = ["domain", "class", "app", "event_key"][:level]
        labels = "'event_key=\"' || b.event_key || '\",' || " if level == 4 else ""
        labels += "b.le || 'namespace=\"' || b.namespace || '\",result=\"' || r || '\"'"
        labels += " || ',slo_app=\"' || b.app || '\"'" if level >= 3 else ""
        labels += " || ',slo_class=\"' || b.class || '\"'" if level >= 2 else ""
        labels += " || ',slo_domain=\"' || b.domain || '\",slo_type=\"' || b.slo_type || '\",slo_version=\"1\"'"
        by = ", ".join([*keys, "le", "namespace", "slo_type"])
        on = " AND ".join(f"b.{key} = l.{key}" for key in by.split(", "))
        metric = "_".join(["slo_domain", "slo_class", "slo_app", "event_key"][:level])
        parts.append(
            f"""(SELECT '{metric}:slo_events_total' AS metric, {labels} AS labels, b.value,
  l.id AS exemplar_id, CASE WHEN l.id IS NOT NULL THEN 1.0 END AS exemplar_value,
  {shown} AS exemplar_labels
FROM (
  SELECT {by}, r, CAST(count(*) FILTER (result = r) AS DOUBLE) AS value
  FROM {source}, (VALUES ('success'), ('fail')) AS results(r) GROUP BY ALL
) b LEFT JOIN (SELECT {by}, result, arg_max(event_id, (event_time, event_id)) AS id FROM {source} GROUP BY ALL) l
  ON {on} AND b.r = l.result LEFT JOIN raw x ON x.event_id = l.id)"""
        )
    return " UNION ALL ".join(parts)


def _counter_level(level: int | None) -> str:
    where = f"WHERE level = {level}" if level else ""
    return f"WITH {SLO}, {_COUNTERS} SELECT metric, labels, value FROM counters {where}"


SAMPLES = E + r""",
per_minute AS (
  SELECT event_type, result, CAST(ceil(epoch_us(event_time) / 60000000.0) AS BIGINT) * 60 AS sec, count(*) AS growth
  FROM e GROUP BY ALL
),
samples AS (
  SELECT event_type, result, sec,
    CAST(sum(growth) OVER (PARTITION BY event_type, result, sec // 604800 ORDER BY sec) AS DOUBLE) AS value
  FROM per_minute
)"""

_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"

_ACCESS_COMMON = r"""
  event_type AS route,
  strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS started,
  CASE WHEN k % 5 <> 0 THEN CAST(duration_ms AS VARCHAR) || CASE WHEN duration_ms = 0 THEN 'ns' ELSE '000000ns' END END AS last_rx,
  CASE WHEN k % 4 <> 0 THEN '10.0.0.' || CAST(user_id % 256 AS VARCHAR) END AS remote,
  CASE WHEN k % 4 <> 0 THEN CAST(user_id + 1000 AS VARCHAR) END AS port,
  regexp_replace(CAST(value AS VARCHAR), '\.0$', '') AS sample_rate,
  CAST(1.0 AS DOUBLE) AS quantity
"""

_MESSAGE_KINDS = "event_id % 20 NOT IN (1, 2, 3, 4, 7, 8)"

_LABEL_KEYS = r"""
  list_aggregate(list_filter([CASE WHEN {d} THEN 'duration' END, CASE WHEN {d} THEN 'endpoint' END,
    CASE WHEN {h} THEN 'httpMethod' END, CASE WHEN {h} THEN 'httpPath' END,
    CASE WHEN {h} THEN CASE WHEN referer IS NOT NULL THEN 'referer' END END,
    CASE WHEN {d} THEN 'requestDuration' END, CASE WHEN {d} THEN 'statusCode' END,
    CASE WHEN {d} THEN 'userId' END], lambda x: x IS NOT NULL), 'string_agg', ',')
"""

_PREDICATES = {
    "isEqualTo": "coalesce(referer = 'ref3', false)",
    "isNotEqualTo": "coalesce(referer <> 'ref3', false)",
    "isMatchingRegexp": r"regexp_matches(http_path, '/1\d$')",
    "isNotMatchingRegexp": "coalesce(NOT regexp_matches(referer, 'f[0-3]'), false)",
    "numberIsEqualTo": "status_code = '404'",
    "numberIsNotEqualTo": "status_code <> '200'",
    "numberIsHigherThan": "CAST(request_duration AS DOUBLE) > 0.75",
    "numberIsEqualOrHigherThan": "CAST(status_code AS DOUBLE) >= 404",
    "numberIsEqualOrLessThan": "coalesce(TRY_CAST(referer AS DOUBLE) <= 5, false)",
    "durationIsHigherThan": "duration_ms > 1500",
}

WEIGHTS = r"""
counted AS (
  SELECT CAST(floor(epoch_us(event_time) / 600000000.0) AS BIGINT) AS n, domain, class, count(*) AS c
  FROM {source} WHERE domain IS NOT NULL GROUP BY ALL
),
weights AS (
  SELECT n + d AS interval_no, domain, class, CAST(sum(c) AS DOUBLE) AS weight
  FROM counted, range(1, 13) AS r(d) GROUP BY ALL
)"""

DEFINED = r"""
stable(slo_domain, slo_version, namespace, team, enabled, escalate, value) AS (VALUES
  ('click', '1', 'production', 'team.click@example.org', 'true', 'sre@example.org', CAST(1 AS DOUBLE)),
  ('error', '1', 'production', 'team.error@example.org', 'true', 'sre@example.org', 1),
  ('purchase', '1', 'test', 'team.purchase@example.org', 'true', NULL, 1),
  ('signup', '1', 'production', 'team.signup@example.org', 'false', 'sre@example.org', 1),
  ('view', '1', 'test', 'team.view@example.org', 'true', 'sre@example.org', 1)
),
thresholds(slo_domain, slo_version, namespace, slo_class, slo_type, le, percentile, value) AS (VALUES
  ('click', '1', 'production', 'critical', 'availability', NULL, NULL, CAST(0.95 AS DOUBLE)),
  ('click', '1', 'production', 'critical', 'latency90', '0.6', '90', 0.9),
  ('click', '1', 'production', 'low', 'availability', NULL, NULL, 0.9),
  ('error', '1', 'production', 'critical', 'availability', NULL, NULL, 0.97),
  ('error', '1', 'production', 'critical', 'latency90', NULL, NULL, 0.85),
  ('error', '1', 'production', 'low', 'availability', NULL, NULL, 1),
  ('purchase', '1', 'test', 'critical', 'availability', NULL, NULL, 0.96),
  ('purchase', '1', 'test', 'low', 'availability', NULL, NULL, 0.8),
  ('signup', '1', 'production', 'critical', 'availability', NULL, NULL, 0.99),
  ('signup', '1', 'production', 'low', 'availability', NULL, NULL, 0.95)
),
burn(slo_domain, class, type, slo_time_range, value) AS (VALUES
  ('click', '', '', '1h', CAST(13.44 AS DOUBLE)), ('click', '', '', '6h', 5.6), ('click', '', '', '1d', 2.8), ('click', '', '', '3d', 1),
  ('signup', '', '', '1h', 13.44), ('signup', '', '', '6h', 5.6), ('signup', '', '', '1d', 2.8), ('signup', '', '', '3d', 1),
  ('error', 'critical', '', '1h', 0.5), ('error', '', 'availability', '6h', 0.8), ('error', '', '', '1d', 0.9),
  ('error', 'low', 'availability', '3d', 0.7),
  ('purchase', '', '', '1h', 0.2), ('purchase', '', '', '6h', 0.3), ('purchase', '', '', '1d', 0.4), ('purchase', '', '', '3d', 0.5)
),
burn_limits AS (
  SELECT t.slo_domain, t.slo_version, t.namespace, t.slo_class, t.slo_type, b.slo_time_range, b.value
  FROM thresholds t JOIN burn b ON t.slo_domain = b.slo_domain
    AND b.class IN ('', t.slo_class) AND b.type IN ('', t.slo_type)
)"""

_LABELS = "namespace, slo_class, slo_domain, slo_type, slo_version"
_SEEN = E + f""",
increments AS (
  SELECT CASE WHEN event_type IN ('purchase', 'view') THEN 'test' ELSE 'production' END AS namespace, slo_class,
    event_type AS slo_domain, 'availability' AS slo_type, '1' AS slo_version, result, CAST(1 + k % 7 AS DOUBLE) AS quantity, event_time
  FROM e
),
seen AS (
  SELECT {_LABELS}, sum(quantity) AS total, coalesce(sum(quantity) FILTER (result = 'fail'), 0) AS fail FROM increments GROUP BY ALL
), {DEFINED}"""

_STAGE_COUNTS = {
    ("lines", "lines_read"): "count(*)",
    ("lines", "malformed"): "count(*) FILTER (event_id % 17 = 0)",
    ("events after tailer", "events"): "count(*) FILTER (event_id % 17 <> 0)",
    ("rename_collisions", "collisions"): "count(*) FILTER (event_id % 17 <> 0 AND status_code <> '404' AND referer IS NOT NULL)",
    **{
        (f"events after {stage}", "events"): "count(*) FILTER (event_id % 17 <> 0 AND status_code <> '404')"
        for stage in ("relabel", "eventMetadataRenamer", "eventKeyGenerator", "metadataClassifier")
    },
}

ORACLE = {
    "stages_events": f"""WITH {RAW}
SELECT event_id, CAST(1.0 AS DOUBLE) AS quantity, http_method AS domain, '/api/' || event_type AS app, status_code AS class,
  CAST(duration_ms AS VARCHAR) AS seconds, event_key,
  CASE WHEN referer IS NOT NULL THEN '10.0.0.' || CAST(user_id % 256 AS VARCHAR) END AS ip
FROM raw WHERE event_id % 17 <> 0 AND status_code <> '404'""",
    "stages_reports": f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT '{report}' AS report, '{name}' AS name, {count} AS value FROM raw" for (report, name), count in _STAGE_COUNTS.items()
    ),
    "log_parse": f"""WITH {E}
SELECT event_id, CAST(1.0 AS DOUBLE) AS quantity, '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS ip,
  strftime(event_time, '%Y-%m-%d %H:%M:%S') AS "time", http_method AS "httpMethod", http_path AS "httpPath",
  status_code AS "statusCode", CASE WHEN k % 5 <> 0 THEN 'ref' || CAST(k % 7 AS VARCHAR) END AS referer,
  CAST(duration_ms AS VARCHAR) AS "requestDuration"
FROM e WHERE event_id % 17 <> 0""",
    "log_malformed": f"""WITH {E}
SELECT event_id, '10.0.0.' || CAST(user_id % 256 AS VARCHAR) || ' - [' || strftime(event_time, '%Y-%m-%d %H:%M:%S')
  || '] "??? ' || http_path || '" ' || status_code || ' "'
  || CASE WHEN k % 5 = 0 THEN '-' ELSE 'ref' || CAST(k % 7 AS VARCHAR) END
  || '" rt="' || CAST(duration_ms AS VARCHAR) || '"' AS value
FROM e WHERE event_id % 17 = 0""",
    "kafka_decode": f"""WITH {E}
SELECT event_id, CASE WHEN event_id % 20 IN (5, 6) THEN 1.0 WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE 1.0 END AS quantity,
  CASE WHEN event_id % 20 NOT IN (5, 6) THEN http_path END AS path,
  CASE WHEN event_id % 20 NOT IN (5, 6) THEN status_code END AS code,
  CASE WHEN event_id % 20 NOT IN (5, 6) AND k % 3 = 0 THEN event_type END AS domain,
  CASE WHEN event_id % 20 NOT IN (5, 6) AND k % 3 = 0 THEN 'web' END AS app,
  CASE WHEN event_id % 20 NOT IN (5, 6) AND k % 3 = 0 THEN slo_class END AS class
FROM e WHERE {_MESSAGE_KINDS}""",
    "kafka_malformed": f"SELECT event_id FROM events WHERE NOT ({_MESSAGE_KINDS})",
    "access_log_http": f"""WITH {E}
SELECT event_id, CAST(part AS BIGINT) AS entry, {_ACCESS_COMMON},
  CAST(26 - CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END
    + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_keys,
  http_path || CASE WHEN part = 1 THEN '/b' ELSE '' END AS path, http_method AS method, 'HTTP11' AS protocol,
  status_code AS code, CAST(k AS VARCHAR) AS body_bytes, CAST(user_id AS VARCHAR) AS header,
  CAST(user_id AS VARCHAR) AS sent_header, CASE WHEN k % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS sent_trailer
FROM e, range(2) AS parts(part) WHERE event_id % 10 < 7""",
    "access_log_tcp": f"""WITH {E}
SELECT event_id, CAST(0 AS BIGINT) AS entry, {_ACCESS_COMMON},
  CAST(10 - CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_keys,
  CAST(k AS VARCHAR) AS received, CAST(user_id AS VARCHAR) AS sent
FROM e WHERE event_id % 10 IN (7, 8)""",
    "access_log_unknown": "SELECT event_id FROM events WHERE event_id % 10 = 9",
    "samples_simple": f"""WITH {SAMPLES}
SELECT event_type AS type, result, CAST(NULL AS VARCHAR) AS name,
  {_NUMBER.format('value')} AS query_result, 'now' AS "time", 'metrics' AS source, sec, CAST(1.0 AS DOUBLE) AS quantity
FROM samples""",
    "samples_quantity": f"""WITH {SAMPLES}
SELECT event_type AS type, result, sec, value - 3 AS quantity FROM samples WHERE value > 3""",
    "select_labels": f"""WITH {SAMPLES}
SELECT event_type AS type, result, sec, value FROM samples
WHERE event_type IN ('view', 'click') AND result <> 'fail'""",
    "instant_poll": f"""WITH {SAMPLES},
bounds AS (SELECT min(sec) AS lo, max(sec) AS hi FROM samples),
polls AS (SELECT unnest(range(CAST(ceil(lo / 600.0) AS BIGINT) * 600, hi // 600 * 600 + 1, 600)) AS poll FROM bounds),
pairs AS (
  SELECT event_type, result, poll - 60 AS sec, max(sec) AS latest
  FROM samples JOIN polls ON sec BETWEEN poll - 60 - 300 AND poll - 60 GROUP BY ALL
)
SELECT p.event_type AS type, p.result, p.sec, s.value FROM pairs p
JOIN samples s ON s.event_type = p.event_type AND s.result = p.result AND s.sec = p.latest""",
    "relabel_replace": f"""WITH {RAW}
SELECT event_id, '/api/' || event_type || '/0' AS path,
  http_method || '-' || substr(status_code, 1, 1) || 'xx-' AS joined,
  CASE WHEN referer NOT IN ('ref1', 'ref2') THEN referer END AS referer, CAST(NULL AS VARCHAR) AS unused
FROM raw""",
    "relabel_keep": f"""WITH {RAW}
SELECT event_id, status_code AS code, http_method AS method FROM raw
WHERE status_code IN ('404', '503') AND http_method = 'POST'""",
    "relabel_drop": f"WITH {RAW} SELECT event_id, status_code AS code FROM raw WHERE status_code <> '404'",
    "relabel_labelmap": f"""WITH {RAW}
SELECT event_id, http_method AS method, http_path AS path, http_method AS old FROM raw""",
    "relabel_labeldrop": f"WITH {RAW} SELECT event_id, {_LABEL_KEYS.format(d='true', h='false')} AS keys FROM raw",
    "relabel_labelkeep": f"WITH {RAW} SELECT event_id, {_LABEL_KEYS.format(d='false', h='true')} AS keys FROM raw",
    "relabel_hashmod": f"""WITH {RAW}
SELECT event_id, CAST(CAST('0x' || substr(md5(http_path || ';' || coalesce(referer, '')), 17, 16) AS UBIGINT) % 16 AS VARCHAR) AS shard
FROM raw""",
    "relabel_url": r"""WITH parts AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
    nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page,
    regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, page, regexp_replace(path, '^/(\w+)/\d+(.*)$', '/\1/0\2') AS path FROM parts""",
    "rename_keys": f"""WITH {RAW}
SELECT event_id, CAST(CASE WHEN referer IS NULL THEN 0 ELSE 1 END AS BIGINT) AS collisions,
  CAST(NULL AS VARCHAR) AS http_path, CAST(NULL AS VARCHAR) AS path, http_path AS route, referer,
  CAST(user_id AS VARCHAR) AS "user" FROM raw""",
    "event_key": f"WITH {RAW} SELECT event_id, coalesce(referer, event_key) AS event_key FROM raw",
    "classify_metadata": f"""WITH {RAW}
SELECT event_id, http_method AS domain, '/api/' || event_type AS app,
  coalesce(referer, CASE WHEN own THEN slo_class END, status_code) AS class, CAST(1 AS INT) AS classified FROM raw""",
    "drop_unclassified": f"""WITH {RAW}
SELECT event_id, 'shop' AS domain, 'api' AS app, slo_class AS class,
  CASE WHEN slo_class = 'low' THEN 1 ELSE 0 END AS shop_low FROM raw WHERE own""",
    **{
        f"pred_{name}": f"WITH {RAW} SELECT event_id, CAST({condition} AS INT) AS holds FROM raw"
        for name, condition in _PREDICATES.items()
    },
    "class_exact": f"""WITH {RAW}
SELECT event_id, event_key,
  CASE WHEN own THEN 'shop' WHEN event_type = 'signup' THEN 'signup' WHEN event_type = 'error' THEN 'shop' END AS domain,
  CASE WHEN own THEN 'api' WHEN event_type IN ('signup', 'error') THEN 'web' END AS app,
  CASE WHEN own THEN slo_class WHEN event_type = 'signup' THEN 'critical' WHEN event_type = 'error' THEN 'low' END AS class
FROM raw""",
    "class_regexp": f"""WITH {RAW}
SELECT event_id, CASE WHEN own THEN 'shop' WHEN http_method = 'GET' THEN 'browse' END AS domain,
  CASE WHEN own THEN 'api' WHEN http_method = 'GET' THEN 'web' END AS app,
  CASE WHEN own THEN slo_class WHEN http_method = 'GET' THEN 'low' END AS class FROM raw""",
    "class_many_patterns": f"""WITH {RAW}, keyed AS (SELECT *, CAST(user_id AS VARCHAR) AS key FROM raw),
matched AS (SELECT *, CASE WHEN NOT own AND regexp_matches(key, '^[0-9]*[0-9][0-9][0-3]$') THEN
  'd' || CAST(CAST(reverse(right(key, 3)) AS INT) AS VARCHAR) END AS found FROM keyed)
SELECT event_id, CASE WHEN own THEN 'shop' ELSE found END AS domain,
  CASE WHEN own THEN 'api' WHEN found IS NOT NULL THEN 'web' END AS app,
  CASE WHEN own THEN slo_class WHEN found IS NOT NULL THEN 'low' END AS class FROM matched""",
    "class_pattern_table": f"""WITH {RAW}
SELECT event_id, CASE WHEN own THEN 'shop' WHEN event_type IN ('view', 'click') THEN 'u' || CAST(user_id % 10 AS VARCHAR) ELSE 'rest' END AS domain,
  CASE WHEN own THEN 'api' ELSE 'web' END AS app,
  CASE WHEN own THEN slo_class WHEN event_type IN ('view', 'click') THEN 'low' ELSE 'high' END AS class FROM raw""",
    "class_learned": f"""WITH {CLASSIFIED}
SELECT event_id, CASE WHEN src IN ('own', 'learned') THEN domain END AS domain,
  CASE WHEN src IN ('own', 'learned') THEN app END AS app,
  CASE WHEN src IN ('own', 'learned') THEN class END AS class FROM classified""",
    "class_dynamic": f"WITH {CLASSIFIED} SELECT event_id, classified_by, domain, app, class FROM classified",
    "class_report": f"""WITH {CLASSIFIED},
reduced AS (
  SELECT *, CASE WHEN src = 'exact' AND event_type = 'error' THEN '' ELSE classified_by END AS cb
  FROM classified WHERE src <> 'own'
)
SELECT CASE WHEN cb = '' THEN 'unclassified' ELSE 'classified' END AS result, cb AS classified_by,
  CASE WHEN cb = '' THEN http_method ELSE '' END AS metadata_http_method,
  CASE WHEN cb = '' THEN status_code ELSE '' END AS metadata_status_code, count(*) AS events
FROM reduced GROUP BY ALL""",
    "matcher_dump": f"""WITH {CLASSIFIED},
ranked AS (
  SELECT domain || ',' || app || ',' || class || ',' || event_key AS line, event_key,
    row_number() OVER (PARTITION BY event_key ORDER BY src = 'own' DESC, event_time DESC, event_id DESC) AS n
  FROM classified WHERE domain IS NOT NULL
)
SELECT line FROM ranked WHERE n = 1
UNION ALL
SELECT line FROM (VALUES ('signup,web,critical,POST:/api/signup', 'POST:/api/signup'),
                         ('shop,web,low,POST:/api/error', 'POST:/api/error')) AS given(line, key)
WHERE key NOT IN (SELECT event_key FROM ranked)""",
    "class_weights": f"""WITH {CLASSIFIED},
minutes AS (
  SELECT CAST(floor(epoch_us(event_time) / 60000000.0) AS BIGINT) AS n, domain, class, count(*) AS c
  FROM classified WHERE domain IS NOT NULL GROUP BY ALL
),
points AS (SELECT domain, class, n + 1 AS since FROM minutes UNION SELECT domain, class, n + 1441 FROM minutes),
pieces AS (SELECT *, lead(since) OVER (PARTITION BY domain, class ORDER BY since) AS until FROM points)
SELECT p.domain, p.class, since, until, CAST(sum(c) AS DOUBLE) AS weight
FROM pieces p JOIN minutes m ON m.domain = p.domain AND m.class = p.class AND m.n BETWEEN since - 1440 AND since - 1
GROUP BY ALL""",
    "class_statistical": f"""WITH {RAW},
owned AS (SELECT *, CASE WHEN own THEN 'shop' END AS domain, CASE WHEN own THEN slo_class END AS class FROM raw),
{WEIGHTS.format(source='owned')},
upto AS (
  SELECT *, sum(weight) OVER (PARTITION BY interval_no ORDER BY domain, class) AS upto,
    sum(weight) OVER (PARTITION BY interval_no) AS total FROM weights
),
drawn AS (
  SELECT event_id, own, slo_class, CAST(floor(epoch_us(event_time) / 600000000.0) AS BIGINT) AS n,
    CAST(CAST('0x' || substr(md5('0|' || CAST(event_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM owned
),
picked AS (
  SELECT event_id, min(upto) AS upto, n FROM drawn JOIN upto ON n = interval_no AND upto > u * total
  WHERE NOT own GROUP BY event_id, n
)
SELECT d.event_id, CASE WHEN own THEN 'increased-weight' ELSE 'classified' END AS statistical_result,
  CASE WHEN own THEN 'shop' WHEN w.domain IS NOT NULL THEN w.domain WHEN u * 4 < 3 THEN 'default' ELSE 'other' END AS domain,
  CASE WHEN own THEN 'api' ELSE 'statistically-guessed' END AS app,
  CASE WHEN own THEN slo_class WHEN w.class IS NOT NULL THEN w.class WHEN u * 4 < 3 THEN 'low' ELSE 'high' END AS class
FROM drawn d LEFT JOIN picked p ON d.event_id = p.event_id
LEFT JOIN upto w ON w.interval_no = p.n AND w.upto = p.upto""",
    "rules_fanout": f"""WITH {SLO}
SELECT event_id, CAST(rule AS BIGINT) AS rule, event_key, result, domain AS slo_domain, class AS slo_class, app AS slo_app,
  le || 'namespace="' || namespace || '",slo_type="' || slo_type || '",slo_version="1"' AS labels,
  CAST(1.0 AS DOUBLE) AS quantity FROM slo""",
    "slo_labels": f"""WITH {SLO}
SELECT event_id, CAST(rule AS BIGINT) AS rule,
  'event_key="' || event_key || '",' || le || 'namespace="' || namespace || '",result="' || result || '",slo_app="' || app
  || '",slo_class="' || class || '",slo_domain="' || domain || '",slo_type="' || slo_type || '",slo_version="1"' AS labels
FROM slo""",
    "counters_domain": _counter_level(1),
    "counters_class": _counter_level(2),
    "counters_app": _counter_level(3),
    "counters_key": _counter_level(4),
    "counters_all": _counter_level(None),
    "zero_init": f"""WITH {SLO}
SELECT event_key, domain AS slo_domain, CAST(rule AS BIGINT) AS rule, r AS result,
  CAST(count(*) FILTER (result = r) AS DOUBLE) AS value
FROM slo, (VALUES ('success'), ('fail')) AS results(r) GROUP BY ALL""",
    "string_map_fns": f"""WITH {RAW}
SELECT event_id,
  CASE WHEN referer IS NULL THEN '' ELSE 'referer="' || referer || '",' END || 'statusCode="x",y="z"' AS merged,
  'referer="r",statusCode="' || status_code || '"' AS with_key,
  CASE WHEN referer IS NULL THEN '' ELSE referer || '|' END || status_code AS by_keys,
  CAST(1 AS INT) AS sub, CAST(coalesce(status_code = '200' AND referer = 'ref1', false) AS INT) AS sub_literal,
  'httpmethod="' || lower(http_method) || '"' AS lowered,
  'endpoint,' || CASE WHEN referer IS NULL THEN '' ELSE 'referer,' END || 'requestDuration,statusCode,userId' AS without,
  'n="",' || CASE WHEN referer IS NULL THEN '' ELSE 'referer="' || referer || '",' END || 'statusCode=""' AS added,
  CASE WHEN own THEN 'shop:api:' || slo_class ELSE '' END AS class_text,
  CASE WHEN own THEN 'app="api",slo_class="' || slo_class || '",slo_domain="shop"' ELSE '' END AS class_map,
  'slo_domain_slo_class:slo_events_total' AS metric, 'metadata_status_code' AS label FROM raw""",
    "scalar_fns": f"""WITH {RAW}
SELECT event_id, CAST(request_duration AS DOUBLE) AS seconds, CAST(NULL AS DOUBLE) AS not_a_number,
  duration_ms * 1000000 AS nanoseconds, status_code AS number,
  CASE WHEN user_id = 0 THEN '0' ELSE
    regexp_replace(substr(CAST(user_id AS VARCHAR), 1, 1) || '.' || substr(CAST(user_id AS VARCHAR), 2), '\\.0*$|(\\.\\d*?)0+$', '\\1')
    || 'e+' || lpad(CAST(5 + length(CAST(user_id AS VARCHAR)) AS VARCHAR), 2, '0') END AS large,
  event_type || ':' || CAST(user_id AS VARCHAR) || '!$' AS expanded,
  CAST(event_type = 'view' AS INT) AS is_view FROM raw""",
    "quality_stats": f"""WITH {CLASSIFIED}
SELECT count(*) AS events, count(*) FILTER (src IN ('exact', '')) AS unclassified,
  count(*) FILTER (src IN ('own', 'learned') AND class <> 'critical') AS not_matching_any_rule
FROM classified""",
    "cap_keys": f"""WITH {CAPPED}
SELECT event_key, CAST(key_capped AS INT) AS key_capped, count(*) AS events, min(event_id) AS first_id
FROM capped GROUP BY ALL""",
    "capped_counters": f"""WITH {CAPPED}, counters AS ({_levels('capped')})
SELECT metric, labels, value FROM counters""",
    "event_key_stats": f"""WITH {SLO}
SELECT least(count(DISTINCT event_key), 4) AS event_keys, CAST(4 AS BIGINT) AS event_keys_limit FROM slo""",
    "exemplars": f"WITH {SLO} {_exemplars()}",
    "exposition": f"""WITH {SLO}, {_COUNTERS}
SELECT metric || '{{' || labels || '}} ' || CASE WHEN value < 1000000 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) END AS line
FROM counters""",
    "rule_thresholds": f"""WITH {SLO},
t(slo_type, operator, labels, threshold) AS (VALUES
  ('availability', 'numberIsHigherThan',
   'namespace="production",operator="numberIsHigherThan",slo_type="availability",slo_version="1"', CAST(499 AS DOUBLE)),
  ('latency99', 'numberIsEqualOrHigherThan',
   'namespace="test",operator="numberIsEqualOrHigherThan",slo_type="latency99",slo_version="1"', 4.5)),
measured AS (
  SELECT t.*, slo.result, CAST(CASE t.slo_type WHEN 'availability' THEN status_code ELSE request_duration END AS DOUBLE) AS number
  FROM t JOIN slo ON slo.slo_type = t.slo_type
)
SELECT slo_type, operator, labels, threshold, result, count(*) AS events, count(*) FILTER (number > threshold) AS above
FROM measured GROUP BY ALL""",
    "stable_version": f"""WITH {_SEEN},
domains AS (SELECT slo_domain, namespace, slo_version, sum(total) AS total FROM seen GROUP BY ALL)
SELECT slo_domain, namespace, slo_version, team, enabled, coalesce(total, 0) AS total,
  CASE WHEN team IS NULL THEN 'undefined' WHEN total IS NULL THEN 'silent' WHEN enabled = 'false' THEN 'disabled' ELSE 'watched' END AS state
FROM stable FULL JOIN domains USING (slo_domain, namespace, slo_version)""",
    "ratio_thresholds": f"""WITH {_SEEN}
SELECT {_LABELS}, value AS threshold, coalesce(total, 0) AS total, coalesce(fail, 0) AS fail, round(1 - fail / total, 9) AS measured,
  CAST(1 - fail / total >= value AS INT) AS met
FROM thresholds FULL JOIN seen USING ({_LABELS})""",
    "burn_thresholds": f"""WITH {_SEEN},
spans(slo_time_range, seconds) AS (VALUES ('1h', CAST(3600 AS BIGINT)), ('6h', 21600), ('1d', 86400), ('3d', 259200)),
ends AS (SELECT max(event_time) AS latest FROM e),
recent AS (
  SELECT {_LABELS}, slo_time_range, sum(quantity) AS total, coalesce(sum(quantity) FILTER (result = 'fail'), 0) AS fail
  FROM increments, spans, ends WHERE epoch_us(event_time) > epoch_us(latest) - seconds * 1000000 GROUP BY ALL
)
SELECT {_LABELS}, slo_time_range, b.value AS burn_limit, coalesce(total, 0) AS total,
  round(fail / total / (1 - t.value), 9) AS burn, CAST(fail / total / (1 - t.value) > b.value AS INT) AS exceeded
FROM burn_limits b JOIN thresholds t USING ({_LABELS}) LEFT JOIN recent USING ({_LABELS}, slo_time_range) WHERE t.value < 1""",
}
