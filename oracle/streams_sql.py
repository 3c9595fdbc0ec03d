"""DuckDB SQL with the expected results of ``sloflow.queries.streams``."""

from oracle.events_sql import CLASSIFIED, E, ORACLE as EVENTS, RAW, SLO, _exemplars, _levels
from oracle.series_sql import ORACLE as SERIES

# All rules over events whose class comes from their method and user.
_OWN = RAW + r""",
classified AS (
  SELECT event_id, event_time, event_key, http_path, http_method, status_code, duration_ms, request_duration,
    CASE http_method WHEN 'GET' THEN 'browse' ELSE 'shop' END AS domain, '/api/' || event_type AS app,
    CASE WHEN user_id % 2 = 0 THEN 'critical' ELSE 'low' END AS class FROM raw
)""" + SLO.removeprefix(CLASSIFIED)

ORACLE = {
    "stages_stream": EVENTS["stages_events"],
    "stages_stream_learned": f"""WITH {RAW}
SELECT event_id, http_method AS domain, '/api/' || event_type AS app,
  coalesce(referer, last_value(referer IGNORE NULLS) OVER (
    PARTITION BY event_key ORDER BY date_trunc('second', event_time), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), '') AS class
FROM raw WHERE event_id % 17 <> 0 AND status_code <> '404'""",
    "stream_parse": f"""WITH {_OWN}
SELECT event_id, CAST(rule AS BIGINT) AS rule, event_key, result, domain AS slo_domain, class AS slo_class, 1.0 AS quantity FROM slo""",
    "stream_learned": EVENTS["class_dynamic"],
    "stream_counters": f"WITH {_OWN}, counters AS ({_levels()}) SELECT metric, labels, value FROM counters",
    "stream_cap": f"""WITH {_OWN},
admitted AS (SELECT http_path AS p FROM slo GROUP BY 1 ORDER BY min((event_time, event_id, rule)) LIMIT 4)
SELECT coalesce(p, 'cardinalityLimitExceeded') AS event_key, CAST(p IS NULL AS INT) AS key_capped,
  count(*) AS events, min(event_id) AS first_id
FROM slo LEFT JOIN admitted ON http_path = p GROUP BY ALL""",
    "stream_capped_counters": f"""WITH {_OWN},
admitted AS (SELECT http_path AS p FROM slo GROUP BY 1 ORDER BY min((event_time, event_id, rule)) LIMIT 4),
capped AS (SELECT slo.* REPLACE (coalesce(p, 'cardinalityLimitExceeded') AS event_key) FROM slo LEFT JOIN admitted ON http_path = p)
{_exemplars('capped', "'httpMethod=\"' || x.http_method || '\"'")}""",
    "stream_increase": SERIES["counter_increase"],
    "stream_windows": f"""WITH {E},
ends AS (SELECT event_type, result, epoch_us(event_time) // 60000000 * 60 + 60 AS minute_end FROM e),
slides AS (
  SELECT event_type, result, (minute_end - 1) // 600 * 600 + 600 + 600 * n AS end_sec FROM ends, range(6) AS r(n)
)
SELECT end_sec - 3600 AS start_sec, end_sec, event_type, result, CAST(count(*) AS DOUBLE) AS value
FROM slides WHERE end_sec * 1000 <= (SELECT epoch_us(max(event_time)) // 1000 FROM e) - 600000 GROUP BY ALL""",
    "stream_late": f"""WITH {E},
arrived AS (
  SELECT *, least((day(event_time) - 1) // 8, 3) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS part,
    epoch_us(event_time) // 60000000 * 60 + 60 AS end_sec FROM e
),
newest AS (SELECT part, max(epoch_us(event_time) // 1000000) AS t FROM arrived GROUP BY 1),
marks AS (
  SELECT p.part, (SELECT max(t) FROM newest n WHERE n.part < p.part) - 600 AS mark FROM newest p
),
told AS (SELECT a.*, coalesce(end_sec <= mark, false) AS late FROM arrived a JOIN marks USING (part))
SELECT 'late' AS kind, event_type, CAST(part AS BIGINT) AS part, CAST(count(*) AS DOUBLE) AS value, CAST(sum(event_id) AS BIGINT) AS ids
FROM told WHERE late GROUP BY ALL
UNION ALL SELECT 'sum', event_type, CAST((end_sec - 1) // 86400 AS BIGINT), CAST(count(*) AS DOUBLE), CAST(count(*) AS BIGINT)
FROM told WHERE NOT late AND end_sec <= (SELECT max(t) FROM newest) - 600 GROUP BY ALL""",
}
