"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

FILES = r"""
ev AS (
  SELECT event_id AS e, CAST(ts AS DATE) AS d, user_id AS u, user_id // 10 AS g,
         (user_id // 10) % 3 AS k, event_type, value
  FROM events
),
fx AS (
  SELECT *,
         CASE WHEN k = 2 THEN event_type ELSE 'all' END || 'L' || CAST(u % 2 AS VARCHAR) AS ent,
         CASE WHEN k = 0 THEN 0 WHEN e % 23 = 0 THEN 1 WHEN e % 37 = 0 THEN 9 WHEN e % 41 = 0 THEN 4 ELSE 0 END AS lag_n,
         CAST(CASE WHEN k < 2 THEN 1000 + e % 50 WHEN e % 13 = 0 THEN 0 ELSE floor(value * 100) END AS BIGINT) AS n,
         CASE WHEN k = 0 THEN 0 WHEN e % 59 = 0 THEN -570 - e % 20 WHEN e % 53 = 0 THEN 540 WHEN e % 11 = 0 THEN 300 ELSE 0 END AS late_min
  FROM ev
),
f AS (
  SELECT e, d AS snapshot_day, CAST(200000 + g AS VARCHAR) AS source_id,
         CASE WHEN e % 7 = 0 THEN 'daily_' || ent || '_report.csv'
              ELSE substr(md5(CAST(e AS VARCHAR)), 1, 8) || '_' || ent || '_payments_report_' ||
                   CASE WHEN e % 29 = 0 THEN strftime(d - CAST(lag_n AS INTEGER), '%Y-%m-%d')
                        WHEN e % 31 = 0 THEN strftime(d - CAST(lag_n AS INTEGER), '%Y%m%d')
                        ELSE strftime(d - CAST(lag_n AS INTEGER), '%Y_%m_%d') END || '.csv' END AS filename,
         n AS rows,
         CASE WHEN k < 2 THEN 'processed' WHEN e % 19 = 0 THEN 'failure' WHEN e % 17 = 0 THEN 'stopped'
              WHEN e % 43 = 0 THEN 'deleted' WHEN n = 0 AND e % 2 = 0 THEN 'empty' ELSE 'processed' END AS status,
         k = 2 AND (e % 17 = 0 OR e % 47 = 0) AS is_duplicated,
         CAST(n * 64 + e % 97 AS BIGINT) AS file_size,
         CASE WHEN k <> 2 OR e % 61 <> 0 THEN CAST(d AS TIMESTAMP) + to_minutes(CAST(480 + e % 20 + late_min AS BIGINT)) END AS uploaded_at,
         CASE WHEN k < 2 THEN NULL WHEN e % 19 = 0 AND e % 2 = 0 THEN 'column structure mismatch'
              WHEN e % 19 = 0 THEN 'schema validation error' WHEN e % 17 = 0 THEN 'File duplicated' END AS status_message
  FROM fx
),
m AS (
  SELECT e, snapshot_day, 'today' AS from_period, source_id, filename, rows, status, is_duplicated, file_size, uploaded_at, status_message FROM f
  UNION ALL
  SELECT e, snapshot_day + 7, 'last_weekday', source_id, filename, rows, status, is_duplicated, file_size, uploaded_at, status_message FROM f
  WHERE snapshot_day + 7 <= (SELECT max(snapshot_day) FROM f)
),
mp AS (
  SELECT *, regexp_replace(regexp_replace(filename, '^[^_]+_', ''), '_\d{4}_\d{2}_\d{2}', '') AS literal_pattern,
         regexp_replace(regexp_replace(filename, '^[^_]+_', ''), '_?(\d{4}_\d{2}_\d{2}|\d{4}-\d{2}-\d{2}|\d{8})', '') AS pattern
  FROM m
),
t AS (SELECT * FROM mp WHERE from_period = 'today'),
l AS (SELECT * FROM mp WHERE from_period = 'last_weekday')
"""

FILE_DATE = r"""coalesce(
  CAST(try_strptime(nullif(regexp_extract(filename, '(\d{4}_\d{2}_\d{2})', 1), ''), '%Y_%m_%d') AS DATE),
  CAST(try_strptime(nullif(regexp_extract(filename, '(\d{4}-\d{2}-\d{2})', 1), ''), '%Y-%m-%d') AS DATE),
  CAST(try_strptime(nullif(regexp_extract(filename, '(\d{8})', 1), ''), '%Y%m%d') AS DATE))"""

DOCS = r"""
ents AS (SELECT g, list_sort(list(ent)) AS ents FROM (SELECT DISTINCT g, ent FROM fx) GROUP BY g),
docs AS (
  SELECT CAST(200000 + g AS VARCHAR) AS source_id,
    concat_ws(chr(10),
      CASE WHEN g % 8 = 7 THEN '#' WHEN g % 8 = 6 THEN 'Delivery profile' ELSE '# _Settlement_Layout_' || CAST(g AS VARCHAR) || '_' END,
      'Entities: ' || array_to_string(ents, ', '),
      'Expected files: [hash]_' || ents[1] || '_payments_report_YYYY_MM_DD.csv' || CASE g % 5 WHEN 2 THEN '; [hash]_onceL9_payments_report_YYYY_MM_DD.csv (weekdays)'
        WHEN 3 THEN ' (daily); [hash]_weeklyL9_report_YYYY_MM_DD.csv (Mondays)' WHEN 4 THEN ' (weekdays)' ELSE '' END,
      CASE WHEN g % 2 = 0 AND g % 10 <> 4 THEN 'Arrives 08:00-08:20 UTC' END,
      CASE WHEN g % 2 = 1 AND g % 10 <> 3 THEN 'Arrives 08:00–08:20 UTC' END,
      CASE WHEN g % 10 = 3 THEN 'Arrives 08:00–08:20 UTC or 17:00–17:30 UTC' END,
      CASE WHEN g % 3 = 0 AND g % 10 <> 4 THEN 'usual ~08:10 UTC' END,
      CASE WHEN g % 10 = 4 THEN 'usual ~08:10 UTC, sometimes usual ~13:05 UTC' END,
      CASE WHEN g % 7 = 2 THEN ents[1] || ' arrives 06:00-06:30 UTC and 12:50-13:10 UTC' END,
      CASE WHEN g % 7 = 3 THEN ents[-1] || ' usual ~13:00 UTC' END,
      CASE WHEN g % 7 = 5 THEN ents[1] || ' usual Monday 1k-2k; ' || ents[-1] || ' usual Monday 5k-90k' END,
      CASE WHEN g % 7 = 6 THEN ents[1] || ' typical range 2k-40k' END,
      CASE WHEN g % 4 = 0 THEN 'expected volume >1000 records' END,
      CASE WHEN g % 4 = 1 THEN 'usual Monday 1' || CAST(g % 5 AS VARCHAR) || 'k-2' || CAST(g % 7 AS VARCHAR) || 'k records' END,
      CASE WHEN g % 4 = 2 THEN 'typical range 5k-30k' END,
      CASE WHEN g % 4 = 3 THEN '95% confidence band: 1,211-69,600' END,
      CASE WHEN g % 5 = 1 THEN 'Not expected on: Saturday, Sunday' END,
      CASE WHEN g % 3 = 2 THEN 'Regularly empty: errorL1' END,
      CASE WHEN g % 3 = 2 THEN 'Variable arrival: signupL0' END,
      CASE WHEN g % 6 = 5 THEN 'Expected coverage: D+3' END,
      'Contact: provider desk') AS text
  FROM ents WHERE g % 9 <> 8
),
head AS (SELECT source_id, text, string_split(text, chr(10))[1] AS first_line FROM docs),
cvn AS (
  SELECT source_id, text,
    coalesce(CASE WHEN first_line LIKE '#%' THEN nullif(trim(trim(ltrim(first_line, '#')), '_'), '') END, 'Source_' || source_id) AS source_name
  FROM head
),
clause AS (
  SELECT source_id, c, nullif(regexp_extract(c, '^\s*(\S+) (?:arrives|usual|typical) ', 1), '') AS entity
  FROM (SELECT source_id, unnest(string_split_regex(text, '[;\n]')) AS c FROM docs)
),
cvw AS (
  SELECT source_id, entity,
    unnest(regexp_extract_all(c, '(\d{2}:\d{2})[-–](\d{2}:\d{2}) UTC', 1)) AS a,
    unnest(regexp_extract_all(c, '(\d{2}:\d{2})[-–](\d{2}:\d{2}) UTC', 2)) AS b
  FROM clause
),
windows AS (
  SELECT source_id, entity, CAST(substr(a, 1, 2) AS INTEGER) * 60 + CAST(substr(a, 4, 2) AS INTEGER) AS start_min,
         CAST(substr(b, 1, 2) AS INTEGER) * 60 + CAST(substr(b, 4, 2) AS INTEGER) AS end_min FROM cvw
),
usual AS (
  SELECT source_id, entity, CAST(substr(a, 1, 2) AS INTEGER) * 60 + CAST(substr(a, 4, 2) AS INTEGER) AS minute
  FROM (SELECT source_id, entity, unnest(regexp_extract_all(c, 'usual ~(\d{2}:\d{2}) UTC', 1)) AS a FROM clause)
),
rraw AS (
  SELECT source_id, entity, 'weekday' AS kind,
    unnest(regexp_extract_all(c, 'usual ([A-Z][a-z]+day) ([0-9.,]+k?)[-–]([0-9.,]+k?)', 1)) AS dow,
    unnest(regexp_extract_all(c, 'usual ([A-Z][a-z]+day) ([0-9.,]+k?)[-–]([0-9.,]+k?)', 2)) AS a,
    unnest(regexp_extract_all(c, 'usual ([A-Z][a-z]+day) ([0-9.,]+k?)[-–]([0-9.,]+k?)', 3)) AS b FROM clause
  UNION ALL
  SELECT source_id, entity, 'typical', NULL, unnest(regexp_extract_all(c, 'typical range ([0-9.,]+k?)[-–]([0-9.,]+k?)', 1)),
    unnest(regexp_extract_all(c, 'typical range ([0-9.,]+k?)[-–]([0-9.,]+k?)', 2)) FROM clause
  UNION ALL
  SELECT source_id, entity, 'band', NULL, unnest(regexp_extract_all(c, 'confidence band: ([0-9,]+)[-–]([0-9,]+)', 1)),
    unnest(regexp_extract_all(c, 'confidence band: ([0-9,]+)[-–]([0-9,]+)', 2)) FROM clause
  UNION ALL
  SELECT source_id, entity, 'minimum', NULL, unnest(regexp_extract_all(c, 'expected volume >([0-9.,]+k?)', 1)), NULL FROM clause
),
ranges AS (
  SELECT source_id, entity, kind, dow,
    CAST(CAST(replace(replace(a, ',', ''), 'k', '') AS DECIMAL(18,3)) * CASE WHEN a LIKE '%k' THEN 1000 ELSE 1 END AS BIGINT) AS lo,
    CAST(CAST(replace(replace(b, ',', ''), 'k', '') AS DECIMAL(18,3)) * CASE WHEN b LIKE '%k' THEN 1000 ELSE 1 END AS BIGINT) AS hi
  FROM rraw
),
cent AS (
  SELECT source_id, trim(unnest(string_split(regexp_extract(text, '(?m)^Entities: (.*)$', 1), ','))) AS entity FROM docs
),
cpat AS (
  SELECT source_id, expected_name, CASE days WHEN 'weekdays' THEN 31 WHEN 'Mondays' THEN 1 WHEN 'daily' THEN 127 END AS due_mask,
    regexp_replace(regexp_replace(expected_name, '^(\[hash\]|\*)_', ''), '_?(YYYY_MM_DD|YYYY-MM-DD|YYYYMMDD)', '') AS pattern
  FROM (SELECT source_id, regexp_replace(item, ' \((.*)\)$', '') AS expected_name, regexp_extract(item, '\((.*)\)$', 1) AS days
        FROM (SELECT source_id, unnest(string_split_regex(regexp_extract(text, '(?m)^Expected files: (.*)$', 1), '; *')) AS item FROM docs))
),
csched AS (
  SELECT source_id, trim(unnest(string_split(x, ','))) AS not_expected_on
  FROM (SELECT source_id, regexp_extract(text, '(?m)^Not expected on: (.*)$', 1) AS x FROM docs) WHERE x <> ''
),
cex AS (
  SELECT source_id, 'regularly_empty' AS kind, regexp_extract(text, '(?m)^Regularly empty: (.*)$', 1) AS entity, CAST(NULL AS INTEGER) AS lag_days FROM docs WHERE text LIKE '%Regularly empty: %'
  UNION ALL
  SELECT source_id, 'variable_arrival', regexp_extract(text, '(?m)^Variable arrival: (.*)$', 1), NULL FROM docs WHERE text LIKE '%Variable arrival: %'
  UNION ALL
  SELECT source_id, 'coverage_lag', NULL, CAST(regexp_extract(text, 'Expected coverage: D\+(\d+)', 1) AS INTEGER) FROM docs WHERE text LIKE '%Expected coverage: %'
),
days AS (SELECT DISTINCT snapshot_day FROM f),
cal AS (SELECT d.snapshot_day, c.source_id FROM days d CROSS JOIN docs c),
off AS (SELECT c.snapshot_day, c.source_id FROM cal c JOIN csched s ON s.source_id = c.source_id AND s.not_expected_on = dayname(c.snapshot_day)),
due AS (
  SELECT c.snapshot_day, c.source_id, p.pattern, p.expected_name
  FROM cal c JOIN cpat p ON p.source_id = c.source_id AND (due_mask IS NULL OR (due_mask >> (isodow(snapshot_day) - 1)) & 1 = 1)
  ANTI JOIN off ON off.snapshot_day = c.snapshot_day AND off.source_id = c.source_id
)
"""

def _weekly(name: str, history: bool = False) -> str:
    """Volume findings against last week, softened by documented ranges and, if asked, by the bounds ``hb`` of history."""
    decided_s, decided_t = ("x.d.s, y.d.s", "x.d.t, y.d.t") if not history else ("x.d.s, y.d.s, h.s", "x.d.t, y.d.t, h.t")
    join = "" if not history else "LEFT JOIN hb h ON h.day = pf.snapshot_day AND h.source_id = pf.source_id AND h.pattern = pf.pattern"
    return f"""{name} AS (
  SELECT pf.snapshot_day, pf.source_id, 'volume' AS detector, CASE WHEN volume_today > volume_last THEN 'volume_up' ELSE 'volume_down' END AS kind,
    NULL AS filename, pf.pattern, pf.entity, CAST(volume_today AS DOUBLE) AS metric, CAST(volume_last AS DOUBLE) AS baseline,
    least(CASE WHEN (volume_today - volume_last) * 100.0 / volume_last > 100 OR (volume_today - volume_last) * 100.0 / volume_last < -80 THEN 2 ELSE 1 END,
      coalesce({decided_s}, 2)) AS severity,
    NULL AS error_text,
    coalesce(pf.entity, pf.pattern) || ' volume ' || format('{{:,}}', volume_today) || ' (' ||
      format('{{:,}}', ((abs(volume_today - volume_last) * 2000 + volume_last) // (volume_last * 2)) // 10) || '.' ||
      CAST(((abs(volume_today - volume_last) * 2000 + volume_last) // (volume_last * 2)) % 10 AS VARCHAR) ||
      CASE WHEN volume_today > volume_last THEN '% above last week ' ELSE '% below last week ' END || format('{{:,}}', volume_last) || ')' ||
      CASE WHEN coalesce({decided_s}) = 0 THEN ', within ' || coalesce({decided_t}) ELSE '' END AS message
  FROM pf LEFT JOIN decided x ON x.snapshot_day = pf.snapshot_day AND x.source_id = pf.source_id AND x.entity = pf.entity
  LEFT JOIN decided y ON y.snapshot_day = pf.snapshot_day AND y.source_id = pf.source_id AND y.entity IS NULL {join}
  WHERE ok_today > 0 AND ok_last > 0 AND volume_last > 0 AND abs((volume_today - volume_last) * 100.0 / volume_last) > 50
),
"""


FACTS = rf"""
st AS (
  SELECT snapshot_day, source_id, pattern,
    count(*) FILTER (from_period = 'today') AS n_today,
    count(*) FILTER (from_period = 'last_weekday') AS n_last,
    count(*) FILTER (from_period = 'today' AND status IN ('processed', 'empty')) AS ok_today,
    count(*) FILTER (from_period = 'last_weekday' AND status IN ('processed', 'empty')) AS ok_last,
    CAST(sum(rows) FILTER (from_period = 'today' AND status IN ('processed', 'empty')) AS BIGINT) AS volume_today,
    CAST(sum(rows) FILTER (from_period = 'last_weekday' AND status IN ('processed', 'empty')) AS BIGINT) AS volume_last,
    max(rows) FILTER (from_period = 'last_weekday') AS max_rows_last,
    min(expected_name) AS expected_name
  FROM (SELECT snapshot_day, source_id, pattern, from_period, status, rows, filename, NULL AS expected_name FROM mp
        UNION ALL
        SELECT snapshot_day, source_id, pattern, 'expected', NULL, NULL, expected_name, expected_name FROM due)
  GROUP BY ALL
),
known AS (
  SELECT st.source_id, st.snapshot_day, st.pattern, max(struct_pack(n := length(c.entity), v := c.entity)).v AS v
  FROM st JOIN cent c ON c.source_id = st.source_id AND contains(st.pattern, c.entity) GROUP BY ALL
),
pf AS (
  SELECT st.*,
    coalesce(known.v, nullif(regexp_extract('_' || st.pattern, '_([A-Za-z0-9]+)_(?:payments|report|accounting)', 1), '')) AS entity,
    coalesce(lag_t.lag_days, 0) AS lag_days,
    off.source_id IS NULL AND coalesce((q.due_mask >> (isodow(snapshot_day) - 1)) & 1 = 1, true) AS is_scheduled, q.due_mask
  FROM st LEFT JOIN known USING (snapshot_day, source_id, pattern)
  LEFT JOIN (SELECT source_id, lag_days FROM cex WHERE kind = 'coverage_lag') lag_t USING (source_id)
  LEFT JOIN off USING (snapshot_day, source_id)
  LEFT JOIN cpat q USING (source_id, pattern)
),
stated AS (
  SELECT source_id, entity, start_min, end_min FROM windows
  UNION ALL SELECT source_id, entity, minute, minute FROM usual u
  WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.source_id = u.source_id AND w.entity IS NOT DISTINCT FROM u.entity)
),
own AS (SELECT DISTINCT source_id, entity FROM stated WHERE entity IS NOT NULL),
pslots AS (
  SELECT pf.snapshot_day, pf.source_id, pf.pattern, s.start_min, s.end_min
  FROM pf LEFT JOIN own USING (source_id, entity) JOIN stated s ON s.source_id = pf.source_id AND s.entity IS NOT DISTINCT FROM own.entity
),
wtext AS (
  SELECT snapshot_day, source_id, pattern, string_agg(strftime(TIMESTAMP '2000-01-01' + to_minutes(start_min), '%H:%M') || '–' ||
    strftime(TIMESTAMP '2000-01-01' + to_minutes(end_min), '%H:%M'), ', ' ORDER BY start_min, end_min) || ' UTC' AS windows_text
  FROM pslots WHERE end_min > start_min GROUP BY ALL
),
fm AS (
  SELECT snapshot_day, source_id, 'missing' AS detector, 'missing' AS kind, NULL AS filename, pattern, entity,
    CAST(n_today AS DOUBLE) AS metric, CAST(n_last AS DOUBLE) AS baseline, 1 AS severity, NULL AS error_text,
    'missing' || coalesce(' past ' || windows_text, '') || ' — expected: ' ||
      coalesce('*_' || regexp_replace(replace(expected_name, 'YYYY_MM_DD', strftime(snapshot_day, '%Y_%m_%d')), '^\[hash\]_', ''), '*_' || pattern) AS message
  FROM pf LEFT JOIN wtext USING (snapshot_day, source_id, pattern) WHERE n_today = 0 AND is_scheduled
),
gv AS (
  SELECT snapshot_day, source_id, entity, CAST(sum(volume_today) AS BIGINT) AS volume FROM pf WHERE ok_today > 0 AND entity IS NOT NULL GROUP BY ALL
  UNION ALL SELECT snapshot_day, source_id, NULL, CAST(sum(volume_today) AS BIGINT) FROM pf WHERE ok_today > 0 GROUP BY ALL
),
jr AS (
  SELECT gv.*, r.kind, r.dow, r.lo, r.hi, coalesce(volume > hi, false) AS is_above, CASE WHEN kind = 'minimum' THEN volume <= lo ELSE volume < lo END AS is_below,
    CASE kind WHEN 'weekday' THEN 'usual ' || dow || ' ' || format('{{:,}}', lo) || '–' || format('{{:,}}', hi)
      WHEN 'typical' THEN 'typical range ' || format('{{:,}}', lo) || '–' || format('{{:,}}', hi)
      WHEN 'band' THEN '95% band ' || format('{{:,}}', lo) || '–' || format('{{:,}}', hi)
      ELSE 'expected >' || format('{{:,}}', lo) END AS range_text
  FROM gv JOIN ranges r ON r.source_id = gv.source_id AND r.entity IS NOT DISTINCT FROM gv.entity
  WHERE r.dow IS NULL OR r.dow = dayname(snapshot_day)
  QUALIFY r.dow IS NOT NULL OR NOT bool_or(r.dow IS NOT NULL) OVER (PARTITION BY snapshot_day, gv.source_id, gv.entity)
),
js AS (
  SELECT *, CASE WHEN (is_above AND volume > hi * 2) OR (is_below AND volume < lo * 0.2) THEN 2 WHEN is_above OR is_below THEN 1 ELSE 0 END AS severity FROM jr
),
decided AS (
  SELECT snapshot_day, source_id, entity, max(struct_pack(s := severity, t := range_text)) AS d FROM js GROUP BY ALL
),
{_weekly("fv")}fr AS (
  SELECT snapshot_day, source_id, 'volume' AS detector, 'outside_' || kind AS kind, NULL AS filename, '*' AS pattern, entity,
    CAST(volume AS DOUBLE) AS metric, CAST(CASE WHEN is_above THEN hi ELSE lo END AS DOUBLE) AS baseline, severity, NULL AS error_text,
    coalesce(entity, 'Source') || ' volume ' || format('{{:,}}', volume) || ' (' ||
      CASE kind WHEN 'band' THEN CASE WHEN is_above THEN '>' ELSE '<' END || '95% bound ' || format('{{:,}}', CASE WHEN is_above THEN hi ELSE lo END)
                WHEN 'minimum' THEN range_text ELSE CASE WHEN is_above THEN '> ' ELSE '< ' END || range_text END || ')' AS message
  FROM js WHERE severity > 0
),
tf AS (
  SELECT t.*, pf.entity, pf.max_rows_last, z.slot.a AS slot_start, z.slot.b AS slot_end, pf.lag_days,
    coalesce(x.entity IS NOT NULL, false) AS may_be_empty, coalesce(v.entity IS NOT NULL, false) AS anytime,
    CAST(uploaded_at AS DATE) - {FILE_DATE} AS old,
    lb.hi_at
  FROM t JOIN pf USING (snapshot_day, source_id, pattern)
  LEFT JOIN (SELECT source_id, entity FROM cex WHERE kind = 'regularly_empty') x ON x.source_id = t.source_id AND x.entity = pf.entity
  LEFT JOIN (SELECT source_id, entity FROM cex WHERE kind = 'variable_arrival') v ON v.source_id = t.source_id AND v.entity = pf.entity
  LEFT JOIN (SELECT snapshot_day, source_id, pattern, max(uploaded_at) AS hi_at FROM l GROUP BY ALL) lb
    ON lb.snapshot_day = t.snapshot_day AND lb.source_id = t.source_id AND lb.pattern = t.pattern
  LEFT JOIN (
    SELECT e, min(struct_pack(d := greatest(start_min - minute, minute - end_min, 0), a := start_min, b := end_min)) AS slot
    FROM (SELECT e, snapshot_day, source_id, pattern, (epoch_us(uploaded_at) - epoch_us(CAST(snapshot_day AS TIMESTAMP))) / 6e7 AS minute FROM t)
    JOIN pslots USING (snapshot_day, source_id, pattern) GROUP BY ALL
  ) z ON z.e = t.e
),
fd AS (
  SELECT snapshot_day, source_id, 'duplicated_failed' AS detector,
    CASE WHEN is_duplicated AND status = 'stopped' THEN 'blocked_duplicate' WHEN status IN ('failure', 'stopped', 'deleted') THEN status ELSE 'duplicate' END AS kind,
    filename, pattern, entity, CAST(rows AS DOUBLE) AS metric, CAST(NULL AS DOUBLE) AS baseline,
    CASE WHEN status IN ('failure', 'stopped', 'deleted') THEN 1 ELSE 0 END AS severity,
    CASE WHEN status = 'failure' THEN regexp_replace(lower(status_message), '[0-9]+', '#', 'g') END AS error_text,
    filename || ' — ' || status || coalesce(' (' || status_message || ')', '') || CASE WHEN is_duplicated THEN ', duplicate' ELSE '' END AS message
  FROM tf WHERE is_duplicated OR status IN ('failure', 'stopped', 'deleted')
),
fe AS (
  SELECT snapshot_day, source_id, 'empty' AS detector, 'unexpected_empty' AS kind, filename, pattern, entity, CAST(rows AS DOUBLE) AS metric,
    CAST(max_rows_last AS DOUBLE) AS baseline, CASE WHEN max_rows_last > 10 THEN 1 ELSE 0 END AS severity, NULL AS error_text,
    coalesce(entity, pattern) || ' empty: 0 records (last week ' || format('{{:,}}', max_rows_last) || ')' AS message
  FROM tf WHERE rows = 0 AND max_rows_last > 0 AND NOT may_be_empty
),
lt AS (
  SELECT *, CASE WHEN slot_end IS NOT NULL THEN CAST(snapshot_day AS TIMESTAMP) + to_minutes(slot_end) ELSE hi_at + INTERVAL 7 DAY END AS due_at
  FROM tf WHERE NOT anytime AND NOT coalesce(old > lag_days, false)
),
fl AS (
  SELECT snapshot_day, source_id, 'late' AS detector, 'late' AS kind, filename, pattern, entity,
    (epoch_us(uploaded_at) - epoch_us(due_at)) / 3.6e9 AS metric,
    (epoch_us(due_at) - epoch_us(CAST(snapshot_day AS TIMESTAMP))) / 3.6e9 AS baseline, 1 AS severity, NULL AS error_text,
    coalesce(entity, pattern) || ' file arrived ' ||
      format('{{:,}}', (((epoch_us(uploaded_at) - epoch_us(due_at)) * 20 + 3600000000) // 7200000000) // 10) || '.' ||
      CAST((((epoch_us(uploaded_at) - epoch_us(due_at)) * 20 + 3600000000) // 7200000000) % 10 AS VARCHAR) || ' hours late at ' ||
      strftime(uploaded_at, '%H:%M') || ' UTC (expected ' || strftime(due_at, '%H:%M') || ' UTC)' AS message
  FROM lt WHERE epoch_us(uploaded_at) - epoch_us(due_at) > 4 * 3600000000
),
le AS (
  SELECT lt.*, lo_at, CASE WHEN slot_start IS NOT NULL THEN CAST(snapshot_day AS TIMESTAMP) + to_minutes(slot_start) ELSE lo_at + INTERVAL 7 DAY END AS opens_at
  FROM lt LEFT JOIN (SELECT snapshot_day, source_id, pattern, min(uploaded_at) AS lo_at FROM l GROUP BY ALL) b USING (snapshot_day, source_id, pattern)
),
fy AS (
  SELECT snapshot_day, source_id, 'late' AS detector, 'early' AS kind, filename, pattern, entity,
    (epoch_us(opens_at) - epoch_us(uploaded_at)) / 3.6e9 AS metric,
    (epoch_us(opens_at) - epoch_us(CAST(snapshot_day AS TIMESTAMP))) / 3.6e9 AS baseline,
    CASE WHEN slot_start IS NOT NULL AND NOT coalesce(epoch_us(opens_at) - epoch_us(lo_at + INTERVAL 7 DAY) > 4 * 3600000000, false) THEN 1 ELSE 0 END AS severity, NULL AS error_text,
    coalesce(entity, pattern) || ' file delivered early at ' || strftime(uploaded_at, '%H:%M') || ' UTC (usual ~' || strftime(opens_at, '%H:%M') || ')' AS message
  FROM le WHERE epoch_us(opens_at) - epoch_us(uploaded_at) > 4 * 3600000000
    AND NOT coalesce(epoch_us(uploaded_at) - epoch_us(due_at) > 4 * 3600000000, false)
),
fp AS (
  SELECT snapshot_day, source_id, 'previous' AS detector,
    CASE WHEN old <= 2 THEN 'recent_backfill' WHEN old > 7 THEN 'historical_backfill' ELSE 'backfill' END AS kind,
    filename, pattern, entity, CAST(old AS DOUBLE) AS metric, CAST(lag_days AS DOUBLE) AS baseline, 0 AS severity, NULL AS error_text,
    filename || ' is ' || CAST(old AS VARCHAR) || ' days old' AS message
  FROM tf WHERE old > lag_days
),
findings AS (
  SELECT * FROM fm UNION ALL SELECT * FROM fv UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM fd
  UNION ALL SELECT * FROM fe UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM fy UNION ALL SELECT * FROM fp
)
"""

ISSUES = r"""
per_source AS (
  SELECT snapshot_day, source_id,
    count(*) FILTER (detector = 'missing') AS n_missing,
    CAST(coalesce(sum(greatest(baseline, 1)) FILTER (detector = 'missing'), 0) AS BIGINT) AS n_missing_files,
    count(*) FILTER (kind = 'blocked_duplicate') AS n_blocked,
    count(*) FILTER (kind = 'failure') AS n_failure,
    count(*) FILTER (kind = 'stopped') AS n_stopped,
    count(*) FILTER (kind = 'deleted') AS n_deleted,
    count(*) FILTER (detector = 'volume' AND severity = 2) AS n_volume_urgent,
    count(*) FILTER (detector = 'volume' AND severity > 0) AS n_volume,
    count(*) FILTER (detector = 'empty' AND baseline > 1000) AS n_empty_big,
    count(*) FILTER (detector = 'empty' AND severity > 0) AS n_empty,
    count(*) FILTER (kind = 'late') AS n_late,
    count(*) FILTER (kind = 'early' AND severity > 0) AS n_change,
    arg_max(message, struct_pack(a := severity, b := abs(metric - baseline), c := message)) FILTER (detector = 'volume') AS top_volume,
    max(baseline) FILTER (detector = 'empty') AS most_before, max(metric) FILTER (kind = 'late') AS most_late, max(metric) FILTER (kind = 'early') AS most_early
  FROM findings GROUP BY ALL
),
errors AS (
  SELECT snapshot_day, source_id, error_text, count(*) AS n FROM findings WHERE kind = 'failure' AND error_text <> '' GROUP BY ALL
),
top_errors AS (
  SELECT snapshot_day, source_id, max(n) AS n_same, arg_max(error_text, struct_pack(a := n, b := error_text)) AS error_text FROM errors GROUP BY ALL
),
totals AS (SELECT snapshot_day, source_id, CAST(sum(rows) AS BIGINT) AS total_rows, count(*) AS n_files FROM t GROUP BY ALL),
everyone AS (
  SELECT snapshot_day, source_id FROM totals UNION SELECT snapshot_day, source_id FROM cal UNION SELECT snapshot_day, source_id FROM findings
),
issues AS (
  SELECT e.snapshot_day, e.source_id, coalesce(o.total_rows, 0) AS total_rows, coalesce(o.n_files, 0) AS n_files,
    p.* EXCLUDE (snapshot_day, source_id), x.n_same, x.error_text AS same_text,
    CASE WHEN n_missing >= 2 THEN 2 WHEN n_missing = 1 THEN 1 ELSE 0 END AS missing_severity,
    CASE WHEN n_blocked >= 2 OR x.n_same >= 2 THEN 2 WHEN n_blocked + n_failure + n_stopped + n_deleted > 0 THEN 1 ELSE 0 END AS duplicated_failed_severity,
    CASE WHEN n_volume_urgent > 0 THEN 2 WHEN n_volume > 0 THEN 1 ELSE 0 END AS volume_severity,
    CASE WHEN n_empty_big >= 2 THEN 2 WHEN n_empty > 0 THEN 1 ELSE 0 END AS empty_severity,
    CASE WHEN n_late + n_change > 0 THEN 1 ELSE 0 END AS late_severity,
    0 AS previous_severity
  FROM everyone e LEFT JOIN totals o USING (snapshot_day, source_id) LEFT JOIN per_source p USING (snapshot_day, source_id)
  LEFT JOIN top_errors x USING (snapshot_day, source_id)
),
crit AS (
  SELECT *, greatest(missing_severity, duplicated_failed_severity, volume_severity, empty_severity, late_severity, 0) AS severity FROM issues
),
ment AS (
  SELECT snapshot_day, source_id, CASE WHEN count(*) <= 2 THEN 'expected: ' || array_to_string(list_sort(list(expected)), '; ')
    ELSE concat_ws('; ', 'entities: ' || array_to_string(list_sort(list(DISTINCT entity) FILTER (entity IS NOT NULL)), ', '),
      'expected: ' || array_to_string(list_sort(list(expected) FILTER (entity IS NULL)), '; ')) END AS names
  FROM (SELECT DISTINCT snapshot_day, source_id, entity, regexp_extract(message, 'expected: (.*)$', 1) AS expected FROM findings WHERE detector = 'missing') GROUP BY ALL
),
ldays AS (
  SELECT snapshot_day, source_id, pattern, CASE WHEN bool_or(kind = 'late') THEN 'late' ELSE 'early' END AS direction
  FROM (SELECT * FROM fl UNION ALL SELECT * FROM fy) GROUP BY ALL
),
lv AS (
  SELECT snapshot_day, source_id, pattern, level, coalesce(direction, 'on time') AS direction
  FROM (SELECT snapshot_day, source_id, pattern, min(epoch_us(uploaded_at)) - epoch_us(CAST(snapshot_day AS TIMESTAMP)) AS level FROM t GROUP BY snapshot_day, source_id, pattern)
  LEFT JOIN ldays USING (snapshot_day, source_id, pattern)
),
lb1 AS (
  SELECT *, direction IS DISTINCT FROM lag(direction) OVER w AS begins, avg(level) OVER b AS mean_before, min(level) OVER b AS low_before, max(level) OVER b AS high_before
  FROM lv WINDOW w AS (PARTITION BY source_id, pattern ORDER BY snapshot_day), b AS (PARTITION BY source_id, pattern ORDER BY snapshot_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
),
lb2 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, pattern ORDER BY snapshot_day) AS run FROM lb1),
lb3 AS (
  SELECT *, row_number() OVER r AS run_length, first(snapshot_day) OVER r AS run_start, avg(level) OVER r - first(mean_before) OVER r AS shift,
    min(level) OVER r > first(high_before) OVER r AS above, max(level) OVER r < first(low_before) OVER r AS below
  FROM lb2 WINDOW r AS (PARTITION BY source_id, pattern, run ORDER BY snapshot_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
truns AS (
  SELECT snapshot_day, source_id, pattern, direction, run_start, CAST(run_length AS INTEGER) AS run_length, CAST(floor(shift / 60000000) AS BIGINT) AS shift_minutes,
    CASE WHEN run_length >= 3 AND coalesce((shift > 3600000000 AND above) OR (shift < -3600000000 AND below), false) THEN 'shifted'
         WHEN run_length >= 3 THEN 'persistent' WHEN run_length > 1 THEN 'repeated' ELSE 'once' END AS course
  FROM lb3 WHERE direction <> 'on time'
),
shifts AS (
  SELECT snapshot_day, source_id, count(*) AS n_shifted, max(struct_pack(a := abs(shift_minutes), b := shift_minutes, c := run_start, d := pattern)) AS top
  FROM truns WHERE course = 'shifted' GROUP BY ALL
),
sw AS (
  SELECT source_id, string_agg(strftime(TIMESTAMP '2000-01-01' + to_minutes(start_min), '%H:%M') || '–' || strftime(TIMESTAMP '2000-01-01' + to_minutes(end_min), '%H:%M'), ', ' ORDER BY start_min, end_min) || ' UTC' AS windows_text
  FROM (SELECT * FROM windows w WHERE end_min > start_min QUALIFY entity IS NULL OR NOT bool_or(entity IS NULL) OVER (PARTITION BY source_id)) GROUP BY ALL
),
clauses AS (
  SELECT c.*, coalesce(n.source_name, 'Source_' || c.source_id) AS source_name,
    CASE severity WHEN 2 THEN 'URGENT ACTION REQUIRED' WHEN 1 THEN 'NEEDS ATTENTION' ELSE 'NO ACTION NEEDED' END AS criticality_level,
    CAST(n_missing_files AS VARCHAR) || CASE WHEN n_missing_files = 1 THEN ' file missing' ELSE ' files missing' END ||
      coalesce(' past ' || sw.windows_text || ' window', '') || coalesce(' — ' || e.names, '') AS c_missing,
    concat_ws(', ',
      CASE WHEN n_blocked > 0 THEN CAST(n_blocked AS VARCHAR) || CASE WHEN n_blocked = 1 THEN ' file blocked as duplicate' ELSE ' files blocked as duplicates' END END,
      CASE WHEN n_failure > 0 THEN CAST(n_failure AS VARCHAR) || ' failed (' || same_text || ')' END,
      CASE WHEN n_stopped > 0 THEN CAST(n_stopped AS VARCHAR) || ' stopped' END,
      CASE WHEN n_deleted > 0 THEN CAST(n_deleted AS VARCHAR) || ' deleted' END) AS c_dup,
    top_volume || CASE WHEN n_volume = 2 THEN '; 1 more volume variation' WHEN n_volume > 2 THEN '; ' || CAST(n_volume - 1 AS VARCHAR) || ' more volume variations' ELSE '' END AS c_volume,
    CAST(n_empty AS VARCHAR) || CASE WHEN n_empty = 1 THEN ' file' ELSE ' files' END || ' unexpectedly empty (last week up to ' || format('{:,}', CAST(most_before AS BIGINT)) || ' records)' AS c_empty,
    concat_ws(', ',
      CASE WHEN n_late > 0 THEN CAST(n_late AS VARCHAR) || CASE WHEN n_late = 1 THEN ' file' ELSE ' files' END || ' uploaded >4 hours late (up to ' || CAST(CAST(floor(most_late) AS BIGINT) AS VARCHAR) || ' hours)' END,
      CASE WHEN n_change > 0 THEN CAST(n_change AS VARCHAR) || CASE WHEN n_change = 1 THEN ' file' ELSE ' files' END || ' delivered early (up to ' || CAST(CAST(floor(most_early) AS BIGINT) AS VARCHAR) || ' hours)' END,
      'upload time shifted by ' || CASE WHEN z.top.b >= 0 THEN '+' ELSE '' END || CAST(z.top.b AS VARCHAR) || ' minutes since ' || strftime(z.top.c, '%Y-%m-%d')) AS c_late, z.n_shifted
  FROM crit c LEFT JOIN shifts z USING (snapshot_day, source_id) LEFT JOIN cvn n USING (source_id) LEFT JOIN sw USING (source_id) LEFT JOIN ment e USING (snapshot_day, source_id)
),
parts AS (
  SELECT snapshot_day, source_id, missing_severity AS s, 0 AS p, c_missing AS text, 'Notify provider to generate/re-send; re-run ingestion and verify completeness' AS action FROM clauses WHERE missing_severity > 0
  UNION ALL SELECT snapshot_day, source_id, duplicated_failed_severity, 1, c_dup, 'Notify provider to resolve duplicate and failed files; re-run ingestion and verify completeness' FROM clauses WHERE duplicated_failed_severity > 0
  UNION ALL SELECT snapshot_day, source_id, volume_severity, 2, c_volume, 'Confirm coverage/window; monitor next run' FROM clauses WHERE volume_severity > 0
  UNION ALL SELECT snapshot_day, source_id, empty_severity, 3, c_empty, 'Notify provider to generate/re-send; re-run ingestion and verify completeness' FROM clauses WHERE empty_severity > 0
  UNION ALL SELECT snapshot_day, source_id, late_severity, 4, c_late, CASE WHEN n_shifted > 0 THEN 'Confirm intentional lag change; keep a short-term volume watch' WHEN n_late > 0 THEN 'Validate downstream completed; track if persists' ELSE 'Confirm schedule change; adjust downstream triggers if needed' END FROM clauses WHERE late_severity > 0
),
joined AS (
  SELECT snapshot_day, source_id, string_agg(text, ' — ' ORDER BY s DESC, p) AS text, arg_min(action, -s * 10 + p) AS action FROM parts GROUP BY ALL
),
lines AS (
  SELECT c.snapshot_day, c.source_id, source_name, severity, criticality_level,
    CASE WHEN severity > 0 THEN j.text ELSE '`[' || format('{:,}', total_rows) || '] records`' END AS summary_line,
    coalesce(j.action, '') AS recommended_action, total_rows, n_files
  FROM clauses c LEFT JOIN joined j USING (snapshot_day, source_id)
)
"""

DAY = "CAST(snapshot_day AS VARCHAR) AS snapshot_day"
WITH_FILES = f"WITH {FILES}"
WITH_DOCS = f"WITH {FILES}, {DOCS}"
WITH_FACTS = f"WITH {FILES}, {DOCS}, {FACTS}"
WITH_ISSUES = f"WITH {FILES}, {DOCS}, {FACTS}, {ISSUES}"
E1 = "regexp_extract(filename, '_([A-Za-z0-9]+)_(?:payments|report|accounting)', 1)"
E2 = r"regexp_extract(filename, '([A-Za-z_]+)(?:_\d{4}_\d{2}_\d{2}|payments|report)', 1)"
E3 = r"regexp_extract(filename, '([A-Za-z0-9_]+)(?:_\d{4}_\d{2}_\d{2})', 1)"
FINDING_COLUMNS = "detector, kind, filename, pattern, entity, metric, baseline, severity, error_text, message"
QUALITY = """count(*) AS total_files, count(DISTINCT source_id) AS unique_sources,
  count(*) FILTER (rows = 0) AS empty_files, count(*) FILTER (is_duplicated) AS duplicates,
  count(*) FILTER (status = 'failure') AS failed_files, count(*) FILTER (status = 'stopped') AS stopped_files,
  count(*) FILTER (status = 'processed') AS successful_files, count(*) FILTER (status = 'empty') AS empty_status_files,
  count(*) FILTER (status = 'deleted') AS deleted_files, min(uploaded_at) AS earliest_upload, max(uploaded_at) AS latest_upload,
  CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(file_size) AS BIGINT) AS total_size_bytes"""
RATES = """count(*) FILTER (status = 'processed') * 100.0 / count(*) AS success_rate,
  count(*) FILTER (is_duplicated) * 100.0 / count(*) AS duplicate_rate,
  count(*) FILTER (rows = 0) * 100.0 / count(*) AS empty_file_rate"""


BANDS = """v AS (
        SELECT snapshot_day AS day, source_id, pattern, CAST(sum(rows) AS BIGINT) AS volume FROM t WHERE status IN ('processed', 'empty') GROUP BY ALL
      ), h0 AS (
        SELECT *, count(*) OVER w AS n_days, sum(volume) OVER w AS s0, sum(CAST(volume AS HUGEINT) * volume) OVER w AS q, min(volume) OVER w AS lowest, max(volume) OVER w AS highest
        FROM v WINDOW w AS (PARTITION BY source_id, pattern, dayofweek(day) ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
      ), b0 AS (
        SELECT *, CASE WHEN n_days >= 3 THEN CAST(s0 AS DOUBLE) / n_days END AS mean_volume,
          CASE WHEN n_days >= 3 THEN sqrt(CAST(n_days * q - s0 * s0 AS DOUBLE) / (n_days * (n_days - 1))) END AS sd FROM h0
      ), bands AS (
        SELECT day, source_id, pattern, volume, n_days, lowest, highest, mean_volume, mean_volume - 1.96::DOUBLE * sd AS lower, mean_volume + 1.96::DOUBLE * sd AS upper FROM b0
      )"""
CADENCE = """came AS (
        SELECT *, snapshot_day - lag(snapshot_day) OVER (PARTITION BY source_id, pattern ORDER BY snapshot_day) AS gap FROM (SELECT DISTINCT source_id, pattern, snapshot_day FROM t)
      ), often AS (
        SELECT source_id, pattern, count(*) AS n_days, CAST(max(gap) AS INTEGER) AS longest_gap, coalesce(bool_and(gap % 7 = 0), false) AS whole,
          CAST(bit_or(1 << (CAST(isodow(snapshot_day) AS INTEGER) - 1)) AS INTEGER) AS mask FROM came GROUP BY ALL
      ), cadence0 AS (
        SELECT *, CASE WHEN n_days < 3 THEN 'irregular' WHEN whole THEN 'weekly' WHEN longest_gap <= 3 AND mask & 96 = 0 THEN 'weekdays' WHEN longest_gap <= 2 THEN 'daily' ELSE 'irregular' END AS cadence FROM often
      ), cadence AS (SELECT source_id, pattern, n_days, longest_gap, cadence, CASE cadence WHEN 'daily' THEN 127 WHEN 'weekdays' THEN 31 ELSE mask END AS due_mask FROM cadence0)"""


NEAR = f"""{WITH_FILES}, shapes AS (SELECT DISTINCT snapshot_day, source_id, pattern FROM t), near AS (
        SELECT a.snapshot_day, a.source_id, a.pattern, count(*) AS n_near, min(b.pattern) AS nearest
        FROM shapes a JOIN shapes b ON a.snapshot_day = b.snapshot_day AND a.source_id = b.source_id AND a.pattern <> b.pattern AND levenshtein(a.pattern, b.pattern) = 1 GROUP BY ALL
      )"""


def _timing(shift: int, where: str = "true", select: str = "*") -> str:
    return f"""{WITH_FILES}, pairs AS (
      SELECT t.e, t.snapshot_day, t.source_id, t.filename, t.literal_pattern, t.uploaded_at AS today_time, l.uploaded_at AS lastweek_time,
        (epoch_us(t.uploaded_at) - epoch_us(l.uploaded_at + INTERVAL {shift} DAY)) / 3.6e9 AS h
      FROM t JOIN l ON t.snapshot_day = l.snapshot_day AND t.source_id = l.source_id AND t.literal_pattern = l.literal_pattern
    ), agg AS (
      SELECT e, {DAY}, source_id, filename, {E3} AS entity_name, literal_pattern AS pattern, today_time, count(*) AS n_baseline,
        min(lastweek_time) AS lastweek_first, max(lastweek_time) AS lastweek_last,
        min(h) AS hour_difference_min, max(h) AS hour_difference_max
      FROM pairs GROUP BY ALL
    ) SELECT {select} EXCLUDE (e) FROM agg WHERE {where}"""


def _volume(where: str = "true") -> str:
    return f"""{WITH_FILES}, pairs AS (
      SELECT t.e, t.snapshot_day, t.source_id, t.filename, t.uploaded_at, t.literal_pattern, t.rows AS a, l.rows AS b
      FROM t JOIN l ON t.snapshot_day = l.snapshot_day AND t.source_id = l.source_id AND t.literal_pattern = l.literal_pattern
      WHERE t.status IN ('processed', 'empty') AND l.status IN ('processed', 'empty') AND l.rows > 0
    ), agg AS (
      SELECT e, {DAY}, source_id, filename, uploaded_at, {E3} AS entity_name, literal_pattern AS pattern, a AS today_volume, count(*) AS n_baseline,
        min(b) AS lastweek_volume_min, max(b) AS lastweek_volume_max,
        min((a - b) * 100.0 / nullif(b, 0)) AS pct_change_min, max((a - b) * 100.0 / nullif(b, 0)) AS pct_change_max,
        max(abs(a - b)) AS abs_difference_max
      FROM pairs GROUP BY ALL
    ) SELECT * EXCLUDE (e) FROM agg WHERE {where}"""


def _detector(name: str, columns: str = FINDING_COLUMNS) -> str:
    return f"{WITH_FACTS} SELECT {DAY}, source_id, {columns} FROM findings WHERE detector = '{name}'"


def _record(rows: str, lists: dict[str, str | None], total: str = "") -> str:
    """``rows`` yields snapshot_day, source_id, names (its lists), name and message of every finding of a record."""
    listed = ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (l = '{c}')), ', '), '') AS {c}" for c in lists)
    numbers = total or ", ".join(f"count(*) FILTER (list_contains(names, '{c}')) AS {n}" for c, n in lists.items() if n)
    return f"""{WITH_FACTS}, flagged AS (SELECT * FROM ({rows}) WHERE len(names) > 0),
      each AS (SELECT DISTINCT snapshot_day, source_id, l, name, message FROM (SELECT *, unnest(names) AS l FROM flagged)),
      said AS (SELECT snapshot_day, source_id, message, min(struct_pack(a := l, b := name, c := message)) AS first FROM each GROUP BY ALL)
      SELECT CAST(a.snapshot_day AS VARCHAR) AS snapshot_day, source_id, coalesce(source_name, 'Source_' || source_id) AS source_name, 0 AS part,
        a.* EXCLUDE (snapshot_day, source_id), b.* EXCLUDE (snapshot_day, source_id), c.details
      FROM (SELECT snapshot_day, source_id, {listed} FROM each GROUP BY ALL) a
      JOIN (SELECT snapshot_day, source_id, {numbers} FROM flagged GROUP BY ALL) b USING (snapshot_day, source_id)
      JOIN (SELECT snapshot_day, source_id, string_agg(message, '; ' ORDER BY first) AS details FROM said GROUP BY ALL) c USING (snapshot_day, source_id)
      LEFT JOIN cvn USING (source_id)"""


ORACLES: dict[str, str] = {
    "manifest": f"{WITH_FILES} SELECT {DAY}, * EXCLUDE (e, snapshot_day) FROM m",
    "manifest_documents": f"{WITH_FILES} SELECT {DAY}, * EXCLUDE (e, snapshot_day) FROM m",
    "manifest_unread": f"{WITH_FILES} SELECT {DAY}, from_period, source_id, filename FROM m WHERE file_size % 89 = 0",
    "outside_scope": f"""{WITH_FILES} SELECT {DAY}, source_id, from_period, filename, uploaded_at
      FROM (SELECT *, CAST(snapshot_day - CASE from_period WHEN 'today' THEN 0 ELSE 7 END AS TIMESTAMP) + INTERVAL 20 HOUR AS taken FROM m)
      WHERE uploaded_at > taken OR uploaded_at <= taken - INTERVAL 1 DAY""",
    "source_slice": f"{WITH_FILES} SELECT {DAY}, * EXCLUDE (e, snapshot_day) FROM m WHERE source_id = '200002'",
    "periods_combined": f"""{WITH_FILES} SELECT {DAY}, * EXCLUDE (e, snapshot_day) REPLACE (CASE from_period WHEN 'today' THEN status_message END AS status_message) FROM m""",
    "stopped_files": f"{WITH_FILES} SELECT {DAY}, source_id, filename, status_message FROM t WHERE status = 'stopped'",
    "source_data": f"""{WITH_DOCS} SELECT {DAY}, m.* EXCLUDE (e, snapshot_day), n.source_name, n.text AS cv_text FROM m LEFT JOIN cvn n USING (source_id)""",
    "quality_summary": f"{WITH_FILES} SELECT {DAY}, source_id, {QUALITY} FROM t GROUP BY snapshot_day, source_id",
    "quality_rates": f"{WITH_FILES} SELECT {DAY}, source_id, {RATES} FROM t GROUP BY snapshot_day, source_id",
    "quality_tool": f"{WITH_FILES} SELECT {QUALITY}, {RATES} FROM t",
    "source_summary": f"""{WITH_FILES} SELECT source_id, from_period, count(filename) AS total_files, CAST(sum(rows) AS BIGINT) AS total_rows,
        CAST(sum(file_size) AS BIGINT) / CAST(count(file_size) AS DOUBLE) AS avg_file_size, count(*) FILTER (status = 'processed') AS processed_files,
        count(*) FILTER (status = 'empty') AS empty_files, count(*) FILTER (status IN ('failure', 'failed')) AS failed_files
      FROM m GROUP BY ALL""",
    "status_pivot": f"""{WITH_FILES} SELECT source_id, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'stopped') AS stopped,
        count(*) FILTER (status = 'empty') AS "empty", count(*) FILTER (status = 'failure') AS failure, count(*) FILTER (status = 'deleted') AS deleted
      FROM t GROUP BY ALL""",
    "status_counts": f"{WITH_FILES} SELECT {DAY}, source_id, status, count(*) AS n_files FROM t GROUP BY ALL",
    "today_listing": f"{WITH_FILES} SELECT DISTINCT {DAY}, source_id, filename, uploaded_at, status FROM t",
    "base_pattern_literal": f"{WITH_FILES} SELECT filename, regexp_replace(filename, '^[^_]+_', '') AS without_hash, literal_pattern AS base_pattern FROM t",
    "base_pattern_normalized": f"{WITH_FILES} SELECT filename, pattern FROM t",
    "distinct_patterns": f"""{WITH_FILES} SELECT {DAY}, source_id, from_period, literal_pattern AS pattern, min(filename) AS example_filename, count(*) AS n_files FROM mp GROUP BY ALL""",
    "entity_e1": f"{WITH_FILES} SELECT filename, {E1} AS entity FROM t",
    "entity_e2": f"{WITH_FILES} SELECT filename, {E2} AS entity FROM t",
    "entity_e3": f"{WITH_FILES} SELECT filename, {E3} AS entity FROM t",
    "entity_known": f"""{WITH_FACTS} SELECT {DAY}, source_id, pattern, entity FROM pf""",
    "entity_counts": f"{WITH_FILES} SELECT {DAY}, source_id, {E1} AS entity_name, count(*) AS file_count FROM t GROUP BY ALL",
    "file_dates": f"""{WITH_FILES} SELECT {DAY}, filename, CAST(fd AS VARCHAR) AS file_date, CAST(snapshot_day - fd AS INTEGER) AS days_old, fd < snapshot_day AS is_older
      FROM (SELECT *, {FILE_DATE} AS fd FROM t)""",
    "calendar_context": f"""{WITH_FILES} SELECT {DAY}, dayname(snapshot_day) AS weekday, dayofweek(snapshot_day) IN (0, 6) AS is_weekend,
        snapshot_day = last_day(snapshot_day) AS is_month_end, count(*) AS n_files, CAST(sum(rows) AS BIGINT) AS total_rows FROM t GROUP BY ALL""",
    "missing_patterns": f"""{WITH_FILES} SELECT {DAY}, source_id, literal_pattern AS pattern, count(*) AS occurrence_count, min(filename) AS example_filename
      FROM l ANTI JOIN (SELECT DISTINCT snapshot_day, source_id, literal_pattern FROM t) USING (snapshot_day, source_id, literal_pattern) GROUP BY ALL""",
    "missing_patterns_normalized": f"""{WITH_FILES} SELECT {DAY}, source_id, pattern, count(*) AS occurrence_count, min(filename) AS example_filename
      FROM l ANTI JOIN (SELECT DISTINCT snapshot_day, source_id, pattern FROM t) USING (snapshot_day, source_id, pattern) GROUP BY ALL""",
    "missing_entities": f"""{WITH_FILES}, te AS (SELECT DISTINCT snapshot_day, source_id, {E2} AS entity FROM t)
      SELECT CAST(x.snapshot_day AS VARCHAR) AS snapshot_day, x.source_id, x.entity, count(*) AS occurrence_count
      FROM (SELECT snapshot_day, source_id, {E2} AS entity FROM l) x ANTI JOIN te USING (snapshot_day, source_id, entity)
      WHERE x.entity <> '' GROUP BY ALL""",
    "missing_expected": f"""{WITH_DOCS} SELECT {DAY}, source_id, pattern, expected_name,
        '*_' || regexp_replace(replace(expected_name, 'YYYY_MM_DD', strftime(snapshot_day, '%Y_%m_%d')), '^\\[hash\\]_', '') AS expected_filename
      FROM due ANTI JOIN t USING (snapshot_day, source_id, pattern)""",
    "missing_by_source": f"""{WITH_FACTS} SELECT {DAY}, source_id, count(*) AS missing_files_number, CASE WHEN count(*) >= 2 THEN 2 ELSE 1 END AS severity
      FROM fm GROUP BY ALL""",
    "missing_detector": _detector("missing"),
    "duplicates": f"{WITH_FILES} SELECT {DAY}, source_id, filename, uploaded_at, status, count(*) AS n FROM t WHERE is_duplicated GROUP BY ALL",
    "blocked_duplicates": f"{WITH_FILES} SELECT {DAY}, source_id, filename, status_message FROM t WHERE is_duplicated AND status = 'stopped'",
    "failed_files": f"{WITH_FILES} SELECT {DAY}, source_id, filename, status, status_message, uploaded_at FROM t WHERE status IN ('failure', 'stopped', 'deleted')",
    "dup_or_failed": f"{WITH_FILES} SELECT {DAY}, source_id, filename, is_duplicated, status, status_message FROM t WHERE is_duplicated OR status IN ('failure', 'stopped', 'deleted')",
    "naming_duplicates": f"""{WITH_FILES} SELECT {DAY}, source_id, regexp_replace(filename, '^[^_]+_', '') AS base_name, 0 AS part, count(*) AS n_files,
        string_agg(filename, ', ' ORDER BY filename) AS all_versions FROM t GROUP BY ALL HAVING count(*) > 1""",
    "near_identical": f"""{WITH_FILES} SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, source_id, pattern, CAST(fd AS VARCHAR) AS file_date, count(*) AS n_files,
        count(*) FILTER (is_duplicated) AS n_flagged, min(filename) AS example_filename
      FROM (SELECT *, {FILE_DATE} AS fd FROM t) GROUP BY ALL HAVING count(*) > 1""",
    "error_patterns": f"""{WITH_FILES} SELECT {DAY}, source_id, regexp_replace(lower(status_message), '[0-9]+', '#', 'g') AS error_text, count(*) AS n_files, count(*) >= 2 AS is_urgent
      FROM t WHERE status = 'failure' GROUP BY ALL""",
    "error_indicators": f"""{WITH_FILES} SELECT {DAY}, source_id, filename, status, status_message FROM t
      WHERE regexp_matches(lower(status_message), 'error|fail|mismatch|invalid|exception|denied')""",
    "duplicated_failed_detector": _detector("duplicated_failed"),
    "empty_listing": f"{WITH_FILES} SELECT {DAY}, source_id, filename, rows, status, uploaded_at FROM t WHERE rows = 0",
    "empty_exact_left": f"""{WITH_FILES} SELECT {DAY}, source_id, filename, uploaded_at, rows AS today_rows, count(b) AS n_baseline,
        min(b_rows) AS lastweek_rows_min, max(b_rows) AS lastweek_rows_max
      FROM (SELECT t.e, t.snapshot_day, t.source_id, t.filename, t.uploaded_at, t.rows, l.e AS b, l.rows AS b_rows FROM t LEFT JOIN l
            ON t.snapshot_day = l.snapshot_day AND t.source_id = l.source_id AND t.filename = l.filename WHERE t.rows = 0)
      GROUP BY e, snapshot_day, source_id, filename, uploaded_at, rows""",
    "empty_from_baseline": f"""{WITH_FILES} SELECT {DAY}, source_id, filename, uploaded_at, rows AS lastweek_rows, count(b) AS n_today, count(b) FILTER (coalesce(b_rows, 0) = 0) AS n_today_empty
      FROM (SELECT l.e, l.snapshot_day, l.source_id, l.filename, l.uploaded_at, l.rows, t.e AS b, t.rows AS b_rows FROM l LEFT JOIN t
            ON t.snapshot_day = l.snapshot_day AND t.source_id = l.source_id AND t.filename = l.filename WHERE l.rows > 10)
      GROUP BY e, snapshot_day, source_id, filename, uploaded_at, rows HAVING count(b) = 0 OR count(b) FILTER (coalesce(b_rows, 0) = 0) > 0""",
    "unexpected_empty": _detector("empty"),
    "filename_compare": f"""{WITH_FILES} SELECT {DAY}, source_id, filename, uploaded_at, a AS today_rows, count(*) AS n_baseline, min(b) AS lastweek_rows_min,
        max(b) AS lastweek_rows_max, min(a - b) AS difference_min, max(a - b) AS difference_max
      FROM (SELECT t.e, t.snapshot_day, t.source_id, t.filename, t.uploaded_at, t.rows AS a, l.rows AS b FROM t JOIN l
            ON t.snapshot_day = l.snapshot_day AND t.source_id = l.source_id AND t.filename = l.filename)
      GROUP BY e, snapshot_day, source_id, filename, uploaded_at, a""",
    "volume_files": _volume(),
    "volume_significant": _volume("abs(pct_change_min) > 50 OR abs(pct_change_max) > 50"),
    "volume_patterns": f"""{WITH_FACTS} SELECT {DAY}, source_id, pattern, volume_today, volume_last,
        (volume_today - volume_last) * 100.0 / nullif(volume_last, 0) AS pct_change, abs(volume_today - volume_last) AS abs_difference
      FROM pf WHERE ok_today > 0 AND ok_last > 0 AND volume_last > 0""",
    "volume_detector": _detector("volume"),
    "volume_vs_range": f"{WITH_FACTS} SELECT {DAY}, source_id, entity, volume, kind, dow, lo, hi, is_above, severity FROM js WHERE severity > 0",
    "volume_band": f"""{WITH_FILES}, {BANDS} SELECT CAST(day AS VARCHAR) AS day, source_id, pattern, volume, n_days, lowest, highest, mean_volume, lower, upper,
        volume < lower OR volume > upper AS outside FROM bands""",
    "volume_with_history": f"""{WITH_FACTS}, {BANDS}, hb AS (
        SELECT *, CASE WHEN volume BETWEEN lower AND upper THEN 0 END AS s, '95% bounds ' || format('{{:,}}', CAST(floor(lower) AS BIGINT)) || '–' ||
          format('{{:,}}', CAST(floor(upper) AS BIGINT)) || ' of ' || CAST(n_days AS VARCHAR) || ' earlier ' || dayname(day) || 's' AS t FROM bands WHERE upper IS NOT NULL
      ), {_weekly("hv", history=True)} ho AS (
        SELECT pf.snapshot_day, pf.source_id, 'volume' AS detector, 'outside_history' AS kind, NULL AS filename, pf.pattern, pf.entity, CAST(volume_today AS DOUBLE) AS metric,
          CASE WHEN volume_today > upper THEN upper ELSE lower END AS baseline, 1 AS severity, NULL AS error_text,
          coalesce(pf.entity, pf.pattern) || ' volume ' || format('{{:,}}', volume_today) || CASE WHEN volume_today > upper THEN ' (>95% bound ' ELSE ' (<95% bound ' END ||
            format('{{:,}}', CAST(floor(CASE WHEN volume_today > upper THEN upper ELSE lower END) AS BIGINT)) || ')' AS message
        FROM pf JOIN hb h ON h.day = pf.snapshot_day AND h.source_id = pf.source_id AND h.pattern = pf.pattern
        WHERE ok_today > 0 AND (volume_today > upper OR volume_today < lower) AND NOT coalesce(ok_last > 0 AND abs(volume_today - volume_last) * 100 > volume_last * 50, false)
          AND NOT EXISTS (SELECT 1 FROM decided d WHERE d.snapshot_day = pf.snapshot_day AND d.source_id = pf.source_id AND (d.entity IS NULL OR d.entity = pf.entity))
      ) SELECT {DAY}, source_id, {FINDING_COLUMNS} FROM (SELECT * FROM hv UNION ALL SELECT * FROM ho UNION ALL SELECT * FROM fr)""",
    "volume_state_bands": f"""{WITH_FILES}, {BANDS}, last_day AS (SELECT max(snapshot_day) AS d FROM f), keys AS (
        SELECT DISTINCT d AS day, source_id, pattern FROM bands, last_day WHERE day < d AND isodow(day) = isodow(d)
      ), v2 AS (SELECT day, source_id, pattern, volume, n FROM (
        SELECT b.day, b.source_id, b.pattern, b.volume, row_number() OVER (PARTITION BY b.source_id, b.pattern ORDER BY b.day DESC) AS n
        FROM bands b JOIN keys k ON k.source_id = b.source_id AND k.pattern = b.pattern AND b.day < k.day AND isodow(b.day) = isodow(k.day)) WHERE n <= 8
      ), g AS (
        SELECT source_id, pattern, count(*) AS n_days, min(volume) AS lowest, max(volume) AS highest, sum(volume) AS s, sum(CAST(volume AS HUGEINT) * volume) AS q FROM v2 GROUP BY ALL
      ), r AS (
        SELECT *, CASE WHEN n_days >= 3 THEN CAST(s AS DOUBLE) / n_days END AS mean_volume,
          CASE WHEN n_days >= 3 THEN sqrt(CAST(n_days * q - s * s AS DOUBLE) / (n_days * (n_days - 1))) END AS sd FROM g
      ) SELECT CAST(d AS VARCHAR) AS day, source_id, pattern, n_days, lowest, highest, mean_volume, mean_volume - 1.96::DOUBLE * sd AS lower, mean_volume + 1.96::DOUBLE * sd AS upper
      FROM r, last_day""",
    "learnt_cadence": f"""{WITH_FILES}, {CADENCE} SELECT source_id, pattern, n_days, longest_gap, cadence, due_mask FROM cadence""",
    "missing_with_cadence": f"""{WITH_FACTS}, {CADENCE} SELECT CAST(fm.snapshot_day AS VARCHAR) AS snapshot_day, source_id, {FINDING_COLUMNS}
      FROM fm LEFT JOIN cadence c USING (source_id, pattern) LEFT JOIN cpat q USING (source_id, pattern)
      WHERE q.due_mask IS NOT NULL OR coalesce(cadence, 'irregular') = 'irregular' OR (c.due_mask >> (isodow(fm.snapshot_day) - 1)) & 1 = 1""",
    "timing_raw": _timing(0),
    "timing_shifted": _timing(7),
    "late_files": _timing(7, "hour_difference_max > 4"),
    "early_files": _timing(7, "hour_difference_min < -4", "-hour_difference_min AS hours_early, *"),
    "late_vs_window": f"""{WITH_FACTS} SELECT {DAY}, source_id, filename, entity, uploaded_at, slot_start AS window_start, slot_end AS window_end,
        (epoch_us(uploaded_at) - epoch_us(CAST(snapshot_day AS TIMESTAMP) + to_minutes(slot_end))) / 3.6e9 AS hours_late
      FROM tf WHERE epoch_us(uploaded_at) - epoch_us(CAST(snapshot_day AS TIMESTAMP) + to_minutes(slot_end)) > 4 * 3600000000""",
    "late_detector": _detector("late"),
    "previous_period": _detector("previous", FINDING_COLUMNS + ", CASE WHEN metric <= 2 THEN 1 ELSE 0 END AS detector_severity"),
    "recurrence": f"""{WITH_FACTS}, daily AS (
        SELECT snapshot_day, source_id, detector, kind, pattern, count(*) AS n_findings FROM findings GROUP BY ALL
      ) SELECT {DAY}, source_id, detector, kind, pattern, n_findings, count(*) OVER w AS earlier_days, count(*) OVER w > 0 AS is_recurring
      FROM daily WINDOW w AS (PARTITION BY source_id, detector, kind, pattern ORDER BY snapshot_day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    "top_volumes": f"""{WITH_FILES} SELECT {DAY}, source_id, filename, rows, uploaded_at, status FROM t WHERE status IN ('processed', 'empty')
      ORDER BY rows DESC, source_id, filename, uploaded_at LIMIT 10""",
    "volumes_ordered": f"{WITH_FILES} SELECT {DAY}, source_id, filename, rows, uploaded_at, status FROM t WHERE status IN ('processed', 'empty') ORDER BY rows DESC",
    "uploads_ordered": f"{WITH_FILES} SELECT {DAY}, source_id, filename, uploaded_at, status FROM t ORDER BY uploaded_at",
    "filenames_ordered": f"{WITH_FILES} SELECT {DAY}, source_id, filename, rows, from_period FROM m ORDER BY filename",
    "total_records": f"""{WITH_FILES} SELECT {DAY}, source_id, CAST(sum(rows) AS BIGINT) AS total_rows, '`[' || format('{{:,}}', CAST(sum(rows) AS BIGINT)) || '] records`' AS records_text
      FROM t GROUP BY ALL""",
    "affected_share": f"""{WITH_FILES} SELECT {DAY}, source_id, count(*) AS n_files, count(*) FILTER (is_duplicated AND status = 'stopped') AS n_affected,
        count(*) FILTER (is_duplicated AND status = 'stopped') * 100.0 / count(*) AS affected_pct FROM t GROUP BY ALL""",
    "findings": f"{WITH_FACTS} SELECT {DAY}, source_id, {FINDING_COLUMNS} FROM findings",
    "ranked_findings": f"""{WITH_FACTS} SELECT {DAY}, source_id, detector, message, severity, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_day, source_id, detector ORDER BY severity DESC,
          CASE WHEN detector IN ('late', 'previous') THEN metric ELSE abs(coalesce(metric, 0) - coalesce(baseline, 0)) END DESC, message, filename NULLS FIRST) AS rank
        FROM findings)""",
    "missing_records": _record(
        "SELECT snapshot_day, source_id, ['missing_files'] AS names, pattern AS name, message FROM fm UNION ALL SELECT snapshot_day, source_id, ['late_files'], filename, message FROM fl",
        {"missing_files": "missing_files_number", "late_files": "late_files_number"}),
    "duplicated_failed_records": _record(
        "SELECT *, filename AS name, CASE kind WHEN 'blocked_duplicate' THEN ['duplicated_files', 'failed_files'] WHEN 'duplicate' THEN ['duplicated_files'] ELSE ['failed_files'] END AS names FROM fd",
        {"duplicated_files": None, "failed_files": None}, "count(*) AS total_issues"),
    "empty_records": _record("SELECT *, filename AS name, ['empty_files'] AS names FROM fe", {"empty_files": "total_empty_files"}),
    "volume_records": _record("SELECT *, pattern AS name, ['unexpected_volume_files'] AS names FROM (SELECT * FROM fv UNION ALL SELECT * FROM fr)", {"unexpected_volume_files": "total_unexpected_volume_files"}),
    "late_records": _record("SELECT *, filename AS name, ['files_uploaded_after_schedule'] AS names FROM fl", {"files_uploaded_after_schedule": "total_files_uploaded_after_schedule"}),
    "previous_records": _record("SELECT *, filename AS name, ['previous_period_files'] AS names FROM fp", {"previous_period_files": "total_previous_period_files"}),
    "near_names": f"""{NEAR} SELECT {DAY}, source_id, pattern, n_near, nearest FROM near""",
    "near_name_findings": f"""{NEAR} SELECT {DAY}, source_id, 'duplicated_failed' AS detector, 'near_identical_name' AS kind, NULL AS filename, pattern, NULL AS entity,
        CAST(n_near AS DOUBLE) AS metric, CAST(NULL AS DOUBLE) AS baseline, 0 AS severity, NULL AS error_text,
        pattern || ' differs by one character from ' || CAST(n_near AS VARCHAR) || CASE WHEN n_near = 1 THEN ' other name, ' ELSE ' other names, the first being ' END || nearest AS message FROM near""",
    "timing_runs": f"{WITH_ISSUES} SELECT {DAY}, source_id, pattern, direction, CAST(run_start AS VARCHAR) AS run_start, run_length, shift_minutes, course FROM truns",
    "entity_issues": f"""{WITH_FACTS}, gone AS (SELECT DISTINCT snapshot_day, source_id, pattern FROM fm), named AS (
        SELECT x.snapshot_day, x.source_id, coalesce(entity, pattern, 'unnamed') AS entity, severity,
          CASE WHEN kind = 'duplicate' THEN 'duplicate' WHEN detector = 'duplicated_failed' THEN 'failed' WHEN kind = 'early' THEN 'early' ELSE detector END AS issue
        FROM findings x WHERE NOT (detector = 'late' AND EXISTS (SELECT 1 FROM gone g WHERE g.snapshot_day = x.snapshot_day AND g.source_id = x.source_id AND g.pattern = x.pattern))
      ), ranks AS (SELECT unnest(['missing', 'failed', 'empty', 'volume', 'late', 'early', 'previous', 'duplicate']) AS issue, unnest(range(8)) AS r),
      kinds AS (SELECT snapshot_day, source_id, entity, issue, r, count(*) AS n, max(severity) AS severity FROM named JOIN ranks USING (issue) GROUP BY ALL)
      SELECT {DAY}, source_id, entity, arg_min(issue, r) AS leading, max(severity) AS severity,
        {", ".join(f"CAST(coalesce(sum(n) FILTER (issue = '{i}'), 0) AS BIGINT) AS n_{i}" for i in ("missing", "failed", "empty", "volume", "late", "early", "previous", "duplicate"))},
        entity || ': ' || string_agg(CAST(n AS VARCHAR) || ' ' || issue, ', ' ORDER BY r) AS clause FROM kinds GROUP BY snapshot_day, source_id, entity""",
    "detector_severities": f"""{WITH_ISSUES} SELECT {DAY}, source_id, detector, severity FROM (
        SELECT snapshot_day, source_id, unnest(['missing', 'duplicated_failed', 'volume', 'empty', 'late', 'previous']) AS detector,
          unnest([missing_severity, duplicated_failed_severity, volume_severity, empty_severity, late_severity, previous_severity]) AS severity FROM crit)""",
    "source_criticality": f"""{WITH_ISSUES} SELECT {DAY}, source_id, n_files, total_rows, missing_severity, duplicated_failed_severity, volume_severity,
        empty_severity, late_severity, previous_severity, severity,
        CASE severity WHEN 2 THEN 'URGENT ACTION REQUIRED' WHEN 1 THEN 'NEEDS ATTENTION' ELSE 'NO ACTION NEEDED' END AS criticality_level FROM crit""",
    "source_lines": f"{WITH_ISSUES} SELECT {DAY}, source_id, source_name, severity, criticality_level, summary_line, recommended_action, total_rows, n_files FROM lines",
    "executive_report": f"""{WITH_ISSUES}, bullets AS (
        SELECT snapshot_day, CAST(3 - severity AS INTEGER) AS section, 1 AS position, source_id,
          '• *' || source_name || ' (id: ' || source_id || ')* – ' || strftime(snapshot_day, '%Y-%m-%d') || ': ' || summary_line ||
          CASE WHEN severity > 0 AND recommended_action <> '' THEN ' → *Action:* ' || recommended_action ELSE '' END AS line FROM lines
      ), heads AS (
        SELECT snapshot_day, unnest([0, 1, 2, 3]) AS section, 0 AS position, '' AS source_id,
          unnest(['*Report generated at UTC HOUR*: 20:00 UTC', '* Urgent Action Required*', '* Needs Attention*', '* No Action Needed*']) AS line
        FROM (SELECT DISTINCT snapshot_day FROM bullets)
      ), blanks AS (
        SELECT h.snapshot_day, h.section, 1, '', CASE WHEN h.section = 2 THEN '• No attention required at this time.' ELSE '• No issues required at this time.' END
        FROM heads h ANTI JOIN bullets b USING (snapshot_day, section) WHERE h.section > 0
      ) SELECT {DAY}, section, position, source_id, line FROM (SELECT * FROM bullets UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM blanks)""",
    "source_report": f"""{WITH_ISSUES}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY snapshot_day, source_id, detector ORDER BY severity DESC,
          CASE WHEN detector IN ('late', 'previous') THEN metric ELSE abs(coalesce(metric, 0) - coalesce(baseline, 0)) END DESC, message, filename NULLS FIRST) AS rank
        FROM findings
      ), texts AS (
        SELECT snapshot_day, source_id, detector, string_agg(message, '; ' ORDER BY rank) AS text
        FROM ranked GROUP BY ALL
      ), wide AS (
        SELECT snapshot_day, source_id, max(text) FILTER (detector = 'missing') AS a, max(text) FILTER (detector = 'duplicated_failed') AS b,
          max(text) FILTER (detector = 'volume') AS c, max(text) FILTER (detector = 'late') AS d, max(text) FILTER (detector = 'empty') AS e, max(text) FILTER (detector = 'previous') AS f
        FROM texts GROUP BY ALL
      ), parted AS (
        SELECT x.*, strftime(snapshot_day, '%Y-%m-%d') AS processing_date, '`[' || format('{{:,}}', total_rows) || '] records`' AS records, a, b, c, d, e, f,
          concat_ws(chr(10), '**Missing Files**: ' || a, '**Failed/Duplicate Files**: ' || b, '**Volume Variations**: ' || c, '**Late/Early Uploads**: ' || d,
            '**Empty Files**: ' || e, '**Previous Period Files**: ' || f) AS body
        FROM lines x LEFT JOIN wide USING (snapshot_day, source_id)
      ) SELECT {DAY}, source_id, 0 AS part, source_name, processing_date, criticality_level, summary_line,
          coalesce(a, '') AS missing_files_details, coalesce(b, '') AS failed_duplicate_details, coalesce(c, '') AS volume_variation_details,
          coalesce(d, '') AS late_early_upload_details, coalesce(e, '') AS empty_file_details, coalesce(f, '') AS previous_period_details,
          CASE WHEN severity = 0 THEN records ELSE '' END AS total_records, recommended_action,
          concat_ws(chr(10), '## Source: ' || source_name || ' (id: ' || source_id || ')', '**Date**: ' || processing_date, '**Criticality Level**: ' || criticality_level,
            '', '### Summary Line', summary_line, '', '### Detailed Findings', CASE WHEN body = '' THEN 'All files received and processed normally.' ELSE body END,
            CASE WHEN severity = 0 THEN chr(10) || '### Total Records' || chr(10) || records END,
            CASE WHEN severity > 0 THEN chr(10) || '### Recommended Action' || chr(10) || recommended_action END) AS full_report
      FROM parted""",
    "cv_names": f"{WITH_DOCS} SELECT source_id, source_name, CAST(length(text) AS INTEGER) AS n_chars FROM cvn",
    "cv_generic_names": f"{WITH_DOCS} SELECT source_id, 'Source_' || source_id AS source_name FROM docs",
    "cv_windows": f"{WITH_DOCS} SELECT source_id, entity, start_min, end_min FROM windows",
    "cv_usual_times": f"{WITH_DOCS} SELECT source_id, entity, minute FROM usual",
    "cv_volume_ranges": f"{WITH_DOCS} SELECT source_id, entity, kind, dow, lo, hi FROM ranges",
    "cv_entities": f"{WITH_DOCS} SELECT source_id, entity FROM cent",
    "cv_file_patterns": f"{WITH_DOCS} SELECT source_id, expected_name, pattern, due_mask FROM cpat",
    "cv_schedule": f"""{WITH_DOCS} SELECT source_id, NULL AS pattern, not_expected_on FROM csched UNION ALL
      SELECT source_id, pattern, day FROM cpat, (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS day, unnest(range(7)) AS i)
      WHERE (due_mask >> CAST(i AS INTEGER)) & 1 = 0""",
    "cv_exemptions": f"{WITH_DOCS} SELECT source_id, kind, entity, lag_days FROM cex",
    "cv_unparsed": f"{WITH_DOCS} SELECT source_id, 'Contact: provider desk' AS line FROM docs",
    "missing_cvs": f"{WITH_FILES}, {DOCS} SELECT DISTINCT source_id FROM m ANTI JOIN docs USING (source_id)",
    "first_sources": f"{WITH_DOCS} SELECT source_id, source_name FROM cvn ORDER BY source_id LIMIT 3",
    "adhoc_today": f"{WITH_FILES} SELECT source_id, status, count(*) AS n, CAST(sum(rows) AS BIGINT) AS total FROM t GROUP BY ALL",
    "adhoc_both_periods": f"""{WITH_FILES} SELECT {DAY}, source_id, count(*) FILTER (from_period = 'today') AS files_today,
        count(*) FILTER (from_period = 'last_weekday') AS files_last_week, CAST(coalesce(sum(rows) FILTER (from_period = 'today'), 0) - coalesce(sum(rows) FILTER (from_period = 'last_weekday'), 0) AS BIGINT) AS difference
      FROM m GROUP BY ALL""",
}
