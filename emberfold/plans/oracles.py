"""The registered queries as SQL for an independent engine, one statement per query key.

Shared common table expressions are kept once and prepended where a statement needs them.
"""

from __future__ import annotations

from emberfold.functions.geo import SpaceTimeGrid

_DET = """det AS (
SELECT event_id, user_id,
  round(36.0e0 + (user_id * 37 % 790) / 100.0e0 + ((event_id * 7919) % 41 - 20) / 1000.0e0, 5) AS latitude,
  round(-9.0e0 + (user_id * 91 % 1300) / 100.0e0 + ((event_id * 104729) % 41 - 20) / 1000.0e0, 5) AS longitude,
  CASE event_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS acq_date,
  CAST(hour(ts) * 100 + minute(ts) AS INT) AS acq_time,
  CASE event_type WHEN 'click' THEN 'N20' WHEN 'error' THEN 'N20' WHEN 'signup' THEN 'NPP' ELSE 'N21' END AS satellite,
  value AS frp,
  date_trunc('minute', ts) AS observed_at
FROM events)"""

_DIRTY = _DET + """,
planted AS (
SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN '90' ELSE CAST(latitude AS VARCHAR) END AS latitude,
  CAST(longitude AS VARCHAR) AS longitude,
  CASE WHEN event_id % 71 = 0 THEN 'unexpected' ELSE confidence END AS confidence,
  acq_date,
  CASE WHEN event_id % 89 = 0 THEN '2460' ELSE CAST(acq_time AS VARCHAR) END AS acq_time,
  CASE WHEN event_id % 83 = 0 THEN chr(7) WHEN event_id % 67 = 0 THEN satellite || chr(7) ELSE satellite END AS satellite,
  CASE WHEN event_id % 73 = 0 THEN '1001' WHEN event_id % 79 = 0 THEN 'not-a-number' ELSE CAST(frp AS VARCHAR) END AS frp
FROM det),
dirty AS (
SELECT * FROM planted
UNION ALL
SELECT event_id, latitude, longitude, 'h', acq_date, acq_time, satellite, '20' FROM planted WHERE event_id % 61 = 0)"""

_ANNOTATED = _DIRTY + """,
parsed AS (
SELECT event_id, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude,
  confidence AS confidence_raw, satellite AS satellite_raw,
  nullif(regexp_replace(satellite, '[\\x00-\\x1f\\x7f]', '', 'g'), '') AS satellite,
  confidence,
  CASE WHEN TRY_CAST(acq_time AS INT) BETWEEN 0 AND 2359 AND TRY_CAST(acq_time AS INT) % 100 <= 59
    THEN TRY_CAST(acq_time AS INT) END AS acq_time,
  CAST(acq_date AS DATE) AS day,
  CASE WHEN TRY_CAST(frp AS DOUBLE) >= 0 THEN TRY_CAST(frp AS DOUBLE) END AS frp
FROM dirty),
timed AS (
SELECT *, CAST(day AS TIMESTAMP) + to_minutes(acq_time // 100 * 60 + acq_time % 100) AS observed_at FROM parsed),
annotated AS (
SELECT *,
  CASE WHEN latitude IS NULL OR longitude IS NULL OR NOT (latitude BETWEEN 35 AND 44 AND longitude BETWEEN -10 AND 5) THEN 'invalid_coordinates'
       WHEN observed_at IS NULL OR NOT (observed_at BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND TIMESTAMP '2024-01-31 00:15:00') THEN 'invalid_timestamps'
       WHEN satellite IS NULL THEN 'invalid_satellites' END AS reject_reason,
  satellite IS NOT NULL AND satellite <> satellite_raw AS satellite_sanitized,
  lower(confidence) NOT IN ('l', 'low', 'n', 'nominal', 'h', 'high') AS confidence_unknown,
  frp IS NULL AS frp_invalid, coalesce(frp > 1000, false) AS frp_high
FROM timed),
flagged AS (
SELECT *, concat_ws(',', CASE WHEN confidence_unknown THEN 'confidence_unknown' END, CASE WHEN frp_high THEN 'frp_high' END,
  CASE WHEN frp_invalid THEN 'frp_invalid' END, CASE WHEN satellite_sanitized THEN 'satellite_sanitized' END) AS flags
FROM annotated),
grouped AS (
SELECT *, row_number() OVER w AS place,
  count(*) OVER (PARTITION BY latitude, longitude, observed_at, satellite) AS copies,
  first_value(confidence) OVER w AS best_confidence, first_value(frp) OVER w AS best_frp, first_value(flags) OVER w AS best_flags
FROM flagged WHERE reject_reason IS NULL
WINDOW w AS (PARTITION BY latitude, longitude, observed_at, satellite
  ORDER BY confidence, coalesce(CAST(frp AS VARCHAR), 'None'), flags DESC))"""

_COMP = _DET.replace("det AS (", "RECURSIVE det AS (", 1) + """,
keyed AS (
SELECT event_id, latitude, longitude, CAST(epoch(observed_at) AS BIGINT) AS t,
  CAST(floor(latitude / 0.02e0) AS BIGINT) AS gy, CAST(floor(longitude / 0.03e0) AS BIGINT) AS gx,
  CAST(epoch(observed_at) AS BIGINT) // 86400 AS gt FROM det),
near_keys AS (
SELECT event_id, latitude, longitude, t, gy + dy AS gy, gx + dx AS gx, gt + dt AS gt FROM keyed,
  (VALUES (-1), (0), (1)) AS y(dy), (VALUES (-1), (0), (1)) AS x(dx), (VALUES (-1), (0), (1)) AS z(dt)),
pairs AS (
SELECT a.event_id AS s, b.event_id AS e FROM keyed a JOIN near_keys b USING (gy, gx, gt)
WHERE a.event_id <> b.event_id AND abs(a.t - b.t) <= 86400
  AND 2 * 6371.0088e0 * asin(sqrt(sin(radians(b.latitude - a.latitude) / 2) ** 2
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ** 2)) <= 2),
reach AS (
SELECT event_id AS a, event_id AS b FROM det
UNION
SELECT reach.a, pairs.e FROM reach JOIN pairs ON reach.b = pairs.s),
comp AS (SELECT a AS event_id, min(b) AS component FROM reach GROUP BY a)"""

_HOURLY = _COMP[: _COMP.index("reach AS (")] + """hours AS (SELECT date_trunc('hour', observed_at) AS h, max(observed_at) AS snapshot_time FROM det GROUP BY 1),
alive AS (SELECT h, event_id, frp FROM det JOIN hours ON observed_at BETWEEN snapshot_time - INTERVAL 1 DAY AND snapshot_time),
hour_pairs AS (SELECT a.h, s, e FROM pairs JOIN alive a ON a.event_id = s JOIN alive b ON b.event_id = e AND b.h = a.h),
reach AS (
SELECT h, event_id AS a, event_id AS b FROM alive
UNION
SELECT reach.h, reach.a, hour_pairs.e FROM reach JOIN hour_pairs ON reach.b = hour_pairs.s AND reach.h = hour_pairs.h),
hourly AS (
SELECT h, component, count(*) AS n, sum(CAST(round(coalesce(frp, 0) * 100) AS BIGINT)) AS cents
FROM (SELECT h, a AS event_id, min(b) AS component FROM reach GROUP BY ALL) JOIN alive USING (h, event_id) GROUP BY ALL)"""

_INC = _COMP + """,
members AS (
SELECT det.*, component,
  printf('%.5f', latitude) || ',' || printf('%.5f', longitude) || ',' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00,' || satellite AS fingerprint,
  sha256('VIIRS_NOAA20_NRT|' || satellite || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.5f', latitude) || '|' || printf('%.5f', longitude)) AS detection_id,
  CASE confidence WHEN 'l' THEN 'low' WHEN 'n' THEN 'nominal' ELSE 'high' END AS level,
  row_number() OVER (PARTITION BY component ORDER BY observed_at, latitude, longitude, satellite, frp) AS place,
  count(*) OVER (PARTITION BY component) AS n
FROM det JOIN comp USING (event_id)),
halves AS (
SELECT component,
  sum(CAST(round(frp * 100) AS BIGINT)) FILTER (WHERE place <= n // 2) / 1e2 / nullif(count(frp) FILTER (WHERE place <= n // 2), 0) AS earlier,
  sum(CAST(round(frp * 100) AS BIGINT)) FILTER (WHERE place > n // 2) / 1e2 / nullif(count(frp) FILTER (WHERE place > n // 2), 0) AS later
FROM members GROUP BY component),
inc AS (
SELECT component, 'incident-' || substr(sha256(concat_ws('|', count(*),
    sum(CAST('0x' || substr(sha256(fingerprint), 1, 12) AS BIGINT)), sum(CAST('0x' || substr(sha256(fingerprint), 13, 12) AS BIGINT)),
    sum(CAST('0x' || substr(sha256(fingerprint), 25, 12) AS BIGINT)), sum(CAST('0x' || substr(sha256(fingerprint), 37, 12) AS BIGINT)))), 1, 10) AS id,
  count(*) AS detection_count,
  CAST(printf('%.5f', sum(CAST(round(latitude * 1000) AS BIGINT)) / 1e3 / count(*)) AS DOUBLE) AS center_latitude,
  CAST(printf('%.5f', sum(CAST(round(longitude * 1000) AS BIGINT)) / 1e3 / count(*)) AS DOUBLE) AS center_longitude,
  coalesce(sum(CAST(round(frp * 100) AS BIGINT)), 0) / 1e2 AS total_frp_mw,
  coalesce(max(frp), 0) AS maximum_frp_mw,
  min(observed_at) AS first_at, max(observed_at) AS last_at,
  CAST(printf('%.2f', (max(epoch(observed_at)) - min(epoch(observed_at))) / 3600e0) AS DOUBLE) AS duration_hours,
  count(*) FILTER (WHERE level = 'low') AS low_n, count(*) FILTER (WHERE level = 'nominal') AS nominal_n, count(*) FILTER (WHERE level = 'high') AS high_n
FROM members GROUP BY component),
incident AS (
SELECT inc.*,
  CASE WHEN high_n >= nominal_n AND high_n >= low_n THEN 'high' WHEN nominal_n >= low_n THEN 'nominal' ELSE 'low' END AS confidence,
  CASE WHEN detection_count < 3 OR first_at = last_at THEN 'stable'
       WHEN earlier <= 0 THEN CASE WHEN later > 0 THEN 'increasing' ELSE 'stable' END
       WHEN later > earlier * 1.2e0 THEN 'increasing' WHEN later < earlier * 0.8e0 THEN 'decreasing' ELSE 'stable' END AS trend,
  CASE WHEN total_frp_mw < 10 THEN 'low' WHEN total_frp_mw < 50 THEN 'moderate' WHEN total_frp_mw < 150 THEN 'high' ELSE 'extreme' END AS severity
FROM inc JOIN halves USING (component))"""

_CROWD = _INC.replace(_COMP + """,
members AS (""", _DET + """,
crowd AS (
SELECT det.* REPLACE (40.0e0 + event_id % 7 / 1e3 AS latitude, -3.0e0 + event_id % 5 / 1e3 AS longitude, s.name AS satellite), 1 AS component
FROM det, (VALUES ('N20'), ('N21'), ('NPP')) AS s(name)),
members AS (""").replace("det.*, component,", "det.*,").replace("FROM det JOIN comp USING (event_id))", "FROM crowd AS det)")

_IDENTITY = _INC + """,
prior AS (SELECT detection_id, 'cluster-' || user_id || '-' || (hour(observed_at) // 12) AS prior_id FROM members WHERE observed_at < TIMESTAMP '2024-01-16 00:00:00'),
held AS (
SELECT component, prior_id, min(observed_at) AS seen_at FROM members JOIN prior USING (detection_id) GROUP BY ALL),
owned AS (
SELECT component, prior_id, seen_at FROM held JOIN incident USING (component)
QUALIFY row_number() OVER (PARTITION BY prior_id ORDER BY first_at, id) = 1),
kept AS (
SELECT component, prior_id AS kept_id FROM owned QUALIFY row_number() OVER (PARTITION BY component ORDER BY seen_at, prior_id) = 1),
fresh AS (
SELECT component, 'cluster-' || substr(sha256(detection_id), 1, 16) AS new_id FROM members
QUALIFY row_number() OVER (PARTITION BY component ORDER BY observed_at, detection_id) = 1),
identity AS (
SELECT incident.*, coalesce(kept_id, new_id) AS cluster_id FROM incident JOIN fresh USING (component) LEFT JOIN kept USING (component)),
merged AS (SELECT component, prior_id AS merged_id FROM owned JOIN kept USING (component) WHERE prior_id <> kept_id)"""

_FACTS = _DET + """,
fact AS (
SELECT *, sha256('VIIRS_NOAA20_NRT|' || satellite || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.5f', latitude) || '|' || printf('%.5f', longitude)) AS detection_id
FROM det)"""

_SPOTS = _DET + """,
spot AS (
SELECT user_id, acq_date, count(*) AS n, sum(CAST(round(frp * 100) AS BIGINT)) / 1e2 AS total_frp_mw,
  (max(epoch(observed_at)) - min(epoch(observed_at))) / 3600e0 AS duration_hours, max(observed_at) AS last_at,
  CASE count(*) % 4 WHEN 0 THEN 'increasing' WHEN 1 THEN 'stable' WHEN 2 THEN 'decreasing' END AS trend
FROM det GROUP BY ALL)"""


def _half_up(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value})"


def _ring_number(value: str) -> str:
    return f"CAST(CAST(printf('%.5f', {value}) AS DOUBLE) AS VARCHAR)"


def _envelope_json() -> str:
    import math
    points = []
    for step in [6, 7, 8, 9, 10, 11, 0, 1, 2, 3, 4, 5, 6]:
        angle = 2 * math.pi * step / 12
        lon = f"longitude + 1.0e0 / (greatest(cos(radians(latitude)), 0.01e0) * 111.32e0) * ({math.cos(angle)!r}::DOUBLE)"
        lat = f"latitude + (1.0e0 / 111.32e0) * ({math.sin(angle)!r}::DOUBLE)"
        points.append(f"'[' || {_ring_number(lon)} || ',' || {_ring_number(lat)} || ']'")
    return """'{"type":"Polygon","coordinates":[[' || """ + " || ',' || ".join(points) + " || ']]}'"


def _token_bucket() -> str:
    return """WITH RECURSIVE req AS (
SELECT event_type AS client, event_id,
  1704067200000000 + (epoch_us(ts) - 1704067200000000) // 200 AS us,
  row_number() OVER (PARTITION BY event_type ORDER BY 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 200, event_id) AS i
FROM events),
walk AS (
SELECT client, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS g_tokens, CAST(NULL AS DOUBLE) AS g_at,
  CAST(NULL AS DOUBLE) AS s_tokens, CAST(NULL AS DOUBLE) AS s_at, '' AS outcome, CAST(0 AS BIGINT) AS retry_after
FROM (SELECT DISTINCT client FROM req)
UNION ALL
SELECT client, i, event_id,
  CASE WHEN g >= 1 THEN g - 1 ELSE g_tokens END, CASE WHEN g >= 1 THEN now ELSE g_at END,
  CASE WHEN g >= 1 AND s >= 1 THEN s - 1 ELSE s_tokens END, CASE WHEN g >= 1 AND s >= 1 THEN now ELSE s_at END,
  CASE WHEN g < 1 THEN 'local_guard' WHEN s < 1 THEN 'shared_bucket' ELSE 'allowed' END,
  CASE WHEN g < 1 THEN greatest(1, CAST(ceil((1 - g) * 3.0e0) AS BIGINT)) WHEN s < 1 THEN greatest(1, CAST(ceil((1 - s) * 12.0e0) AS BIGINT)) ELSE 0 END
FROM (
  SELECT walk.client, req.i, req.event_id, g_tokens, g_at, s_tokens, s_at, req.us / 1e6 AS now,
    CASE WHEN g_at IS NULL OR g_at + 86400 <= req.us / 1e6 THEN 20e0 ELSE least(20e0, g_tokens + greatest(0e0, req.us / 1e6 - g_at) / 3.0e0) END AS g,
    CASE WHEN s_at IS NULL OR s_at + 86400 <= req.us / 1e6 THEN 5e0 ELSE least(5e0, s_tokens + greatest(0e0, req.us / 1e6 - s_at) / 12.0e0) END AS s
  FROM walk JOIN req ON req.client = walk.client AND req.i = walk.i + 1))
SELECT client, event_id, outcome, retry_after FROM walk WHERE i > 0"""


def _sessions() -> str:
    grid = SpaceTimeGrid()
    deg = repr(grid.cell_deg)
    return f"""WITH {_DET},
rowed AS (SELECT *, least(CAST(floor((latitude + 90.0e0) / {deg}::DOUBLE) AS BIGINT), {grid.rows - 1}) AS gy FROM det),
sized AS (SELECT *, greatest(CAST(ceil(cos(radians(least(abs(gy * {deg}::DOUBLE - 90.0e0), abs((gy + 1) * {deg}::DOUBLE - 90.0e0)))) * (360.0e0 / {deg}::DOUBLE)) AS BIGINT), 1) AS cells FROM rowed),
placed AS (SELECT *, least(CAST(floor((longitude + 180.0e0) / 360.0e0 * cells) AS BIGINT), cells - 1) AS gx FROM sized),
gaps AS (SELECT *, CASE WHEN epoch(observed_at) - epoch(lag(observed_at) OVER w) <= 86400 THEN 0 ELSE 1 END AS starts FROM placed WINDOW w AS (PARTITION BY gy, gx ORDER BY observed_at)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY gy, gx ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN starts = 1 AND row_number() OVER (PARTITION BY gy, gx, observed_at ORDER BY event_id) > 1 THEN 0 ELSE starts END AS s2 FROM gaps) q)
SELECT CAST(min(observed_at) AS VARCHAR) AS started_at, CAST(max(observed_at) AS VARCHAR) AS ended_at, count(*) AS detections,
  min(latitude) AS south, min(longitude) AS west FROM runs GROUP BY gy, gx, run"""


_ISO = "strftime({}, '%Y-%m-%d %H:%M:%S')"


_HOURS = """hours AS (SELECT 'cluster-' || user_id AS cluster_id, date_trunc('hour', observed_at) AS hour, count(*) AS n, sum(coalesce(CAST(round(frp * 100) AS BIGINT), 0)) AS cents
  FROM det WHERE observed_at <= TIMESTAMP '2024-01-30 15:30:00' GROUP BY ALL),
filled AS (SELECT cluster_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hours GROUP BY cluster_id),
series AS (SELECT f.cluster_id, f.hour, coalesce(h.n, 0) AS n, coalesce(h.cents, 0) AS cents FROM filled f LEFT JOIN hours h ON f.cluster_id = h.cluster_id AND f.hour = h.hour)"""


def statements() -> dict[str, str]:
    det = f"WITH {_DET} "
    dirty = f"WITH {_DIRTY} "
    ann = f"WITH {_ANNOTATED} "
    inc = f"WITH {_INC} "
    ident = f"WITH {_IDENTITY} "
    fact = f"WITH {_FACTS} "
    spot = f"WITH {_SPOTS} "
    iso = _ISO.format
    columns = ["latitude", "longitude", "confidence", "acq_date", "acq_time", "satellite", "frp"]
    stats = """count(*) AS total_detections,
  coalesce(CAST(printf('%.2f', sum(CAST(round(frp * 100) AS BIGINT)) / 1e2 / count(frp)) AS DOUBLE), 0) AS average_frp,
  coalesce(max(frp), 0) AS maximum_frp"""
    corrected = "(SELECT observed_at, satellite, CASE WHEN event_id % 2 = 0 THEN frp ELSE 2 * frp END AS frp FROM det)"
    sql = {
        "fire_stats": det + f"SELECT {stats} FROM det",
        "s01_read_csv": det + "SELECT " + ", ".join(
            f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + " FROM det",
        "s02_required_columns": dirty + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS present_values FROM dirty" for c in columns),
        "s03_volume_guard": """SELECT o AS above_actual, n + o AS max_rows, n <= n + o AS allowed
FROM (SELECT count(*) AS n FROM events), (VALUES (-1), (0), (1)) AS v(o)""",
        "s04_all_invalid_batch": """SELECT 'home' AS area, count(*) AS received_rows, count(*) AS accepted_rows, false AS refused FROM events
UNION ALL SELECT 'elsewhere', count(*), 0, true FROM events""",
        "s05_area_window": det + """SELECT event_id, latitude, longitude FROM det
WHERE latitude BETWEEN 37 AND 42 AND longitude BETWEEN -5 AND 3
  AND observed_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:15:00'""",
        "s06_public_projection": ann + """SELECT latitude, longitude, best_confidence AS confidence, strftime(observed_at, '%Y-%m-%d') AS acq_date,
  acq_time, satellite, best_frp AS frp FROM grouped WHERE place = 1""",
        "s07_history_scan": fact + """SELECT detection_id, strftime(observed_at, '%Y-%m-%d') AS observation_date, latitude, longitude FROM fact
WHERE CAST(observed_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'""",
        "v01_coordinates": ann + "SELECT event_id, latitude, longitude, coalesce(reject_reason = 'invalid_coordinates', false) AS refused FROM annotated",
        "v02_bounds": ann + """SELECT event_id, coalesce(latitude BETWEEN 37 AND 42 AND longitude BETWEEN -5 AND 3, false) AS inside FROM annotated""",
        "v03_time": ann + "SELECT event_id, acq_time AS hhmm FROM annotated",
        "v04_observed_at": ann + f"SELECT event_id, {iso('observed_at')} AS observed_at FROM annotated",
        "v05_window": ann + """SELECT event_id, coalesce(observed_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:15:00', false) AS inside
FROM annotated WHERE reject_reason IS DISTINCT FROM 'invalid_coordinates'""",
        "v06_text": ann + """SELECT event_id, satellite, coalesce(satellite <> satellite_raw, true) AS changed_or_invalid FROM annotated""",
        "v07_satellite": ann + "SELECT event_id, satellite, satellite_sanitized, coalesce(reject_reason = 'invalid_satellites', false) AS refused FROM annotated",
        "v08_confidence": ann + "SELECT event_id, confidence, confidence_unknown FROM annotated",
        "v09_frp": ann + "SELECT event_id, frp, frp_invalid, frp_high FROM annotated",
        "v10_quality_flags": ann + "SELECT event_id, flags FROM flagged",
        "v11_deduplicate": ann + f"""SELECT latitude, longitude, best_confidence AS confidence, acq_time, satellite, best_frp AS frp, best_flags AS flags,
  {iso('observed_at')} AS observed_at, copies FROM grouped WHERE place = 1""",
        "v12_quality_report": ann + """SELECT
  (SELECT count(*) FROM annotated) AS received_rows,
  (SELECT count(*) FROM grouped WHERE place = 1) AS accepted_rows,
  (SELECT count(*) FROM annotated WHERE reject_reason IS NOT NULL) AS dropped_rows,
  (SELECT count(*) FROM grouped WHERE place > 1) AS duplicates_removed,
  (SELECT count(*) FROM grouped WHERE (confidence, frp, flags) IS DISTINCT FROM (best_confidence, best_frp, best_flags)) AS conflicting_duplicates,
  (SELECT count(*) FROM annotated WHERE reject_reason = 'invalid_coordinates') AS invalid_coordinates,
  (SELECT count(*) FROM annotated WHERE reject_reason = 'invalid_timestamps') AS invalid_timestamps,
  (SELECT count(*) FROM annotated WHERE reject_reason = 'invalid_satellites') AS invalid_satellites,
  (SELECT count(*) FROM grouped WHERE frp_invalid) AS invalid_frp,
  (SELECT count(*) FROM grouped WHERE frp_high) AS high_frp,
  (SELECT count(*) FROM grouped WHERE confidence_unknown) AS unknown_confidence""",
        "v13_canonical_sort": ann + """SELECT strftime(observed_at, '%Y-%m-%d') AS acq_date, acq_time, latitude, longitude, satellite,
  row_number() OVER (ORDER BY strftime(observed_at, '%Y-%m-%d'), acq_time, latitude, longitude, satellite) AS place FROM grouped WHERE place = 1""",
        "v14_coerce": ann + f"""SELECT event_id, latitude, longitude, CASE WHEN lower(confidence) IN ('l', 'low') THEN 'low' WHEN lower(confidence) IN ('n', 'nominal') THEN 'nominal'
  WHEN lower(confidence) IN ('h', 'high') THEN 'high' ELSE 'unknown' END AS confidence_normalized, frp, {iso('observed_at')} AS observed_at
FROM annotated WHERE latitude IS NOT NULL AND observed_at IS NOT NULL""",
        "a01_summary": ann + f"SELECT {stats.replace('frp)', 'best_frp)').replace('(frp', '(best_frp')} FROM grouped WHERE place = 1",
        "a02_by_satellite": ann + "SELECT satellite, count(*) AS detections FROM grouped WHERE place = 1 GROUP BY satellite",
        "a03_overview": inc + """SELECT count(*) AS possible_clusters, CAST(sum(detection_count) AS BIGINT) AS grouped_detections,
  max(total_frp_mw) AS highest_total_frp_mw, count(*) FILTER (WHERE duration_hours >= 6) AS persistent_clusters FROM incident""",
        "a04_severity_histogram": inc + """SELECT severity, count(*) AS snapshot_count FROM incident
WHERE detection_count % 3 <> 0 AND CAST(last_at AS DATE) >= DATE '2024-01-24' GROUP BY severity""",
        "a05_satellites": inc + """SELECT id, string_agg(satellite, ', ' ORDER BY first_place) AS satellites FROM (
  SELECT component, satellite, min(place) AS first_place FROM members GROUP BY ALL) JOIN incident USING (component) GROUP BY id""",
        "c01_haversine": det + """SELECT event_id, CAST(round(1e6 * 2 * 6371.0088e0 * asin(sqrt(sin(radians(latitude - 40.4168e0) / 2) ** 2
  + cos(radians(40.4168e0)) * cos(radians(latitude)) * sin(radians(longitude - (-3.7038e0)) / 2) ** 2))) AS BIGINT) AS distance_mm FROM det""",
        "c02_linked_detections": f"WITH {_COMP} SELECT event_id, event_id IN (SELECT s FROM pairs) AS linked FROM det",
        "c03_components": f"WITH {_COMP} SELECT event_id, component AS first_event_id FROM comp",
        "c04_detection_clusters": inc + "SELECT event_id, id AS incident_id FROM members JOIN incident USING (component)",
        "c05_incident_id": inc + "SELECT id, detection_count FROM incident",
        "c06_center": inc + "SELECT id, center_latitude, center_longitude FROM incident",
        "c07_frp_totals": inc + "SELECT id, total_frp_mw, maximum_frp_mw FROM incident",
        "c08_time_extent": inc + f"SELECT id, {iso('first_at')} AS first_detected_at, {iso('last_at')} AS last_detected_at, duration_hours FROM incident",
        "c09_confidence": inc + "SELECT id, confidence FROM incident",
        "c10_trend": inc + "SELECT id, trend FROM incident",
        "c11_severity": inc + "SELECT id, severity FROM incident",
        "c12_members": inc + """SELECT id, place, latitude, longitude, members.confidence AS confidence, acq_date, printf('%04d', acq_time) AS acq_time, satellite, frp
FROM members JOIN incident USING (component)""",
        "c13_envelope_points": det + """SELECT event_id, min(lat5) AS south, max(lat5) AS north, min(lon5) AS west, max(lon5) AS east, count(*) AS points FROM (
  SELECT event_id, CAST(round(1e5 * (latitude + 1.0e0 / 111.32e0 * sin(2 * pi() * k / 12))) AS BIGINT) AS lat5,
    CAST(round(1e5 * (longitude + 1.0e0 / (111.32e0 * greatest(cos(radians(latitude)), 0.01e0)) * cos(2 * pi() * k / 12))) AS BIGINT) AS lon5
  FROM det, range(12) AS r(k)) GROUP BY event_id""",
        "c14_envelope": inc + """SELECT id, min(CAST(round(1e5 * (latitude - 1.0e0 / 111.32e0)) AS BIGINT)) AS south, max(CAST(round(1e5 * (latitude + 1.0e0 / 111.32e0)) AS BIGINT)) AS north,
  min(CAST(round(1e5 * (longitude - 1.0e0 / (111.32e0 * cos(radians(latitude))))) AS BIGINT)) AS west,
  max(CAST(round(1e5 * (longitude + 1.0e0 / (111.32e0 * cos(radians(latitude))))) AS BIGINT)) AS east
FROM members JOIN incident USING (component) GROUP BY id""",
        "c15_ranked": inc + """SELECT row_number() OVER (ORDER BY total_frp_mw DESC, observed_at, latitude, longitude, satellite) AS rank,
  id, total_frp_mw, incident.confidence AS confidence, trend, severity FROM incident JOIN members USING (component) WHERE place = 1""",
        "c18_large_cluster": "WITH " + _CROWD + """ SELECT id, detection_count, total_frp_mw, trend, detection_count AS members, detection_count AS last_place,
  (SELECT string_agg(satellite, ', ' ORDER BY place) FROM (SELECT satellite, min(place) AS place FROM members GROUP BY satellite)) AS satellites, 0 AS violations
FROM incident""",
        "c16_contract": inc + """SELECT id, 'severity_unknown_label' AS violation FROM incident WHERE confidence = 'low'
UNION ALL SELECT id, 'duration_negative' FROM incident WHERE trend = 'decreasing'""",
        "c17_area_members": inc + """SELECT id AS incident_id, CASE WHEN detection_count > 1 THEN 'area' ELSE 'singleton' END AS layer, latitude, longitude, acq_date,
  printf('%04d', acq_time) AS acq_time FROM members JOIN incident USING (component)""",
        "h01_snapshot_hour": f"SELECT {iso(chr(100) + 'ate_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS snapshot_at, count(*) AS events FROM events GROUP BY 1",
        "h02_detection_id": fact + "SELECT event_id, detection_id FROM fact",
        "h03_first_per_id": ann + """SELECT sha256('VIIRS_NOAA20_NRT|' || satellite || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.5f', latitude) || '|' || printf('%.5f', longitude)) AS detection_id,
  confidence, frp FROM grouped
QUALIFY row_number() OVER (PARTITION BY satellite, observed_at, latitude, longitude ORDER BY confidence, frp NULLS FIRST) = 1""",
        "h04_prior_assignments": fact + """SELECT detection_id, 'cluster-' || user_id AS prior_id FROM fact
WHERE observed_at < TIMESTAMP '2024-01-16 00:00:00' AND CAST(observed_at AS DATE) >= DATE '2024-01-10'""",
        "h05_new_cluster_id": ident + "SELECT id AS incident_id, new_id FROM fresh JOIN incident USING (component)",
        "h06_identity": ident + "SELECT id AS incident_id, cluster_id FROM identity",
        "h07_active_snapshots": ident + """SELECT cluster_id, count(DISTINCT detection_id) AS detection_count,
  total_frp_mw, maximum_frp_mw, identity.confidence AS confidence, trend, severity, 'active' AS status FROM identity JOIN members USING (component) GROUP BY ALL""",
        "h07_snapshot_members": ident + "SELECT DISTINCT cluster_id, detection_id FROM identity JOIN members USING (component)",
        "h08_merged_snapshots": ident + f"""SELECT merged_id AS cluster_id, cluster_id AS merged_into_cluster_id, 0 AS detection_count, 0e0 AS total_frp_mw, severity, {iso('first_at')} AS first_detected_at
FROM merged JOIN identity USING (component)""",
        "h09_detection_facts": ident + """SELECT detection_id, cluster_id, strftime(observed_at, '%Y-%m-%d') AS observation_date, latitude, longitude, satellite, members.confidence AS confidence, frp AS frp_mw
FROM members JOIN identity USING (component)""",
        "h10_geojson": det + f"SELECT event_id, {_envelope_json()} AS boundary FROM det",
        "h11_relationships": fact + """SELECT 'duplicate_detection' AS violation, detection_id AS key FROM fact WHERE event_id % 61 = 0
UNION ALL SELECT DISTINCT 'orphan_cluster_reference', 'cluster-' || user_id FROM fact WHERE user_id NOT IN (SELECT user_id FROM fact WHERE satellite = 'NPP')
UNION ALL SELECT DISTINCT 'duplicate_cluster_snapshot', 'cluster-' || user_id FROM fact WHERE satellite = 'NPP' AND user_id IN (SELECT user_id FROM fact WHERE satellite = 'N20')""",
        "h12_upsert_clusters": fact + """SELECT 'cluster-' || user_id AS cluster_id, acq_date AS snapshot_date, count(*) AS detection_count, max(frp) AS maximum_frp_mw,
  CASE WHEN acq_date < '2024-01-16' THEN 'first' ELSE 'second' END AS source_dataset, 'high' AS severity FROM fact GROUP BY ALL""",
        "h13_upsert_detections": fact + """SELECT detection_id, 'cluster-' || user_id AS cluster_id, frp + 1 AS frp_mw, acq_date AS observation_date,
  CASE WHEN acq_date < '2024-01-16' THEN '2024-01-30 00:00:00' ELSE '2024-01-31 00:00:00' END AS first_ingested_at, '2024-01-31 00:00:00' AS last_ingested_at FROM fact""",
        "h14_json_batches": fact + f"SELECT detection_id, {iso('observed_at')} AS observed_at, latitude, longitude, frp, concat_ws(',', satellite, confidence) AS tags FROM fact",
        "h15_retention": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date, CAST(ts AS DATE) < DATE '2024-01-16' AS expired, count(*) AS rows_before,
  CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 0 ELSE count(*) END AS rows_after FROM events GROUP BY CAST(ts AS DATE)""",
        "h16_size_guard": "SELECT l AS limit_name, l = 'one_byte' AS refused, n AS rows_held FROM (SELECT count(*) AS n FROM events), (VALUES ('one_byte'), ('default')) AS v(l)",
        "h17_schema_evolution": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date, count(*) AS detections, count(*) FILTER (WHERE CAST(ts AS DATE) < DATE '2024-01-16') AS without_flags
FROM events GROUP BY CAST(ts AS DATE)""",
        "h18_layout": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date, count(*) AS detections, count(DISTINCT user_id) AS clusters FROM events GROUP BY CAST(ts AS DATE)",
        "h19_snapshot_job": f"""WITH {_COMP} SELECT 'ingested' AS status, '2024-01-31 00:00:00' AS snapshot_at, (SELECT count(*) FROM det) AS detections_processed,
  (SELECT count(DISTINCT component) FROM comp) AS cluster_snapshots_processed, 0 AS clusters_merged""",
        "p01_intensity": det + "SELECT event_id, CASE WHEN frp < 5 THEN 'Low' WHEN frp < 15 THEN 'Moderate' WHEN frp < 50 THEN 'High' ELSE 'Extreme' END AS intensity FROM det",
        "p02_cluster_level": spot + """SELECT user_id, acq_date, CASE WHEN total_frp_mw < 10 THEN 'Low' WHEN total_frp_mw < 50 THEN 'Moderate' WHEN total_frp_mw < 150 THEN 'High' ELSE 'Extreme' END AS level_label FROM spot""",
        "p03_time_label": det + """SELECT event_id, substr(printf('%04d', acq_time), 1, 2) || ':' || substr(printf('%04d', acq_time), 3, 2) || ' UTC' AS time_label,
  acq_date || ' at ' || substr(printf('%04d', acq_time), 1, 2) || ':' || substr(printf('%04d', acq_time), 3, 2) || ' UTC' AS observed_label FROM det""",
        "p04_confidence_label": dirty + "SELECT event_id, CASE confidence WHEN 'l' THEN 'Low' WHEN 'n' THEN 'Nominal' WHEN 'h' THEN 'High' ELSE confidence END AS confidence_label FROM dirty",
        "p05_frp_label": ann + "SELECT event_id, CASE WHEN frp IS NULL THEN 'Not available' ELSE printf('%.2f', frp) || ' MW' END AS frp_label FROM annotated",
        "p06_coordinates_label": det + "SELECT event_id, printf('%.4f', latitude) || ', ' || printf('%.4f', longitude) AS coordinates_label FROM det",
        "p07_detection_key": det + "SELECT event_id, concat_ws('-', CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR), acq_date, CAST(acq_time AS VARCHAR), satellite) AS detection_key FROM det",
        "p08_duration_label": spot + """SELECT user_id, acq_date, CASE WHEN duration_hours = 0 THEN 'Single observation' WHEN duration_hours < 1 THEN CAST(CAST(floor(duration_hours * 60 + 0.5) AS BIGINT) AS VARCHAR) || ' min'
  WHEN duration_hours * 4 = floor(duration_hours * 4) AND duration_hours * 2 <> floor(duration_hours * 2) THEN printf('%.1f', duration_hours + 0.01) || ' h'
  ELSE printf('%.1f', duration_hours) || ' h' END AS duration_label FROM spot""",
        "p09_trend_label": spot + "SELECT user_id, acq_date, CASE trend WHEN 'increasing' THEN 'Increasing' WHEN 'stable' THEN 'Stable' WHEN 'decreasing' THEN 'Decreasing' ELSE 'Unknown' END AS trend_label FROM spot",
        "p10_age_label": spot + """SELECT user_id, acq_date, CASE WHEN minutes < 60 THEN minutes || CASE WHEN minutes = 1 THEN ' minute ago' ELSE ' minutes ago' END
  ELSE hours || CASE WHEN hours = 1 THEN ' hour ago' ELSE ' hours ago' END END AS age_label
FROM (SELECT *, CAST(floor(minutes / 60e0 + 0.5) AS BIGINT) AS hours FROM (
  SELECT *, greatest(1, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_at)) / 60e0 + 0.5) AS BIGINT)) AS minutes FROM spot))""",
        "t01_stream_snapshots": f"""WITH {_HOURLY} SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS snapshot_at, count(*) AS clusters, sum(n) AS detections,
  max(n) AS largest, sum(cents) AS frp_cents FROM hourly GROUP BY h""",
        "t02_stream_dedup": ann + """SELECT DISTINCT sha256('VIIRS_NOAA20_NRT|' || satellite || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.5f', latitude) || '|' || printf('%.5f', longitude)) AS detection_id FROM grouped""",
        "t03_quarantine": ann + """SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN reject_reason = 'invalid_coordinates' THEN reject_reason
    WHEN observed_at IS NULL OR NOT observed_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:15:00' THEN 'invalid_timestamps' ELSE reject_reason END AS reason
  FROM annotated) GROUP BY 1""",
        "t04_token_bucket": _token_bucket(),
        "t04_token_bucket_stream": _token_bucket(),
        "t05_freshness": """WITH hit AS (
SELECT r.event_id, r.user_id, r.ts, s.ts AS snapshot_at FROM (SELECT * FROM events WHERE event_type = 'view') r
ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') s ON r.user_id = s.user_id AND r.ts >= s.ts)
SELECT event_id, user_id, snapshot_at IS NOT NULL AS available, CAST(floor((epoch_us(ts) - epoch_us(snapshot_at)) / 1e6) AS BIGINT) AS data_age_seconds,
  epoch_us(ts) - epoch_us(snapshot_at) >= 86400000000 AS data_stale FROM hit""",
        "t06_failure_backoff": """WITH a AS (
SELECT user_id, event_id, ts, event_type = 'error' AS failed,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS k FROM a WHERE failed)
SELECT user_id, event_id, k AS failure_count, CAST(least(60 * 2 ** least(k - 1, 30), 900) AS BIGINT) AS delay_seconds FROM b""",
        "t07_rolling_stats": det + f"""SELECT CAST(days AS BIGINT) AS days, {stats} FROM det JOIN (VALUES (1), (3), (5), (31)) AS v(days)
  ON observed_at >= TIMESTAMP '2024-01-31 00:00:00' - to_days(days) GROUP BY days""",
        "t07_sliding_stream": det + """SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total_detections, sum(CAST(round(frp * 100) AS BIGINT)) / 1e2 AS total_frp, max(frp) AS maximum_frp
FROM (SELECT frp, date_trunc('hour', observed_at) - to_hours(CAST(k * 6 AS INT)) - to_hours(CAST(hour(observed_at) % 6 AS INT)) AS window_start FROM det, range(4) AS r(k)) GROUP BY window_start""",
        "t07_sliding_append": det + """SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total_detections, sum(CAST(round(frp * 100) AS BIGINT)) / 1e2 AS total_frp, max(frp) AS maximum_frp
FROM (SELECT frp, date_trunc('hour', observed_at) - to_hours(CAST(k * 6 AS INT)) - to_hours(CAST(hour(observed_at) % 6 AS INT)) AS window_start FROM det, range(4) AS r(k)
  WHERE event_id % 97 <> 0 OR observed_at >= TIMESTAMP '2024-01-08 00:00:00') GROUP BY window_start
HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(observed_at) FROM det) - INTERVAL 24 HOUR""",
        "t07_history_rolling": det + f"""SELECT CAST(days AS BIGINT) AS days, {stats} FROM {corrected} JOIN (VALUES (1), (3), (7), (30)) AS v(days)
  ON observed_at BETWEEN TIMESTAMP '2024-01-30 15:30:00' - to_days(days) AND TIMESTAMP '2024-01-30 15:45:00' GROUP BY days""",
        "a02_history_satellites": det + f"""SELECT satellite, {stats} FROM {corrected}
WHERE observed_at BETWEEN TIMESTAMP '2024-01-20 15:30:00' AND TIMESTAMP '2024-01-30 15:45:00' GROUP BY satellite""",
        "a06_period_comparison": det + f"""SELECT satellite, coalesce(l.total_detections, 0) AS total_detections, coalesce(l.average_frp, 0) AS average_frp, coalesce(l.maximum_frp, 0) AS maximum_frp,
  coalesce(e.total_detections, 0) AS earlier_total_detections, coalesce(e.average_frp, 0) AS earlier_average_frp, coalesce(e.maximum_frp, 0) AS earlier_maximum_frp,
  coalesce(l.total_detections, 0) - coalesce(e.total_detections, 0) AS change_detections
FROM (SELECT satellite, {stats} FROM {corrected} WHERE observed_at BETWEEN TIMESTAMP '2024-01-21 15:30:00' AND TIMESTAMP '2024-01-30 15:45:00' GROUP BY satellite) AS l
FULL JOIN (SELECT satellite, {stats} FROM {corrected} WHERE observed_at >= TIMESTAMP '2024-01-12 15:30:00' AND observed_at < TIMESTAMP '2024-01-21 15:30:00' GROUP BY satellite) AS e USING (satellite)""",
        "h20_hourly_series": det + f""", {_HOURS} SELECT cluster_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour_start, n AS detections, cents / 1e2 AS total_frp FROM series""",
        "h20_persistence": det + f""", {_HOURS}, placed AS (SELECT *, row_number() OVER w - 1 AS x, count(*) OVER (PARTITION BY cluster_id) AS size, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER w AS run FROM series
  WINDOW w AS (PARTITION BY cluster_id ORDER BY hour)),
pauses AS (SELECT cluster_id, max(empty) AS pause FROM (SELECT cluster_id, run, count(*) - 1 AS empty FROM placed GROUP BY ALL) GROUP BY cluster_id)
SELECT cluster_id, any_value(size) AS span_hours, count(*) FILTER (n > 0) AS active_hours, any_value(pause) AS longest_pause_hours, CAST(sum(n) AS BIGINT) AS detections, sum(cents) / 1e2 AS total_frp,
  CASE WHEN any_value(size) > 1 THEN CAST(6 * (2 * sum(x * cents) - (any_value(size) - 1) * sum(cents)) AS DOUBLE) / (CAST(any_value(size) AS DOUBLE) * (CAST(any_value(size) AS DOUBLE) * any_value(size) - 1)) / 1e2 END AS slope_mw_per_hour,
  coalesce(sum(cents) FILTER (hour > TIMESTAMP '2024-01-29 15:00:00'), 0) / 1e2 AS last_24h_frp,
  coalesce(sum(cents) FILTER (hour > TIMESTAMP '2024-01-28 15:00:00' AND hour <= TIMESTAMP '2024-01-29 15:00:00'), 0) / 1e2 AS before_24h_frp,
  (coalesce(sum(cents) FILTER (hour > TIMESTAMP '2024-01-29 15:00:00'), 0) - coalesce(sum(cents) FILTER (hour > TIMESTAMP '2024-01-28 15:00:00' AND hour <= TIMESTAMP '2024-01-29 15:00:00'), 0)) / 1e2 AS change_frp
FROM placed JOIN pauses USING (cluster_id) GROUP BY cluster_id""",
        "a04_history_severity": det + """SELECT CASE WHEN top < 10 THEN 'low' WHEN top < 50 THEN 'moderate' WHEN top < 150 THEN 'high' ELSE 'extreme' END AS severity, count(*) AS snapshot_count
FROM (SELECT user_id, acq_date, count(*) AS n, max(frp) AS top FROM det GROUP BY ALL) WHERE n % 3 <> 0 AND acq_date >= '2024-01-09' GROUP BY ALL""",
        "t08_location_sessions": _sessions(),
        "l01_sanitize": """SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS id, left(regexp_replace(replace(replace(text, 'the', '[REDACTED]'), 'license', '[REDACTED]'), '[\\x00-\\x1f\\x7f]+', ' ', 'g'), 1000) AS text FROM documents
UNION ALL SELECT 'conversations', conv_id || '-' || turn, left(regexp_replace(replace(replace(text, 'the', '[REDACTED]'), 'license', '[REDACTED]'), '[\\x00-\\x1f\\x7f]+', ' ', 'g'), 1000) FROM conversations""",
    }
    uuid = """u AS (SELECT event_id, ts, event_type, md5(CAST(event_id AS VARCHAR)) AS h, 200 + (event_id * 7 % 5) * 100 AS status FROM events),
ids AS (SELECT event_id, ts, event_type, status, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN upper(h)
  ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || CASE WHEN event_id % 5 = 2 THEN '1' ELSE '4' END || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS client_id FROM u)"""
    key = b"report-key".ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    hmac = lambda message: f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"
    legacy = b"legacy-client-without-installation-id".hex()
    sql.update({
        "l02_uuid": f"""WITH {uuid} SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'invalid' WHEN event_id % 5 = 2 THEN 'other' ELSE 'v4' END AS kind FROM ids""",
        "l03_pseudonym": f"""WITH {uuid} SELECT event_id, CASE WHEN client_id = '' THEN {hmac(f"unhex('{legacy}')")}
  WHEN event_id % 5 >= 3 THEN {hmac("unhex(replace(client_id, '-', ''))")} END AS client_key FROM ids""",
        "l04_json_lines": f"""WITH {uuid} SELECT event_id, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","severity":"' || CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARNING' ELSE 'INFO' END
  || '","message":"' || event_type || '","event":"' || event_type || '","status":' || status || ',"client_id":"' || client_id || '"}}' AS line FROM ids""",
        "l05_status_severity": f"""WITH {uuid} SELECT event_id, CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARNING' ELSE 'INFO' END AS severity FROM ids""",
    })
    return sql
