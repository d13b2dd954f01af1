"""SQL for the queries, written against the driver's tables."""

ORACLE: dict[str, str] = {}


def _add(name: str, *parts: str) -> None:
    ORACLE[name] = "\n".join(parts)


def _with(*tables: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(tables)


# The raw log, as in tables.raw_log.
LOG = """
log AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session,
         event_id AS pos, event_type AS eventid, ts, epoch_us(ts) // 1000 AS ms,
         json_extract_string(props, '$.k') AS k, value, user_id,
         CASE WHEN value >= 5 THEN '10.0.0.' || user_id ELSE '' END AS src_ip,
         CASE WHEN json_extract_string(props, '$.k') = '0' THEN ''
              ELSE json_extract_string(props, '$.k') END AS src_port,
         CASE WHEN value >= 10 THEN '10.1.0.' || json_extract_string(props, '$.k') ELSE '' END AS dst_ip,
         CASE WHEN value >= 3 THEN json_extract_string(props, '$.k') END AS dst_port,
         'sensor-' || event_type AS sensor,
         CASE WHEN value < 50 THEN '' ELSE CAST(user_id AS VARCHAR) END AS uuid,
         CASE WHEN value < 2 THEN NULL ELSE 'ssh' END AS protocol
  FROM events
)"""

SESSIONS = LOG + """,
staged AS (
  SELECT *, CASE eventid WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2
            WHEN 'view' THEN 3 ELSE 4 END AS step,
         CASE eventid WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
            WHEN 'purchase' THEN 3 ELSE 4 END AS place,
         row_number() OVER (PARTITION BY session ORDER BY ms, pos) AS rn,
         row_number() OVER (PARTITION BY session ORDER BY ms DESC, pos DESC) AS back,
         row_number() OVER (PARTITION BY session, eventid ORDER BY ms, pos) AS nth
  FROM log
),
per_session AS (
  SELECT session,
         nullif(max(CASE WHEN rn = 1 THEN src_ip END), '') AS src_ip,
         max(CASE WHEN rn = 1 THEN sensor END) AS sensor,
         nullif(max(CASE WHEN rn = 1 THEN uuid END), '') AS uuid,
         max(CASE WHEN rn = 1 THEN protocol END) AS protocol,
         max(CASE WHEN eventid = 'view' AND nth = 1 THEN src_port END) AS src_port,
         nullif(max(CASE WHEN eventid = 'view' AND nth = 1 THEN dst_ip END), '') AS dst_ip,
         max(CASE WHEN eventid = 'view' AND nth = 1 THEN dst_port END) AS dst_port,
         min(ms) AS start_ms, max(ms) AS end_ms,
         min(ts) AS start_ts,
         max(CASE WHEN eventid = 'error' AND nth = 1 THEN CAST(k AS DOUBLE) END) AS closed,
         count(*) AS event_count,
         CASE min(step) WHEN 0 THEN 'purchase' WHEN 1 THEN 'signup' WHEN 2 THEN 'click'
              WHEN 3 THEN 'view' ELSE 'error' END AS stage
  FROM staged GROUP BY session
)"""

# Orders where the customer is, as in tables.space_events.
SPACE = """
place AS (
  SELECT *, 
         CASE WHEN c_custkey % 11 = 0 THEN ''
              ELSE CAST(CAST(c_nationkey * 80 - 950 + (c_custkey % 7) * 5 AS DOUBLE) / 10 AS VARCHAR) END AS latitude,
         CASE WHEN c_custkey % 11 = 0 THEN ''
              ELSE CAST(CAST(c_nationkey * 150 - 1800 + (c_custkey % 13) * 10 AS DOUBLE) / 10 AS VARCHAR) END AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
space AS (
  SELECT o_orderkey AS event_key, 'order ' || o_orderkey AS description,
         o_orderdate AS datetime, epoch_ms(o_orderdate) AS ms, n_name AS location,
         latitude, longitude,
         try_cast(nullif(latitude, '') AS DOUBLE) AS lat, try_cast(nullif(longitude, '') AS DOUBLE) AS lon,
         o_orderpriority AS category,
         CASE WHEN o_orderstatus = 'P' THEN 'SHAPE' ELSE 'order' END AS type,
         CASE WHEN o_totalprice < 200000 THEN c_mktsegment END AS shape,
         'status/' || o_orderstatus AS status_path, 'segment/' || c_mktsegment AS segment_path,
         o_custkey AS customer, o_totalprice AS price
  FROM place
)"""

IN_RANGE = "datetime > TIMESTAMP '1994-01-01' AND datetime < TIMESTAMP '1998-01-01'"
BY_FILTER = "(status_path = 'status/O' OR segment_path = 'segment/BUILDING')"
BY_CATEGORY = "category IN ('1-URGENT', '2-HIGH')"

# Sessions

_add("session_rows", _with(SESSIONS), """
SELECT session, src_ip, sensor, uuid, protocol, src_port, dst_ip, dst_port, start_ms, end_ms,
       round(coalesce(closed, (end_ms - start_ms) / 1000.0), 6) AS duration_sec, event_count, stage
FROM per_session""")

_add("session_stage_counts", _with(SESSIONS), "SELECT stage, count(*) AS sessions FROM per_session GROUP BY stage")

_add("session_groups", _with(SESSIONS), """
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY place, seen_ms, seen_pos) - 1 AS INTEGER) AS group_idx,
       eventid, event_count
FROM (SELECT session, eventid, place, count(*) AS event_count, min(ms) AS seen_ms, min(pos) AS seen_pos
      FROM staged GROUP BY ALL)""")

_add("occurrence_index", _with(SESSIONS), "SELECT session, pos, eventid, nth - 1 AS occurrence FROM staged")

_add("session_events", _with(SESSIONS), """,
ids AS (
  SELECT session, string_agg(eventid, ',' ORDER BY place) AS listed
  FROM (SELECT DISTINCT session, eventid, place FROM staged) GROUP BY session
)
SELECT p.session AS id,
       concat_ws(' ', p.session,
         CASE WHEN src_port IS NOT NULL THEN coalesce(src_ip, 'null') || ':' || src_port ELSE src_ip END,
         CASE WHEN dst_ip IS NOT NULL AND dst_port IS NOT NULL THEN '> ' || dst_ip || ':' || dst_port END,
         protocol) AS description,
       strftime(start_ts, '%m/%d/%Y') AS date, strftime(start_ts, '%H:%M') AS time,
       stage AS type,
       CASE stage WHEN 'purchase' THEN '#d64550' WHEN 'signup' THEN '#a970c9' WHEN 'click' THEN '#e8973a' END AS colour,
       '' AS latitude, 'stage:' || stage || ',' || listed AS associations
FROM per_session p JOIN ids USING (session)""")

_HEADER = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", None, None, None, None, None, "sensor", "uuid"]
_add("session_header", _with(SESSIONS), "\nUNION ALL\n".join(
    f"SELECT session, {place} AS place, '{name}' AS field, {name} AS value FROM per_session WHERE {name} <> ''"
    for place, name in enumerate(_HEADER) if name
) + """
UNION ALL SELECT session, 8, 'timestamp', CAST(start_ts AS VARCHAR) FROM per_session
UNION ALL
SELECT session, 9, 'duration', CASE WHEN d = floor(d) THEN CAST(CAST(d AS BIGINT) AS VARCHAR) ELSE CAST(d AS VARCHAR) END
FROM (SELECT session, coalesce(closed, (end_ms - start_ms) / 1000.0) AS d FROM per_session)""")

_add("session_cards", _with(SESSIONS), "SELECT count(*) AS cards FROM per_session")

LOGGED = """
SELECT session, pos, 'eventid' AS field, 0 AS item, eventid AS value FROM log
UNION ALL SELECT session, pos, 'session', 0, session FROM log
UNION ALL SELECT session, pos, 'message', 0, 'm ' || k FROM log WHERE value < 30
UNION ALL SELECT session, pos, 'src_ip', 0, src_ip FROM log
UNION ALL SELECT session, pos, 'zeta', 0, 'z' FROM log
UNION ALL SELECT session, pos, 'username', 0, 'root' FROM log WHERE value >= 10
UNION ALL SELECT session, pos, 'k', 0, k FROM log
UNION ALL SELECT session, pos, 'tags', 0, CASE WHEN value < 4 THEN '[]' ELSE eventid END FROM log WHERE value < 20
UNION ALL SELECT session, pos, 'tags', 1, k FROM log WHERE value >= 4 AND value < 20
UNION ALL SELECT session, pos, 'timestamp', 0, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') FROM log"""
_add("log_fields", _with(LOG), LOGGED)

_add("field_coverage", _with(LOG), """
SELECT session, pos,
       concat_ws(',', 'timestamp', 'k', CASE WHEN value >= 10 THEN 'username' END, 'zeta',
                 CASE WHEN value < 20 THEN 'tags' END, CASE WHEN value < 30 THEN 'message' END) AS fields,
       concat_ws(',', CASE WHEN value < 10 THEN 'username' END, 'of_' || eventid) AS absent
FROM log""")

# Payloads

_add("log_lines", _with(LOG), "SELECT session, pos, eventid, ms, src_ip, CAST(NULL AS VARCHAR) AS protocol FROM log")

_add("classify_payloads", """
SELECT event_type <> 'view' AS is_session_export, count(*) AS documents FROM events GROUP BY 1""")

_add("session_export", _with(LOG), """
SELECT CAST(pos AS VARCHAR) AS file, session, '10.9.9.9' AS src_ip, '1.5' AS latitude,
       CAST(1 AS BIGINT) AS event_count, eventid AS stage, ms AS start_ms
FROM log WHERE eventid <> 'view'""")

_add("event_objects", _with(LOG), """
SELECT CAST(pos AS VARCHAR) AS file, session, k, 0 AS type_errors FROM log WHERE eventid = 'view'""")

# Contracts

RAW = SPACE + """,
raw AS (
  SELECT o_orderkey AS event_key, o_totalprice AS price, o_orderdate, o_orderpriority, o_orderstatus, c_mktsegment,
         CASE WHEN o_totalprice >= 5000 THEN 'order' END AS description,
         CASE WHEN o_totalprice < 20000 THEN '' WHEN o_totalprice < 40000 THEN '13/45/2020'
              WHEN o_totalprice < 50000 THEN NULL ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date,
         CASE WHEN o_totalprice < 10000 THEN '' WHEN o_totalprice < 100000 THEN '9:30'
              WHEN o_totalprice < 200000 THEN '' ELSE '17:05:59' END AS time,
         CASE WHEN o_totalprice > 480000 THEN NULL ELSE latitude END AS latitude,
         CASE WHEN o_totalprice > 490000 THEN NULL ELSE longitude END AS longitude,
         CASE WHEN o_totalprice < 250000 THEN c_mktsegment ELSE '' END AS shape
  FROM place
),
judged AS (
  SELECT *,
         concat_ws('; ',
           CASE WHEN description IS NULL THEN 'description is required' END,
           CASE WHEN (latitude IS NULL) <> (longitude IS NULL) THEN 'latitude and longitude must come together' END,
           CASE WHEN date IS NULL AND latitude IS NULL THEN 'date or latitude must be given' END) AS broken,
         CASE WHEN price >= 50000 THEN
           epoch_ms(o_orderdate) + CASE time WHEN '9:30' THEN 34200000 WHEN '' THEN 0 ELSE 61500000 END END AS ms
  FROM raw
  WHERE NOT coalesce(date = '' AND time = '', false)
),
verdict AS (
  SELECT *, CASE WHEN broken <> '' THEN broken WHEN ms IS NULL THEN 'date or time cannot be read' ELSE '' END AS message
  FROM judged
)"""

_add("validate_orders", _with(RAW), """
SELECT event_key, latitude, longitude, ms AS datetime_ms FROM verdict WHERE message = ''""")

_add("rejected_orders", _with(RAW), """
SELECT CAST(event_key AS VARCHAR) AS id, message FROM verdict WHERE message <> ''""")

_add("rejects_summary", _with(RAW), """
SELECT 'events' AS "table", count(*) AS rejected FROM verdict WHERE message <> ''""")

_add("duplicate_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)
WHERE r > 1""")

_add("repeated_keys", """
SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1""")

_add("first_definitions", _with(LOG), """
SELECT session, pos, eventid, dst_port
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS rn FROM log) WHERE rn = 1""")

for _name in ("resolve_refs", "resolve_refs_by_join"):
    _add(_name, """
SELECT o_orderkey AS event_key,
       'CATEGORY:' || o_orderpriority || ',FILTER:' || o_orderstatus || ',FILTER:' || c_mktsegment AS associations
FROM orders JOIN customer ON o_custkey = c_custkey""")

_add("resolve_shape", _with(RAW), """
SELECT CAST(event_key AS VARCHAR) AS id,
       CASE WHEN shape NOT IN ('', 'FURNITURE') THEN shape END AS title,
       CASE WHEN shape = 'FURNITURE' THEN 'shape is not known' ELSE '' END AS message
FROM raw""")

_add("resolve_refs_of_rows", """
SELECT CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS event_key, p_name || ',' || p_name AS titles,
       (p_partkey * 1000001) || ',' || (p_partkey * 1000001) AS micros
FROM lineitem JOIN part ON l_partkey = p_partkey""")

# What the domain says of an event that keeps the contract.
LINKED = RAW + """,
linked AS (
  SELECT *, concat_ws('; ', CASE WHEN shape = 'FURNITURE' THEN 'shape is not known' END,
                            CASE WHEN ms IS NULL THEN 'date or time cannot be read' END) AS fault
  FROM judged WHERE broken = ''
)"""

_add("linked_events", _with(LINKED), """
SELECT event_key, ms AS datetime_ms, nullif(shape, '') AS shape,
       'CATEGORY:' || o_orderpriority || ',FILTER:' || o_orderstatus
         || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ',FILTER:' || c_mktsegment END AS associations
FROM linked WHERE fault = ''""")

_add("rejects_by_table", _with(LINKED), """
SELECT 'events' AS "table",
       (SELECT count(*) FROM judged WHERE broken <> '') + (SELECT count(*) FROM linked WHERE fault <> '') AS rejected
UNION ALL SELECT 'associations', 2
UNION ALL SELECT 'shapes', 1""")

_add("with_features", """
SELECT 'associations' AS "table",
       (SELECT count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus) FROM orders)
       + (SELECT count(DISTINCT c_mktsegment) FROM customer) - 1 AS "rows" """)

_add("custom_fields", _with(RAW), """
SELECT event_key, upper(shape) AS note, 1 AS tags, CAST(NULL AS VARCHAR) AS page FROM judged WHERE broken = ''""")

_add("dimension_rows", """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN '[7]' ELSE 'STAR' END AS shape,
       CASE WHEN s_suppkey % 3 = 0 THEN 'shape must be text' ELSE '' END AS type_errors
FROM supplier""")

_add("later_earlier", """
SELECT l_orderkey, l_linenumber, epoch_ms(greatest(l_shipdate, o_orderdate)) AS later_ms,
       epoch_ms(least(l_shipdate, o_orderdate)) AS earlier_ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

_add("time_order", _with(SPACE), """
SELECT event_key, row_number() OVER (ORDER BY datetime, event_key) - 1 AS place FROM space""")

_add("default_shapes", "SELECT DISTINCT c_mktsegment AS id FROM customer WHERE c_mktsegment <> 'FURNITURE'")

_add("validate_shapes", """
SELECT CAST(p_partkey AS VARCHAR) AS id,
       CASE WHEN p_size < 10 OR p_size >= 40 THEN 'a shape must be given' ELSE '' END AS message
FROM part""")

_add("enabled_sites", """
SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN ' 1' ELSE '1' END AS enabled
FROM supplier WHERE s_acctbal >= 4000""")

CORNERS = """
corner(pos, dy, dx) AS (VALUES (0, 0, 0), (1, 0, 5), (2, 5, 5), (3, 5, 0), (4, 0, 0)),
point AS (
  SELECT s_name AS name, pos, CAST(s_nationkey * 6 - 80 + dy AS DOUBLE) AS lat,
         CAST(s_suppkey % 300 - 150 + dx AS DOUBLE) AS lon
  FROM supplier, corner
)"""
_add("parse_regions", _with(CORNERS), "SELECT name, pos, lat, lon FROM point")

_add("region_segments", _with(CORNERS), """
SELECT a.name, a.pos AS segment_idx, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
FROM point a JOIN point b ON a.name = b.name AND b.pos = a.pos + 1""")

_add("default_categories", "SELECT DISTINCT o_orderpriority AS title FROM orders")

# Selection

_add("select_events_range", _with(SPACE), f"SELECT event_key FROM space WHERE {IN_RANGE}")

_add("select_events_filters", _with(SPACE), f"""
SELECT event_key FROM space WHERE {IN_RANGE} AND type <> 'SHAPE' AND {BY_FILTER}""")

_add("select_events_categories", _with(SPACE), f"""
SELECT event_key FROM space WHERE {IN_RANGE} AND type <> 'SHAPE' AND {BY_CATEGORY}""")

_add("select_events_both", _with(SPACE), f"""
SELECT event_key FROM space WHERE {IN_RANGE} AND {BY_CATEGORY}
AND CASE WHEN type = 'SHAPE' THEN coalesce(shape IN ('BUILDING', 'MACHINERY'), false) ELSE {BY_FILTER} END""")

_add("matches_associations", _with(SPACE), f"SELECT event_key FROM space WHERE {BY_FILTER} AND {BY_CATEGORY}")

_add("with_any_active_filter", _with(SPACE), """
SELECT event_key FROM space WHERE status_path = 'status/O'
OR segment_path IN (SELECT 'segment/' || c_mktsegment FROM customer WHERE c_acctbal < -990)""")

_add("with_any_active_category", _with(SPACE), """
SELECT event_key FROM space WHERE category IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 499900)""")

_add("nonlocated_pass", _with(SPACE), f"""
SELECT event_key FROM space WHERE (({IN_RANGE}) OR (latitude = '' AND longitude = '')) AND type <> 'SHAPE'""")

_add("timeline_events", "SELECT event_type AS eventid, count(*) AS events FROM events GROUP BY 1")

_add("track_rows", _with(SPACE), f"""
SELECT event_key, CASE WHEN {BY_CATEGORY} THEN category ELSE type END AS track FROM space""")

_add("in_bbox", _with(SPACE), """
SELECT event_key FROM space WHERE lat BETWEEN -10 AND 60 AND lon BETWEEN -20 AND 45.5""")

_add("in_bbox_across", _with(SPACE), """
SELECT event_key FROM space WHERE lat BETWEEN -75 AND 75 AND (lon >= 120 OR lon <= -100)""")

_add("valid_coordinates", _with(SPACE), """
SELECT coalesce(abs(lat) <= 90, false) AS valid_latitude, coalesce(abs(lon) <= 180, false) AS valid_longitude,
       latitude <> '' AND longitude <> '' AS located, count(*) AS events
FROM space GROUP BY 1, 2, 3""")

for _name, _text in (("search_documents", "src1"), ("search_text", "tion")):
    _add(_name, f"""
SELECT doc_id FROM documents
WHERE contains(lower(text), '{_text}') OR contains(lower(source), '{_text}') OR contains(lower(lang), '{_text}')""")

# Fixed value: a hit with its letters, up to six words before and up to five after.
SNIPPET = "(([^ ]* ){0,6}[a-zA-Z]*tion[a-zA-Z]*( [^ ]*){0,5})"
_add("search_snippets", f"""
SELECT doc_id, CAST(len(hits) AS INTEGER) AS hits, md5(array_to_string(hits, '|')) AS digest FROM (
  SELECT doc_id, CASE WHEN contains(lower(text), 'tion')
    THEN list_transform(regexp_extract_all(lower(text), '{SNIPPET}', 1), lambda x: '...' || x)
    ELSE [regexp_extract(text, '^(([^ ]* ){{0,10}})', 1)] END AS hits
  FROM documents)""")

# Links

_add("attach_sources", """
SELECT c.conv_id || '-' || c.turn AS event_key,
       coalesce(a.url, 'null') || ' null ' || coalesce(b.url, 'null') AS urls
FROM conversations c LEFT JOIN pages a ON a.page_id = c.conv_id
LEFT JOIN pages b ON b.page_id = c.conv_id + c.turn""")

LATEST = SPACE + """,
latest AS (
  SELECT event_key, datetime FROM (
    SELECT *, row_number() OVER (PARTITION BY customer ORDER BY datetime DESC, event_key DESC) AS rn FROM space)
  WHERE rn = 1
)"""

_add("coevents", _with(LATEST), """
SELECT event_key, event_key IN (SELECT event_key FROM latest) AS is_selected
FROM space WHERE datetime IN (SELECT datetime FROM latest)""")

_add("coevent_counts", _with(SPACE), """
SELECT ms AS datetime_ms, count(*) AS events FROM space GROUP BY ms HAVING count(*) > 1""")

_add("neighbourhood", _with(LOG), """
SELECT pos, eventid FROM log e WHERE EXISTS (
  SELECT 1 FROM log a WHERE a.eventid = 'purchase' AND a.ms > e.ms - 300000 AND a.ms < e.ms + 300000)""")

_add("by_keys", """
SELECT o_orderkey AS event_key, 'order ' || o_orderkey AS description, l_orderkey * 10 + l_linenumber AS list_pos
FROM lineitem JOIN orders ON o_orderkey = l_orderkey + l_linenumber""")

FILTER_PATHS = """
filters AS (
  SELECT p_partkey, CASE WHEN p_size < 3 THEN p_type ELSE concat_ws('/', p_type, p_brand, p_name) END AS path FROM part
)"""

_add("paths_to_ids", _with(FILTER_PATHS), """
SELECT p.p_partkey AS list_pos, f.path, CAST(f.last AS VARCHAR) AS id
FROM part p JOIN (SELECT path, max(p_partkey) AS last FROM filters GROUP BY path) f
ON f.path = concat_ws('/', p.p_type, p.p_brand, p.p_name)""")

_add("ids_to_paths", _with(FILTER_PATHS), """
SELECT path, count(*) AS uses FROM lineitem JOIN filters ON l_partkey = p_partkey GROUP BY path""")

# Groups

_add("count_located", _with(SPACE), f"""
SELECT count(*) AS events, 'events' AS unit FROM space WHERE {IN_RANGE} AND type <> 'SHAPE' AND latitude <> '' AND longitude <> ''""")

VALID = "abs(lat) <= 90 AND abs(lon) <= 180"
LABEL = "location || '$_' || latitude || '_' || longitude"

_add("group_locations", _with(SPACE), f"""
SELECT location, latitude, longitude, min(event_key) AS location_id, count(*) AS events, {LABEL} AS label
FROM space WHERE {IN_RANGE} AND type <> 'SHAPE' AND {VALID} GROUP BY location, latitude, longitude""")

_add("project_spans", _with(SPACE), """
SELECT customer AS project, min(ms) AS start_ms, max(ms) AS end_ms, arg_min(category, event_key) AS category,
       min(event_key) AS first_key
FROM space WHERE latitude = '' AND longitude = '' GROUP BY customer""")


# The first filter of an order is its status.
_add("project_spans_by_filter", _with(SPACE), """
SELECT 'status/' || o_orderstatus AS project, min(ms) AS start_ms, max(ms) AS end_ms,
       arg_min(category, event_key) AS category, min(event_key) AS first_key
FROM space JOIN orders ON event_key = o_orderkey WHERE latitude = '' AND longitude = '' GROUP BY o_orderstatus""")


def _shares(key: str, source: str, sets: int) -> str:
    """Hits per set; with three sets the last takes segment/BUILDING from the first."""
    if sets == 3:
        hits = [
            "sum(CASE WHEN status_path = 'status/O' THEN 1 ELSE 0 END)",
            "sum(CASE WHEN status_path = 'status/F' THEN 1 ELSE 0 END + CASE WHEN segment_path = 'segment/MACHINERY' THEN 1 ELSE 0 END)",
            "sum(CASE WHEN segment_path = 'segment/BUILDING' THEN 1 ELSE 0 END)",
        ]
    else:
        hits = ["sum(CASE WHEN status_path = 'status/O' THEN 1 ELSE 0 END + CASE WHEN segment_path = 'segment/BUILDING' THEN 1 ELSE 0 END)"]
    rows = "\nUNION ALL\n".join(f"SELECT {key}, {i} AS set_idx, {h} AS n FROM {source} GROUP BY {key}" for i, h in enumerate(hits))
    return f"""
SELECT {key}, set_idx, CAST(n AS BIGINT) AS hits,
       round(CASE WHEN total = 0 THEN 1.0 ELSE CAST(n AS DOUBLE) / total END, 6) AS share
FROM (SELECT *, sum(n) OVER (PARTITION BY {key}) AS total FROM ({rows}))
WHERE total > 0 OR set_idx = 0"""


_add("colour_shares", _with(SPACE), _shares("location", "space", 3))
_add("colour_shares_by_customer", _with(SPACE), _shares("customer", "space", 1))

_add("categories_by_panel", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS panel FROM part")

MEDIA = """
ended AS (
  SELECT page_id, url, length(html) AS n,
         ['.png', '.jpg', '.jpeg ', '.mp4', '.md', '.pdf', '.PNG', ''][length(html) % 8 + 1] AS ending FROM pages
),
media AS (
  SELECT page_id, unnest([url, url || ending, 'https://twitter.com/user_1/status/' || n, 'https://t.me/c/' || page_id]) AS path
  FROM ended
),
typed AS (
  SELECT page_id, path,
         CASE WHEN regexp_matches(trim(path), '\\.(png|jpg|jpeg)$') THEN 'Image'
              WHEN regexp_matches(trim(path), '\\.mp4$') THEN 'Video'
              WHEN regexp_matches(trim(path), '\\.md$') THEN 'Text'
              WHEN regexp_matches(trim(path), '\\.pdf$') THEN 'Document'
              WHEN regexp_matches(trim(path), '.+twitter\\.com.+') THEN 'Tweet'
              WHEN regexp_matches(trim(path), '.+t\\.me.+') THEN 'Telegram' ELSE 'Unknown' END AS media_type,
         CASE WHEN regexp_matches(path, '\\.(png|jpg)$') THEN 'Image'
              WHEN regexp_matches(path, '\\.mp4$') THEN 'Video'
              WHEN regexp_matches(path, '\\.md$') THEN 'Text' ELSE 'Unknown' END AS short_type
  FROM media
)"""

_add("media_type_counts", _with(MEDIA), """
SELECT CAST(page_id AS VARCHAR) AS source_id, media_type, count(*) AS paths FROM typed GROUP BY 1, 2""")

_add("media_types", _with(MEDIA), "SELECT media_type, short_type, count(*) AS paths FROM typed GROUP BY 1, 2")

_add("tweet_ids", """
SELECT CAST(page_id AS VARCHAR) AS source_id, CAST(length(html) AS VARCHAR) AS tweet_id FROM pages""")

# Stories

STEPS = SPACE + """,
steps AS (
  SELECT 'story:' || location AS narrative_id, *,
         row_number() OVER w - 1 AS step_idx, count(*) OVER (PARTITION BY location) AS steps,
         lead(event_key) OVER w AS next_key, lead(latitude) OVER w AS next_lat, lead(longitude) OVER w AS next_lon
  FROM space WINDOW w AS (PARTITION BY location ORDER BY datetime, event_key)
)"""

_add("narrative_steps", _with(STEPS), """
SELECT narrative_id, event_key, step_idx, steps, step_idx > 0 AS has_previous, step_idx < steps - 1 AS has_next
FROM steps""")

_add("narrative_legs", _with(STEPS), """
SELECT narrative_id, step_idx, event_key AS from_key, next_key AS to_key, latitude AS from_latitude,
       longitude AS from_longitude, next_lat AS to_latitude, next_lon AS to_longitude
FROM steps WHERE latitude <> '' AND longitude <> '' AND next_lat <> '' AND next_lon <> ''""")

_add("narrative_legs_marked", _with(STEPS), """,
marked AS (
  SELECT narrative_id, event_key, latitude, row_number() OVER w - 1 AS step_idx,
         lead(event_key) OVER w AS next_key, lead(latitude) OVER w AS next_lat
  FROM steps WHERE price >= 200000 WINDOW w AS (PARTITION BY narrative_id ORDER BY datetime, event_key)
)
SELECT narrative_id, event_key AS from_key, next_key AS to_key, step_idx
FROM marked WHERE latitude <> '' AND next_lat <> ''""")


def _extent(low: str, high: str) -> str:
    return f"""
SELECT narrative_id, steps,
  round(CASE WHEN abs(flat - south) < abs(flat - north) THEN flat - abs(flat - north) ELSE south END, 6) AS south,
  round(CASE WHEN abs(flon - west) < abs(flon - east) THEN flon - abs(flon - east) ELSE west END, 6) AS west,
  round(CASE WHEN abs(flat - south) > abs(flat - north) THEN flat + abs(flat - south) ELSE north END, 6) AS north,
  round(CASE WHEN abs(flon - west) > abs(flon - east) THEN flon + abs(flon - west) ELSE east END, 6) AS east,
  round(lo - (hi - lo) / 10.0::DOUBLE, 3) AS start_ms,
  round(hi + (hi - (lo - (hi - lo) / 10.0::DOUBLE)) / 10.0::DOUBLE, 3) AS end_ms
FROM (
  SELECT narrative_id, count(*) AS steps,
         least(coalesce(min(lat), 180), 180) AS south, greatest(coalesce(max(lat), -180), -180) AS north,
         least(coalesce(min(lon), 180), 180) AS west, greatest(coalesce(max(lon), -180), -180) AS east,
         max(CASE WHEN step_idx = 0 THEN lat END) AS flat, max(CASE WHEN step_idx = 0 THEN lon END) AS flon,
         {low} AS lo, {high} AS hi
  FROM steps GROUP BY narrative_id)"""


_add("narrative_extent", _with(STEPS), _extent("min(ms)", "max(ms)"))
_add("narrative_extent_limits", _with(STEPS), _extent(
    "least(min(ms), epoch_ms(TIMESTAMP '1993-06-01'))", "greatest(max(ms), epoch_ms(TIMESTAMP '2002-01-01'))"
))

_add("narrative_from_filters", _with(SPACE), f"""
SELECT 'segment/BUILDING-status/O' AS narrative_id, event_key,
       row_number() OVER (ORDER BY datetime, event_key) - 1 AS step_idx, count(*) OVER () AS steps
FROM space WHERE {BY_FILTER}""")

_add("conversation_steps", """
SELECT conv_id AS narrative_id, conv_id || '-' || turn AS event_key,
       row_number() OVER w - 1 AS step_idx, count(*) OVER (PARTITION BY conv_id) AS steps,
       lead(conv_id || '-' || turn) OVER w AS next_key
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")

for _name in ("step_of", "first_step_of"):
    _add(_name, _with(LATEST + STEPS[len(SPACE):]), """
SELECT narrative_id, event_key, step_idx FROM steps WHERE event_key IN (SELECT event_key FROM latest)""")

for _name, _end in (("last_step_of_category", "max"), ("first_step_of_category", "min")):
    _add(_name, _with(LATEST + STEPS[len(SPACE):]), f"""
SELECT narrative_id, category, {_end}(step_idx) AS step_idx FROM steps
WHERE category IN (SELECT category FROM space WHERE event_key IN (SELECT event_key FROM latest))
GROUP BY 1, 2""")

_add("step_at", _with(STEPS), "SELECT narrative_id, event_key FROM steps WHERE step_idx = 3")

_add("only_in_narrative", _with(SPACE), f"""
SELECT location, count(*) AS events FROM space WHERE {BY_FILTER} GROUP BY location""")

_add("neighbours", _with(LOG), """
SELECT pos AS event_key, lag(pos) OVER w AS previous_key, lead(pos) OVER w AS next_key
FROM log WINDOW w AS (ORDER BY ts, pos)""")

_add("neighbours_in_session", _with(LOG), """
SELECT pos AS event_key, lag(pos) OVER w AS previous_key, lead(pos) OVER w AS next_key
FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, pos)""")

# Filter tree

TREE = FILTER_PATHS + """,
prefix AS (
  SELECT DISTINCT string_split(path, '/')[1:n] AS parts
  FROM filters, (SELECT unnest([1, 2, 3]) AS n) WHERE n <= len(string_split(path, '/'))
),
tree AS (
  SELECT array_to_string(parts, '/') AS path, CAST(len(parts) AS INTEGER) AS depth,
         CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') END AS parent,
         parts[-1] AS leaf, parts
  FROM prefix
)"""

_add("path_tree", _with(TREE), "SELECT path, depth, parent, leaf FROM tree")

_add("path_ancestors", _with(TREE), """
SELECT path, CASE depth WHEN 1 THEN '' WHEN 2 THEN parts[1] ELSE parts[1] || '|' || parts[1] || '/' || parts[2] END AS ancestors
FROM tree""")

_add("sibling_counts", _with(TREE), """
SELECT path, parent, CASE WHEN parent IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY parent) - 1 END AS siblings
FROM tree""")

_add("siblings", _with(TREE), """
SELECT path, parent FROM tree
WHERE parent IN ('ECONOMY', 'SMALL') AND path NOT IN ('ECONOMY/Brand#1', 'SMALL/Brand#2')""")

_add("toggle_closure", _with(TREE + """,
marked AS (
  SELECT path, parent, path IN ('ECONOMY', 'ECONOMY/Brand#1', 'SMALL/Brand#2', 'SMALL') AS active FROM tree
),
walk(node, member, parent, active) AS (
  SELECT path, path, parent, active FROM marked
  UNION ALL
  SELECT m.path, w.member, m.parent, w.active FROM walk w JOIN marked m ON m.path = w.parent AND m.active = w.active
)"""), "SELECT node, member FROM walk")

# Map

POINTS = SPACE + f""",
points AS (
  SELECT {LABEL} AS label, lat, lon, min(event_key) AS location_id, lon / 360 + 0.5 AS x,
         CASE WHEN lat >= 90 THEN 0.0 WHEN lat <= -90 THEN 1.0 ELSE greatest(0.0, least(1.0,
           0.5 - 0.25 * ln((1 + sin(lat * pi() / 180)) / (1 - sin(lat * pi() / 180))) / pi())) END AS y
  FROM space WHERE {VALID} GROUP BY ALL
)"""

_add("project_points", _with(POINTS), "SELECT label, round(x, 9) AS x, round(y, 9) AS y FROM points")


def _cells(zooms: str) -> str:
    return POINTS + f""",
placed AS (
  SELECT zoom, label, location_id, x, y, lat, lon, CAST(floor(x * (512 * pow(2, zoom) / 30)) AS BIGINT) AS cell_x,
         CAST(floor(y * (512 * pow(2, zoom) / 30)) AS BIGINT) AS cell_y
  FROM points, (SELECT unnest({zooms}) AS zoom)
),
grouped AS (
  SELECT zoom, cell_x, cell_y, count(*) AS point_count, avg(x) AS mx, avg(y) AS my, min(lat) AS lat, min(lon) AS lon
  FROM placed GROUP BY zoom, cell_x, cell_y
),
apart AS (
  SELECT a.zoom, a.cell_x, a.cell_y, b.zoom AS deep
  FROM placed a JOIN placed b ON a.label = b.label AND b.zoom > a.zoom
  GROUP BY a.zoom, a.cell_x, a.cell_y, b.zoom HAVING count(DISTINCT (b.cell_x, b.cell_y)) > 1
),
opened AS (
  SELECT g.*, CAST(coalesce(min(deep), 17) AS INTEGER) AS expansion_zoom
  FROM grouped g LEFT JOIN apart USING (zoom, cell_x, cell_y) GROUP BY ALL
)"""


ALL_ZOOMS = "[2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]"
CENTRE = """round(CASE WHEN point_count > 1 THEN (mx - 0.5) * 360 ELSE lon END, 6) AS longitude,
       round(CASE WHEN point_count > 1 THEN atan(exp((1 - my * 2) * pi())) * 360 / pi() - 90 ELSE lat END, 6) AS latitude"""

_add("clusters", _with(_cells(ALL_ZOOMS)), f"""
SELECT CAST(zoom AS INTEGER) AS zoom, cell_x, cell_y, point_count, point_count > 1 AS is_cluster, {CENTRE}, expansion_zoom
FROM opened""")


def _circles(finest: int, coarsest: int) -> str:
    """A zoom at a time, from the finest; in each, a point at a time by label. A point is a
    centre unless a centre before it is near; others go to their first centre."""
    sql = POINTS + f""",
level{finest + 1} AS (SELECT label AS k, x, y, lat, lon, CAST(1 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS origin FROM points)"""
    for zoom in range(finest, coarsest - 1, -1):
        radius = f"(30 / CAST({512 * 2**zoom} AS DOUBLE))"
        near = f"(c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) <= {radius} * {radius}"
        sql += f""",
ord{zoom} AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM level{zoom + 1}),
walk{zoom}(i, centres) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, x DOUBLE, y DOUBLE)[])
  UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(w.centres, lambda c: {near})) > 0 THEN w.centres
                   ELSE list_append(w.centres, {{'k': o.k, 'x': o.x, 'y': o.y}}) END
  FROM walk{zoom} w JOIN ord{zoom} o ON o.i = w.i + 1
),
centre{zoom} AS (SELECT unnest(centres, recursive := true) FROM walk{zoom} WHERE i = (SELECT max(i) FROM walk{zoom})),
taken{zoom} AS (
  SELECT o.k, o.x, o.y, o.lat, o.lon, o.n, o.origin, min(c.k) AS parent
  FROM ord{zoom} o JOIN centre{zoom} c ON {near} GROUP BY ALL
),
level{zoom} AS (
  SELECT parent AS k, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y, arg_min(lat, k) AS lat, arg_min(lon, k) AS lon,
         CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(origin) ELSE {zoom} END AS origin
  FROM taken{zoom} GROUP BY parent
)"""
    return sql


_add("circle_clusters", _with(_circles(4, 1)), " UNION ALL ".join(f"""
SELECT {zoom} AS zoom, k AS label, n AS point_count, n > 1 AS is_cluster,
       round(CASE WHEN n > 1 THEN (x - 0.5) * 360 ELSE lon END, 6) AS longitude,
       round(CASE WHEN n > 1 THEN atan(exp((1 - y * 2) * pi())) * 360 / pi() - 90 ELSE lat END, 6) AS latitude,
       CASE WHEN n > 1 THEN origin + 1 END AS expansion_zoom
FROM level{zoom}""" for zoom in (4, 3, 2, 1)))

_add("circle_members", _with(_circles(3, 1)), """
SELECT a.k AS label, c.parent AS cluster
FROM taken3 a JOIN taken2 b ON b.k = a.parent JOIN taken1 c ON c.k = b.parent""")

_add("cluster_totals", _with(_cells(ALL_ZOOMS)), """
SELECT CAST(zoom AS INTEGER) AS zoom, CAST(sum(CASE WHEN point_count > 1 THEN point_count ELSE 0 END) AS BIGINT) AS points_in_clusters
FROM grouped GROUP BY 1""")

_add("cluster_members", _with(_cells("[5]")), """
SELECT label, cell_x, cell_y FROM placed""")

_add("expansion_zoom", _with(_cells(ALL_ZOOMS)), """
SELECT CAST(zoom AS INTEGER) AS zoom, cell_x, cell_y, expansion_zoom, CAST(greatest(expansion_zoom + 2, 16) AS INTEGER) AS zoom_to_fly
FROM opened WHERE zoom IN (2, 4, 6) AND point_count > 1""")

_add("clusters_in_view", _with(_cells("[4]")), f"""
SELECT * FROM (SELECT cell_x, cell_y, point_count, {CENTRE} FROM grouped)
WHERE longitude BETWEEN -60.05 AND 80.05 AND latitude BETWEEN -40.05 AND 50.05""")

_add("flag_selected_locations", _with(POINTS), f""",
latest AS (
  SELECT latitude, longitude, category,
         row_number() OVER (PARTITION BY customer ORDER BY datetime DESC, event_key DESC) AS rn FROM space
)
SELECT DISTINCT {LABEL} AS label,
       (latitude, longitude) IN (SELECT (latitude, longitude) FROM latest WHERE rn = 1 AND category = '1-URGENT') AS is_selected
FROM space WHERE {VALID}""")

_add("selected_clusters", _with(_cells("[4]")), """
SELECT DISTINCT CAST(zoom AS INTEGER) AS zoom, cell_x, cell_y, point_count
FROM placed JOIN grouped USING (zoom, cell_x, cell_y)
WHERE point_count > 1 AND location_id IN (SELECT event_key FROM space WHERE category = '1-URGENT')""")

_add("cluster_colour_shares", _with(_cells("[4]") + f""",
members AS (
  SELECT space.*, cell_x, cell_y FROM space JOIN placed ON {LABEL} = label
)"""), _shares("cell_x, cell_y", "members", 3))

# Time

_add("activity", """
SELECT epoch_us(ts) // 43200000000 * 43200000 AS window_ms, event_type AS track, count(*) AS events
FROM events GROUP BY 1, 2""")

_add("activity_levels", _with(SPACE), """
SELECT CAST(minutes AS INTEGER) AS minutes, ms // (minutes * 60000) * (minutes * 60000) AS window_ms, category, count(*) AS events
FROM space, (SELECT CAST(unnest([10512000, 1051200, 129600, 4320, 720, 60]) AS BIGINT) AS minutes)
GROUP BY 1, 2, 3""")

_add("activity_rolled_up", _with(SPACE), """
SELECT CAST(minutes AS INTEGER) AS minutes, ms // (minutes * 60000) * (minutes * 60000) AS window_ms, category AS track, count(*) AS events
FROM space, (SELECT CAST(unnest([60, 720, 4320, 129600]) AS BIGINT) AS minutes)
GROUP BY 1, 2, 3""")

_add("assign_lanes", _with(SPACE + """,
span AS (
  SELECT customer, min(ms) AS s, max(ms) AS e, row_number() OVER (ORDER BY min(ms), min(event_key)) AS n
  FROM space WHERE latitude = '' AND longitude = '' GROUP BY customer
),
opened AS (
  SELECT a.n - 1 AS i, customer, a.n - (SELECT count(*) FROM span b WHERE b.e < a.s) AS load FROM span a
),
lanes AS (
  SELECT *, coalesce(max(load) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM opened
),
ended AS (SELECT n - 1 AS i, row_number() OVER (ORDER BY e, n) - 1 AS rank FROM span),
laid(i, customer, lane) AS (
  SELECT i, customer, used FROM lanes WHERE load > used
  UNION ALL
  SELECT l.i, l.customer, c.lane
  FROM laid c JOIN ended d ON d.i = c.i JOIN lanes l ON l.load <= l.used AND l.i - l.used = d.rank
)"""), """
SELECT customer AS project, lane, lane * 16 AS "offset" FROM laid""")

# Span by span, with the end of the last span in each lane.
_add("lowest_lanes", _with(SPACE + """,
span AS (
  SELECT customer, min(ms) AS s, max(ms) AS e, row_number() OVER (ORDER BY min(ms), min(event_key)) AS n
  FROM space WHERE latitude = '' AND longitude = '' GROUP BY customer
),
laid(n, customer, lane, ends) AS (
  SELECT CAST(0 AS BIGINT), NULL::BIGINT, CAST(-1 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n, customer, p - 1,
         list_transform(range(1, greatest(len(ends), p) + 1), lambda i: CASE WHEN i = p THEN e ELSE ends[i] END)
  FROM (
    SELECT b.n, b.customer, b.e, a.ends,
           CAST(coalesce(list_min(list_filter(range(1, len(a.ends) + 1), lambda i: a.ends[i] < b.s)), len(a.ends) + 1) AS BIGINT) AS p
    FROM laid a JOIN span b ON b.n = a.n + 1)
)"""), """
SELECT customer AS project, lane, lane * 16 AS "offset" FROM laid WHERE n > 0""")

# Lanes needed = greatest number of spans open at one time; ends count as open.
_add("lanes_used", _with(SESSIONS + """,
span AS (SELECT session, min(ts) AS s, max(ts) AS e FROM staged GROUP BY session)"""), """
SELECT max(n) AS lanes, (SELECT count(*) FROM span) AS spans
FROM (SELECT a.session, count(*) AS n FROM span a JOIN span b ON b.s <= a.s AND b.e >= a.s GROUP BY a.session)""")

_add("lane_islands", _with(SESSIONS + """,
span AS (SELECT session, min(ts) AS s, max(ts) AS e FROM staged GROUP BY session),
reach AS (
  SELECT *, max(e) OVER (ORDER BY s, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM span
),
chain AS (
  SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (ORDER BY s, session) AS island FROM reach
)"""), """
SELECT count(*) AS spans, epoch_us(min(s)) // 1000 AS start_ms, epoch_us(max(e)) // 1000 AS end_ms FROM chain GROUP BY island""")

_add("event_labels", _with(SPACE), """
SELECT strftime(datetime, '%d %B, %Y') AS label, count(*) AS events FROM space GROUP BY 1""")

# Flows

_add("map_view", _with(_cells("[3, 8]").replace(
    f"FROM space WHERE {VALID}",
    f"FROM space WHERE {VALID} AND {IN_RANGE} AND {BY_FILTER} AND {BY_CATEGORY} AND type <> 'SHAPE'",
).replace("b.zoom > a.zoom", "b.zoom > a.zoom AND a.zoom IN (3, 8)").replace(
    "unnest([3, 8])", f"unnest({ALL_ZOOMS})"
)), f"""
SELECT CAST(zoom AS INTEGER) AS zoom, cell_x, cell_y, point_count, point_count > 1 AS is_cluster, {CENTRE}, expansion_zoom
FROM opened WHERE zoom IN (3, 8)""")

_add("timeline_view", _with(SPACE), f"""
SELECT ms // 7776000000 * 7776000000 AS window_ms, category AS track, count(*) AS events
FROM space WHERE {IN_RANGE} AND {BY_FILTER} AND {BY_CATEGORY} AND type <> 'SHAPE' GROUP BY 1, 2""")

BUYERS = SESSIONS + """,
buyers AS (SELECT DISTINCT session FROM staged WHERE eventid = 'purchase')"""

_add("card_sections", _with(BUYERS), """
SELECT session, pos, eventid, nth - 1 AS occurrence, CASE WHEN value < 10 THEN 2 ELSE 1 END AS absent
FROM staged WHERE session IN (SELECT session FROM buyers)""")

_add("card_values", _with(BUYERS + """,
fields AS (""" + LOGGED + ")"), """
SELECT field, count(*) AS values, count(DISTINCT value) AS different
FROM fields WHERE session IN (SELECT session FROM buyers) GROUP BY field""")
