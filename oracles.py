"""The registered queries in SQL for DuckDB, written independently of the Spark operators.

The control log of binding B1 has a closed form, so its family versions need no fold here.
"""

from __future__ import annotations

ATTRIBUTES = (
    "lat", "long", "isNotTracked", "entityOffset", "sourceName", "speed", "elevation", "course",
    "nationality", "category", "pictureURL", "height", "nickname", "externalSystemID",
)


def _uuid(expression: str) -> str:
    cuts = ", ".join(f"substr(md5({expression}),{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat_ws('-', {cuts})"


def _flat(alias: str, prefix: str = "") -> str:
    return ", ".join(f'{alias}."{name}" AS "{prefix}{name}"' for name in ATTRIBUTES)


SOURCES = f"""
marks AS (SELECT CAST(floor(count(*) / 4) AS BIGINT) AS quarter, CAST(floor(count(*) / 2) AS BIGINT) AS half,
                 CAST(floor(count(*) * 3 / 4) AS BIGINT) AS three FROM events),
src AS (SELECT event_type AS sensor_id, CAST(user_id AS VARCHAR) AS reports_id, user_id, min(event_id) AS data_offset,
               {_uuid("concat_ws('|', 'creation', event_type, CAST(user_id AS VARCHAR))")} AS system_uuid
        FROM events GROUP BY event_type, user_id),
joined AS (SELECT s.*, half, three, {_uuid("concat_ws('|', 'merge', CAST(user_id AS VARCHAR))")} AS family_id,
                  CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n_sons,
                  CAST(row_number() OVER (PARTITION BY user_id ORDER BY sensor_id) - 1 AS INTEGER) AS son_ordinal
           FROM src s, marks WHERE user_id % 3 = 0 AND data_offset < half
           QUALIFY count(*) OVER (PARTITION BY user_id) >= 2)"""

MEMBERS = SOURCES + """,
members AS (
  SELECT s.system_uuid AS family_id, 1 AS version_seq, 'NONE' AS state, s.data_offset AS v_from, j.half AS v_to,
         1 AS n_sons, 0 AS son_ordinal, s.system_uuid, s.sensor_id, s.reports_id, s.data_offset,
         CAST(NULL AS VARCHAR) AS prev_family_id
  FROM src s LEFT JOIN joined j ON s.system_uuid = j.system_uuid
  UNION ALL
  SELECT family_id, 1, 'MERGED', half, CASE WHEN user_id % 6 = 0 THEN three END, n_sons, son_ordinal, system_uuid,
         sensor_id, reports_id, data_offset, system_uuid FROM joined
  UNION ALL
  SELECT CASE WHEN son_ordinal = 0 THEN family_id ELSE system_uuid END, 2,
         CASE WHEN son_ordinal = 0 THEN 'SON_TAKEN' ELSE 'WAS_SPLIT' END, three, NULL, 1, 0, system_uuid,
         sensor_id, reports_id, data_offset, family_id FROM joined WHERE user_id % 6 = 0)"""


def _reports(foreign: bool = False) -> str:
    topic = "CASE WHEN event_id % 97 = 0 THEN 'view' ELSE event_type END" if foreign else "event_type"
    return f""",
reports AS (
  SELECT {topic} AS topic, event_id AS "offset", event_id AS pos, value AS lat, CAST(user_id AS DOUBLE) AS "long",
         event_id % 2 = 0 AS "isNotTracked", event_id AS "entityOffset", event_type AS "sourceName", value AS speed,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS elevation, CAST(event_id % 360 AS DOUBLE) AS course,
         CASE event_id % 3 WHEN 0 THEN 'ISRAEL' WHEN 1 THEN 'USA' ELSE 'SPAIN' END AS nationality,
         CASE event_id % 2 WHEN 0 THEN 'airplane' ELSE 'boat' END AS category,
         concat('http://pics/', CAST(event_id AS VARCHAR)) AS "pictureURL", CAST(user_id % 10 AS DOUBLE) AS height,
         concat(event_type, '-', CAST(user_id AS VARCHAR)) AS nickname, CAST(user_id AS VARCHAR) AS "externalSystemID"
  FROM events)"""


def _routed(mode: str, foreign: bool = False) -> str:
    lower = "AND r.pos >= m.v_from" if mode == "resume" else ""
    return MEMBERS + _reports(foreign) + f""",
routed AS (
  SELECT m.family_id, m.version_seq, m.state, m.n_sons, m.v_to, r.pos, r.topic, r."offset", m.son_ordinal AS sub_ordinal,
         w.system_uuid AS reporter, w.son_ordinal AS reporter_ordinal, r."sourceName" AS source_name,
         r."externalSystemID" AS external_id
  FROM reports r JOIN members m ON r.topic = m.sensor_id AND r."externalSystemID" = m.reports_id
       AND r."offset" >= m.data_offset AND (m.v_to IS NULL OR r.pos < m.v_to) {lower}
  LEFT JOIN members w ON w.family_id = m.family_id AND w.version_seq = m.version_seq
       AND w.sensor_id = r."sourceName" AND w.reports_id = r."externalSystemID"),
accepted AS (SELECT * FROM routed WHERE reporter IS NOT NULL)"""


def _records(mode: str, foreign: bool = False) -> str:
    """Records with one row per son; ``known`` is the position of the report the son's state is from."""
    return _routed(mode, foreign) + """,
first_part AS (SELECT family_id, version_seq, reporter, max(pos) AS seed_pos FROM accepted
               WHERE state = 'NONE' AND v_to IS NOT NULL GROUP BY ALL),
records AS (
  SELECT a.family_id AS "entityID", a.version_seq, a.pos, a.topic, a."offset", a.sub_ordinal, a.reporter, a.n_sons,
         CASE WHEN row_number() OVER (PARTITION BY a.family_id, a.version_seq, s.son_ordinal ORDER BY a.pos) = 1
              THEN a.state ELSE 'NONE' END AS "stateChanges",
         s.son_ordinal, s.system_uuid AS son_id,
         coalesce(max(CASE WHEN s.system_uuid = a.reporter THEN a.pos END) OVER (
                    PARTITION BY a.family_id, a.version_seq, s.son_ordinal ORDER BY a.pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  CASE WHEN s.state = 'MERGED' THEN f.seed_pos END) AS known
  FROM accepted a JOIN members s ON s.family_id = a.family_id AND s.version_seq = a.version_seq
  LEFT JOIN first_part f ON f.family_id = s.system_uuid)"""


def _updates(mode: str) -> str:
    return "WITH" + _records(mode) + f"""
SELECT x."entityID", x.version_seq, x.pos, x.topic, x."offset", x."stateChanges", p.nickname AS preferred_nickname,
       p.speed AS preferred_speed, x.son_ordinal, x.son_id, {_flat('k', 'son_')}
FROM records x JOIN reports p ON p.pos = x.pos LEFT JOIN reports k ON k.pos = x.known"""


def _late_updates() -> str:
    """Resume updates where late reports stand right above all rows of the first part, in the order of their positions.

    ``pos`` numbers the reports in the order of arrival, ``effective`` is where they take effect; shown is where they are from.
    """
    before, after = _updates("resume").split("reports AS (\n")
    arrived, after = after.split("FROM events)", 1)
    sql = before + """first_part_end AS (SELECT max(p) AS seen FROM (
  SELECT event_id AS p FROM events WHERE event_id % 10 <> 7 UNION ALL SELECT data_offset FROM src
  UNION ALL SELECT half FROM joined) WHERE p < (SELECT CAST(floor(count(*) * 5 / 8) AS BIGINT) FROM events)),
arrived AS (
""" + arrived + """FROM events),
reports AS (SELECT * REPLACE (row_number() OVER (ORDER BY effective, "offset") AS pos) FROM (
  SELECT *, CASE WHEN "offset" % 10 = 7 AND pos <= seen THEN seen + 1 ELSE pos END AS effective
  FROM arrived, first_part_end))""" + after
    for old, new in (
        ("r.pos < m.v_to", "r.effective < m.v_to"), ("r.pos >= m.v_from", "r.effective >= m.v_from"),
        ("x.version_seq, x.pos,", 'x.version_seq, p."offset" AS pos,'),
    ):
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


MEMBER_COLUMNS = """family_id, version_seq, state, v_from, v_to, n_sons, son_ordinal, system_uuid, sensor_id, reports_id,
       data_offset"""

CONTROL = SOURCES + f""",
control AS (
  SELECT data_offset AS pos, 'CREATE' AS kind, 'creation' AS topic, data_offset AS "offset",
         concat_ws('|', sensor_id, reports_id) AS event_key, sensor_id AS "sourceName", reports_id AS "externalSystemID",
         data_offset AS "dataOffset", CAST(NULL AS VARCHAR) AS merged_ids, CAST(NULL AS VARCHAR) AS "splittedEntityID"
  FROM src
  UNION ALL
  SELECT half, 'MERGE', 'merge', user_id, CAST(user_id AS VARCHAR), NULL, NULL, NULL,
         string_agg(system_uuid, ',' ORDER BY son_ordinal), NULL FROM joined GROUP BY half, user_id
  UNION ALL
  SELECT DISTINCT three, 'SPLIT', 'split', user_id, CAST(user_id AS VARCHAR), NULL, NULL, CAST(NULL AS BIGINT), NULL, family_id
  FROM joined WHERE user_id % 6 = 0),
bad AS (
  SELECT quarter AS pos, user_id, concat('bad|', CAST(user_id AS VARCHAR)) AS event_key, user_id % 7 AS c,
         own, own_offset, {_uuid("concat_ws('|', 'unknown', CAST(user_id AS VARCHAR))")} AS nobody
  FROM (SELECT user_id, arg_min(system_uuid, (data_offset, sensor_id)) AS own, min(data_offset) AS own_offset
        FROM src GROUP BY user_id), marks WHERE user_id % 7 BETWEEN 1 AND 5)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["control_union"] = "WITH" + CONTROL + " SELECT * FROM control"
    sql["control_validated"] = "WITH" + CONTROL + f"""
SELECT {_uuid("concat_ws('|', topic, event_key)")} AS event_id, kind, pos, event_key,
       CAST(CASE kind WHEN 'MERGE' THEN len(string_split(merged_ids, ',')) WHEN 'SPLIT' THEN 1 ELSE 0 END AS INTEGER) AS n_ids,
       CAST(NULL AS VARCHAR) AS reason FROM control
UNION ALL
SELECT {_uuid("concat_ws('|', CASE c WHEN 2 THEN 'split' ELSE 'merge' END, event_key)")},
       CASE c WHEN 2 THEN 'SPLIT' ELSE 'MERGE' END, pos, event_key,
       CAST(CASE c WHEN 2 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS INTEGER),
       CASE c WHEN 3 THEN 'DUPLICATE_ID' WHEN 4 THEN 'MALFORMED_ID' WHEN 5 THEN 'EMPTY_LIST' END FROM bad"""
    sql["family_versions"] = "WITH" + MEMBERS + f" SELECT {MEMBER_COLUMNS}, prev_family_id FROM members"
    sql["membership_current"] = "WITH" + MEMBERS + f" SELECT {MEMBER_COLUMNS} FROM members WHERE v_to IS NULL"
    sql["membership_asof"] = "WITH" + MEMBERS + f""" SELECT {MEMBER_COLUMNS} FROM members
WHERE v_from <= (SELECT CAST(floor(count(*) * 5 / 8) AS BIGINT) FROM events)
  AND (v_to IS NULL OR v_to > (SELECT CAST(floor(count(*) * 5 / 8) AS BIGINT) FROM events))"""
    sql["rejected_events"] = "WITH" + CONTROL + """
SELECT CASE c WHEN 2 THEN 'SPLIT' ELSE 'MERGE' END AS kind, pos, event_key,
       CASE c WHEN 3 THEN 'DUPLICATE_ID' WHEN 4 THEN 'MALFORMED_ID' WHEN 5 THEN 'EMPTY_LIST' ELSE 'UNKNOWN_ID' END AS reason,
       CASE c WHEN 1 THEN CASE WHEN own_offset <= pos THEN nobody ELSE concat_ws(',', own, nobody) END
              WHEN 2 THEN nobody END AS missing FROM bad"""
    sql["rejected_events_all"] = sql["rejected_events"] + """
UNION ALL SELECT kind, pos + 1, event_key, 'DUPLICATE_EVENT', NULL FROM control WHERE kind = 'MERGE'
UNION ALL SELECT 'DELETE', quarter, concat('noise|', CAST(user_id AS VARCHAR)), 'UNKNOWN_KIND', NULL
FROM (SELECT DISTINCT user_id FROM src WHERE user_id % 7 = 6), marks"""
    sql["source_registry"] = "WITH" + SOURCES + " SELECT system_uuid, sensor_id, reports_id, data_offset FROM src"

    sql["reports_from_offset"] = "WITH" + SOURCES + _reports() + """,
starts AS (SELECT topic, CAST(floor((min("offset") + max("offset")) / 2) AS BIGINT) AS first FROM reports GROUP BY topic)
SELECT r.topic, r."offset", r."externalSystemID" AS external_id, r.speed FROM reports r JOIN starts s ON r.topic = s.topic
WHERE r."offset" >= s.first"""
    sql["reports_filtered"] = "WITH" + SOURCES + _reports() + """
SELECT s.system_uuid, r.topic, r."offset", r."externalSystemID" AS external_id, r.speed FROM reports r
JOIN src s ON r.topic = s.sensor_id AND r."externalSystemID" = s.reports_id AND r."offset" >= s.data_offset"""
    sql["attributes_converted"] = "WITH" + SOURCES + _reports() + f"""
SELECT r.topic, r."offset", {_flat('r')}, r."offset" % 11 = 0 OR r."offset" % 13 = 0 AS invalid_enum
FROM (SELECT * REPLACE (CASE WHEN "offset" % 11 = 0 THEN 'ATLANTIS' ELSE nationality END AS nationality,
                        CASE WHEN "offset" % 13 <> 0 THEN category END AS category) FROM reports) r"""
    for mode in ("resume", "replay"):
        sql[f"reports_routed_{mode}"] = "WITH" + _routed(mode) + """
SELECT family_id, version_seq, state, n_sons, pos, topic, "offset", sub_ordinal, reporter AS reporter_uuid FROM accepted"""
        sql[f"reports_routed_foreign_{mode}"] = "WITH" + _routed(mode, True) + """
SELECT family_id, version_seq, state, n_sons, pos, topic, "offset", sub_ordinal, reporter_ordinal,
       reporter AS reporter_uuid, source_name FROM accepted"""
        sql[f"family_updates_{mode}"] = _updates(mode)
    sql["rejected_reports"] = "WITH" + _routed("replay", True) + """
SELECT family_id, version_seq, pos, topic, "offset", source_name, external_id, 'FOREIGN_SOURCE' AS reason
FROM routed WHERE reporter IS NULL"""
    sql["rejected_records"] = "WITH" + SOURCES + """
SELECT event_type AS topic, event_id AS "offset", event_id AS pos,
       CASE event_id % 13 WHEN 2 THEN 'NULL_VALUE' WHEN 3 THEN 'MISSING_FIELD' WHEN 4 THEN 'INVALID_ENUM' ELSE 'MALFORMED' END AS reason,
       CASE event_id % 13 WHEN 3 THEN 'externalSystemID' WHEN 4 THEN 'category' END AS fields
FROM events WHERE event_id % 13 BETWEEN 1 AND 5
UNION ALL SELECT 'creation', data_offset, data_offset, 'MALFORMED', NULL FROM src WHERE user_id % 7 = 0"""
    sql["decoded_records"] = "WITH" + SOURCES + """
SELECT 'REPORT' AS kind, event_type AS topic, event_id AS "offset", event_id AS pos, CAST(NULL AS VARCHAR) AS "sourceName",
       CAST(NULL AS BIGINT) AS "dataOffset", value AS speed, CAST(user_id AS VARCHAR) AS external_id
FROM events WHERE event_id % 13 NOT BETWEEN 1 AND 5
UNION ALL SELECT 'CREATE', 'creation', data_offset, data_offset, sensor_id, data_offset, NULL, reports_id FROM src WHERE user_id % 7 <> 0"""
    sql["son_latest"] = "WITH" + _routed("replay") + f""",
last AS (SELECT family_id, version_seq, reporter AS system_uuid, max(pos) AS pos FROM accepted GROUP BY ALL)
SELECT l.family_id, l.version_seq, l.system_uuid, l.pos, {_flat('r')} FROM last l JOIN reports r ON r.pos = l.pos"""
    sql["preferred_son"] = "WITH" + _routed("replay") + f""",
last AS (SELECT family_id, version_seq, max(pos) AS pos, arg_max(reporter, pos) AS system_uuid FROM accepted GROUP BY ALL)
SELECT l.family_id, l.version_seq, l.system_uuid, l.pos, {_flat('r')} FROM last l JOIN reports r ON r.pos = l.pos"""
    sql["family_seeds"] = "WITH" + _routed("replay") + f""",
last AS (SELECT family_id, max(pos) AS pos FROM accepted WHERE state = 'NONE' AND v_to IS NOT NULL GROUP BY ALL)
SELECT m.family_id, m.version_seq, m.system_uuid, {_flat('r')} FROM members m
JOIN last l ON l.family_id = m.system_uuid AND m.prev_family_id = m.system_uuid JOIN reports r ON r.pos = l.pos"""
    sql["family_seeds_carry"] = "WITH" + _routed("resume") + f""",
told AS (SELECT m.family_id, m.version_seq, m.system_uuid, max(a.pos) AS pos FROM members m
         JOIN accepted a ON a.reporter = m.system_uuid AND a.pos < m.v_from GROUP BY ALL)
SELECT t.family_id, t.version_seq, t.system_uuid, {_flat('r')} FROM told t JOIN reports r ON r.pos = t.pos"""
    sql["family_complete"] = "WITH" + _records("replay") + """
SELECT "entityID", version_seq, pos, topic, "offset", n_sons, CAST(count(known) AS INTEGER) AS n_known,
       count(known) = n_sons AS complete FROM records GROUP BY "entityID", version_seq, pos, topic, "offset", n_sons"""
    sql["state_changes"] = "WITH" + _records("replay") + """
SELECT DISTINCT "entityID", version_seq, pos, topic, "offset", "stateChanges" FROM records WHERE "stateChanges" <> 'NONE'"""
    sql["family_sons"] = "WITH" + _records("resume") + """
SELECT x."entityID", x.version_seq, x.pos, x.son_ordinal, x.son_id, k."sourceName" AS son_source,
       k."externalSystemID" AS son_external_id FROM records x LEFT JOIN reports k ON k.pos = x.known"""
    sql["published_updates"] = "WITH" + _records("resume") + """
SELECT 'update' AS topic, x."entityID" AS "key", x."stateChanges", x.pos AS entity_offset, p.nickname,
       CAST(count(*) AS INTEGER) AS n_sons, CAST(sum(k."entityOffset") AS BIGINT) AS sum_son_offsets
FROM records x JOIN reports p ON p.pos = x.pos LEFT JOIN reports k ON k.pos = x.known
GROUP BY x."entityID", x."stateChanges", x.pos, p.nickname"""
    sql["family_snapshot"] = "WITH" + _records("replay") + f""",
ranked AS (SELECT *, rank() OVER (PARTITION BY "entityID" ORDER BY version_seq DESC, pos DESC) AS r FROM records),
live AS (SELECT DISTINCT family_id FROM members WHERE v_to IS NULL)
SELECT x."entityID", x.version_seq, x.pos, x.n_sons, l.family_id IS NOT NULL AS live, x.reporter AS preferred_uuid,
       p.nickname AS preferred_nickname, x.son_ordinal, x.son_id, {_flat('k', 'son_')}
FROM ranked x JOIN reports p ON p.pos = x.pos LEFT JOIN reports k ON k.pos = x.known
LEFT JOIN live l ON l.family_id = x."entityID" WHERE x.r = 1"""
    sql["stream_late_updates"] = _late_updates()
    sql["stream_updates"] = sql["family_updates_resume"]
    sql["stream_latest"] = "WITH" + SOURCES + _reports() + f""",
last AS (SELECT topic, "externalSystemID" AS ext, max(pos) AS pos FROM reports GROUP BY ALL)
SELECT l.topic, l.ext AS external_id, l.pos, r.nickname, r.speed FROM last l JOIN reports r ON r.pos = l.pos"""

    sql["throttled_stream"] = "SELECT event_id, event_type, CAST(4 AS BIGINT) AS n_batches FROM events"
    sql["stop_by_name"] = """
SELECT pipeline, event_id, false AS stopped FROM events, (VALUES ('A'), ('C')) AS p(pipeline)
UNION ALL SELECT 'B', max(event_id), true FROM events"""
    sql["merged_ranges"] = """
SELECT 'orders' AS branch, unnest(range(a, b + 1)) AS value FROM (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders)
UNION ALL
SELECT 'events', unnest(range(a, b + 1)) FROM (SELECT min(event_id) AS a, max(event_id) AS b FROM events)"""
    sql["mapped_branches"] = """
SELECT 'first' AS branch, o_orderkey + 1 AS value FROM orders UNION ALL SELECT 'second', o_orderkey + 1 FROM orders"""
    sql["tee_suffix"] = """
SELECT 'tee' AS branch, doc_id, text AS value FROM documents
UNION ALL SELECT 'main', doc_id, concat(text, '- supervisor') FROM documents"""
    # DuckDB maps letter by letter; the full upper case of the sharp s is two letters
    sql["upper_case"] = "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS value FROM documents"
    sql["twin_primes"] = """
WITH n AS (SELECT DISTINCT o_orderkey AS n FROM orders),
d AS (SELECT unnest(range(2, 2 + CAST(floor(sqrt(max(n) + 2)) AS BIGINT))) AS d FROM n),
primes AS (SELECT a.d FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.d < a.d AND a.d % b.d = 0))
SELECT n AS value FROM n WHERE n > 1
AND NOT EXISTS (SELECT 1 FROM primes p WHERE (n > p.d AND n % p.d = 0) OR (n + 2 > p.d AND (n + 2) % p.d = 0))"""
    sql["variant_collect"] = "SELECT event_id, value AS payload FROM events WHERE event_type = 'purchase'"
    sql["take_while"] = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM events)
WHERE failed = 0"""
    sql["ordered_fold"] = """
SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS folded FROM events GROUP BY user_id"""
    sql["ordered_fold_pieces"] = """
WITH ranked AS (SELECT user_id, event_id, substr(event_type, 1, 1) AS letter,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
pieces AS (SELECT user_id, CAST(n // 64 AS BIGINT) AS piece,
  CASE WHEN n // 64 > 0 THEN '-' ELSE '' END || string_agg(letter, '-' ORDER BY event_id) AS text
  FROM ranked GROUP BY user_id, n // 64)
SELECT user_id, piece, text, CAST(coalesce(sum(length(text)) OVER (
  PARTITION BY user_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pieces"""
    sql["stream_take_while"] = sql["take_while"]
    sql["stream_killed_by_key"] = """
SELECT event_id, user_id, event_type FROM (
  SELECT event_id, user_id, event_type, coalesce(last_value(
    CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'signup') AS told FROM events)
WHERE told = 'signup' AND event_type NOT IN ('error', 'signup')"""
    sql["tokenize"] = r"""
WITH parts AS (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\x0B\f\r]') AS a FROM documents),
rows AS (SELECT doc_id, len(a) AS n, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM parts),
ends AS (SELECT doc_id, max(CASE WHEN token <> '' THEN i ELSE 0 END) AS last FROM rows GROUP BY doc_id)
SELECT r.doc_id, CAST(r.i - 1 AS INTEGER) AS token_no, r.token FROM rows r JOIN ends e ON r.doc_id = e.doc_id
WHERE r.i <= e.last OR r.n = 1"""
    lines = """concat(CASE event_type WHEN 'error' THEN '[ERROR]' WHEN 'purchase' THEN '[INFO]' WHEN 'signup' THEN '[WARN]'
              WHEN 'click' THEN '[DEBUG]' ELSE '' END, ' user ', CAST(user_id AS VARCHAR), ' ', props,
              CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN ' [INFO]' ELSE '' END)"""
    sql["log_levels"] = rf"""
SELECT event_id, line, coalesce(nullif(regexp_extract(line, '.*\[(DEBUG|INFO|WARN|ERROR)\].*', 1), ''), 'UNKNOWN') AS level
FROM (SELECT event_id, {lines} AS line FROM events)"""
    sql["text_written"] = f"""
SELECT line, CAST(sum(strlen(line)) OVER () AS BIGINT) AS n_bytes FROM (SELECT {lines} AS line FROM events)"""
    sql["lines_by_level"] = "SELECT line, level FROM (" + sql["log_levels"] + ")"
    sql["observed_events"] = """
SELECT event_id, (SELECT count(*) FROM events) AS n_events, (SELECT max(event_id) FROM events) AS last_event
FROM events WHERE event_type = 'error'"""
    sql["file_lines"] = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
rows AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM parts)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, line, CAST(strlen(line) AS INTEGER) AS n_bytes, strlen(line) > 512 AS rejected
FROM rows WHERE NOT (i = n AND line = '')"""
    return sql
