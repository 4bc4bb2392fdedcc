"""DuckDB SQL for every registered catalogue query."""

_CAT = """cat AS (SELECT p_partkey AS pos, p_name AS title, p_brand AS host, CAST(p_size AS INTEGER) AS duration FROM part)"""

_RAW = r"""raw AS (SELECT p_partkey AS seq,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN ' ' ELSE p_name END AS raw_title,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS raw_host,
  CASE p_partkey % 10 WHEN 0 THEN 'abc' WHEN 1 THEN '0' WHEN 2 THEN '1001' WHEN 3 THEN CAST(p_size AS VARCHAR) || 'min'
    WHEN 4 THEN '  ' || CAST(p_size AS VARCHAR) WHEN 5 THEN CAST(p_size AS VARCHAR) || '.7' WHEN 6 THEN '99999999999'
    WHEN 7 THEN '  ' ELSE CAST(p_size AS VARCHAR) END AS raw_duration FROM part),
parsed AS (SELECT *, TRY_CAST(regexp_extract(raw_duration, '^[ \t\n\x0B\f\r]*([+-]?[0-9]+)', 1) AS INTEGER) AS duration FROM raw),
classified AS (SELECT *, CASE WHEN raw_title = '' THEN 'title_empty' WHEN raw_host = '' THEN 'host_empty'
  WHEN regexp_matches(raw_duration, '^[ \t\n\x0B\f\r]*$') THEN 'duration_missing' WHEN duration IS NULL THEN 'duration_not_integer'
  WHEN duration NOT BETWEEN 1 AND 1000 THEN 'duration_out_of_range' ELSE 'ok' END AS status FROM parsed)"""

_STATE = """cmd AS (SELECT user_id AS session_id, event_id AS seq,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'click' THEN 3
    WHEN event_type = 'purchase' THEN 4 WHEN event_type = 'error' AND event_id % 50 = 0 THEN 5 ELSE 9 END AS choice,
  't' || CAST(CASE WHEN event_type = 'click' THEN event_id % 9 ELSE event_id % 7 END AS VARCHAR) AS title,
  CAST(user_id AS VARCHAR) AS host, CAST(1 + floor(value) AS INTEGER) AS duration FROM events),
ends AS (SELECT session_id, min(seq) AS x FROM cmd WHERE choice = 5 GROUP BY session_id),
live AS (SELECT c.* FROM cmd c LEFT JOIN ends e ON c.session_id = e.session_id WHERE c.choice BETWEEN 1 AND 5
  AND (e.x IS NULL OR c.seq <= e.x)
  AND NOT (c.choice = 1 AND (c.title = '' OR c.host = '' OR c.duration NOT BETWEEN 1 AND 1000))),
counted AS (SELECT *, max(CASE WHEN choice = 4 THEN seq END) OVER w AS s_last, count(CASE WHEN choice = 1 THEN 1 END) OVER w AS n_before
  FROM live WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT * FROM counted WHERE NOT (choice = 3 AND title = '' AND n_before > 0))"""

_ORDER = """CASE WHEN a.seq < c.s_last THEN 0 ELSE 1 END, CASE WHEN a.seq < c.s_last THEN a.duration ELSE 0 END, a.seq"""

_SEARCH = f"""hits AS (SELECT c.session_id, c.seq, a.host, a.duration,
  row_number() OVER (PARTITION BY c.session_id, c.seq ORDER BY {_ORDER}) AS rn
  FROM state c JOIN state a ON a.session_id = c.session_id AND a.title = c.title AND a.seq < c.seq AND a.choice = 1
  WHERE c.choice = 3),
answers AS (SELECT c.session_id, c.seq, c.title AS term,
  CASE WHEN c.n_before = 0 THEN 'empty' WHEN h.seq IS NULL THEN 'not_found' ELSE 'found' END AS outcome, h.host, h.duration
  FROM state c LEFT JOIN hits h ON h.session_id = c.session_id AND h.seq = c.seq AND h.rn = 1 WHERE c.choice = 3)"""

_LINE = "title || ' | Host: ' || host || ' | Duration: ' || CAST(duration AS VARCHAR) || ' min'"
_RESEQ = f"{_CAT}, moved AS (SELECT row_number() OVER (ORDER BY duration, pos) AS pos, title, host, duration FROM cat)"


def oracle_sql() -> dict[str, str]:
    return {
        "parse_int": f"WITH {_RAW} SELECT seq, raw_duration, duration AS parsed FROM parsed",
        "range_check": f"WITH {_RAW} SELECT seq, duration AS parsed, COALESCE(duration BETWEEN 1 AND 1000, FALSE) AS in_range FROM parsed",
        "nonempty_check": f"WITH {_RAW} SELECT seq, raw_title <> '' AS title_ok, raw_host <> '' AS host_ok FROM raw",
        "intake_classify": f"WITH {_RAW} SELECT seq, duration, status FROM classified",
        "intake_accepted": f"WITH {_RAW} SELECT seq, raw_title AS title, raw_host AS host, duration FROM classified WHERE status = 'ok'",
        "intake_rejected": f"WITH {_RAW} SELECT seq, raw_title, raw_host, raw_duration, status AS reason FROM classified WHERE status <> 'ok'",
        "retry_collapse": r"""WITH attempt AS (SELECT user_id AS entry_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'abc'
  WHEN 'view' THEN '  ' ELSE CAST(CAST(floor(value) AS INTEGER) - 20 AS VARCHAR) END AS raw FROM events),
parsed AS (SELECT *, TRY_CAST(regexp_extract(raw, '^[ \t\n\x0B\f\r]*([+-]?[0-9]+)', 1) AS INTEGER) AS value FROM attempt)
SELECT entry_id, arg_min(value, seq) AS value FROM parsed WHERE value BETWEEN 1 AND 1000 GROUP BY entry_id""",
        "append_batch": f"""WITH {_CAT} SELECT * FROM cat WHERE pos < 1500 UNION ALL
SELECT COALESCE((SELECT max(pos) FROM cat WHERE pos < 1500), -1) + row_number() OVER (ORDER BY pos) AS pos, title, host, duration FROM cat WHERE pos >= 1500""",
        "project_columns": f"WITH {_CAT} SELECT title, host, duration FROM cat",
        "listing_ordinal": f"WITH {_CAT} SELECT row_number() OVER (ORDER BY pos) AS ordinal, title, host, duration FROM cat",
        "listing_lines": f"WITH {_CAT}, n AS (SELECT row_number() OVER (ORDER BY pos) AS ordinal, title, host, duration FROM cat) SELECT ordinal, CAST(ordinal AS VARCHAR) || '. ' || {_LINE} AS line FROM n",
        "title_lookup": f"WITH {_CAT} SELECT * FROM cat WHERE title = 'red widget' ORDER BY pos LIMIT 1",
        "title_lookup_line": f"WITH {_CAT} SELECT pos, 'Found: ' || {_LINE} AS line FROM cat WHERE title = 'red widget' ORDER BY pos LIMIT 1",
        "title_lookup_batch": f"""WITH {_CAT}, probe AS (SELECT p_name AS term, min(p_partkey) AS probe_id FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name
  UNION ALL SELECT 'no such title', -1 UNION ALL SELECT 'Red Widget', -2 UNION ALL SELECT 'red widget ', -3),
hit AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY pos) AS rn FROM cat)
SELECT probe_id, term, CASE WHEN (SELECT count(*) FROM cat) = 0 THEN 'empty' WHEN pos IS NULL THEN 'not_found' ELSE 'found' END AS outcome, pos, host, duration
FROM probe LEFT JOIN hit ON term = title AND rn = 1""",
        "sort_by_duration": f"WITH {_CAT} SELECT * FROM cat ORDER BY duration, pos",
        "resequence_by_duration": f"WITH {_RESEQ} SELECT * FROM moved",
        "title_lookup_after_sort": f"WITH {_RESEQ} SELECT * FROM moved WHERE title = 'red widget' ORDER BY pos LIMIT 1",
        "apply_corrections": f"""WITH {_CAT} SELECT pos, CASE WHEN pos % 17 = 0 THEN '' ELSE title END AS title,
CASE WHEN pos % 17 = 2 THEN 'guest of ' || host WHEN pos % 17 = 3 THEN '' ELSE host END AS host,
CAST(CASE WHEN pos % 17 = 1 THEN 5000 ELSE duration END AS INTEGER) AS duration FROM cat""",
        "apply_correction_feed": f"""WITH {_CAT}, feed AS (SELECT user_id AS fix, event_id AS seq,
  CASE WHEN event_type IN ('click', 'signup') THEN CASE WHEN event_id % 11 = 0 THEN '' ELSE 'title ' || CAST(event_id % 97 AS VARCHAR) END END AS new_title,
  CASE WHEN event_type IN ('view', 'signup') THEN 'host ' || CAST(event_id % 89 AS VARCHAR) END AS new_host,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) * 10 - 100 AS INTEGER) END AS new_duration FROM events),
last AS (SELECT fix, arg_max(new_title, seq) FILTER (WHERE new_title IS NOT NULL) AS new_title, arg_max(new_host, seq) FILTER (WHERE new_host IS NOT NULL) AS new_host,
  arg_max(new_duration, seq) FILTER (WHERE new_duration IS NOT NULL) AS new_duration FROM feed GROUP BY fix)
SELECT pos, COALESCE(new_title, title) AS title, COALESCE(new_host, host) AS host, COALESCE(new_duration, duration) AS duration FROM cat LEFT JOIN last ON fix = pos""",
        "record_defaults": f"""WITH {_CAT} SELECT pos, CASE WHEN pos % 5 = 0 THEN '' ELSE title END AS title,
CASE WHEN pos % 7 = 0 THEN '' ELSE host END AS host, CASE WHEN pos % 4 = 0 THEN 0 ELSE duration END AS duration FROM cat""",
        "commands_effective": f"WITH {_STATE} SELECT session_id, seq, choice, title, host, duration FROM state WHERE choice <> 5",
        "replay_search": f"WITH {_STATE}, {_SEARCH} SELECT session_id, seq, term, outcome, host, duration FROM answers",
        "replay_view": f"""WITH {_STATE} SELECT c.session_id, c.seq,
row_number() OVER (PARTITION BY c.session_id, c.seq ORDER BY {_ORDER}) AS ordinal, a.title, a.host, a.duration
FROM state c JOIN state a ON a.session_id = c.session_id AND a.seq < c.seq AND a.choice = 1 WHERE c.choice = 2""",
        "command_outcomes": f"""WITH {_STATE}, {_SEARCH} SELECT session_id, seq, choice,
CASE WHEN choice = 1 THEN 'added' WHEN choice = 5 THEN 'exiting' WHEN n_before = 0 THEN 'empty' WHEN choice = 2 THEN 'listed' ELSE 'sorted' END AS outcome
FROM state WHERE choice <> 3 UNION ALL SELECT session_id, seq, 3 AS choice, outcome FROM answers""",
    }
