"""The expected result of every registered query, as SQL on the given tables."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
VIEW = "event_id AS id, user_id, event_type AS kind, value, ts AS occurred_at"

DIFFERING = f"""
WITH timed AS (
  SELECT event_id, user_id, event_type, value,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN {NOW} - INTERVAL 7 DAY
              WHEN event_id % 107 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE ts END AS ts
  FROM events),
view AS (
  SELECT event_id AS id, user_id, event_type AS kind, ts AS occurred_at,
         CASE WHEN ts > {NOW} - INTERVAL 7 DAY THEN value + 1000 ELSE value END AS value
  FROM timed WHERE ts IS NOT NULL)
"""

RULES = "CASE " + " ".join(f"WHEN event_id % {k} = 0 THEN {k}" for k in (97, 89, 83, 79, 73, 71, 67, 61, 59)) + " ELSE 0 END"

MESSAGES = f"""
WITH sent AS (
  SELECT event_id, ts, user_id, event_type, value, props, CAST(event_id AS BIGINT) AS off FROM events
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value + 1, props, event_id + 1000000000000
  FROM events WHERE event_type = 'purchase'),
ruled AS (SELECT *, {RULES} AS rule, CAST(event_id % 4 AS INTEGER) AS part FROM sent),
good AS (
  SELECT event_id, user_id, CASE WHEN rule = 73 THEN 'null' ELSE event_type END AS event_type, value,
         ts AS occurred_at, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         replace(props, ': ', ':') AS props, part, off
  FROM ruled WHERE rule NOT IN (97, 89, 79, 71, 67, 61, 59)),
bad AS (
  SELECT part, off,
         CASE rule WHEN 89 THEN 'user_id: path $.user_id not found'
                   WHEN 79 THEN 'value: not a double'
                   WHEN 71 THEN 'occurred_at: not a timestamptz'
                   ELSE 'malformed JSON' END AS reject_reason
  FROM ruled WHERE rule IN (97, 89, 79, 71, 67, 61, 59))
"""

LATEST_MESSAGES = (
    MESSAGES
    + """
SELECT event_id, user_id, event_type, value, occurred_at, k, props
FROM good QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY off DESC) = 1
"""
)


def coerced(forms: list[str], kind: str) -> str:
    """One expected value per document form, in turn; NULL means rejected."""
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return f"""
SELECT event_id, v, v IS NOT NULL AS accepted
FROM (SELECT event_id, CAST(CASE event_id % {len(forms)} {cases} END AS {kind}) AS v FROM events)
"""


TEXT_FORMS = coerced(
    [
        "event_type",
        "'null'",
        "user_id::VARCHAR",
        "user_id::VARCHAR || '.0'",
        "(user_id + 10000000)::VARCHAR || '.5'",
        """'{"a":[1,2],"b":' || user_id::VARCHAR || '}'""",
        "'true'",
        "'q\"é'",
        "'[]'",
        "rtrim('0.0001' || user_id::VARCHAR, '0')",
        "left((user_id + 1)::VARCHAR, 1)"
        " || CASE WHEN length(rtrim((user_id + 1)::VARCHAR, '0')) > 1"
        "    THEN '.' || substr(rtrim((user_id + 1)::VARCHAR, '0'), 2) ELSE '' END"
        " || 'e' || (18 + length((user_id + 1)::VARCHAR))::VARCHAR",
        "''",
    ],
    "VARCHAR",
)

FEED = """
WITH steps(kind, change, days, added) AS (VALUES
  (NULL, 'insert', 0, 0),
  ('purchase', 'update_preimage', 1, 0), ('purchase', 'update_postimage', 1, 1),
  ('error', 'delete', 2, 0),
  ('signup', 'delete', 1, 0), ('signup', 'insert', 2, 2),
  ('view', 'delete', 1, 0), ('view', 'insert', 1, 3)),
feed AS (
  SELECT event_id, user_id, event_type, value + added AS value, ts, change AS _change_type,
         CAST(datediff('day', DATE '2024-01-01', ts::DATE) + days AS BIGINT) AS _commit_version
  FROM events JOIN steps ON kind IS NULL OR kind = event_type)
"""

# Replays versions up to 20 onto the rows up to the 10th.
CHANGE_APPLY = (
    FEED
    + """,
replayed AS (
  SELECT *, row_number() OVER (PARTITION BY event_id
              ORDER BY _commit_version DESC, CASE WHEN _change_type = 'delete' THEN 0 ELSE 1 END DESC) AS back,
         bool_or(_change_type = 'delete') OVER (PARTITION BY event_id) AS was_deleted
  FROM feed WHERE _commit_version <= 20 AND _change_type <> 'update_preimage'),
target AS (SELECT event_id, user_id, event_type, value, ts, ts AS synced_at FROM events
           WHERE ts <= TIMESTAMP '2024-01-10 00:00:00')
SELECT r.event_id, r.user_id, r.event_type, r.value, r.ts, CASE WHEN NOT was_deleted THEN t.synced_at END AS synced_at
FROM replayed r LEFT JOIN target t USING (event_id) WHERE back = 1 AND _change_type <> 'delete'
UNION ALL
SELECT * FROM target WHERE event_id NOT IN (SELECT event_id FROM replayed)
"""
)

UNTIMED = """
WITH untimed AS (
  SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN ts END AS ts, user_id, event_type, value, props FROM events)
"""

LINEAGE = """
WITH RECURSIVE customers AS (
  SELECT 'C' || c_custkey AS own, 'N' || c_nationkey AS home, 'R' || n_regionkey AS conn,
         c_acctbal < 0 AS stray, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT 'table:' || conn || ':' || home AS src, 'sync:' || own AS dst FROM customers
  UNION ALL
  SELECT 'sync:' || own, 'table:' || conn || ':' || own FROM customers WHERE NOT stray
  UNION ALL
  SELECT 'table:' || conn || ':' || own, 'projection:O' || o_orderkey
  FROM orders JOIN customers ON o_custkey = c_custkey),
nodes AS (
  SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT 'sync:' || own FROM customers),
walked AS (
  SELECT node, CAST(0 AS BIGINT) AS layer FROM nodes WHERE node NOT IN (SELECT dst FROM edges)
  UNION
  SELECT dst, layer + 1 FROM walked JOIN edges ON node = src),
layers AS (SELECT node, max(layer) AS layer FROM walked GROUP BY node)
"""

SUBGRAPH = (
    LINEAGE
    + """,
up AS (SELECT 'sync:C7' AS node UNION SELECT src FROM up JOIN edges ON node = dst),
down AS (SELECT 'sync:C7' AS node UNION SELECT dst FROM down JOIN edges ON node = src),
inside AS (SELECT node FROM up UNION SELECT node FROM down)
"""
)

ORACLES: dict[str, str] = {
    "column_view": "SELECT props AS payload, event_id, ts AS occurred_at FROM events",
    "describe_columns": """
SELECT CAST(ordinal_position AS BIGINT) AS ordinal, column_name AS name,
       CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type,
       (SELECT count(*) FROM events) AS total
FROM information_schema.columns WHERE table_name = 'events'
""",
    "binary_to_string": "SELECT event_id, props, event_type FROM events",
    "time_range": """
SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-24 00:00:00'
""",
    "age_window": f"""
SELECT * FROM events WHERE {NOW} - ts >= INTERVAL 36 HOUR AND {NOW} - ts < INTERVAL 180 HOUR
""",
    "tiered_read": f"SELECT {VIEW} FROM events",
    "tiered_read_three": f"SELECT {VIEW} FROM events",
    "tiered_read_differing": DIFFERING + "SELECT * FROM view",
    "tiered_page_differing": DIFFERING
    + f"""
SELECT * FROM view ORDER BY occurred_at DESC, id
LIMIT 100 OFFSET (SELECT count(*) - 50 FROM timed WHERE ts > {NOW} - INTERVAL 7 DAY)
""",
    "tier_counts": f"""
SELECT CASE WHEN {NOW} - ts < INTERVAL 7 DAY THEN 'hot' WHEN {NOW} - ts < INTERVAL 14 DAY THEN 'warm' ELSE 'cold' END
         AS tier, count(*) AS "rows"
FROM events GROUP BY 1
""",
    "tier_coverage": UNTIMED
    + f"""
, tiers(tier, low, high) AS (VALUES ('hot', NULL, 7), ('warm', 7, 14), ('cold', 14, NULL)),
placed AS (
  SELECT tier, ts, coalesce(ts > {NOW} - to_days(high), true) AND coalesce(ts <= {NOW} - to_days(low), true) AS inside
  FROM tiers, untimed)
SELECT tier, count(*) FILTER (WHERE ts IS NOT NULL AND inside) AS in_window,
       count(*) FILTER (WHERE ts IS NOT NULL AND NOT inside) AS outside_window,
       count(*) FILTER (WHERE ts IS NULL) AS without_time
FROM placed GROUP BY tier
""",
    "page_summary": """
SELECT count(*) AS total, CAST(20 AS BIGINT) AS "limit", CAST(40 AS BIGINT) AS "offset", true AS tiered,
       CAST(41 AS BIGINT) AS first_row, least(60, count(*)) AS last_row
FROM events
""",
    "table_page": "SELECT * FROM events ORDER BY event_id LIMIT 50 OFFSET 100",
    "table_page_deep_dates": """
SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY day DESC, o_orderkey
LIMIT 100 OFFSET (SELECT count(*) // 2 FROM orders)
""",
    "table_page_deep_doubles": """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
LIMIT 100 OFFSET (SELECT count(*) // 2 FROM lineitem)
""",
    "lake_page": "SELECT o_orderkey, o_orderdate AS day FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10",
    "tiered_page": f"SELECT {VIEW} FROM events ORDER BY ts DESC, event_id LIMIT 20",
    "tiered_page_straddle": f"""
SELECT {VIEW} FROM events ORDER BY ts DESC, event_id LIMIT 40
OFFSET (SELECT count(*) - 10 FROM events WHERE ts > TIMESTAMP '2024-01-24 00:00:00')
""",
    "tiered_page_past_end": "SELECT count(*) AS total, CAST(0 AS BIGINT) AS rows_on_page FROM events",
    "tiered_page_deep": f"""
SELECT {VIEW} FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET (SELECT count(*) // 2 FROM events)
""",
    "map_messages": MESSAGES + "SELECT * FROM good",
    "rejected_messages": MESSAGES + "SELECT * FROM bad",
    "reject_counts": MESSAGES + "SELECT reject_reason, count(*) AS messages FROM bad GROUP BY 1",
    "json_paths": """
SELECT event_id, event_id AS with_prefix, event_id AS without_prefix, user_id AS quoted_key, true AS object_found,
       false AS through_array, false AS dotted_key, false AS missing_key
FROM events
""",
    "coerce_text": TEXT_FORMS,
    "coerce_unknown_type": TEXT_FORMS,
    "coerce_int": coerced(
        ["user_id", "user_id", "NULL", "NULL", "NULL", "user_id", "NULL", "NULL", "NULL", "-1 - user_id", "NULL"],
        "BIGINT",
    ),
    "coerce_float": coerced(["value", "NULL", "user_id", "user_id * 100", "NULL", "NULL", "NULL"], "DOUBLE"),
    "coerce_bool": coerced(["true", "false", "NULL", "NULL", "NULL"], "BOOLEAN"),
    "coerce_timestamp": coerced(
        [
            "ts",
            "ts",
            "date_trunc('second', ts) - INTERVAL 330 MINUTE",
            "NULL",
            "NULL",
            "NULL",
            "date_trunc('second', ts) + INTERVAL 123456 MICROSECOND",
            "NULL",
            "date_trunc('second', ts) + INTERVAL 30 MINUTE",
        ],
        "TIMESTAMP",
    ),
    "latest_per_key": """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""",
    "upsert_merge": """
SELECT event_id, user_id, event_type,
       CASE WHEN ts > TIMESTAMP '2024-01-17 00:00:00' THEN value + 1 ELSE value END AS value, ts,
       CASE WHEN ts > TIMESTAMP '2024-01-24 00:00:00' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS synced_at
FROM events
""",
    "upsert_small_batch": """
SELECT event_id, user_id, event_type,
       CASE WHEN ts > TIMESTAMP '2024-01-30 00:00:00' THEN value + 1 ELSE value END AS value, ts, ts AS synced_at
FROM events
""",
    "upsert_null_keys": """
SELECT CASE WHEN event_id % 101 <> 0 THEN event_id END AS event_id, user_id, event_type,
       CASE WHEN event_id % 101 <> 0 AND ts > TIMESTAMP '2024-01-17 00:00:00' THEN value + 1 ELSE value END AS value, ts,
       CASE WHEN ts <= TIMESTAMP '2024-01-24 00:00:00' THEN ts END AS synced_at
FROM events WHERE event_id % 101 <> 0 OR ts <= TIMESTAMP '2024-01-24 00:00:00'
""",
    "upsert_key_only": """
SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS first_seen FROM events GROUP BY user_id
""",
    "delete_by_key": """
SELECT event_id, user_id FROM events WHERE user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'purchase' AND ts::DATE = DATE '2024-01-01')
""",
    "change_feed_range": FEED
    + "SELECT event_id, _change_type, _commit_version FROM feed WHERE _commit_version BETWEEN 10 AND 20",
    "change_apply": CHANGE_APPLY,
    "change_apply_incremental": CHANGE_APPLY,
    "change_apply_resumed": CHANGE_APPLY,
    "change_apply_repeated_keys": CHANGE_APPLY.replace("r.value,", "r.value + 7 AS value,"),
    "feed_to_table": FEED
    + """
SELECT event_id, user_id, event_type, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id
              ORDER BY _commit_version DESC, CASE WHEN _change_type = 'delete' THEN 0 ELSE 1 END DESC) AS back
  FROM feed WHERE _change_type <> 'update_preimage')
WHERE back = 1 AND _change_type <> 'delete'
""",
    "keyed_compacted": LATEST_MESSAGES,
    "change_cursor": FEED + "SELECT max(_commit_version) AS last_applied FROM feed WHERE _commit_version <= 20",
    "retention_prune": UNTIMED + f"SELECT * FROM untimed WHERE ts IS NULL OR ts >= {NOW} - INTERVAL 7 DAY",
    "retention_pruned_count": UNTIMED + f"SELECT count(*) AS pruned FROM untimed WHERE ts < {NOW} - INTERVAL 7 DAY",
    "topic_to_lake": MESSAGES + "SELECT event_id, user_id, event_type, value, occurred_at, k, props FROM good",
    "topic_to_lake_replayed": MESSAGES + "SELECT event_id, user_id, event_type, value, occurred_at, k, props FROM good",
    "lake_merged": MESSAGES + "SELECT event_id, user_id, event_type, value, occurred_at, k, props FROM good",
    "lake_pruned": UNTIMED + f"SELECT * FROM untimed WHERE ts IS NULL OR ts >= {NOW} - INTERVAL 7 DAY",
    "topic_to_table": LATEST_MESSAGES,
    "topic_drain_twice": LATEST_MESSAGES,
    "two_topics_one_lake": MESSAGES + "SELECT event_id, user_id, event_type, value, occurred_at, k, props FROM good",
    "two_topics_one_table": LATEST_MESSAGES,
    "job_status": """
WITH observed AS (
  SELECT user_id AS job,
         arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE event_type END, ts) AS phase,
         max(ts) FILTER (WHERE event_type <> 'error') AS beat,
         arg_max(event_id, ts) FILTER (WHERE event_type <> 'error') AS mark,
         arg_max(props, ts) FILTER (WHERE event_type = 'error') AS last_error
  FROM events GROUP BY user_id)
SELECT c_custkey AS job, coalesce(phase, 'Missing') AS phase, date_trunc('second', beat) AS last_beat_at,
       CASE WHEN beat IS NOT NULL THEN CAST(0 AS BIGINT) END AS lag, CAST(mark AS VARCHAR) AS watermark, last_error,
       coalesce(beat > TIMESTAMP '2024-01-30 23:59:00', false) AS alive
FROM customer LEFT JOIN observed ON c_custkey = job
""",
    "lineage_edges": LINEAGE + "SELECT src, dst FROM edges",
    "lineage_nodes": """
WITH customers AS (
  SELECT 'C' || c_custkey AS own, 'N' || c_nationkey AS home, 'R' || n_regionkey AS conn, c_acctbal < 0 AS stray, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
tables AS (
  SELECT conn, home AS name FROM customers
  UNION SELECT conn, own FROM customers WHERE NOT stray
  UNION SELECT conn, own FROM customers JOIN orders ON o_custkey = c_custkey),
observed AS (
  SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE event_type END, ts) AS phase,
         coalesce(max(ts) FILTER (WHERE event_type <> 'error') > TIMESTAMP '2024-01-30 23:59:00', false) AS alive
  FROM events GROUP BY user_id)
SELECT 'table:' || conn || ':' || name AS node, 'table' AS kind, name, conn AS connection,
       CAST(NULL AS BOOLEAN) AS alive, CAST(NULL AS VARCHAR) AS phase FROM tables
UNION ALL
SELECT 'sync:' || own, 'sync', own, NULL, alive, phase FROM customers LEFT JOIN observed ON user_id = c_custkey
UNION ALL
SELECT 'projection:O' || o_orderkey, 'projection', 'O' || o_orderkey, NULL, NULL, NULL
FROM orders JOIN customers ON o_custkey = c_custkey
""",
    "lineage_layers": LINEAGE + "SELECT node, layer FROM layers",
    "lineage_subgraph": SUBGRAPH
    + """
SELECT node, layer - min(layer) OVER () AS layer FROM layers WHERE node IN (SELECT node FROM inside)
""",
    "lineage_subgraph_edges": SUBGRAPH
    + """
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM inside) AND dst IN (SELECT node FROM inside)
""",
}

# Queries that reach the result of another one by another way.
ORACLES |= {
    "tier_counts_lake": ORACLES["tier_counts"],
    "page_summary_lake": ORACLES["page_summary"],
    "upsert_touched": ORACLES["upsert_merge"],
    "named_view": ORACLES["tiered_read_three"],
}
