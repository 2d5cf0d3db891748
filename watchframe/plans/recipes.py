"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

``$name`` stands for a table, ``$cts``, ``$passed`` and ``$five`` for the expressions the engines spell
differently. The operators under test never appear here.
"""

from __future__ import annotations

from string import Template

GRID_START, GRID_END = 1_704_067_200, 1_704_067_200 + 21_600  # 2024-01-01 and six hours
SCRAPE = "TIMESTAMP '2024-01-31 00:00:00'"

# Time is compressed 120 times, so events are dense enough for five-minute windows.
DIALECT = {
    "spark": {
        "cts": "timestamp_micros(1704067200000000 + (unix_micros(ts) - 1704067200000000) div 120)",
        "passed": "((unix_micros(ts) - 1704067200000000) div 120)",
        "five": "floor(unix_seconds(ts) / 300)",
    },
    "duckdb": {
        "cts": "make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 120)",
        "passed": "((epoch_us(ts) - 1704067200000000) // 120)",
        "five": "floor(epoch_us(ts) / 300000000)",
    },
}

RAW_EVENTS = """
SELECT event_id, ts, CASE CAST(event_id % 10 AS INT)
 WHEN 0 THEN concat('{"environment":"', envn, '","application":"shop","component":"', event_type, '","severity":"', upper(event_type), '","message":"m', k, '","user_id":"u', u, '","session_id":"s', u, '","client_ip":"10.0.0.', u4, '","timestamp":"', tz, 'Z","labels":{"a":"x","n":', k, ',"b":true,"z":null,"o":{"q":1},"r":[1]}}')
 WHEN 1 THEN concat('{"env":" ', envn, ' ","app":"shop","level":"Warn","msg":"m', k, '","userId":"u', u, '","sessionId":"s', u, '","time":"', tz, 'Z"}')
 WHEN 2 THEN concat('{"env":"', envn, '","module":"crm","action":"', event_type, '","text":"m', k, '","trace_id":"t', k, '","ip":"10.0.0.', u4, '","timestamp":"', tz, 'Z","labels":{"z":null}}')
 WHEN 3 THEN concat('{"environment":5,"env":"', envn, '","app":"shop","message":"m', k, '","timestamp":17,"time":"', tz, 'Z"}')
 WHEN 4 THEN concat('{"environment":"  ","env":"', envn, '","app":"shop","message":"m', k, '","timestamp":"', tz, 'Z"}')
 WHEN 5 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","labels":"notmap"}')
 WHEN 6 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","timestamp":"', tz, '"}')
 WHEN 7 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","user":"u', u, '","timestamp":"', tz, '+02:00"}')
 WHEN 8 THEN concat('{"env":"', envn, '","app":"shop","timestamp":"', tz, 'Z"}')
 ELSE CASE CAST(event_id % 70 AS INT) WHEN 9 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","n":', repeat('7', 400), '}')
      WHEN 19 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","n":', repeat('7', 300), 'e99}')
      WHEN 29 THEN concat('{"env":"', envn, '","app":"shop","message":"m', k, '","n":', repeat('7', 300), '.5e3, "t":"', repeat('7', 400), '"}')
      ELSE concat('{"env":"', envn, '","app":') END END AS value
FROM (SELECT event_id, ts, event_type, CAST(user_id AS STRING) AS u, CAST(user_id % 4 AS STRING) AS u4,
      CAST(event_id % 100 AS STRING) AS k, concat('env', CAST(user_id % 3 AS STRING)) AS envn,
      concat(substr(CAST(ts AS STRING),1,10),'T',substr(CAST(ts AS STRING),12,8)) AS tz FROM $events) e
"""


def _scope(key: str) -> str:
    return (f"concat('env', CAST({key} % 3 AS STRING)) AS environment, concat('db', CAST({key} % 5 AS STRING)) AS target, "
            f"{SCRAPE} AS ts")


# System-view snapshots for fifteen targets. Counter names carry trailing blanks on purpose.
SNAPSHOTS = {
    "dm_os_wait_stats": f"""
SELECT environment, target, {SCRAPE} AS ts, event_type AS wait_type,
       CAST(sum(CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS wait_time_ms
FROM (SELECT {_scope('user_id')}, event_type, value FROM $events) e GROUP BY environment, target, event_type""",
    "dm_exec_requests": f"""
SELECT {_scope('o_custkey')}, o_orderkey AS session_id,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 20 AS INT) ELSE 0 END AS blocking_session_id FROM $orders""",
    "dm_exec_sessions": f"""
SELECT {_scope('c_custkey')}, c_custkey AS session_id, lower(c_mktsegment) AS status FROM $customer""",
    "dm_os_performance_counters": f"""
SELECT environment, target, {SCRAPE} AS ts,
       concat(CASE event_type WHEN 'click' THEN 'Batch Requests/sec' WHEN 'view' THEN 'Transactions/sec'
              WHEN 'purchase' THEN 'Total Server Memory (KB)' ELSE concat('other ', event_type) END, '    ') AS counter_name,
       count(*) AS cntr_value
FROM (SELECT {_scope('user_id')}, event_type FROM $events) e GROUP BY environment, target, event_type""",
    "master_files": f"""
SELECT {_scope('p_partkey')}, CAST(p_partkey % 25 AS INT) AS database_id, p_partkey AS file_id, p_size AS size FROM $part""",
    "databases": f"""
SELECT DISTINCT concat('env', CAST(p_partkey % 3 AS STRING)) AS environment, concat('db', CAST(p_partkey % 5 AS STRING)) AS target,
       CAST(p_partkey % 25 AS INT) AS database_id, n_name AS name
FROM $part JOIN $nation ON n_nationkey = p_partkey % 25""",
}

# Events as gauge samples; every 17th carries one more label.
SAMPLES = """
SELECT concat('app_', event_type) AS metric, concat('env', CAST(user_id % 3 AS STRING)) AS environment,
       concat('db', CAST(user_id % 5 AS STRING)) AS target,
       CASE WHEN event_id % 17 = 0 THEN concat('z', CAST(user_id % 2 AS STRING)) END AS zone,
       $cts AS ts, event_id AS ord, value FROM $events"""

# A counter that grows with time and starts anew every half minute; two events share each instant.
COUNTER_SAMPLES = """
SELECT event_type, CAST(user_id % 5 AS INT) AS target, $cts AS ts, event_id * 2 + k AS ord,
       CAST(CAST(floor($passed / 600000) AS BIGINT) % 50 + k AS DOUBLE) AS value
FROM $events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) twice"""

# Values with the special numbers among them.
SPECIAL_VALUES = """
SELECT event_type, CASE WHEN event_id % 211 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN event_id % 5 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value FROM $events"""

UP_SAMPLES = """
SELECT job, instance, environment, ts, event_id, CASE WHEN (CAST($five AS BIGINT) + j) % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS value
FROM (SELECT event_id, CAST(user_id % 4 AS INT) AS j, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'store-api' WHEN 1 THEN 'edge-proxy'
      WHEN 2 THEN 'store-worker' ELSE 'xstore-api' END AS job, concat('i', CAST(user_id % 3 AS STRING)) AS instance,
      concat('env', CAST(user_id % 2 AS STRING)) AS environment, $cts AS ts FROM $events) x"""

# Suppliers as database targets, four to a collector, with faults planted.
TARGETS = """
SELECT s_suppkey AS s, c, concat(' col-', CAST(c AS STRING), ' ') AS id,
       CASE c % 4 WHEN 3 THEN 'otel' ELSE 'sqlserver' END AS kind, c % 5 <> 0 AS enabled,
       CASE c % 6 WHEN 0 THEN '' WHEN 1 THEN 'plain' ELSE concat('kv/c', CAST(c AS STRING)) END AS c_credential,
       concat('env', CAST(c % 3 AS STRING)) AS c_environment,
       CASE WHEN c % 11 = 5 THEN 'soon' WHEN c % 13 = 6 THEN '-5s' WHEN c % 4 = 0 THEN '' WHEN c % 4 = 1 THEN '1m30s'
            WHEN c % 4 = 2 THEN '500ms' ELSE '45s' END AS scrape_interval,
       CASE WHEN c % 3 = 0 THEN concat('tgt-', CAST(c * 4 AS STRING)) END AS chosen,
       CASE WHEN s_suppkey % 29 = 7 THEN '' WHEN s_suppkey % 4 = 3 AND c % 7 = 2 THEN concat('tgt-', CAST(s_suppkey - 1 AS STRING))
            ELSE concat('tgt-', CAST(s_suppkey AS STRING)) END AS name,
       CASE s_suppkey % 3 WHEN 0 THEN ' ' ELSE concat(' prod', CAST(s_suppkey % 3 AS STRING)) END AS environment,
       CASE WHEN s_suppkey % 23 = 5 THEN '' ELSE concat('host', CAST(s_suppkey AS STRING)) END AS host,
       CASE s_suppkey % 19 WHEN 3 THEN 0 WHEN 4 THEN 70000 ELSE 1433 END AS port,
       CASE WHEN s_suppkey % 3 <> 1 THEN concat('d', CAST(s_suppkey AS STRING)) END AS database_name,
       CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('secret/t', CAST(s_suppkey AS STRING))
            WHEN 2 THEN concat('env/T', CAST(s_suppkey AS STRING)) ELSE concat('x', CAST(s_suppkey AS STRING)) END AS credential,
       s_suppkey % 2 = 0 AS own_probes, CASE WHEN s_suppkey % 31 = 8 THEN -5 ELSE 5000 END AS own_timeout
FROM (SELECT s_suppkey, CAST(floor(s_suppkey / 4) AS BIGINT) AS c FROM $supplier) x"""

# Some users share one of four addresses, the others have one of their own.
ADDRESS = """CASE WHEN user_id % 50 = 0 THEN concat('10.0.0.', CAST(user_id % 4 AS STRING))
       ELSE concat('10.1.', CAST(CAST(floor(user_id / 250) AS BIGINT) AS STRING), '.', CAST(user_id % 250 AS STRING)) END"""

METADATA = {
    "database_targets": """
SELECT s_suppkey AS id, s_nationkey AS environment_id, CASE WHEN s_suppkey % 5 = 0 THEN 'postgres' ELSE 'sqlserver' END AS engine,
       s_name AS name, concat('host', CAST(s_suppkey AS STRING)) AS host, 1433 AS port,
       CASE WHEN s_suppkey % 3 <> 0 THEN concat('d', CAST(s_suppkey AS STRING)) END AS database_name,
       CASE WHEN s_suppkey % 7 = 0 THEN 'disabled' ELSE 'active' END AS status, concat('kv/', s_name) AS credential_ref FROM $supplier""",
    "environments": "SELECT n_nationkey AS id, lower(n_name) AS slug FROM $nation",
    "probe_assignments": """
SELECT concat(CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS id, l_suppkey AS database_target_id,
       l_partkey AS probe_definition_id, (l_suppkey + l_partkey) % 4 <> 0 AS enabled,
       CAST(15 + l_partkey % 3 * 15 AS INT) AS interval_seconds
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM $lineitem) l""",
    "probe_definitions": """
SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_type AS query_template, CAST(p_size % 4 * 1000 AS INT) AS timeout_ms,
       p_partkey % 6 <> 0 AS enabled FROM $part""",
    "investigations": f"""
SELECT event_id AS id, concat('app', CAST(user_id % 4 AS STRING)) AS application, CAST(user_id % 3 AS INT) AS environment_id,
       concat('env', CAST(user_id % 3 AS STRING)) AS environment,
       CASE event_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'session' WHEN 2 THEN 'ip' WHEN 3 THEN 'request' END AS subject_type,
       CASE event_id % 5 WHEN 0 THEN concat('u', CAST(user_id AS STRING)) WHEN 1 THEN concat('s', CAST(user_id AS STRING))
            WHEN 2 THEN {ADDRESS} WHEN 3 THEN concat('r', CAST(event_id % 500 AS STRING)) END AS subject_value,
       ts - INTERVAL '1' HOUR AS time_start,
       CASE WHEN event_id = 7 THEN TIMESTAMP '9999-01-01 00:00:00' WHEN event_id % 61 = 0 THEN ts - INTERVAL '2' HOUR ELSE ts + INTERVAL '1' HOUR END AS time_end, ts AS created_at
FROM $events""",
    "requests": """
SELECT event_id AS request_id, concat('env', CAST(user_id % 3 AS STRING)) AS environment_slug,
       CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'session' END AS subject_type,
       concat(CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 's' END, CAST(user_id AS STRING)) AS subject_value,
       CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' HOUR ELSE ts - INTERVAL '12' HOUR END AS lo, ts AS hi
FROM $events""",
    "slugs": "SELECT DISTINCT CAST(user_id % 3 AS INT) AS id, concat('env', CAST(user_id % 3 AS STRING)) AS slug FROM $events",
    "report_runs": """
SELECT o_orderkey AS id, concat('app', CAST(o_custkey % 8 AS STRING)) AS application_id,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status, o_orderdate AS created_at
FROM $orders""",
}

# Tables of the metadata model in the columns its rules read, with faults planted for every kind of rule.
MODEL = {
    "environments": """
SELECT CAST(n_nationkey AS STRING) AS id, lower(n_name) AS slug, 'active' AS status,
       CASE n_nationkey % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' WHEN 3 THEN 'test' ELSE 'lab' END AS type
FROM $nation""",
    "users": """
SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 41 = 0 THEN 'same@example.com' ELSE concat(lower(c_name), '@example.com') END AS email,
       CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'away' ELSE 'active' END AS status FROM $customer""",
    "applications": """
SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN s_suppkey % 17 = 9 THEN 'none' ELSE CAST(s_nationkey AS STRING) END AS environment_id,
       concat('app', CAST(s_suppkey % 3 AS STRING)) AS name, 'active' AS status,
       CASE s_suppkey % 6 WHEN 5 THEN 'urgent' WHEN 4 THEN 'low' ELSE 'high' END AS criticality FROM $supplier""",
    "investigations": """
SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'none' ELSE CAST(o_orderkey % 10 AS STRING) END AS application_id,
       CAST(o_orderkey % 26 AS STRING) AS environment_id, CAST(o_custkey AS STRING) AS created_by,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'paused' END AS status,
       CASE o_orderkey % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'session' WHEN 2 THEN 'request' WHEN 3 THEN 'host' ELSE 'user' END AS subject_type,
       o_orderdate AS time_start,
       CASE WHEN o_orderkey % 53 = 0 THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate + INTERVAL '1' DAY END AS time_end FROM $orders""",
    "investigation_jobs": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_orderkey AS STRING) AS investigation_id,
       CASE l_returnflag WHEN 'A' THEN 'queued' WHEN 'N' THEN 'running' ELSE 'completed' END AS status FROM $lineitem""",
    "alert_policies": """
SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey % 12 AS STRING) AS application_id, p_brand AS name,
       CASE p_size % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'critical' END AS severity FROM $part""",
    "alert_events": """
SELECT CAST(event_id AS STRING) AS id, CAST(user_id % 11 AS STRING) AS application_id,
       CASE WHEN event_id % 97 = 0 THEN 'none' WHEN event_id % 3 <> 0 THEN CAST(event_id % 200 AS STRING) END AS alert_policy_id,
       CASE event_type WHEN 'error' THEN 'firing' WHEN 'view' THEN 'resolved' WHEN 'click' THEN 'suppressed' ELSE 'open' END AS status,
       'info' AS severity, CAST(user_id AS STRING) AS fingerprint, date_trunc('day', ts) AS started_at,
       CASE WHEN event_id % 59 = 0 THEN ts - INTERVAL '2' DAY WHEN event_id % 2 = 0 THEN ts END AS resolved_at FROM $events""",
}

# A chain of references, three tables deep, with claims that block at its end.
DELETE_CHAIN = {
    "buyers": "SELECT CAST(c_custkey AS STRING) AS id FROM $customer",
    "purchases": "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS buyer_id FROM $orders",
    "lines": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_orderkey AS STRING) AS purchase_id,
       l_shipdate FROM $lineitem""",
    "claims": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS line_id FROM $lineitem
WHERE l_returnflag = 'R' AND l_partkey % 97 = 0""",
    "notes": "SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS STRING) END AS purchase_id FROM $events",
}

SUBJECT_EVENTS = f"""
SELECT event_id, ts AS timestamp, event_type, value, concat('app', CAST(user_id % 4 AS STRING)) AS application,
       concat('env', CAST(user_id % 3 AS STRING)) AS environment, concat('c', CAST(event_id % 6 AS STRING)) AS component,
       event_type AS severity, concat('u', CAST(user_id AS STRING)) AS user_id, concat('s', CAST(user_id AS STRING)) AS session_id,
       {ADDRESS} AS client_ip, concat('r', CAST(event_id % 500 AS STRING)) AS request_id FROM $events"""

# Events and investigations for the correlation: one address for all users of an application, so a search by address finds its whole traffic.
_SHARED = "concat('10.0.0.', CAST(user_id % 4 AS STRING))"
CORRELATION_EVENTS = SUBJECT_EVENTS.replace(ADDRESS, _SHARED)
CORRELATION_WINDOWS = METADATA["investigations"].replace(ADDRESS, _SHARED)

CUSTOMER_NEXT = """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       c_mktsegment FROM $customer WHERE c_custkey % 10 <> 0
UNION ALL
SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM $customer WHERE c_custkey % 50 = 0"""

# The customers with a few edits.
CUSTOMER_EDITED = """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 997 = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM $customer WHERE c_custkey % 1009 <> 4
UNION ALL
SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM $customer WHERE c_custkey % 1013 = 5"""

WINDOWS = """
SELECT event_id AS id, ts AS time_start, CASE WHEN event_id % 53 = 0 THEN ts - INTERVAL '1' HOUR ELSE ts + INTERVAL '1' HOUR END AS time_end
FROM $events"""

PROBE_RUNS = """
SELECT concat('col-', CAST(l_suppkey % 10 AS STRING)) AS collector_id, l_shipdate AS started_at,
       l_extendedprice / 100 AS latency_ms, l_returnflag <> 'R' AS ok FROM $lineitem"""

# Suppliers as inventory documents, with faults planted; some have no channels.
DOCUMENTS = """
SELECT s_suppkey AS s, concat('doc-', CAST(s_suppkey AS STRING)) AS document,
       CASE s_suppkey % 7 WHEN 1 THEN '' WHEN 2 THEN 'board/path' WHEN 4 THEN concat('https://board', CAST(s_suppkey AS STRING), '.example.org/x')
            WHEN 5 THEN 'https://board.example.org' WHEN 6 THEN 'http://board:3000' WHEN 0 THEN 'http://board:3000/' END AS grafana_url,
       CASE s_suppkey % 5 WHEN 2 THEN 'http://' WHEN 4 THEN '//logs.example.org' ELSE concat('http://logs', CAST(s_suppkey AS STRING), ':3100') END AS loki_url,
       CASE s_suppkey % 11 WHEN 6 THEN 'mailto:a@example.org' ELSE 'http://alerts:9093' END AS alert_url,
       CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'otel:4317' WHEN 3 THEN 'grpc://otel:4317' END AS otel_url,
       s_suppkey % 19 <> 0 AS has_channels, CASE s_suppkey % 9 WHEN 4 THEN '' WHEN 5 THEN 'pager' ELSE 'mail' END AS channel_id,
       CASE s_suppkey % 13 WHEN 2 THEN '' ELSE 'email' END AS channel_type,
       CASE WHEN s_suppkey % 17 <> 3 THEN concat('ops', CAST(s_suppkey AS STRING)) END AS channel_target,
       CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('secret/c', CAST(s_suppkey AS STRING))
            WHEN 2 THEN concat('x', CAST(s_suppkey AS STRING)) ELSE concat('env/C', CAST(s_suppkey AS STRING)) END AS channel_credential
FROM $supplier"""

_UUID = "concat('00000000-0000-4000-8000-', lpad(CAST({key} AS STRING), 12, '0'))"
# JSON payloads for the contracts, sound ones and one fault of each kind.
PAYLOADS = {
    "alert_evidence": """
SELECT event_id AS id, CASE CAST(event_id % 9 AS INT)
 WHEN 0 THEN concat('{"source_type":"log","title":"t', k, '","url":"https://logs.example.org/', k, '","time_start":"', tz, 'Z","metadata":{"rows":', k, '}}')
 WHEN 1 THEN concat('{"source_type":"log","url":"https://logs.example.org/', k, '"}')
 WHEN 2 THEN concat('{"source_type":"log","title":"t","url":"logs/', k, '"}')
 WHEN 3 THEN concat('{"source_type":', k, ',"title":"t","url":"https://a.example.org","metadata":null}')
 WHEN 4 THEN concat('{"source_type":"log","title":"t","url":"https://a.example.org","time_end":"', tz, '"}')
 WHEN 5 THEN concat('{"source_type":"log","title":"t","url":"https://a.example.org","metadata":[', k, ']}')
 WHEN 6 THEN concat('{"source_type":"log","extra":', k, '}')
 WHEN 7 THEN concat('{"source_type":"log', k, '"') ELSE concat('[', k, ']') END AS value
FROM (SELECT event_id, CAST(event_id % 100 AS STRING) AS k, concat(substr(CAST(ts AS STRING),1,10),'T',substr(CAST(ts AS STRING),12,8)) AS tz FROM $events) e""",
    "session_investigation": """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 8 AS INT)
 WHEN 0 THEN concat('{"application_id":"', app, '","environment_id":"', app, '","user_id":"u","time_start":"', d, 'T00:00:00Z","time_end":"', d, 'T01:00:00.5+02:00"}')
 WHEN 1 THEN concat('{"application_id":"', app, '","time_start":"', d, 'T00:00:00Z"}')
 WHEN 2 THEN concat('{"application_id":"app", "environment_id":"', app, 'f","time_start":"', d, 'T00:00:00Z","time_end":"', d, 'T01:00:00Z"}')
 WHEN 3 THEN concat('{"application_id":"', app, '","time_start":"', d, ' 00:00:00","time_end":"', d, '"}')
 WHEN 4 THEN concat('{"application_id":"', app, '","subject":"u","time_start":"', d, 'T00:00:00Z","time_end":"', d, 'T01:00:00Z"}')
 WHEN 5 THEN concat('{"application_id":"', app, '","user_id":null,"ip":4,"time_start":"', d, 'T00:00:00Z","time_end":"', d, 'T01:00:00Z"}')
 WHEN 6 THEN concat('"', app, '"') ELSE concat('{"application_id":', app, '}') END AS value
FROM (SELECT o_orderkey, """ + _UUID.format(key="o_custkey") + """ AS app, substr(CAST(o_orderdate AS STRING),1,10) AS d FROM $orders) o""",
    "report_payload": """
SELECT o_orderkey AS id, concat('{"application_id":"', app, '",', CASE CAST(o_orderkey % 10 AS INT)
 WHEN 1 THEN concat('"period":{"start":"', d, 'T00:00:00Z"},"sections":[]}')
 WHEN 2 THEN concat('"period":{"start":"', d, '","end":"', d, 'T00:00:00Z"},"sections":[]}')
 WHEN 3 THEN concat(period, '"sections":{"id":"a"}}')
 WHEN 4 THEN concat(period, '"sections":[{"id":"a","title":"A"},{"id":"b"},{"id":"c"}]}')
 WHEN 5 THEN concat(period, '"sections":[{"id":"a","title":"A"},"b"]}')
 WHEN 6 THEN concat(period, '"sections":[{"id":"a","title":"A","rows":1},{"id":2,"title":null}]}')
 WHEN 7 THEN concat('"period":{"start":"', d, 'T00:00:00Z","end":"', d, 'T00:00:00Z","zone":"UTC"},"sections":[],"notes":""}')
 WHEN 8 THEN '"period":"now"}' WHEN 9 THEN concat(period, '"sections":[') ELSE concat(period, '"sections":[{"id":"a","title":"A","data":[{"n":1}]}]}') END) AS value
FROM (SELECT o_orderkey, """ + _UUID.format(key="o_custkey") + """ AS app, substr(CAST(o_orderdate AS STRING),1,10) AS d,
      concat('"period":{"start":"', substr(CAST(o_orderdate AS STRING),1,10), 'T00:00:00Z","end":"2030-01-01T00:00:00Z"},') AS period FROM $orders) o""",
}

LINK_TEMPLATES = {
    "logs": "/explore?orgId=1&left=${query}",
    "target": "/d/overview?var-target=${target}",
}


def for_duckdb(recipe: str) -> str:
    return Template(recipe).safe_substitute(DIALECT["duckdb"]).replace("$", "")
