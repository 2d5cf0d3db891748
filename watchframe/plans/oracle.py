"""The registered queries in plain SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from watchframe.functions.text import WHITE_SPACE
from watchframe.operators.normalize import FIELD_KEYS
from watchframe.plans import recipes
from watchframe.plans.recipes import GRID_END, GRID_START, for_duckdb
from watchframe.schemas import CHECKS, FOREIGN_KEYS, UNIQUE

JOBS = "store-api|edge-proxy|store-worker"
_SPACE = WHITE_SPACE.replace("'", "''")


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


# ---- normalisation

def _first_string(keys: tuple[str, ...]) -> str:
    cases = ", ".join(
        f"CASE WHEN json_type(doc, '$.{k}') = 'VARCHAR' THEN trim(json_extract_string(doc, '$.{k}'), '{_SPACE}') END" for k in keys)
    return f"coalesce({cases}, '')"


_FIELDS = ", ".join(f"{_first_string(keys)} AS f_{name}" for name, keys in FIELD_KEYS.items())
_RFC3339 = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})"
_LABEL_PAIRS = """
SELECT event_id, string_agg(k || '=' || json_extract_string(doc, '$.labels.' || k), ',' ORDER BY k) AS labels
FROM (SELECT event_id, doc, unnest(json_keys(doc, '$.labels')) AS k FROM docs WHERE json_type(doc, '$.labels') = 'OBJECT')
WHERE json_type(doc, '$.labels.' || k) NOT IN ('NULL', 'OBJECT', 'ARRAY') GROUP BY event_id"""

# every number outside of string literals fits a double
_NO_ENDLESS_NUMBER = r"""len(list_filter(regexp_extract_all(regexp_replace(value, '"(?:[^"\\]|\\.)*"', '""', 'g'), '[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?'),
    lambda x: coalesce(isinf(try_cast(x AS DOUBLE)), true))) = 0"""

NORMALIZED = (
    ("raw", for_duckdb(recipes.RAW_EVENTS)),
    ("docs", f"SELECT event_id, ts, value, CASE WHEN json_valid(value) AND {_NO_ENDLESS_NUMBER} THEN CAST(value AS JSON) END AS doc FROM raw"),
    ("label_text", _LABEL_PAIRS),
    ("fields", f"SELECT event_id, ts, doc, {_FIELDS} FROM docs"),
    ("stamped", f"""SELECT *, CASE WHEN f_timestamp = '' THEN epoch_us(ts)
        WHEN regexp_full_match(f_timestamp, '{_RFC3339}') THEN epoch_us(try_cast(f_timestamp AS TIMESTAMPTZ)) END AS timestamp_us FROM fields"""),
    ("checked", """SELECT s.*, coalesce(l.labels, '') AS labels,
        CASE WHEN doc IS NULL OR json_type(doc) NOT IN ('OBJECT', 'NULL') THEN 'parse application event'
             WHEN timestamp_us IS NULL THEN 'timestamp must be RFC3339'
             WHEN f_environment = '' OR f_application = '' OR f_message = '' THEN 'environment, application, and message are required' END AS reject_reason,
        CASE WHEN f_severity = '' THEN 'info' ELSE lower(f_severity) END AS severity
        FROM stamped s LEFT JOIN label_text l USING (event_id)"""),
    ("accepted", """SELECT event_id, ts, timestamp_us, f_environment AS environment, f_application AS application, f_component AS component,
        f_platform AS platform, severity, f_message AS message, f_user_id AS user_id, f_session_id AS session_id,
        f_request_id AS request_id, f_client_ip AS client_ip, labels FROM checked WHERE reject_reason IS NULL"""),
)
# a contract asks for JSON, whatever the size of its numbers
_ANY_JSON = ("docs", "SELECT event_id, ts, value, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS doc FROM raw")
_ACCEPTED = _with(*NORMALIZED)
_ROWS = ("event_id, timestamp_us, environment, application, component, platform, severity, message, user_id, session_id, "
         "request_id, client_ip, labels")

_ENVELOPE = " || ".join(
    [r"""'{"timestamp":"' || strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp_us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(timestamp_us % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z"'"""]
    + [f"""CASE WHEN {c} = '' THEN '' ELSE ',"{c}":"' || {c} || '"' END"""
       for c in ("environment", "application", "component", "platform", "severity", "message", "user_id", "session_id", "request_id", "client_ip")]
    + ["coalesce(',\"labels\":{' || shown || '}', '')", "'}'"])
_LABEL_JSON = """SELECT event_id, string_agg('"' || k || '":"' || json_extract_string(doc, '$.labels.' || k) || '"', ',' ORDER BY k) AS shown
FROM (SELECT event_id, doc, unnest(json_keys(doc, '$.labels')) AS k FROM docs WHERE json_type(doc, '$.labels') = 'OBJECT')
WHERE json_type(doc, '$.labels.' || k) NOT IN ('NULL', 'OBJECT', 'ARRAY') GROUP BY event_id"""

_LOGS = NORMALIZED + (
    ("own", """SELECT event_id, severity, timestamp_us, unnest([{'k': 'environment', 'v': environment}, {'k': 'application', 'v': application},
        {'k': 'component', 'v': component}, {'k': 'platform', 'v': platform}, {'k': 'telemetry.source', 'v': 'collector'}]) AS e FROM accepted"""),
    ("pairs", """SELECT event_id, e.k AS k, e.v AS v FROM own WHERE e.v <> '' UNION ALL
        SELECT event_id, split_part(p, '=', 1), split_part(p, '=', 2) FROM
        (SELECT event_id, unnest(string_split(labels, ',')) AS p FROM accepted WHERE labels <> '')"""),
    ("policy", """SELECT event_id, string_agg(k || '=' || v, ',' ORDER BY k) AS labels, count(*) AS n, max(length(v)) AS longest
        FROM pairs GROUP BY event_id"""),
)


def _payload_sql(name: str, *rules: str) -> str:
    """Rules of a payload that must be an object, spelled out here and not taken from the contracts."""
    return _with(("raw", for_duckdb(recipes.PAYLOADS[name])),
                 ("docs", "SELECT id, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS doc FROM raw")) + f"""
SELECT id, rule FROM (SELECT id, unnest(CASE WHEN doc IS NULL THEN ['parse'] WHEN json_type(doc) <> 'OBJECT' THEN ['type']
    ELSE [{', '.join(rules)}] END) AS rule FROM docs) WHERE rule IS NOT NULL"""


def _needs(*paths: str) -> list[str]:
    return [f"CASE WHEN json_type(doc, '$.{p}') IS NULL THEN 'required:{p}' END" for p in paths]


def _typed(kind: str, *paths: str) -> list[str]:
    return [f"CASE WHEN json_type(doc, '$.{p}') <> '{kind}' THEN 'type:{p}' END" for p in paths]


def _shaped(pattern: str, *paths: str) -> list[str]:
    return [f"CASE WHEN json_type(doc, '$.{p}') = 'VARCHAR' AND NOT regexp_full_match(json_extract_string(doc, '$.{p}'), '{pattern}') THEN 'format:{p}' END"
            for p in paths]


def _closed(place: str, rule: str, *names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"CASE WHEN len(list_filter(json_keys(doc, '{place}'), lambda k: k NOT IN ({listed}))) > 0 THEN '{rule}' END"


def _item(rule: str, test: str) -> str:
    return (f"CASE WHEN json_type(doc, '$.sections') = 'ARRAY' AND len(list_filter(json_extract(doc, '$.sections[*]'), lambda s: {test})) > 0 "
            f"THEN '{rule}:sections[]' END")


def _event_contract() -> str:
    texts = ("timestamp", "environment", "application", "component", "platform", "severity", "message", "user_id", "session_id", "request_id", "client_ip")
    odd = "list_filter(json_keys(doc, '$.labels'), lambda k: json_type(doc, '$.labels.' || k) IN ('NULL', 'OBJECT', 'ARRAY'))"
    rules = [*_needs("timestamp", "environment", "application", "severity", "message"), *_typed("VARCHAR", *texts), *_typed("OBJECT", "labels"),
             *_shaped(_RFC3339, "timestamp"), _closed("$", "additional", *texts, "labels"),
             f"CASE WHEN json_type(doc, '$.labels') = 'OBJECT' AND len({odd}) > 0 THEN 'value_type:labels' END"]
    return _with(NORMALIZED[0], _ANY_JSON) + f"""
SELECT event_id, rule FROM (SELECT event_id, unnest(CASE WHEN doc IS NULL THEN ['parse'] ELSE [{', '.join(rules)}] END) AS rule FROM docs)
WHERE rule IS NOT NULL"""


_UUID = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_ABSOLUTE = "[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+.*"
_OBJECT_ITEM = "json_type(s) = 'OBJECT' AND "
_PAYLOADS = {
    "alert_evidence": _payload_sql(
        "alert_evidence", *_needs("source_type", "title", "url"), *_typed("VARCHAR", "source_type", "title", "url", "time_start", "time_end"),
        *_typed("OBJECT", "metadata"), *_shaped(_RFC3339, "time_start", "time_end"), *_shaped(_ABSOLUTE, "url"),
        _closed("$", "additional", "source_type", "title", "url", "time_start", "time_end", "metadata")),
    "session_investigation": _payload_sql(
        "session_investigation", *_needs("application_id", "time_start", "time_end"),
        *_typed("VARCHAR", "application_id", "environment_id", "user_id", "ip", "session_id", "request_id", "time_start", "time_end"),
        *_shaped(_UUID, "application_id", "environment_id"), *_shaped(_RFC3339, "time_start", "time_end"),
        _closed("$", "additional", "application_id", "environment_id", "user_id", "ip", "session_id", "request_id", "time_start", "time_end")),
    "report_payload": _payload_sql(
        "report_payload", *_needs("application_id", "period", "sections"), *_typed("VARCHAR", "application_id", "period.start", "period.end"),
        *_shaped(_UUID, "application_id"), *_typed("OBJECT", "period"), *_typed("ARRAY", "sections"),
        *[f"CASE WHEN json_type(doc, '$.period') = 'OBJECT' THEN {r} END" for r in _needs("period.start", "period.end")],
        *_shaped(_RFC3339, "period.start", "period.end"), _closed("$", "additional", "application_id", "period", "sections"),
        _closed("$.period", "additional:period", "start", "end"), _item("type", "json_type(s) <> 'OBJECT'"),
        _item("additional", _OBJECT_ITEM + "len(list_filter(json_keys(s), lambda k: k NOT IN ('id', 'title', 'data'))) > 0"),
        *[_item(kind, _OBJECT_ITEM + test.format(n=n)).replace("sections[]' END", f"sections[].{n}' END") for n in ("id", "title")
          for kind, test in (("required", "json_type(s, '$.{n}') IS NULL"), ("type", "json_type(s, '$.{n}') <> 'VARCHAR'"))]),
}


# ---- probes

_SNAPSHOTS = tuple((name, for_duckdb(text)) for name, text in recipes.SNAPSHOTS.items())
_SCOPE_LABELS = "'environment=' || environment || ',target=' || target"
_PROBES = {
    "waits": """SELECT 'sqlserver_wait_time_ms' AS metric, 'environment=' || environment || ',target=' || target || ',wait_type=' || wait_type AS labels,
        0::BIGINT AS ord, wait_time_ms::DOUBLE AS value, environment, target FROM dm_os_wait_stats WHERE wait_time_ms > 0""",
    "blocking": """SELECT 'sqlserver_blocked_requests' AS metric, 'blocking_session_id=' || blocking_session_id || ',environment=' || environment || ',target=' || target AS labels,
        0::BIGINT AS ord, count(*)::DOUBLE AS value, environment, target FROM dm_exec_requests WHERE blocking_session_id <> 0 GROUP BY blocking_session_id, environment, target""",
    "sessions": """SELECT 'sqlserver_sessions' AS metric, 'environment=' || environment || ',status=' || status || ',target=' || target AS labels,
        0::BIGINT AS ord, count(*)::DOUBLE AS value, environment, target FROM dm_exec_sessions GROUP BY status, environment, target""",
    "memory_pressure": """SELECT 'sqlserver_memory_kb' AS metric, 'environment=' || environment || ',metric=total_server_memory_kb,target=' || target AS labels,
        0::BIGINT AS ord, cntr_value::DOUBLE AS value, environment, target FROM dm_os_performance_counters WHERE rtrim(counter_name) = 'Total Server Memory (KB)'""",
    "storage": """SELECT 'sqlserver_database_file_size_mb' AS metric, 'database_name=' || coalesce(name, '<nil>') || ',environment=' || environment || ',target=' || target AS labels,
        file_id AS ord, round(size * 8.0::DOUBLE / 1024, 6) AS value, environment, target FROM master_files LEFT JOIN databases USING (environment, target, database_id)""",
    "throughput": """SELECT 'sqlserver_throughput' AS metric, 'counter_name=' || rtrim(counter_name) || ',environment=' || environment || ',target=' || target AS labels,
        0::BIGINT AS ord, cntr_value::DOUBLE AS value, environment, target FROM dm_os_performance_counters WHERE rtrim(counter_name) IN ('Batch Requests/sec', 'Transactions/sec')""",
}
_FLEET = ("fleet", """SELECT DISTINCT 'env' || (c_custkey % 3) AS environment, 'db' || (c_custkey % 5) AS target FROM customer""")
_OFF = {"waits": "db4", "storage": "db4", "sessions": "db1"}  # switched off on one target


def _cycle(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({_PROBES[n]}) SEMI JOIN fleet USING (environment, target) WHERE target <> '{_OFF.get(n, '')}'" for n in names)


_SCHEDULED = _with(
    *[(n, for_duckdb(recipes.METADATA[n])) for n in ("database_targets", "environments", "probe_assignments", "probe_definitions")],
    ("live", """SELECT id AS target_id, environment_id, name AS target_name, engine, host, port, ifnull(database_name, '') AS database_name, credential_ref
        FROM database_targets WHERE status = 'active' AND engine = 'sqlserver'"""),
    ("duty", "SELECT id AS probe_assignment_id, database_target_id AS target_id, probe_definition_id, interval_seconds FROM probe_assignments WHERE enabled"),
    ("known", "SELECT id AS probe_definition_id, name AS probe_name, category AS probe_category, query_template, timeout_ms FROM probe_definitions WHERE enabled"),
    ("places", "SELECT id AS environment_id, slug AS environment_slug FROM environments"),
) + """SELECT * EXCLUDE (environment_id), 'sql-fleet' AS collector_id,
       CASE WHEN timeout_ms > 0 THEN timeout_ms::BIGINT WHEN interval_seconds > 0 THEN interval_seconds::BIGINT * 1000 ELSE 5000 END AS effective_timeout_ms
FROM duty JOIN known USING (probe_definition_id) JOIN live USING (target_id) JOIN places USING (environment_id)"""

_TARGETS = (
    ("targets", for_duckdb(recipes.TARGETS)),
    ("resolved", """SELECT s, c, 'col-' || c AS id, kind, enabled, c_credential, c_environment, scrape_interval, chosen, name, host, port,
        coalesce(database_name, '') AS database_name,
        CASE WHEN trim(environment) = '' THEN c_environment ELSE trim(environment) END AS environment_slug,
        CASE WHEN credential = '' THEN c_credential ELSE credential END AS credential_ref, own_probes, own_timeout,
        CASE scrape_interval WHEN '' THEN 30 WHEN '1m30s' THEN 90 WHEN '500ms' THEN 0.5 WHEN '45s' THEN 45 WHEN '-5s' THEN -5 END::DOUBLE AS interval_s
        FROM targets"""),
)
_NOT_SECRET = "{c} <> '' AND NOT ({c} LIKE 'kv/%' OR {c} LIKE 'secret/%' OR {c} LIKE 'env/%')"

_CHANNELS = (
    ("docs", for_duckdb(recipes.DOCUMENTS)),
    ("channels", """SELECT document, channel_id AS id, channel_type AS kind, coalesce(channel_target, '') AS target, channel_credential AS credential FROM docs WHERE has_channels
        UNION ALL SELECT document, 'pager', 'webhook', 'duty', 'kv/p' || s FROM docs WHERE has_channels"""),
)


def _url_rules(name: str, column: str, required: bool) -> str:
    missing = f"SELECT document, 'endpoint' AS entity_kind, '' AS entity, 'url_missing:{name}' AS rule FROM docs WHERE coalesce({column}, '') = '' UNION ALL "
    return (missing if required else "") + f"""SELECT document, 'endpoint' AS entity_kind, '' AS entity, 'url_not_absolute:{name}' AS rule FROM docs
        WHERE {column} <> '' AND NOT regexp_full_match({column}, '{_ABSOLUTE}')"""


# ---- time series

_SAMPLES = ("samples", for_duckdb(recipes.SAMPLES))
_SERIES_LABELS = "'environment=' || environment || ',target=' || target || CASE WHEN zone IS NULL THEN '' ELSE ',zone=' || zone END"
_UP = (
    ("up_samples", for_duckdb(recipes.UP_SAMPLES)),
    ("grid", f"SELECT unnest(generate_series({GRID_START}, {GRID_END}, 15))::BIGINT AS step"),
    ("up", """SELECT job, instance, environment, step, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS value FROM up_samples JOIN grid
        ON epoch_us(ts) <= step * 1000000 AND epoch_us(ts) > (step - 300) * 1000000 GROUP BY job, instance, environment, step"""),
)
_ALERTS = _UP + (
    ("down", f"SELECT job, instance, environment, step FROM up WHERE value = 0 AND regexp_full_match(job, '{JOBS}')"),
    ("numbered", "SELECT *, step // 15 - row_number() OVER (PARTITION BY job, instance, environment ORDER BY step) AS run FROM down"),
    ("runs", """SELECT job, instance, environment, min(step) AS active_from, max(step) AS active_to FROM numbered GROUP BY job, instance, environment, run"""),
    ("fired", f"""SELECT 'ServiceDown' AS alertname, 'warning' AS severity, job, instance, environment, active_from + 120 AS started_s,
        CASE WHEN active_to + 15 <= {GRID_END} THEN active_to + 15 ELSE -1 END AS resolved_s,
        CASE WHEN active_to + 15 <= {GRID_END} THEN 'resolved' ELSE 'firing' END AS status FROM runs WHERE active_to - active_from >= 120"""),
)


def _rate(step_s: int) -> tuple[tuple[str, str], ...]:
    return (
        ("counters", for_duckdb(recipes.COUNTER_SAMPLES)),
        ("grid", f"SELECT unnest(generate_series({GRID_START}, {GRID_END}, {step_s}))::BIGINT AS step"),
        ("seen", """SELECT event_type, target, step, epoch_us(ts) AS us, epoch_us(ts)::HUGEINT * 1000000000 + ord AS pos, value,
            lag(value) OVER (PARTITION BY event_type, target, step ORDER BY ts, ord) AS previous
            FROM counters JOIN grid ON epoch_us(ts) <= step * 1000000 AND epoch_us(ts) > (step - 300) * 1000000"""),
        ("windows", """SELECT event_type, target, step, count(*) AS n, min(us) AS us0, max(us) AS us1, arg_min(value, pos) AS v0,
            arg_max(value, pos) - arg_min(value, pos) + sum(CASE WHEN value < previous THEN previous ELSE 0 END) AS increase
            FROM seen GROUP BY event_type, target, step HAVING max(us) > min(us)"""),
        ("spans", """SELECT *, (us1 - us0) / 1e6 AS sampled, (us1 - us0) / 1e6 / (n - 1) AS average, us0 / 1e6 - (step - 300) AS to_start,
            step - us1 / 1e6 AS to_end FROM windows"""),
        ("capped", """SELECT *, CASE WHEN to_start >= 1.1::DOUBLE * average THEN average / 2 ELSE to_start END AS start_gap,
            CASE WHEN to_end >= 1.1::DOUBLE * average THEN average / 2 ELSE to_end END AS end_gap FROM spans"""),
        ("rates", """SELECT event_type, target, step, n, increase, increase * (sampled + end_gap +
            CASE WHEN increase > 0 AND v0 >= 0 THEN least(start_gap, sampled * v0 / increase) ELSE start_gap END) / sampled / 300 AS rate FROM capped"""),
    )


_INVESTIGATIONS = ("investigations", for_duckdb(recipes.METADATA["investigations"]))
_SUBJECT_EVENTS = ("subject_events", for_duckdb(recipes.SUBJECT_EVENTS))
_CORRELATED = (
    ("investigations", for_duckdb(recipes.CORRELATION_WINDOWS)), ("subject_events", for_duckdb(recipes.CORRELATION_EVENTS)),
    ("correlated", """SELECT i.id AS investigation_id, e.event_id, e.timestamp, e.component, e.severity FROM investigations i JOIN subject_events e
        ON e.application = i.application AND e.environment = i.environment
        AND (i.subject_type IS NULL OR i.subject_value = CASE i.subject_type WHEN 'user' THEN e.user_id WHEN 'session' THEN e.session_id
            WHEN 'ip' THEN e.client_ip ELSE e.request_id END) AND e.timestamp BETWEEN i.time_start AND i.time_end"""),
)
_GONE = "SELECT c_custkey FROM customer WHERE c_custkey % 31 = 0"
_DELTAS = _with(_SUBJECT_EVENTS, ("d", """SELECT application, component, now, timestamp FROM
    (SELECT *, timestamp >= TIMESTAMP '2024-01-16' AS now FROM subject_events WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31')"""),
    ("deltas", """SELECT application, component,
    count(*) FILTER (timestamp >= TIMESTAMP '2024-01-16') AS events_current, count(*) FILTER (timestamp < TIMESTAMP '2024-01-16') AS events_previous,
    count(*) FILTER (timestamp >= TIMESTAMP '2024-01-16' AND severity = 'error') AS errors_current,
    count(*) FILTER (timestamp < TIMESTAMP '2024-01-16' AND severity = 'error') AS errors_previous,
    events_current - events_previous AS events_delta, errors_current - errors_previous AS errors_delta
    FROM subject_events WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31' GROUP BY application, component"""))

def _model() -> str:
    return _with(*[(name, for_duckdb(text)) for name, text in recipes.MODEL.items()])


def _audit_sql() -> str:
    parts = []
    for u in UNIQUE:
        if u.table in recipes.MODEL:
            known = " AND ".join(f"{k} IS NOT NULL" for k in u.keys)
            rule = ",".join(u.keys).replace("'", "''")
            parts.append(f"""SELECT '{u.table}' AS "table", 'unique:{rule}' AS rule, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM
                (SELECT count(*) AS n FROM {u.table} WHERE {known} AND {u.where or 'true'} GROUP BY {', '.join(u.keys)} HAVING count(*) > 1)""")
    for k in FOREIGN_KEYS:
        if k.table in recipes.MODEL and k.parent in recipes.MODEL:
            parts.append(f"""SELECT '{k.table}', 'foreign_key:{k.column}->{k.parent}', count(DISTINCT {k.column}), count(*) FROM {k.table} c
                WHERE {k.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.parent} p WHERE p.id = c.{k.column})""")
    for c in CHECKS:
        if c.table in recipes.MODEL:
            expression = c.expression.replace("`", '"')
            parts.append(f"SELECT '{c.table}', '{c.name}', count(*), count(*) FROM {c.table} WHERE NOT ({expression})")
    return _model() + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_keys > 0"


def _delete_sql() -> str:
    words = {"cascade": "removed", "set_null": "cleared", "restrict": "blocked"}
    parts = [
        f"""SELECT '{k.table}' AS "table", '{k.column}' AS "column", '{words[k.on_delete]}' AS effect, {k.column} AS key, count(*) AS n_rows
            FROM {k.table} WHERE {k.column} IN (SELECT id FROM applications WHERE right(id, 1) IN ('1', '3', '5', '7', '9')) GROUP BY {k.column}"""
        for k in FOREIGN_KEYS if k.parent == "applications" and k.table in recipes.MODEL]
    return _model() + " UNION ALL ".join(parts)


_PAYLOAD = _DELTAS + """, worst AS (SELECT application, component, errors_delta, row_number() OVER (PARTITION BY application ORDER BY errors_delta DESC, component) AS rank
        FROM deltas WHERE errors_delta > 0 QUALIFY rank <= 3),
    listed AS (SELECT application, string_agg('{"component":"' || component || '","errors_delta":' || errors_delta || ',"rank":' || rank || '}', ',' ORDER BY rank) AS data FROM worst GROUP BY application),
    health AS (SELECT application, count(*) AS n, count(*) FILTER (severity = 'error') AS bad, round(avg(CASE WHEN severity = 'error' THEN 1::DOUBLE ELSE 0 END), 6) AS ratio FROM subject_events GROUP BY application)
    SELECT application AS application_id, '{"application_id":"' || application || '","period":{"start":"2024-01-01T00:00:00Z","end":"2024-01-31T00:00:00Z"},"sections":['
        || '{"id":"health","title":"Health summary","data":[{"error_ratio":' || ratio || ',"n_errors":' || bad || ',"n_events":' || n || '}]}'
        || coalesce(',{"id":"regressions","title":"Top regressions","data":[' || data || ']}', '') || ']}' AS payload
    FROM health LEFT JOIN listed USING (application)"""

_ROW_JSON = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}'"""
_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4))
_VERSION = f"""WITH h AS (SELECT sha256({_ROW_JSON}) AS h FROM customer), t AS (SELECT count(*) AS n, {_PIECES} FROM h)
    SELECT n, sha256('{{"n":' || n || ',"s0":' || s0 || ',"s1":' || s1 || ',"s2":' || s2 || ',"s3":' || s3 || '}}') AS version FROM t"""

_STREAM_SAME = {"stream_normalize": "normalize_accepted", "stream_rejected": "normalize_rejected", "stream_latest": "series_latest",
                "stream_probe_cycle": "probe_cycle_samples", "sink_evidence": "probe_evidence", "rate5m_bucketed": "rate5m",
                "stream_sessions": "sessions", "stream_observed_counts": "observed_counts", "read_collector_table": "inventory_enabled"}

ORACLE: dict[str, str] = {
    "normalize_accepted": _ACCEPTED + f"SELECT {_ROWS} FROM accepted",
    "normalize_rejected": _ACCEPTED + "SELECT event_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
    "event_counts_by_severity": _ACCEPTED + "SELECT environment, application, severity, count(*) AS n_events FROM accepted GROUP BY ALL",
    "event_counts_per_hour": _ACCEPTED + "SELECT timestamp_us - timestamp_us % 3600000000 AS window_start_us, environment, severity, count(*) AS n_events FROM accepted GROUP BY ALL",
    "labels_scalar_filter": _ACCEPTED + "SELECT event_id, labels FROM accepted WHERE labels <> ''",
    "event_envelope": _with(*NORMALIZED, ("shown", _LABEL_JSON)) + f"SELECT a.event_id, {_ENVELOPE} AS envelope FROM accepted a LEFT JOIN shown s USING (event_id)",
    "alert_deliveries": _with(*NORMALIZED[:2]) + "SELECT count(*) AS n_deliveries FROM docs WHERE json_type(doc) IN ('OBJECT', 'NULL')",
    "contract_violations": _event_contract(),
    **{f"contract_{name}": sql for name, sql in _PAYLOADS.items()},
    "log_label_policy": _with(*_LOGS) + """SELECT a.event_id, 'shop-logs' AS job, a.severity AS level, p.labels,
        CASE WHEN p.n > 7 THEN 'too many label names' WHEN p.longest > 8 AND p.longest IS NOT NULL THEN 'label value too long' ELSE '' END AS reject_reason
        FROM accepted a JOIN policy p USING (event_id)""",
    "too_old_rejects": _ACCEPTED + "SELECT event_id, 'too old' AS reject_reason FROM accepted WHERE make_timestamp(timestamp_us) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR",
    **{f"probe_{n}": _with(*_SNAPSHOTS) + f"SELECT metric, labels, ord, value FROM ({sql})" for n, sql in _PROBES.items()},
    "probe_cycle_samples": _with(*_SNAPSHOTS, _FLEET) + f"SELECT metric, labels, ord, value FROM ({_cycle(tuple(_PROBES))})",
    "probe_evidence": _with(*_SNAPSHOTS, _FLEET) + " UNION ALL ".join(
        f"SELECT environment, target, '{k}' AS kind, '{k} snapshot for ' || target AS title, CAST(count(*) AS VARCHAR) AS n_rows FROM ({_cycle((k,))}) GROUP BY environment, target"
        for k in ("blocking", "sessions")),
    "probe_schedule_override": _with(*_SNAPSHOTS, _FLEET) + f"""SELECT metric, labels, ord, value FROM ({_cycle(tuple(_PROBES))})
        WHERE NOT (metric = 'sqlserver_sessions' AND target IN ('db0', 'db2') AND labels LIKE '%status=building%')""",
    "probe_override": _with(*_SNAPSHOTS) + f"SELECT metric, labels, ord, value FROM ({_PROBES['sessions']}) WHERE labels NOT LIKE '%status=building%'",
    "scheduled_probes": _SCHEDULED,
    "inventory_flatten": _with(*_TARGETS) + """, probes AS (
        SELECT r.*, p.probe_name, p.timeout_ms FROM resolved r, unnest(CASE WHEN own_probes
            THEN [{'probe_name': 'waits', 'timeout_ms': own_timeout}, {'probe_name': 'storage', 'timeout_ms': 0}]
            ELSE [{'probe_name': 'sessions', 'timeout_ms': 0}, {'probe_name': 'blocking', 'timeout_ms': 1500}] END) AS u(p))
        SELECT id AS collector_id, environment_slug, name AS target_name, host, port, database_name, credential_ref, probe_name, timeout_ms,
            coalesce(CAST(floor(interval_s) AS INT), -1) AS interval_seconds,
            CASE WHEN timeout_ms > 0 THEN timeout_ms::BIGINT WHEN floor(interval_s) > 0 THEN CAST(floor(interval_s) AS BIGINT) * 1000 ELSE 5000 END AS effective_timeout_ms
        FROM probes WHERE enabled AND kind = 'sqlserver' AND (chosen IS NULL OR name IN (chosen, 'tgt-ghost'))""",
    "inventory_enabled": _with(*_TARGETS) + """SELECT id, c_environment AS environment, coalesce(interval_s, -1) AS interval_s, count(*) AS n_targets
        FROM resolved WHERE enabled AND kind = 'sqlserver' GROUP BY ALL""",
    "inventory_violations": _with(*_TARGETS, ("cols", "SELECT DISTINCT id, c_credential, interval_s, chosen, c FROM resolved")) + f"""
        SELECT 'collector' AS entity_kind, id AS collector_id, id AS entity, 'credential_not_a_reference' AS rule FROM cols WHERE {_NOT_SECRET.format(c='c_credential')}
        UNION ALL SELECT 'collector', id, id, 'interval_unreadable' FROM cols WHERE interval_s IS NULL
        UNION ALL SELECT 'collector', id, id, 'interval_not_positive' FROM cols WHERE interval_s <= 0
        UNION ALL SELECT 'target', id, name, 'name_missing' FROM resolved WHERE name = ''
        UNION ALL SELECT 'target', id, name, 'host_missing' FROM resolved WHERE host = ''
        UNION ALL SELECT 'target', id, name, 'port_range' FROM resolved WHERE port < 1 OR port > 65535
        UNION ALL SELECT 'target', id, name, 'credential_not_a_reference' FROM resolved WHERE {_NOT_SECRET.format(c='credential_ref')}
        UNION ALL SELECT 'target', id, name, 'timeout_negative' FROM resolved WHERE own_probes AND own_timeout < 0
        UNION ALL SELECT 'target', id, name, 'name_repeated' FROM resolved WHERE name <> '' GROUP BY id, name HAVING count(*) > 1
        UNION ALL SELECT 'target_names', id, n, 'name_unknown' FROM (SELECT id, unnest([chosen, 'tgt-ghost']) AS n FROM cols WHERE chosen IS NOT NULL)
            ANTI JOIN resolved ON resolved.name = n""",
    "redacted_inventory": _with(*_TARGETS) + """SELECT id, CASE WHEN c_credential = '' THEN '' ELSE c_credential || ':<redacted>' END AS collector_ref, name AS target_name,
        CASE WHEN credential_ref = '' THEN '' ELSE credential_ref || ':<redacted>' END AS target_ref FROM resolved""",
    "document_violations": _with(*_CHANNELS) + " UNION ALL ".join([
        _url_rules("grafana", "grafana_url", True), _url_rules("loki", "loki_url", True), _url_rules("alertmanager", "alert_url", True),
        _url_rules("opentelemetry", "otel_url", False),
        "SELECT document, 'channel', id, 'id_missing' FROM channels WHERE id = ''",
        "SELECT document, 'channel', id, 'channel_incomplete' FROM channels WHERE kind = '' OR target = ''",
        f"SELECT document, 'channel', id, 'credential_not_a_reference' FROM channels WHERE {_NOT_SECRET.format(c='credential')}",
        "SELECT document, 'channel', id, 'id_repeated' FROM channels WHERE id <> '' GROUP BY document, id HAVING count(*) > 1"]),
    "redacted_documents": _with(_CHANNELS[0]) + """SELECT document, 'db=<redacted>,mail=<redacted>' AS secrets,
        CASE WHEN has_channels THEN channel_id || '>' || CASE WHEN channel_credential = '' THEN '' ELSE channel_credential || ':<redacted>' END
            || '|pager>kv/p' || s || ':<redacted>' ELSE '' END AS channels, CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS n_boards, 0 AS n_links FROM docs""",
    "series_latest": _with(_SAMPLES) + f"""SELECT metric, {_SERIES_LABELS} AS labels, epoch_us(ts) AS ts_us, value FROM samples
        QUALIFY row_number() OVER (PARTITION BY metric, environment, target, zone ORDER BY ts DESC, ord DESC) = 1""",
    "metric_last_value": _with(_SAMPLES) + """SELECT a.metric, coalesce(l.value, 0) AS value FROM
        (SELECT DISTINCT 'app_' || event_type AS metric FROM events UNION ALL SELECT 'none_' || r_name FROM region) a LEFT JOIN
        (SELECT metric, value FROM samples QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts DESC, ord DESC) = 1) l ON l.metric = a.metric""",
    "label_set_violations": _with(_SAMPLES, ("named", "SELECT *, CASE WHEN zone IS NULL THEN 'environment,target' ELSE 'environment,target,zone' END AS label_names FROM samples"),
        ("expected", "SELECT *, first_value(label_names) OVER (PARTITION BY metric ORDER BY ts, ord) AS expected_names FROM named"))
        + "SELECT metric, expected_names, label_names, count(*) AS n_samples FROM expected WHERE label_names <> expected_names GROUP BY ALL",
    "metric_help": "SELECT DISTINCT 'app_' || event_type AS metric, 'app_' || event_type AS help FROM events",
    "panel_last_value": _with(_SAMPLES) + f"""SELECT metric, epoch_us(ts) AS ts_us, value FROM samples
        WHERE epoch_us(ts) BETWEEN ({GRID_END} - 3600)::BIGINT * 1000000 AND {GRID_END}::BIGINT * 1000000
        QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts DESC, ord DESC) = 1""",
    "up_count": _with(*_UP) + "SELECT step, count(*) AS n_series FROM up GROUP BY step",
    "up_ratio_by_job": _with(*_UP) + "SELECT step, job, round(avg(value), 6) AS value FROM up GROUP BY step, job",
    "gauge_sum_by": _with(_SAMPLES, _UP[1], ("gauges", """SELECT metric, environment, target, coalesce(zone, '') AS zone, step, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + ord) AS value
        FROM samples JOIN grid ON epoch_us(ts) <= step * 1000000 AND epoch_us(ts) > (step - 300) * 1000000 GROUP BY ALL"""))
        + "SELECT step, metric, environment, round(sum(value), 4) AS value FROM gauges GROUP BY step, metric, environment",
    "rate5m_sum_by": _with(*_rate(15)) + "SELECT step, event_type, round(sum(rate), 6) AS value FROM rates GROUP BY step, event_type",
    "rate5m": _with(*_rate(60)) + "SELECT event_type, target, step, n, round(increase, 6) AS increase, round(rate, 6) AS rate FROM rates",
    "alert_firing": _with(*_ALERTS) + """SELECT job, instance, environment, n.step, CASE WHEN n.step - r.active_from >= 120 THEN 'firing' ELSE 'pending' END AS state, r.active_from
        FROM down n JOIN runs r USING (job, instance, environment) WHERE n.step BETWEEN r.active_from AND r.active_to""",
    "alert_events": _with(*_ALERTS) + """SELECT alertname, severity, job, instance, environment, started_s, resolved_s, status,
        'Service ' || job || ' is down' AS summary, environment || '/' || instance AS place FROM fired""",
    "alert_fingerprints": _with(*_ALERTS) + """SELECT job, instance, environment, max(started_s) AS started_s,
        sha256('["ServiceDown"][{"key":"environment","value":"' || environment || '"},{"key":"instance","value":"' || instance || '"},{"key":"job","value":"' || job || '"}]') AS fingerprint
        FROM fired GROUP BY job, instance, environment""",
    "alert_groups": _with(*_ALERTS) + """SELECT alertname, job, environment, count(*) AS n_alerts, count(DISTINCT instance) AS n_fingerprints,
        count(*) FILTER (status = 'firing') AS n_firing, min(started_s) AS first_started_s, max(resolved_s) AS last_resolved_s FROM fired GROUP BY alertname, job, environment""",
    "snapshot_diff": _with(("next", for_duckdb(recipes.CUSTOMER_NEXT))) + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
        CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed'
             WHEN o.c_name = n.c_name AND o.c_nationkey = n.c_nationkey AND o.c_acctbal = n.c_acctbal AND o.c_mktsegment = n.c_mktsegment THEN 'unchanged' ELSE 'updated' END AS change
        FROM customer o FULL JOIN next n ON o.c_custkey = n.c_custkey""",
    "row_version_hash": "SELECT doc_id, sha256(text) AS version FROM documents",
    "audit_unique": "SELECT l_orderkey AS key0, l_linenumber AS key1, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "audit_partial_unique": "SELECT l_orderkey AS key0, l_linenumber AS key1, count(*) AS n_rows FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING count(*) > 1",
    "audit_fk": f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 31 <> 0)",
    "audit_fk_keys": f"SELECT o_custkey AS key, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 31 <> 0) GROUP BY o_custkey",
    "audit_checks": """SELECT o_orderkey AS id, 'enum:o_orderstatus' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT p_partkey, 'range:p_size' FROM part WHERE p_size NOT BETWEEN 1 AND 40""",
    "audit_temporal": _with(("windows", for_duckdb(recipes.WINDOWS))) + "SELECT id, 'temporal' AS rule FROM windows WHERE time_end < time_start",
    "delete_cascade": f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({_GONE})",
    "delete_set_null": f"SELECT o_orderkey, CASE WHEN o_custkey IN ({_GONE}) THEN -1 ELSE o_custkey END AS o_custkey FROM orders",
    "delete_restrict": f"SELECT o_custkey AS id, count(*) AS n_rows FROM orders WHERE o_custkey IN ({_GONE}) GROUP BY o_custkey",
    "sink_samples": _with(_SAMPLES) + "SELECT strftime(ts, '%Y-%m-%d') AS date, metric, count(*) AS n, round(sum(value), 4) AS total FROM samples GROUP BY ALL",
    "sink_logs": _with(*_LOGS) + """SELECT 'shop-logs' AS job, severity AS level, strftime(make_timestamp(timestamp_us), '%Y-%m-%d') AS date, count(*) AS n FROM accepted GROUP BY ALL""",
    "publish_guard": "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer",
    "publish_log": """SELECT true AS accepted, '' AS reason, 3::BIGINT AS n, 1::BIGINT AS n_versions
        UNION ALL SELECT false, (SELECT min('{"key0":' || c_custkey || ',"n_rows":2}') FROM customer WHERE c_custkey % 9 = 0), 1, 1""",
    "investigation_timeline": _with(*_CORRELATED) + """SELECT investigation_id, event_id, epoch_us(timestamp) AS timestamp_us, component, severity FROM correlated""",
    "due_runs": """SELECT 'rs' || s_suppkey AS schedule_id, 'app' || s_nationkey AS application_id, 'queued' AS status, count(*) AS n FROM
        (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 4 <> 0 GROUP BY ALL""",
    "stream_alert_dedup": "SELECT user_id AS fingerprint, epoch_us(date_trunc('day', ts)) AS started_us FROM events GROUP BY ALL",
    "metadata_audit": _audit_sql(),
    "delete_effects": _delete_sql(),
    "table_version": _VERSION,
    "report_payload": _PAYLOAD,
    "investigation_overlap": _with(_INVESTIGATIONS, ("requests", for_duckdb(recipes.METADATA["requests"])), ("slugs", for_duckdb(recipes.METADATA["slugs"]))) + """
        SELECT r.request_id, i.id AS investigation_id, r.environment_slug, r.subject_type, r.subject_value FROM requests r
        JOIN investigations i ON i.environment_id = (SELECT id FROM slugs WHERE slug = r.environment_slug) AND i.subject_type = r.subject_type
        AND i.subject_value = r.subject_value AND i.time_start <= r.hi AND i.time_end >= r.lo""",
    "subject_correlation": _with(*_CORRELATED) + "SELECT investigation_id, event_id FROM correlated",
    "latest_n_per_env": _with(_INVESTIGATIONS) + """SELECT environment_id, id, epoch_us(created_at) AS created_at_us FROM investigations
        QUALIFY row_number() OVER (PARTITION BY environment_id ORDER BY created_at DESC, id) <= 5""",
    "failed_runs_per_app": _with(("runs", for_duckdb(recipes.METADATA["report_runs"]))) + """SELECT application_id, id, epoch_us(created_at) AS created_at_us FROM runs WHERE status = 'failed'
        QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id) <= 3""",
    "application_links": """SELECT o_orderkey AS request_id, s_suppkey AS application_id, s_nationkey AS environment_id, c_custkey AS user_id
        FROM orders JOIN supplier ON s_suppkey = o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = s_nationkey""",
    "deep_links": """SELECT event_id, CASE WHEN event_id % 2 = 0
        THEN '/explore?orgId=1&left=' || replace(url_encode('{app="shop", user="' || user_id || '"} |= `' || event_type || ' & more`'), '+', '%20')
        ELSE '/d/overview?var-target=' || replace(url_encode('db ' || (user_id % 5) || '/é'), '+', '%20') END AS url FROM events""",
    "baseline_mad": """WITH m AS (SELECT event_type, count(*) AS n, median(value) AS median, mad(value) AS mad FROM events GROUP BY event_type)
        SELECT event_type, n, round(median, 6) AS median, round(mad, 6) AS mad, round(median - mad * 3 * 1.4826::DOUBLE, 6) AS lower, round(median + mad * 3 * 1.4826::DOUBLE, 6) AS upper FROM m""",
    "baseline_quantile": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS lower, round(quantile_cont(value, 0.95), 6) AS upper FROM events GROUP BY event_type",
    "baseline_ewma": """WITH RECURSIVE means AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS bucket, avg(value) AS mean FROM events GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS i FROM means),
        fold AS (SELECT event_type, i, mean AS s FROM ranked WHERE i = 1
            UNION ALL SELECT f.event_type, r.i, f.s * 0.7::DOUBLE + r.mean * 0.3::DOUBLE FROM fold f JOIN ranked r ON r.event_type = f.event_type AND r.i = f.i + 1)
        SELECT r.event_type, r.bucket, round(r.mean, 6) AS mean, round(f.s, 6) AS ewma, round(r.mean - f.s, 6) AS deviation
        FROM ranked r JOIN fold f USING (event_type, i)""",
    "special_quantiles": _with(("v", for_duckdb(recipes.SPECIAL_VALUES)), ("o", "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM v")) + """
        SELECT event_type, n, CASE WHEN isnan(min(value) FILTER (pos = 0)) THEN 'NaN' ELSE '-Infinity' END AS low,
            round(min(value) FILTER (pos = floor(0.5 * (n - 1))) * (1 - (0.5::DOUBLE * (n - 1) - floor(0.5 * (n - 1)))) + min(value) FILTER (pos = ceil(0.5 * (n - 1))) * (0.5::DOUBLE * (n - 1) - floor(0.5 * (n - 1))), 6) AS middle,
            CASE WHEN isinf(min(value) FILTER (pos = floor(0.9 * (n - 1)))) THEN 'Infinity' END AS high,
            CASE WHEN isnan(min(value) FILTER (pos = n - 1)) THEN 'NaN' ELSE 'Infinity' END AS top FROM o GROUP BY event_type, n""",
    "null_key_breaches": """WITH e AS (SELECT *, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events),
        band AS (SELECT kind, quantile_cont(value, 0.95) AS upper FROM e GROUP BY kind)
        SELECT event_id, coalesce(e.kind, '') AS kind, CASE WHEN value > 200 THEN 'static' ELSE 'adaptive' END AS cause
        FROM e JOIN band ON e.kind IS NOT DISTINCT FROM band.kind WHERE value > 200 OR value > upper""",
    "newest_alerts": _with(("a", for_duckdb(recipes.MODEL["alert_events"]))) + """SELECT application_id, fingerprint, id, epoch_us(started_at) AS started_at_us FROM a
        QUALIFY row_number() OVER (PARTITION BY application_id, fingerprint ORDER BY started_at DESC, id) = 1""",
    "scheduled_probes_of_targets": "SELECT * EXCLUDE (effective_timeout_ms) FROM (" + _SCHEDULED + """) WHERE environment_slug = 'nation_3'
        AND target_name = (SELECT min(s_name) FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0)""",
    "snapshot_diff_live": _with(("next", f"SELECT * FROM ({for_duckdb(recipes.CUSTOMER_NEXT)}) WHERE c_custkey % 4 <> 0"), ("past", "SELECT * FROM customer WHERE c_custkey % 6 <> 0")) + """
        SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed'
             WHEN o.c_name = n.c_name AND o.c_nationkey = n.c_nationkey AND o.c_acctbal = n.c_acctbal AND o.c_mktsegment = n.c_mktsegment THEN 'unchanged' ELSE 'updated' END AS change
        FROM past o FULL JOIN next n ON o.c_custkey = n.c_custkey""",
    "read_raw_events": _with(NORMALIZED[0]) + "SELECT value, count(*) AS n FROM raw GROUP BY value",
    "sink_report": _with(_SUBJECT_EVENTS, ("h", "SELECT application, count(*) AS n_events, count(*) FILTER (severity = 'error') AS n_errors FROM subject_events GROUP BY application"))
        + "SELECT * FROM h UNION ALL SELECT * FROM h",
    "read_snapshot_tables": _with(*_SNAPSHOTS) + f"SELECT metric, labels, ord, value FROM ({_PROBES['blocking']})",
    "baseline_seasonal": """SELECT event_type, isodow(ts)::BIGINT AS dow, hour(ts)::BIGINT AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation
        FROM events GROUP BY ALL""",
    "anomalies": """WITH band AS (SELECT event_type, quantile_cont(value, 0.95) AS upper FROM events GROUP BY event_type)
        SELECT event_id, event_type, CASE WHEN value > 200 THEN 'static' ELSE 'adaptive' END AS cause FROM events JOIN band USING (event_type) WHERE value > 200 OR value > upper""",
    "alert_cooldown": _with(*_ALERTS) + """SELECT job, started_s, 1::BIGINT AS n FROM (SELECT job, started_s, lag(started_s) OVER (PARTITION BY job ORDER BY started_s) AS previous FROM fired)
        WHERE previous IS NULL OR started_s - previous >= 1800""",
    "correlated_alerts": _with(*_ALERTS) + """SELECT a.environment, a.started_s AS at_s, count(DISTINCT b.job) AS n_signals, count(*) AS n_alerts
        FROM (SELECT DISTINCT environment, started_s FROM fired) a JOIN fired b ON b.environment = a.environment
        AND b.started_s > a.started_s - 900 AND b.started_s <= a.started_s GROUP BY ALL HAVING count(DISTINCT b.job) >= 2""",
    "wait_rate_by_target": _with(*_rate(15)) + """SELECT step, 'env' || (target % 3) AS environment, target, event_type AS wait_type, round(sum(rate), 6) AS value
        FROM rates GROUP BY step, target, event_type""",
    "event_rate_by_severity": _with(*_rate(15)) + """SELECT step, 'env' || (target % 3) AS environment, 'app' || (target % 2) AS application, event_type AS severity,
        round(sum(rate), 6) AS value FROM rates GROUP BY ALL""",
    "baseline_stored": f"""SELECT 'shop' AS application_id, event_type AS signal_key, '30d' AS window, 'quantile' AS method, count(*) AS n,
        round(quantile_cont(value, 0.05), 6) AS lower, round(quantile_cont(value, 0.95), 6) AS upper, {GRID_END}000000::BIGINT AS last_computed_at_us FROM events GROUP BY event_type""",
    "read_metadata_tables": _model() + """SELECT 'users' AS table, coalesce(status, '') AS status, count(*) AS n, count(DISTINCT email) AS n_names FROM users GROUP BY ALL
        UNION ALL SELECT 'applications', status, count(*), count(DISTINCT name) FROM applications GROUP BY ALL""",
    "binary_labels": "SELECT c_custkey, c_name, c_mktsegment || ' é' AS segment FROM customer",
    "absolute_urls": """SELECT page_id, page_id % 5 NOT IN (0, 1, 2) AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS absolute FROM pages""",
    "correlated_events": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events)
        SELECT a.user_id, a.s AS at_s, count(DISTINCT b.event_type) AS n_signals, count(*) AS n_alerts
        FROM (SELECT DISTINCT user_id, s FROM e) a JOIN e b ON b.user_id = a.user_id AND b.s > a.s - 3600 AND b.s <= a.s
        GROUP BY ALL HAVING count(DISTINCT b.event_type) >= 3""",
    "rolling_mad": """WITH e AS (SELECT event_type, epoch_us(ts) // 86400000000 AS d, value FROM events),
        w AS (SELECT k.event_type, k.d * 86400 AS bucket, count(*) AS n, median(value) AS median, mad(value) AS mad
            FROM (SELECT DISTINCT event_type, d FROM e) k JOIN e ON e.event_type = k.event_type AND e.d BETWEEN k.d - 6 AND k.d GROUP BY ALL)
        SELECT event_type, bucket, n, round(median, 6) AS median, round(mad, 6) AS mad, round(median - mad * (3.0::DOUBLE * 1.4826::DOUBLE), 6) AS lower,
            round(median + mad * (3.0::DOUBLE * 1.4826::DOUBLE), 6) AS upper FROM w""",
    "snapshot_diff_tree": _with(("next", for_duckdb(recipes.CUSTOMER_EDITED))) + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
        CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'updated' END AS change
        FROM customer o FULL JOIN next n ON o.c_custkey = n.c_custkey
        WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal IS DISTINCT FROM n.c_acctbal""",
    "observed_counts": _ACCEPTED + """, k AS (SELECT unnest(['click', 'error', 'view', 'other']) AS severity),
        n AS (SELECT CASE WHEN severity IN ('click', 'error', 'view') THEN severity ELSE 'other' END AS severity, count(*) AS n FROM accepted GROUP BY 1)
        SELECT severity, coalesce(n, 0) AS n_events FROM k LEFT JOIN n USING (severity)""",
    "sketch_bands": """WITH e AS (SELECT event_type, epoch_us(ts) // 86400000000 AS d FROM events)
        SELECT k.event_type, k.d * 86400 AS bucket, count(*) AS n, true AS near
        FROM (SELECT DISTINCT event_type, d FROM e) k JOIN e ON e.event_type = k.event_type AND e.d BETWEEN k.d - 6 AND k.d GROUP BY ALL""",
    "delete_plan": _with(*[(name, for_duckdb(text)) for name, text in recipes.DELETE_CHAIN.items()],
        ("gone", "SELECT DISTINCT id AS key FROM buyers WHERE right(id, 1) IN ('1', '3', '6')"),
        ("p", "SELECT DISTINCT key, purchases.id FROM gone JOIN purchases ON buyer_id = key"),
        ("l", "SELECT DISTINCT key, lines.id FROM p JOIN lines ON purchase_id = p.id"),
        ("b", "SELECT key, count(*) AS n FROM l JOIN claims ON line_id = l.id GROUP BY key")) + """
        SELECT key, 'claims' AS "table", 'line_id' AS "column", 'blocked' AS effect, n AS n_rows FROM b
        UNION ALL SELECT key, 'purchases', 'buyer_id', 'removed', count(*) FROM gone JOIN purchases ON buyer_id = key WHERE key NOT IN (SELECT key FROM b) GROUP BY key
        UNION ALL SELECT key, 'lines', 'purchase_id', 'removed', count(*) FROM p JOIN lines ON purchase_id = p.id WHERE key NOT IN (SELECT key FROM b) GROUP BY key
        UNION ALL SELECT key, 'notes', 'purchase_id', 'cleared', count(*) FROM p JOIN notes ON purchase_id = p.id WHERE key NOT IN (SELECT key FROM b) GROUP BY key""",
    "sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events),
        s AS (SELECT *, sum(CASE WHEN us - previous <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS session FROM e)
        SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, session""",
    "investigation_summary": _with(*_CORRELATED) + """SELECT investigation_id, component, severity, count(*) AS n_events, epoch_us(min(timestamp)) AS first_seen_us, epoch_us(max(timestamp)) AS last_seen_us
        FROM correlated GROUP BY investigation_id, component, severity""",
    "investigation_severity": _with(*_CORRELATED) + """SELECT investigation_id, count(*) AS n_events, round(avg(CASE WHEN severity = 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_share,
        CASE WHEN avg(CASE WHEN severity = 'error' THEN 1.0::DOUBLE ELSE 0 END) >= 0.6::DOUBLE THEN 'critical' WHEN avg(CASE WHEN severity = 'error' THEN 1.0::DOUBLE ELSE 0 END) >= 0.3::DOUBLE THEN 'warning' ELSE 'info' END AS severity
        FROM correlated GROUP BY investigation_id""",
    "anomaly_windows": """WITH b AS (SELECT 'app' || (user_id % 4) AS application, epoch_us(ts) // 3600000000 AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2),
        r AS (SELECT *, bucket - row_number() OVER (PARTITION BY application ORDER BY bucket) AS run FROM b)
        SELECT application, min(bucket) * 3600 AS window_start_s, (max(bucket) + 1) * 3600 AS window_end_s, sum(n)::BIGINT AS n_errors FROM r GROUP BY application, run""",
    "error_fingerprint": r"""SELECT source, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text),
        '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '0x[0-9a-f]+', '<hex>', 'g'), '[0-9]+', '<n>', 'g')) AS fingerprint, count(*) AS n
        FROM documents GROUP BY ALL""",
    "latency_quantiles": """WITH d AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events)
        SELECT event_type, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM d WHERE v >= 0 GROUP BY event_type""",
    "period_delta": _DELTAS + "SELECT * FROM deltas",
    "top_regressions": _DELTAS + """SELECT application, component, errors_delta, row_number() OVER (PARTITION BY application ORDER BY errors_delta DESC, component) AS rank
        FROM deltas WHERE errors_delta > 0 QUALIFY rank <= 3""",
    "wait_hotspots": _with(*_SNAPSHOTS) + """SELECT environment, target, wait_type, wait_time_ms::DOUBLE AS value, row_number() OVER (PARTITION BY environment ORDER BY wait_time_ms DESC, target, wait_type) AS rank
        FROM dm_os_wait_stats WHERE wait_time_ms > 0 QUALIFY rank <= 2""",
    "alert_noise": _with(*_ALERTS) + """SELECT job, environment, count(*) AS n_fired, coalesce(sum(CASE WHEN resolved_s > 0 THEN resolved_s - started_s END), 0)::BIGINT AS firing_s FROM fired GROUP BY job, environment""",
    "slo_delta": _with(*_UP) + "SELECT job, round(avg(value), 6) AS ratio, count(*) AS n_steps, round(avg(value) - 0.95::DOUBLE, 6) AS delta FROM up GROUP BY job",
    "collector_health": """SELECT 'col-' || (l_suppkey % 10) AS collector_id, count(*) AS n_runs, count(*) FILTER (l_returnflag = 'R') AS n_failed,
        (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(l_shipdate))) // 1000000 AS age_s,
        round(quantile_cont(l_extendedprice / 100, 0.5), 6) AS p50_ms, round(quantile_cont(l_extendedprice / 100, 0.95), 6) AS p95_ms FROM lineitem GROUP BY l_suppkey % 10""",
    "stream_counts": _ACCEPTED + """SELECT timestamp_us - timestamp_us % 3600000000 AS window_start_us, environment, severity, count(*) AS n_events FROM accepted
        WHERE make_timestamp(timestamp_us) >= ts - INTERVAL 168 HOUR GROUP BY ALL""",
    "stream_alert_hold": _with(*_ALERTS) + """SELECT job, instance, environment, 'firing' AS kind, started_s, started_s AS at_s FROM fired
        UNION ALL SELECT job, instance, environment, 'resolved', started_s, resolved_s FROM fired WHERE resolved_s > 0""",
}
ORACLE.update({twin: ORACLE[name] for twin, name in _STREAM_SAME.items()})
