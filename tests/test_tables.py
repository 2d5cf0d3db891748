from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchframe.operators import audit, correlate, investigate, metadata, normalize, probes, reports, spans as spans_of
from watchframe.schemas import CHECKS, FOREIGN_KEYS, METADATA_TABLES, UNIQUE, Check, ForeignKey, Unique
from watchframe.sources import sinks
from watchframe.sources.snapshots import read_metadata

NOW = datetime(2024, 1, 1)
H = timedelta(hours=1)

# One sound row per table; missing columns are NULL.
SOUND = {
    "users": {"id": "u", "email": "alice@example.com", "status": "active"},
    "roles": {"id": "r", "name": "admin"},
    "user_roles": {"user_id": "u", "role_id": "r"},
    "environments": {"id": "e", "slug": "prod", "type": "production", "status": "active"},
    "applications": {"id": "a", "environment_id": "e", "name": "crm", "criticality": "high", "status": "active"},
    "application_components": {"id": "c", "application_id": "a", "name": "n", "component_type": "t"},
    "telemetry_sources": {"id": "ts", "application_id": "a", "ingest_mode": "otlp", "status": "active"},
    "normalization_rules": {"id": "nr", "source_type": "s", "version": "1"},
    "database_targets": {"id": "t", "environment_id": "e", "engine": "sqlserver", "host": "h", "port": 1433, "status": "active"},
    "probe_definitions": {"id": "pd", "engine": "sqlserver", "name": "waits", "version": "1", "default_interval_seconds": 30, "timeout_ms": 5},
    "probe_assignments": {"id": "pa", "database_target_id": "t", "probe_definition_id": "pd", "interval_seconds": 30},
    "investigations": {"id": "i", "application_id": "a", "environment_id": "e", "created_by": "u", "status": "queued",
                       "subject_type": "user", "subject_value": "v", "time_start": NOW, "time_end": NOW},
    "investigation_jobs": {"id": "j", "investigation_id": "i", "status": "queued"},
    "investigation_results": {"id": "ir", "investigation_id": "i", "severity": "info"},
    "evidence_links": {"id": "el", "investigation_id": "i"},
    "alert_policies": {"id": "ap", "application_id": "a", "name": "n", "severity": "warning"},
    "adaptive_baselines": {"id": "ab", "application_id": "a", "signal_key": "s", "window": "7d", "method": "mad"},
    "notification_routes": {"id": "nt", "application_id": "a", "name": "n"},
    "alert_events": {"id": "ae", "application_id": "a", "alert_policy_id": "ap", "status": "firing", "severity": "info",
                     "fingerprint": "f", "started_at": NOW},
    "report_templates": {"id": "rt", "name": "n"},
    "report_schedules": {"id": "rs", "application_id": "a", "report_template_id": "rt", "cron_expression": "* * * * *", "timezone": "UTC"},
    "report_runs": {"id": "rr", "application_id": "a", "report_schedule_id": "rs", "requested_by": "u", "status": "completed",
                    "time_start": NOW, "time_end": NOW + H, "started_at": NOW, "finished_at": NOW + H},
}


def tables(spark, extra=()):
    rows = {name: [row] for name, row in SOUND.items()}
    for name, changes in extra:
        rows[name] = rows[name] + [{**SOUND[name], **changes}]
    out = {}
    for name, ddl in METADATA_TABLES.items():
        columns = [c.strip().split(" ")[0] for c in ddl.split(",")]
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows[name]], ddl)
    return out


def found(spark, names, extra=()):
    """Broken rules, looking only at the named tables."""
    picked = {n: t for n, t in tables(spark, extra).items() if n in names}
    return sorted((r.table, r.rule, r.n_rows) for r in audit.audit_tables(picked).collect())


def test_the_model_is_whole():
    assert len(METADATA_TABLES) == 22 and len(FOREIGN_KEYS) == 25
    assert sorted(SOUND) == sorted(METADATA_TABLES)
    assert len([c for c in CHECKS if c.name.startswith("enum")]) == 16
    assert len([c for c in CHECKS if c.name.startswith("range")]) == 4
    assert len([c for c in CHECKS if c.name.startswith("temporal")]) == 4
    assert len([u for u in UNIQUE if u.keys != ("id",)]) == 17
    for c in (*UNIQUE, *FOREIGN_KEYS, *CHECKS):
        assert c.table in METADATA_TABLES


def test_sound_tables_pass(spark):
    assert audit.audit_tables(tables(spark)).isEmpty()


def test_unique_rules(spark):
    extra = [("users", {"id": "u2"}), ("database_targets", {"id": "t2", "database_name": ""}),
             ("investigation_jobs", {"id": "j2"}), ("investigation_jobs", {"id": "j3", "status": "running"}),
             ("investigation_jobs", {"id": "j4", "status": "failed"}), ("investigation_jobs", {"id": "j5", "status": "failed"})]
    assert found(spark, {"users", "database_targets", "investigation_jobs"}, extra) == [
        ("database_targets", "unique:environment_id,engine,host,port,coalesce(database_name, '')", 2),
        ("investigation_jobs", "unique:investigation_id,status", 2), ("users", "unique:email", 2)]


def test_reference_and_row_rules(spark):
    extra = [("investigations", {"id": "i2", "application_id": "gone", "status": "lost", "subject_type": None, "time_end": NOW - H}),
             ("alert_events", {"id": "ae2", "alert_policy_id": None, "fingerprint": "g", "resolved_at": NOW - H}),
             ("probe_assignments", {"id": "pa2", "database_target_id": "t9", "interval_seconds": 0}),
             ("database_targets", {"id": "t2", "host": "h2", "port": 65536}),
             ("report_runs", {"id": "rr2", "started_at": NOW + 2 * H, "time_start": NOW + 2 * H})]
    names = {"applications", "investigations", "alert_events", "alert_policies", "probe_assignments", "database_targets", "report_runs"}
    assert found(spark, names, extra) == [
        ("alert_events", "temporal:started_at<=resolved_at", 1), ("database_targets", "range:port", 1),
        ("investigations", "enum:status", 1), ("investigations", "foreign_key:application_id->applications", 1),
        ("investigations", "temporal:time_start<=time_end", 1), ("probe_assignments", "foreign_key:database_target_id->database_targets", 1),
        ("probe_assignments", "range:interval_seconds", 1), ("report_runs", "temporal:started_at<=finished_at", 1),
        ("report_runs", "temporal:time_start<=time_end", 1)]


def test_delete_effects(spark):
    t = tables(spark)
    gone = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.table, r.effect) for r in audit.delete_effects(t, "applications", gone).collect())
    assert ("adaptive_baselines", "removed") in got and ("investigations", "blocked") in got and len(got) == 9
    users = spark.createDataFrame([("u",)], "id string")
    assert ("report_runs", "cleared") in [(r.table, r.effect) for r in audit.delete_effects(t, "users", users).collect()]
    assert audit.set_null(t["report_runs"], users, "requested_by").first().requested_by is None
    assert audit.cascade_kept(t["adaptive_baselines"], gone, "application_id").isEmpty()


def test_nulls_pass_checks_and_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "k string, v int")
    assert audit.duplicate_keys(df, Unique("x", ("k", "v"))).isEmpty()
    assert audit.broken_checks(df, [Check("x", "c", "k IN ('a')")]).isEmpty()


def test_scheduled_probes(spark, tmp_path):
    extra = [("probe_definitions", {"id": "pd2", "name": "blocking"}), ("probe_assignments", {"id": "pa2", "probe_definition_id": "pd2"}),
             ("database_targets", {"id": "t2", "name": "off", "status": "disabled"}), ("probe_assignments", {"id": "pa3", "database_target_id": "t2"})]
    for name, df in tables(spark, extra).items():
        if "enabled" in df.columns:
            df = df.withColumn("enabled", F.lit(True))
        df.write.parquet(f"{tmp_path}/{name}")
    t = read_metadata(spark, str(tmp_path), ("database_targets", "environments", "probe_assignments", "probe_definitions"))
    args = (t["database_targets"], t["environments"], t["probe_assignments"], t["probe_definitions"], "sqlserver", "any")
    assert sorted((r.probe_name, r.environment_slug, r.database_name) for r in metadata.scheduled_probes(*args).collect()) == [
        ("blocking", "prod", ""), ("waits", "prod", "")]
    assert metadata.scheduled_probes(*args, environment_slug="test").isEmpty()
    assert metadata.scheduled_probes(*args, target_names=["other"]).isEmpty()


def test_investigation_lookup_and_links(spark):
    t = tables(spark)
    requests = spark.createDataFrame(
        [("in", "prod", "user", "v", NOW - 50 * H, NOW), ("out", "prod", "user", "v", NOW + H, NOW + 9 * H), ("env", "test", "user", "v", NOW, NOW)],
        "request_id string, environment_slug string, subject_type string, subject_value string, lo timestamp, hi timestamp")
    long = t["investigations"].withColumn("time_start", F.lit(NOW - 100 * H)).withColumn("id", F.lit("long"))
    found = correlate.overlapping_investigations(requests, t["investigations"].unionByName(long), t["environments"])
    assert sorted((r.request_id, r.investigation_id) for r in found.collect()) == [("in", "i"), ("in", "long")]
    asked = spark.createDataFrame([("crm", "prod", "alice@example.com"), ("crm", "prod", "bob@example.com")],
                                  "application_name string, environment_slug string, user_email string")
    linked = metadata.link_applications(t["applications"], t["environments"], t["users"], asked).collect()
    assert [(r.application_id, r.environment_id, r.user_id) for r in linked] == [("a", "e", "u")]


def test_correlation_honours_every_given_subject(spark):
    ddl = "event_id int, application string, environment string, timestamp timestamp, user_id string, client_ip string, session_id string, request_id string"
    events = spark.createDataFrame([
        (1, "a", "p", NOW, "u", "9", "s", None), (2, "a", "p", NOW + 5 * H, "u", "9", "s", None), (3, "a", "q", NOW, "u", "8", "s", None),
        (4, "a", "p", NOW, None, None, None, "r"), (5, "b", "p", NOW, "u", "9", "s", None)], ddl)
    windows = spark.createDataFrame([
        ("user", "a", None, "u", None, None, None, NOW - 3 * H, NOW + 3 * H), ("both", "a", "p", "u", "9", None, None, NOW, NOW + 9 * H),
        ("req", "a", "p", None, None, None, "r", NOW, NOW), ("all", "a", None, None, None, None, None, NOW - H, NOW + H)],
        "investigation_id string, application string, environment string, user string, ip string, session string, request string, time_start timestamp, time_end timestamp")
    got = correlate.correlate_subjects(events, windows, ["event_id"]).collect()
    assert sorted((r.investigation_id, r.event_id) for r in got) == [
        ("all", 1), ("all", 3), ("all", 4), ("both", 1), ("both", 2), ("req", 4), ("user", 1), ("user", 3)]


def test_newest_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") >= 0, "hot"))
    top = metadata.newest_per_key(df, ["k"], ["id"], 2)
    assert sorted(r.id for r in top.collect()) == [998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame([("m", "", NOW, 1, 1.0, {"a": "b"}), ("n", "", NOW, 1, 2.0, {})],
                                    "metric string, help string, ts timestamp, ord bigint, value double, labels map<string,string>")
    for _ in range(2):
        sinks.append_samples(samples, f"{tmp_path}/samples")
    stored = spark.read.parquet(f"{tmp_path}/samples")
    assert stored.count() == 4 and stored.filter("metric = 'm' and date = '2024-01-01'").count() == 2
    logs = spark.createDataFrame([("j", "info", NOW, "b")], "job string, level string, ts timestamp, body string")
    sinks.append_logs(logs, f"{tmp_path}/logs")
    assert spark.read.parquet(f"{tmp_path}/logs").first().level == "info"
    proofs = probes.evidence(spark.createDataFrame([("e", "t", NOW, "x")], "environment string, target string, ts timestamp, status string"),
                             probes.default_catalog()["sessions"])
    sinks.append_evidence(proofs, f"{tmp_path}/evidence")
    assert spark.read.parquet(f"{tmp_path}/evidence").first().metadata == {"rows": "1"}
    raw = spark.createDataFrame([('{"env":"e","app":"a","msg":"m"}', NOW)], "value string, ingest_ts timestamp")
    sinks.write_envelopes(normalize.accepted(normalize.normalize(raw)), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().environment == "e"
    report = spark.createDataFrame([("a", 1)], "name string, n int")
    for kind in ("csv", "json"):
        sinks.write_report(report, f"{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().n == "1"
    assert spark.read.json(f"{tmp_path}/json").first().n == 1


def test_due_runs(spark):
    schedules = tables(spark)["report_schedules"].withColumn("enabled", F.lit(True))
    due = spark.createDataFrame([("rs", NOW, NOW + H), ("rs", NOW, NOW + H), ("x", NOW, NOW)], "schedule_id string, time_start timestamp, time_end timestamp")
    assert [(r.schedule_id, r.status) for r in reports.due_runs(schedules, due).collect()] == [("rs", "queued")]


@pytest.mark.parametrize("keys,want", [([], [("b", 3.0)]), (["g"], [("a", 2.0), ("b", 3.0)])])
def test_top_n(spark, keys, want):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    assert sorted((r.g, r.v) for r in reports.top_n(df, keys, "v", ["g"], 1).collect()) == want


def test_an_audit_reads_each_table_once(spark, tmp_path):
    """Against the rules one by one, with keys that repeat, point nowhere or are NULL."""
    orders = spark.range(2000).selectExpr("CAST(id % 1900 AS STRING) AS id", "IF(id % 7 = 0, NULL, id % 90) AS buyer_id", "id % 4 AS kind")
    buyers = spark.range(80).selectExpr("CAST(id AS DECIMAL(9,1)) AS id", "IF(id % 40 = 0, NULL, CAST(id % 30 AS STRING)) AS name")
    for name, df in (("orders", orders), ("buyers", buyers)):
        df.write.parquet(f"{tmp_path}/{name}")
    t = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("orders", "buyers")}
    unique = [Unique("orders", ("id",)), Unique("orders", ("id", "kind"), "kind < 2"), Unique("buyers", ("id",)), Unique("buyers", ("name",))]
    keys, checks = [ForeignKey("orders", "buyer_id", "buyers", "restrict")], [Check("orders", "enum:kind", "kind IN (0, 1, 2)")]
    got = audit.audit_tables(t, unique, keys, checks)
    want = {}
    for u in unique:
        want[u.table, f"unique:{','.join(u.keys)}"] = [r.n_rows for r in audit.duplicate_keys(t[u.table], u).collect()]
    want["orders", "foreign_key:buyer_id->buyers"] = [r.n_rows for r in audit.orphan_keys(t["orders"], t["buyers"], "buyer_id").collect()]
    want["orders", "enum:kind"] = [1] * audit.broken_checks(t["orders"], checks).count()
    assert {(r.table, r.rule): (r.n_keys, r.n_rows) for r in got.collect()} == {k: (len(n), sum(n)) for k, n in want.items() if n}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Join" not in plan
    assert audit.audit_tables({n: df.limit(0) for n, df in t.items()}, unique, keys, checks).isEmpty()


def test_a_section_is_a_top_list(spark):
    rows = spark.range(500).selectExpr("id % 2 AS app", "id AS n", "id % 10 AS rank")
    parts = [reports.section(rows, F.col("app").cast("string"), "a", "A", ["n"], [F.col("rank").desc()], 3)]
    texts = [r.payload for r in reports.report_payload(parts, "s", "e").orderBy("application_id").collect()]
    assert [text.count('"n":') for text in texts] == [3, 3] and '"n":8}' in texts[0] and '"n":29}' in texts[1]


def test_a_timeline_is_in_order_within_its_chunks(spark):
    rows = spark.range(3000).selectExpr("id % 3 AS investigation_id", "timestamp_seconds((id * 7919) % 400000) AS timestamp")
    placed = investigate.timeline(rows).withColumn("task", F.spark_partition_id())
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in placed.collect():
        seen.setdefault((r.investigation_id, r.chunk), []).append((r.task, r.timestamp))
    assert sum(len(v) for v in seen.values()) == 3000 and len(seen) == 15
    assert all(len({task for task, _ in v}) == 1 and v == sorted(v) for v in seen.values())


def test_a_timeline_of_correlated_events_shuffles_no_pairs(spark):
    events = spark.range(400).selectExpr(
        "id AS event_id", "'a' AS application", "'p' AS environment", "timestamp_seconds(1700000000 + (id * 7919) % 9000) AS timestamp",
        "concat('u', id % 2) AS user_id", "'9' AS client_ip", "CAST(NULL AS STRING) AS session_id", "'r' AS request_id")
    windows = spark.range(30).selectExpr(
        "id AS investigation_id", "'a' AS application", "CASE WHEN id % 3 > 0 THEN 'p' END AS environment", "CASE WHEN id % 2 = 0 THEN 'u1' END AS user",
        "CASE WHEN id % 5 = 0 THEN '9' END AS ip", "CASE WHEN id = 7 THEN 's' END AS session", "CAST(NULL AS STRING) AS request",
        "timestamp_seconds(1700000000 + id * 100) AS time_start", "timestamp_seconds(1700000000 + id * 300) AS time_end")
    packed = correlate.correlate_in_order(events, windows, ["event_id", "timestamp"], block=16)
    placed = investigate.timeline(packed)
    rows = placed.collect()
    want = correlate.correlate_subjects(events, windows, ["event_id", "timestamp"]).collect()
    assert len(want) > 1000 and sorted((r.investigation_id, r.event_id) for r in rows) == sorted((r.investigation_id, r.event_id) for r in want)
    seen = {}
    for r in rows:
        seen.setdefault((r.investigation_id, r.chunk), []).append(r.timestamp)
    assert all(v == sorted(v) and len(v) <= 16 for v in seen.values())
    for one in range(30):
        parts = [seen[k] for k in sorted(k for k in seen if k[0] == one)]
        assert sum(parts, []) == sorted(sum(parts, []))
    inline = placed._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("inline" in line for line in inline[:3])  # pairs are made last, above every exchange


def crowd(spark, n_events=600, n_windows=40):
    """Events and windows of two applications with ties, missing values and repeated ids, and their pairs by a plain loop."""
    events = [(i % 590, "ab"[i % 2], ["p", "q", None][i % 3], None if i % 97 == 5 else NOW + timedelta(minutes=(i * 7919) % 900 // 2),
               None if i % 11 == 0 else f"u{i % 4}", f"{i % 3}", "s", None, ["c", "d", None][i % 5 % 3], ["error", "info"][i % 7 % 2]) for i in range(n_events)]
    windows = [(i % 37, "ab"[i % 2], None if i % 3 == 0 else "pq"[i % 2], f"u{i % 4}" if i % 2 else None, f"{i % 3}" if i % 5 == 0 else None,
                "s" if i == 9 else None, None, NOW + timedelta(minutes=i * 9), NOW + timedelta(minutes=i * 9 + [0, 40, 300, -5][i % 4]))
               for i in range(n_windows)] + [(99, "a", None, None, None, None, None, NOW - 900 * H, NOW + 90000 * H)]
    pairs = [(w, e) for w in windows for e in events if e[3] is not None and w[1] == e[1] and w[2] in (None, e[2])
             and all(w[k] in (None, e[k + 1]) for k in (3, 4, 5, 6)) and w[7] <= e[3] <= w[8]]
    kinds = "environment string, user string, ip string, session string, request string, time_start timestamp, time_end timestamp"
    return spark.createDataFrame(events, "event_id int, application string, environment string, timestamp timestamp, user_id string, client_ip string, "
                                 "session_id string, request_id string, component string, severity string"), spark.createDataFrame(
        windows, f"investigation_id int, application string, {kinds}"), pairs


def test_counted_pairs_are_those_of_a_plain_loop(spark):
    events, windows, pairs = crowd(spark)
    found = correlate.correlate_subjects(events, windows, ["event_id", "timestamp"], count_by=["component", "severity"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # windows and events are counted in one pass, without pairs
    want = {}
    for w, e in pairs:
        want.setdefault((w[0], e[8], e[9]), []).append(e[3])
    got = {(r.investigation_id, r.component, r.severity): (r.n_events, r.first_seen, r.last_seen) for r in investigate.summary(found).collect()}
    assert len(pairs) > 1000 and got == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    by_app = correlate.correlate_subjects(events, windows, ["event_id"], count_by=["application", "severity"], without_subject=False)
    assert sum(r.n_events for r in by_app.collect()) == sum(any(w[3:7]) for w, _ in pairs)
    assert correlate.correlate_subjects(events, windows.limit(0), ["event_id"], count_by=["severity"]).count() == 0


def test_severity_of_counted_pairs(spark):
    events, windows, pairs = crowd(spark)
    is_error = F.col("severity") == "error"
    counted = correlate.correlate_subjects(events, windows, ["severity"], count_by=["severity"])
    made = correlate.correlate_subjects(events, windows, ["severity"])
    got, same = ({r.investigation_id: tuple(r)[1:] for r in investigate.result_severity(c, is_error, 0.4, 0.55).collect()} for c in (counted, made))
    want = {}
    for w, e in pairs:
        want.setdefault(w[0], []).append(1.0 if e[9] == "error" else 0.0)
    assert got == same == {k: (len(v), sum(v) / len(v), "critical" if sum(v) / len(v) >= 0.55 else "warning" if sum(v) / len(v) >= 0.4 else "info")
                           for k, v in want.items()}


def test_pairs_are_made_last_from_blocks(spark):
    events, windows, pairs = crowd(spark)
    made = correlate.correlate_subjects(events, windows, ["event_id", "timestamp", "component"])
    assert "Generate posexplode(events" in "".join(made._jdf.queryExecution().optimizedPlan().toString().split("\n")[:3])
    rows = sorted((r.investigation_id, r.event_id, r.timestamp, str(r.component)) for r in made.collect())
    assert rows == sorted((w[0], e[0], e[3], str(e[8])) for w, e in pairs)


@pytest.mark.parametrize("held, pairs", [(8, 3), (50, 1), (10_000, 10_000)])
def test_large_cells_are_counted_in_parts(held, pairs):
    spans = [(c, f"k{c}", t, t + 40, t * 10 + c, None) for c in range(5) for t in range(0, 90, 7)]
    events = [(c, f"k{c}", t % 97, None, None, ["x", "y", None][t % 3]) for c in range(5) for t in range(60)]
    rows = sorted(spans + events, key=lambda r: (r[0] // 3, r[3] is None, r[2]))  # cells 0-2 and 3-4 share a hash
    at = pa.timestamp("us", "UTC")
    schema = pa.schema([("cell", pa.int64()), ("key", pa.string()), ("at", at), ("until", at), ("investigation_id", pa.int64()), ("by_g", pa.string())])
    table = pa.Table.from_arrays([pa.array([v // 3 if i == 0 else v for v in c], f.type) for i, (c, f) in enumerate(zip(zip(*rows), schema))], schema=schema)
    got = {}
    for out in spans_of.span_counter(["g"], held, pairs)(iter(table.to_batches(max_chunksize=13))):
        for r in out.to_pylist():
            n, lo, hi = got.get((r["investigation_id"], r["g"]), (0, r["first_seen"], r["last_seen"]))
            got[r["investigation_id"], r["g"]] = n + r["n_events"], min(lo, r["first_seen"]), max(hi, r["last_seen"])
    want = {}
    for s in spans:
        for e in events:
            if s[1] == e[1] and s[2] <= e[2] <= s[3]:
                want.setdefault((s[4], e[5]), []).append(datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=e[2]))
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}
