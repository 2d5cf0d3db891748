from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from watchframe.functions.numbers import parse_number
from watchframe.operators import probes, series

TS = datetime(2024, 1, 1)
WAITS = probes.default_catalog()["waits"]


def rows_frame(spark, ddl, *rows):
    return spark.createDataFrame([("prod", "orders-1", TS, *r) for r in rows], f"environment string, target string, ts timestamp, {ddl}")


def test_decode_uses_declared_columns_only(spark):
    df = rows_frame(spark, "wait_type string, wait_time_ms bigint, spare_number int, spare_text string", ("DISK_WAIT", 317, 8, "left out"))
    got = probes.decode(df, WAITS).collect()
    assert [(r.metric, r.value, r.labels) for r in got] == [
        ("sqlserver_wait_time_ms", 317.0, {"environment": "prod", "target": "orders-1", "wait_type": "DISK_WAIT"})]


@pytest.mark.parametrize("ddl,value,expected", [
    ("wait_time_ms int", 5, 5.0), ("wait_time_ms float", 1.5, 1.5), ("wait_time_ms decimal(11,6)", Decimal("0.1875"), 0.1875),
    ("wait_time_ms string", "7.5", 7.5), ("wait_time_ms string", "x", None), ("wait_time_ms binary", bytearray(b"12"), 12.0),
    ("wait_time_ms boolean", True, None), ("wait_time_ms timestamp", TS, None), ("wait_time_ms int", None, None), ("other int", 1, None),
])
def test_value_coercion(spark, ddl, value, expected):
    got = [r.value for r in probes.decode(rows_frame(spark, ddl, (value,)), WAITS).collect()]
    assert got == ([] if expected is None else [expected])


def test_missing_and_null_labels(spark):
    without = probes.decode(rows_frame(spark, "wait_time_ms int", (1,)), WAITS).first().labels
    null = probes.decode(rows_frame(spark, "wait_type string, wait_time_ms int", (None, 1)), WAITS).first().labels
    assert without == {"environment": "prod", "target": "orders-1"}
    assert null["wait_type"] == "<nil>"


@pytest.mark.parametrize("text,expected", [
    ("1", 1.0), ("1.", 1.0), (".5", 0.5), ("-1e3", -1000.0), ("1e400", None), ("1.0d", None), (" 1 ", None), ("", None),
    ("inf", float("inf")), ("-Infinity", float("-inf")), ("0x1p-2", 0.25), ("0x1.8p1", 3.0), ("-0X.8P0", -0.5), ("0x", None), ("1_0", None), (".", None),
])
def test_number_text(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(parse_number(F.col("t"))).first()[0]
    assert got == expected


def test_not_a_number_text(spark):
    got = spark.createDataFrame([("NaN",)], "t string").select(parse_number(F.col("t"))).first()[0]
    assert got != got


def snapshots(spark):
    return {
        "dm_os_wait_stats": rows_frame(spark, "wait_type string, wait_time_ms bigint", ("A", 1), ("B", 0)),
        "dm_exec_requests": rows_frame(spark, "session_id int, blocking_session_id int", (1, 0), (2, 1), (3, 1), (4, 2)),
        "dm_exec_sessions": rows_frame(spark, "session_id int, status string", (1, "running"), (2, "sleeping"), (3, "running")),
        "dm_os_performance_counters": rows_frame(
            spark, "counter_name string, cntr_value bigint", ("Total Server Memory (KB)   ", 9), ("batch requests/SEC", 4), ("Other", 1)),
        "master_files": rows_frame(spark, "database_id int, file_id int, size int", (1, 2, 256), (1, 1, 128), (9, 1, 1)),
        "databases": rows_frame(spark, "database_id int, name string", (1, "main")).drop("ts"),
    }


def test_catalog_has_six_complete_probes():
    catalog = probes.default_catalog("x_")
    assert sorted(catalog) == ["blocking", "memory_pressure", "sessions", "storage", "throughput", "waits"]
    assert all(p.metrics and m.name.startswith("x_") and m.help for p in catalog.values() for m in p.metrics)


def test_cycle_samples_and_evidence(spark):
    samples, proofs = probes.collector_cycle(snapshots(spark), probes.default_catalog(""))
    got = {(r.metric, *sorted(v for k, v in r.labels.items() if k not in ("environment", "target")), r.ord): r.value for r in samples.collect()}
    assert got == {
        ("wait_time_ms", "A", 0): 1, ("blocked_requests", "1", 0): 2, ("blocked_requests", "2", 0): 1, ("sessions", "running", 0): 2,
        ("sessions", "sleeping", 0): 1, ("memory_kb", "total_server_memory_kb", 0): 9, ("throughput", "batch requests/SEC", 0): 4,
        ("database_file_size_mb", "main", 2): 2, ("database_file_size_mb", "main", 1): 1, ("database_file_size_mb", "<nil>", 1): 0.007813}
    assert sorted((r.kind, r.title, r.metadata["rows"]) for r in proofs.collect()) == [
        ("blocking", "blocking snapshot for orders-1", "2"), ("sessions", "sessions snapshot for orders-1", "2")]


def test_no_rows_give_no_evidence(spark):
    empty = {**snapshots(spark), "dm_exec_requests": rows_frame(spark, "session_id int, blocking_session_id int", (1, 0))}
    _, proofs = probes.collector_cycle(empty, probes.default_catalog())
    assert [r.kind for r in proofs.collect()] == ["sessions"]


def test_schedule_limits_the_cycle(spark):
    schedule = spark.createDataFrame([("c", "prod", "orders-1", "waits"), ("c", "prod", "other", "sessions"), ("c", "prod", "orders-1", "cpu")],
                                     "collector_id string, environment_slug string, target_name string, probe_name string")
    samples, proofs = probes.collector_cycle(snapshots(spark), probes.default_catalog(), schedule)
    assert [r.metric for r in samples.collect()] == ["sqlserver_wait_time_ms"]
    assert proofs.isEmpty()
    assert [r.probe_name for r in probes.unknown_probes(schedule, probes.default_catalog()).collect()] == ["cpu"]


def test_template_override_and_new_probe(spark):
    sessions = probes.default_catalog("")["sessions"]
    assert probes.with_template(spark, sessions, "") is sessions
    own = probes.with_template(spark, sessions, "SELECT status, 7 AS session_count, '{x}' AS note FROM sys.dm_exec_sessions GROUP BY status")
    rows = probes.run_for_target(own, snapshots(spark), "prod", "orders-1")
    assert sorted((r.labels["status"], r.value) for r in probes.decode(rows, own).collect()) == [("running", 7.0), ("sleeping", 7.0)]
    cpu = probes.Probe("cpu", "cpu", lambda s: s["dm_exec_sessions"], (probes.Metric("cpu", "", "session_id", ("status",)),))
    catalog = probes.register_probe(probes.default_catalog(), cpu)
    assert len(catalog) == 7 and probes.decode(cpu.rows(snapshots(spark)), cpu).count() == 3


@pytest.mark.parametrize("timeout,interval,expected", [(2000, 30, 2000), (0, 30, 30000), (0, 0, 5000), (None, None, 5000)])
def test_effective_timeout(spark, timeout, interval, expected):
    df = spark.createDataFrame([(timeout, interval)], "t int, i int")
    assert df.select(probes.effective_timeout_ms(F.col("t"), F.col("i"))).first()[0] == expected


def sample_frame(spark, *rows):
    return spark.createDataFrame([(m, h, TS, o, v, lab) for m, h, o, v, lab in rows],
                                 "metric string, help string, ts timestamp, ord bigint, value double, labels map<string,string>")


def test_last_write_wins_per_series(spark):
    s = sample_frame(spark, ("m", "", 1, 1.0, {"a": "x", "b": "y"}), ("m", "", 2, 2.0, {"b": "y", "a": "x"}), ("m", "", 3, 3.0, {"a": "z", "b": "y"}))
    assert sorted((r.labels["a"], r.value) for r in series.latest(s).collect()) == [("x", 2.0), ("z", 3.0)]
    asked = spark.createDataFrame([("m",), ("none",)], "metric string")
    assert sorted(map(tuple, series.lookup_last_value(asked, s).collect())) == [("m", 3.0), ("none", 0.0)]


def test_label_set_is_fixed_by_the_first_sample(spark):
    s = sample_frame(spark, ("m", "", 1, 1.0, {"a": "x"}), ("m", "", 2, 2.0, {"a": "x", "b": "y"}), ("n", "", 3, 1.0, {}))
    assert [tuple(r) for r in series.label_set_violations(s).collect()] == [("m", "a", "a,b", 1)]


def test_help_defaults_to_the_metric_name(spark):
    s = sample_frame(spark, ("m", "", 1, 1.0, {}), ("n", "first", 1, 1.0, {}), ("n", "later", 2, 1.0, {}))
    assert sorted(map(tuple, series.metric_help(s).collect())) == [("m", "m"), ("n", "first")]


def test_last_not_null(spark):
    s = sample_frame(spark, ("m", "", 1, 1.0, {}), ("m", "", 2, None, {}))
    assert series.last_not_null(s, ["metric"], F.lit(TS)).first().value == 1.0
    assert series.last_not_null(s, ["metric"], F.lit(datetime(2024, 1, 1, 2))).isEmpty()
