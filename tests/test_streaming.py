import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchframe.operators import normalize, probes, series
from watchframe.plans import replay
from watchframe.sources.events import read_raw, stream_raw
from watchframe.streaming import jobs

T0 = datetime(2024, 1, 1)
STEP0 = 1_704_067_200


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def event(env, seconds, **more):
    return json.dumps({"env": env, "app": "a", "msg": "m", "timestamp": f"{(T0 + timedelta(seconds=seconds)).isoformat()}Z", **more})


def ingested(df):
    return df.withColumn("ingest_ts", F.lit(T0).cast("timestamp"))


def test_normalise_over_several_batches(spark, tmp_path):
    put(tmp_path / "in", "1.txt", [event("p", 1), "{bad"])
    root, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        jobs.normalize_to_tables(ingested(stream_raw(spark, str(tmp_path / "in"), 1)), root, check).awaitTermination()

    run()
    put(tmp_path / "in", "2.txt", [event("q", 2, labels={"k": 1})])
    run()
    accepted, rejected = spark.read.parquet(f"{root}/accepted"), spark.read.parquet(f"{root}/rejected")
    assert sorted((r.environment, r.labels) for r in accepted.collect()) == [("p", None), ("q", '{"k":"1"}')]
    assert [r.reject_reason for r in rejected.collect()] == [normalize.REJECT_PARSE]
    whole = normalize.accepted(normalize.normalize(ingested(read_raw(spark, str(tmp_path / "in")))))
    assert whole.count() == accepted.count()


def test_latest_across_batches(spark, tmp_path):
    ddl = "metric string, help string, ts timestamp, ord bigint, value double, labels map<string,string>"
    source, root, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    batches = [[("m", "", T0, 1, 1.0, {"a": "x"}), ("m", "", T0, 2, 2.0, {"a": "x"}), ("n", "", T0, 1, 9.0, {})],
               [("m", "", T0, 3, 3.0, {"a": "x"}), ("n", "", T0 - timedelta(1), 5, 8.0, {}), ("m", "", T0, 1, 4.0, {"a": "y"})]]
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        jobs.latest_to_table(spark.readStream.schema(ddl).parquet(source), root, check).awaitTermination()
    got = jobs.read_latest(spark, root)
    want = series.latest(spark.read.schema(ddl).parquet(source))
    assert sorted((r.metric, sorted(r.labels.items()), r.value) for r in got.collect()) == sorted(
        (r.metric, sorted(r.labels.items()), r.value) for r in want.collect())


def test_counts_update_and_refuse_late_events(spark, tmp_path):
    put(tmp_path / "in", "1.txt", [event("p", 1), event("p", 2), event("p", -169 * 3600)])
    root, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        events = normalize.accepted(normalize.normalize(ingested(stream_raw(spark, str(tmp_path / "in")))))
        jobs.count_to_table(jobs.drop_late(events.drop("labels")), root, check).awaitTermination()

    run()
    put(tmp_path / "in", "2.txt", [event("p", 3), event("q", 3700)])
    run()
    got = jobs.read_counts(spark, root).collect()
    assert sorted((r.environment, r.n_events) for r in got) == [("p", 3), ("q", 1)]


def test_alert_hold_keeps_state_between_batches(spark, tmp_path):
    ddl = "job string, step bigint, at timestamp, is_true boolean"

    def rows(job, truths, first=0):
        return [(job, STEP0 + 15 * (first + i), T0 + timedelta(seconds=15 * (first + i)), x) for i, x in enumerate(truths)]

    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [
        rows("a", [True] * 5) + rows("b", [True] * 9 + [False]) + rows("c", [True, False] * 5),
        rows("a", [True] * 6, 5) + rows("b", [True] * 3, 10) + rows("d", [True] * 9),
        rows("a", [True] * 2, 20) + rows("b", [True] * 2, 1),  # a has a hole; the rows of b are late
        rows("c", [False], 400),  # time passes: silent series resolve
    ]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        held = jobs.hold_alerts(spark.readStream.schema(ddl).parquet(source), ["job"], silence="10 minutes")
        jobs.write_parquet(held, out, check, settings=jobs.STATE_STORE).awaitTermination()
    got = sorted((r.job, r.kind, (r.started_s - STEP0) // 15, (r.at_s - STEP0) // 15) for r in spark.read.parquet(out).collect())
    assert got == [("a", "firing", 8, 8), ("a", "resolved", 8, 11), ("b", "firing", 8, 8), ("b", "resolved", 8, 9),
                   ("d", "firing", 8, 8), ("d", "resolved", 8, 9)]


def test_the_hold_forgets_series_that_ended(spark, tmp_path):
    ddl = "job string, step bigint, at timestamp, is_true boolean"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def rows(job, first, n, truth=True):
        return [(job, STEP0 + 15 * (first + i), T0 + timedelta(seconds=15 * (first + i)), truth) for i in range(n)]

    held_series = []
    for batch in [rows("a", 0, 12) + rows("b", 0, 3), rows("a", 12, 2), rows("beyond", 4_000, 1, False), rows("beyond", 8_000, 1, False), rows("beyond", 12_000, 1, False)]:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        held = jobs.hold_alerts(spark.readStream.schema(ddl).parquet(source), ["job"], silence="1 minute")
        jobs.write_parquet(held, out, check, settings=jobs.STATE_STORE).awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "run").load(check)
        held_series.append(sorted(r.job for r in state.select("key.job").collect()))
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(check)
    assert {r.job for r in waiting.select("key.job").collect()} <= {"beyond"}  # the newest row still waits, nothing else does
    assert held_series[0] == ["a"] or held_series[1] == ["a"]
    assert held_series[-1] == []
    got = sorted((r.job, r.kind) for r in spark.read.parquet(out).collect())
    assert got == [("a", "firing"), ("a", "resolved")]


def test_repeated_alerts_are_stored_once_however_late(spark, tmp_path):
    ddl = "fingerprint string, started_at timestamp, n int"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [[("f", T0 + timedelta(10), 1), ("f", T0 + timedelta(10), 2)], [("f", T0 + timedelta(11), 3), ("f", T0 + timedelta(10), 4)],
               [("f", T0, 5), ("g", T0, 6), ("f", T0 + timedelta(11), 7)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        jobs.dedup_to_table(spark.readStream.schema(ddl).parquet(source), out, check).awaitTermination()
    got = sorted((r.fingerprint, (r.started_at - T0).days) for r in spark.read.parquet(out).collect())
    assert got == [("f", 0), ("f", 10), ("f", 11), ("g", 0)]


def test_a_late_row_does_not_break_a_run(spark, tmp_path):
    ddl = "job string, step bigint, at timestamp, is_true boolean"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    step = lambda i: ("a", STEP0 + 15 * i, T0 + timedelta(seconds=15 * i), True)
    batches = [[step(i) for i in range(10) if i != 4], [step(4)], [("z", STEP0 + 6000, T0 + timedelta(seconds=6000), False)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        held = jobs.hold_alerts(spark.readStream.schema(ddl).parquet(source), ["job"], silence="10 minutes")
        jobs.write_parquet(held, out, check, settings=jobs.STATE_STORE).awaitTermination()
    got = sorted((r.kind, (r.started_s - STEP0) // 15, (r.at_s - STEP0) // 15) for r in spark.read.parquet(out).collect())
    assert got == [("firing", 8, 8), ("resolved", 8, 10)]


def test_polling_runs_new_scrapes_and_leaves_out_failing_collectors(spark, tmp_path):
    ddl = "environment string, target string, ts timestamp, status string"
    sessions = spark.createDataFrame([("p", "d", T0, "run"), ("p", "d", T0, "run"), ("p", "d", T0 + timedelta(1), "idle")], ddl)
    catalog = {"sessions": probes.default_catalog()["sessions"]}
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(ts, schedule=None):
        spark.createDataFrame([(ts,)], "ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp").parquet(source)
        jobs.poll_probes(stream, {"dm_exec_sessions": sessions}, catalog, root, check, schedule, None).awaitTermination()
        return sorted((r.labels["status"], r.value) for r in spark.read.parquet(f"{root}/samples").collect())

    assert run(T0) == [("run", 2.0)]
    assert run(T0 + timedelta(1)) == [("idle", 1.0), ("run", 2.0)]
    schedule = spark.createDataFrame(
        [("c", "p", "d", "cpu"), ("e", "p", "d", "sessions")], "collector_id string, environment_slug string, target_name string, probe_name string")
    assert run(T0, schedule) == [("idle", 1.0), ("run", 2.0), ("run", 2.0)]
    assert [(r.collector_id, r.reason) for r in spark.read.parquet(f"{root}/failures").collect()] == [("c", "unknown probe cpu")]


def test_a_slice_of_many_compact_rows_comes_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "ROWS_A_FILE", 20)
    rows = spark.range(400).selectExpr("id", "timestamp_seconds(1700000000 + id) AS ts").coalesce(1)
    stream = replay.stream_slices(rows, "ts", f"{tmp_path}/in")
    stored = spark.read.parquet(f"{tmp_path}/in")
    per_file = stored.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 20 and max(r["count"] for r in per_file) <= 20
    assert stored.count() == stored.distinct().count() == 400 and stream.isStreaming
