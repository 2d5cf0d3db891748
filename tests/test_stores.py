"""Bucketed samples, sketches, counts of the write pass, streamed sessions and deletes that reach far."""

import random
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from watchframe.operators import audit, investigate, rules, sketches
from watchframe.schemas import ForeignKey
from watchframe.sources import sinks
from watchframe.streaming import jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


# ---- deletes

CHAIN = (ForeignKey("b", "a_id", "a", "cascade"), ForeignKey("c", "b_id", "b", "cascade"), ForeignKey("d", "c_id", "c", "restrict"),
         ForeignKey("e", "b_id", "b", "set_null"), ForeignKey("b", "next", "b", "cascade"))


def plan(spark, tmp_path, rows, gone, keys=CHAIN):
    ddl = {"a": "id int", "b": "id string, a_id int, next string", "c": "id string, b_id string", "d": "c_id string", "e": "id int, b_id string"}
    tables = {name: spark.createDataFrame(rows.get(name, []), ddl[name]) for name in ddl}
    deleted = spark.createDataFrame([(g,) for g in gone], "id int")
    found = audit.delete_plan(tables, "a", deleted, str(tmp_path / uuid.uuid4().hex), keys).collect()
    return sorted((r.key, r.table, r.column, r.effect, r.n_rows) for r in found)


def test_a_block_at_the_end_of_a_chain_withdraws_the_whole_delete(spark, tmp_path):
    rows = {"a": [(1,), (2,), (3,)], "b": [("b1", 1, None), ("b2", 2, None), ("b2x", 2, None)], "c": [("c1", "b1"), ("c2", "b2"), (None, "b2")],
            "d": [("c1",), (None,)], "e": [(1, "b1"), (2, "b2"), (3, "b2"), (4, None)]}
    assert plan(spark, tmp_path, rows, [1, 2, 2, 3, None]) == [
        ("1", "d", "c_id", "blocked", 1),
        ("2", "b", "a_id", "removed", 2), ("2", "c", "b_id", "removed", 2), ("2", "e", "b_id", "cleared", 2)]


def test_references_in_a_circle_come_to_an_end(spark, tmp_path):
    rows = {"a": [(1,)], "b": [("x", 1, "z"), ("y", None, "x"), ("z", None, "y")], "c": [("c", "z")]}
    assert plan(spark, tmp_path, rows, [1]) == [
        ("1", "b", "a_id", "removed", 1), ("1", "b", "next", "removed", 3), ("1", "c", "b_id", "removed", 1)]


def test_deletes_of_nothing(spark, tmp_path):
    assert plan(spark, tmp_path, {}, []) == []
    assert plan(spark, tmp_path, {"a": [(1,)]}, [1], ()) == []


def test_a_plan_of_one_level_is_the_effects(spark, tmp_path):
    keys = (ForeignKey("b", "a_id", "a", "cascade"), ForeignKey("c", "b_id", "a", "set_null"))
    tables = {"a": spark.range(4).select(F.col("id").cast("string")), "b": spark.createDataFrame([("1",), ("1",), ("2",)], "a_id string"),
              "c": spark.createDataFrame([("9", "1"), ("8", "7")], "id string, b_id string")}
    gone = tables["a"].filter("id < 3")
    names = ["key", "table", "column", "effect", "n_rows"]
    deep = audit.delete_plan(tables, "a", gone, str(tmp_path / "p"), keys).select(names)
    flat = audit.delete_effects(tables, "a", gone, keys).select(names)
    assert sorted(map(tuple, deep.collect())) == sorted(map(tuple, flat.collect()))


# ---- sketches

def test_merged_sketches_keep_their_rank_error(spark):
    rng = random.Random(5)
    values = {k: [rng.lognormvariate(0, 2) for _ in range(20_000)] for k in ("a", "b")}
    rows = [(k, T0 + timedelta(minutes=i), v) for k in values for i, v in enumerate(values[k])]
    df = spark.createDataFrame([*rows, ("a", T0, None), ("a", None, 1.0), ("a", T0, float("nan"))], "k string, ts timestamp, v double").repartition(7)
    hourly = sketches.bucket_sketches(df, ["k"], "v", 3600)
    assert hourly.count() == 2 * -(-20_000 // 60)
    band = sketches.sketch_quantiles(sketches.merged(hourly, ["k"]), {"p5": 0.05, "p50": 0.5, "p99": 0.99})
    for r in band.collect():
        assert r.n == 20_000
        for p, got in ((0.05, r.p5), (0.5, r.p50), (0.99, r.p99)):
            assert abs(sum(v <= got for v in values[r.k]) / 20_000 - p) <= 2 * sketches.RANK_ERROR


def test_trailing_sketches_cover_their_span_only(spark):
    df = spark.createDataFrame([("k", T0 + timedelta(days=d), float(d)) for d in (0, 1, 4, 4, 5)], "k string, ts timestamp, v double")
    spans = sketches.trailing(sketches.bucket_sketches(df, ["k"], "v", 86_400), ["k"], 86_400, 2)
    got = sketches.sketch_quantiles(spans, {"low": 0.0, "high": 1.0})
    first = int(T0.timestamp()) // 86_400
    assert sorted((r.bucket // 86_400 - first, r.n, r.low, r.high) for r in got.collect()) == [
        (0, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (4, 2, 4.0, 4.0), (5, 3, 4.0, 5.0)]
    empty = sketches.sketch_band(df.filter("false"), ["k"], "v", 3600)
    assert empty.columns == ["k", "n", "lower", "upper"] and empty.count() == 0


# ---- bucketed samples

def bucketed(spark, tmp_path, samples, **settings):
    chunks = rules.stored_chunks(samples, ["s"], order="ord", **settings)
    name = f"t{uuid.uuid4().hex}"
    return sinks.store_bucketed(chunks, name, str(tmp_path / name), ["s", "chunk"], 8)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_samples_are_read_without_a_shuffle(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), T0 + timedelta(seconds=rng.randrange(9000)), i, float(rng.randrange(40))) for i in range(3000)]
    samples = spark.createDataFrame(rows, "s string, ts timestamp, ord int, value double")
    stored = bucketed(spark, tmp_path, samples, step_s=15, chunk_steps=40)
    rates = rules.rate_of_chunks(stored, ["s"], chunk_steps=40)
    vector = rules.vector_of_chunks(stored, ["s"], chunk_steps=40)
    assert "Exchange" not in plan_of(rates) and "Exchange" not in plan_of(vector)
    tidy = lambda df: sorted(map(str, df.select(*[F.round(c, 9) if t == "double" else F.col(c) for c, t in df.dtypes]).collect()))
    assert tidy(rates) == tidy(rules.rate(samples, ["s"], order="ord", chunk_steps=40))
    assert tidy(vector) == tidy(rules.instant_vector(samples, ["s"], order="ord"))
    assert stored.filter("s = 'hot'").select("chunk").distinct().count() > 10  # a dense series lies in many buckets


# ---- counts of the write pass

def test_events_are_counted_as_they_are_written(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    events = spark.createDataFrame([("e1", "error"), ("e2", "error"), ("e3", "odd"), ("e4", None), ("e5", "info")], "event_id string, severity string")
    counts = sinks.store_events(events.mapInArrow(read, events.schema), str(tmp_path / "e"), ("error", "info", "debug"))
    assert counts == {"error": 2, "info": 1, "debug": 0, "other": 2}
    assert reads.value == 5 and spark.read.parquet(str(tmp_path / "e")).count() == 5
    assert sinks.store_events(events.filter("false"), str(tmp_path / "e"), ("error",)) == {"error": 0, "other": 0}


# ---- streamed sessions

def streamed(spark, tmp_path, batches, silence, gap_s=1800):
    ddl = "u string, ts timestamp"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    open_after = []
    for batch in batches:
        spark.createDataFrame([(u, T0 + timedelta(seconds=s)) for u, s in batch], ddl).coalesce(1).write.mode("append").parquet(source)
        found = jobs.sessions(spark.readStream.schema(ddl).parquet(source), ["u"], gap_s, silence=silence)
        jobs.write_parquet(found, out, check).awaitTermination()
        open_after.append(spark.read.format("statestore").load(check).count())
    start = int(T0.timestamp()) * 10**6
    got = sorted((r.u, (r.start_us - start) / 1e6, (r.end_us - start) / 1e6, r.n_events) for r in spark.read.parquet(out).collect())
    return got, open_after


def test_a_pause_of_exactly_the_gap_keeps_a_session(spark, tmp_path):
    got, open_after = streamed(spark, tmp_path, [[("a", 0), ("a", 1800), ("b", 0), ("b", 1800.000001)], [("z", 1_000_000)]], "1 hour")
    assert got == [("a", 0, 1800, 2), ("b", 0, 0, 1), ("b", 1800.000001, 1800.000001, 1)]
    assert open_after == [3, 1]  # what has ended leaves the state


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    got, _ = streamed(spark, tmp_path, [[("a", 0), ("a", 3000)], [("a", 1500), ("a", 1500)], [("z", 1_000_000)], [("a", 10)]], "2 hours")
    assert got == [("a", 0, 3000, 4)]  # the event that comes after its time is left out


def test_streamed_sessions_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.randrange(200_000)) for _ in range(300)]
    slices = [[r for r in rows if r[1] // 40_000 == i] for i in (1, 0, 3, 2, 4)]
    got, _ = streamed(spark, tmp_path, [*slices, [("z", 10_000_000)]], "90000 seconds")
    events = spark.createDataFrame([(u, T0 + timedelta(seconds=s)) for u, s in rows], "u string, ts timestamp")
    start = int(T0.timestamp()) * 10**6
    want = [(r.u, (r.start_us - start) / 1e6, (r.end_us - start) / 1e6, r.n_events) for r in investigate.sessions(events, ["u"]).collect()]
    assert got == sorted(want)
