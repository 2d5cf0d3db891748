"""Continuous twins of the batch operators. Every sink write is keyed by batch id, so a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from watchframe.operators import logs, normalize, probes, series
from watchframe.operators.alerts import HOLD_SECONDS
from watchframe.operators.investigate import SESSION_GAP_S
from watchframe.operators.rules import STEP_SECONDS
from watchframe.sources import sinks
from watchframe.streaming.merge_table import MergeTable

WATERMARK = f"{logs.MAX_AGE_HOURS} hours"
SCRAPE_INTERVAL = "30 seconds"  # fixed value: default scrape interval


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Run once over what is there, or every ``interval`` when one is given. A failing batch stops the query."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def poll_probes(
    scrapes: DataFrame, snapshots: Mapping[str, DataFrame], catalog: Mapping[str, probes.Probe], root: str, checkpoint: str,
    schedule: DataFrame | None = None, interval: str | None = SCRAPE_INTERVAL,
) -> StreamingQuery:
    """Run the collector cycle for every new scrape time in the stream ``scrapes`` (column ``ts``).

    Samples and evidence go to ``root``; a repeated batch overwrites both. A collector with an unknown or failing probe is
    noted in ``root/failures`` and left out of the batch, the others go on. Without a schedule there is one collector, whose
    failure stops the query.
    """
    def store(due: Mapping[str, DataFrame], plan: DataFrame | None, batch_id: int, name: str) -> None:
        samples, evidence = probes.collector_cycle(due, catalog, plan, f"{root}/rows/batch={batch_id}/run={name}")
        samples.write.mode("overwrite").parquet(f"{root}/samples/batch={batch_id}/run={name}")
        evidence.write.mode("overwrite").parquet(f"{root}/evidence/batch={batch_id}/run={name}")

    def cycle(batch: DataFrame, batch_id: int) -> None:
        times = batch.select("ts").distinct().persist()  # each probe reads them, the stream is read once
        try:
            due = {n: df.join(times, "ts", "left_semi") if "ts" in df.columns else df for n, df in snapshots.items()}
            if schedule is None:
                store(due, None, batch_id, "all")
                return
            failures = [(r["collector_id"], "unknown probe " + r["probe_name"]) for r in
                        probes.unknown_probes(schedule, catalog).groupBy("collector_id").agg(F.min("probe_name").alias("probe_name")).collect()]
            sound = schedule.filter(~F.col("collector_id").isin([c for c, _ in failures])) if failures else schedule
            try:
                store(due, sound, batch_id, "all")
            except Exception:  # some collector fails: run each by itself
                for i, row in enumerate(sound.select("collector_id").distinct().orderBy("collector_id").collect()):
                    try:
                        store(due, sound.filter(F.col("collector_id") == row["collector_id"]), batch_id, "all" if i == 0 else str(i))
                    except Exception as error:
                        failures.append((row["collector_id"], str(error)[:500]))
            if failures:
                notes = batch.sparkSession.createDataFrame(failures, "collector_id string, reason string")
                notes.write.mode("overwrite").parquet(f"{root}/failures/batch={batch_id}")
        finally:
            times.unpersist()

    return _start(scrapes.writeStream.foreachBatch(cycle), checkpoint, interval)


def normalize_to_tables(raw: DataFrame, root: str, checkpoint: str, interval: str | None = None,
                        severities: Sequence[str] = normalize.SEVERITIES) -> StreamingQuery:
    """Normalise raw events into ``root/accepted`` and ``root/rejected``; ``root/counts`` has the accepted ones of each batch by
    severity, counted as they are written.
    """
    checked = normalize.normalize(raw)
    labels = F.to_json(normalize.text_labels(F.col("labels")))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("labels", labels).persist()
        try:
            counts = sinks.store_events(normalize.accepted(batch), f"{root}/accepted/batch={batch_id}", severities)
            batch.sparkSession.createDataFrame(list(counts.items()), "severity string, n_events bigint").write.mode("overwrite").parquet(
                f"{root}/counts/batch={batch_id}")
            normalize.rejected(batch, *[c for c in raw.columns if c != "value"], "message").write.mode("overwrite").parquet(
                f"{root}/rejected/batch={batch_id}")
        finally:
            batch.unpersist()

    return _start(checked.writeStream.foreachBatch(store), checkpoint, interval)


def drop_late(events: DataFrame, ingest_ts: str = "ingest_ts", ts: str = "timestamp") -> DataFrame:
    """Refuse events older than the age limit at ingest, and bound later state by a watermark.

    The watermark alone follows the newest event, not the clock, so the explicit test stays.
    """
    fresh = events.filter(logs.too_old_reason(F.col(ts), F.col(ingest_ts)).isNull())
    return fresh.withWatermark(ts, WATERMARK)


def counts_table(spark: SparkSession, root: str, keys: Sequence[str] = ("environment", "severity")) -> MergeTable:
    return MergeTable(spark, root, ["window_start", *keys], "batch")


def count_to_table(
    events: DataFrame, root: str, checkpoint: str, keys: Sequence[str] = ("environment", "severity"),
    window: str = "1 hour", interval: str | None = None,
) -> StreamingQuery:
    """Running event counts per window; each batch adds only the windows it changed to the table in ``root``."""
    counts = normalize.count_accepted(events, keys, window)

    def store(batch: DataFrame, batch_id: int) -> None:
        counts_table(batch.sparkSession, root, keys).add(batch.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return _start(counts.writeStream.outputMode("update").foreachBatch(store), checkpoint, interval)


def read_counts(spark: SparkSession, root: str, keys: Sequence[str] = ("environment", "severity")) -> DataFrame:
    """Current counts: the newest update of every window."""
    return counts_table(spark, root, keys).read().select("window_start", *keys, "n_events")


def latest_table(spark: SparkSession, root: str) -> MergeTable:
    return MergeTable(spark, root, ["metric", "series"], "order")


def latest_to_table(samples: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the last value per series in the table in ``root``. A batch is reduced to its own last values, and writes only these and
    the runs that are due to be merged.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        order = series.arrival(F.col("ts"), F.col("ord"))
        rows = series.keyed(batch).withColumn("order", order).select("metric", "series", "ts", "value", "order")
        latest_table(batch.sparkSession, root).add(rows, batch_id)

    return _start(samples.writeStream.foreachBatch(merge), checkpoint, interval)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return latest_table(spark, root).read().select("metric", series.labels_of(F.col("series")).alias("labels"), "ts", "value")


def sessions(events: DataFrame, subject: Sequence[str], gap_s: int = SESSION_GAP_S, ts: str = "ts", silence: str = "1 hour") -> DataFrame:
    """Streamed twin of ``investigate.sessions``: a session leaves once the watermark, ``silence`` behind the newest event of the
    batches before, has passed its end.

    The state holds one merged session per open run of a subject, not its events, whatever their order; events that come later
    than ``silence`` are left out.
    """
    us = F.unix_micros(ts)
    span = F.session_window(ts, f"{gap_s} seconds")  # sessions that touch are merged, so a pause of exactly the gap is none
    merged = events.withWatermark(ts, silence).groupBy(*subject, span).agg(
        F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_events"))
    return merged.select(*subject, "start_us", "end_us", "n_events")


class Hold(StatefulProcessor):
    """Run of true steps of one series, the steps that wait for the watermark, and a timer for the next one due.

    Once the watermark has passed all waiting steps and the run has ended, the series' state is removed.
    """

    def __init__(self, names: Sequence[str], step_s: int, hold_s: int):
        self.names, self.step_s, self.hold_s = list(names), step_s, hold_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start bigint, last bigint, fired boolean")
        self.waiting = handle.getMapState("waiting", "step bigint", "is_true boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        for frame in rows:
            for step, truth in zip(frame["step"], frame["is_true"]):
                if step > passed:  # others come too late: their time is done
                    self.waiting.updateValue((int(step),), (bool(truth),))
        yield self._advance(key, passed)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs() // 1000)

    def _advance(self, key: tuple, passed: int) -> pd.DataFrame:
        start, last, fired = self.run.get() if self.run.exists() else (None, None, False)
        waiting, out = {k[0]: v[0] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}, []
        for step in sorted(s for s in waiting if s <= passed):
            truth = waiting.pop(step)
            self.waiting.removeKey((step,))
            if start is not None and (not truth or step - last > self.step_s):
                out += [(*key, "resolved", start + self.hold_s, last + self.step_s)] if fired else []
                start, fired = None, False
            if truth:
                start, last = (step if start is None else start), step
                if not fired and last - start >= self.hold_s:
                    fired = True
                    out.append((*key, "firing", start + self.hold_s, start + self.hold_s))
        if start is not None and passed > last + self.step_s:
            out += [(*key, "resolved", start + self.hold_s, last + self.step_s)] if fired else []
            start = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [*waiting, *([last + self.step_s + 1] if start is not None else [])]
        if due:
            self.handle.registerTimer(max(min(due), passed + 1) * 1000)
        if start is not None:
            self.run.update((start, last, fired))
        elif self.run.exists():
            self.run.clear()
        if not waiting and self.waiting.exists():
            self.waiting.clear()
        return pd.DataFrame(out, columns=[*self.names, "kind", "started_s", "at_s"])

    def close(self) -> None:
        pass


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def hold_alerts(
    evaluations: DataFrame, keys: Sequence[str], step_s: int = STEP_SECONDS, hold_s: int = HOLD_SECONDS,
    silence: str = "5 minutes",
) -> DataFrame:
    """Stateful alert hold over rows ``keys``, ``step`` (epoch seconds), ``at`` (its timestamp), ``is_true``.

    Emits ``firing`` once a run has held, and ``resolved`` when it ends. Rows wait until the watermark, ``silence`` behind the
    newest row of the batches before, has passed them and are then taken in order, so they may come late by as much, in any batch;
    later ones are left out. A step without a row by then ends a run. State per series is the run and the rows that wait, at most
    one per step of ``silence``; a series whose run has ended and that waits for nothing has none. The stream must be started under
    the settings of ``STATE_STORE``.
    """
    names = list(keys)
    types = {f.name: f.dataType.simpleString() for f in evaluations.schema.fields}
    output = ", ".join(f"`{k}` {types[k]}" for k in names) + ", kind string, started_s bigint, at_s bigint"
    return evaluations.withWatermark("at", silence).groupBy(*names).transformWithStateInPandas(
        Hold(names, step_s, hold_s), output, "append", "eventtime")


def dedup_to_table(events: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Store each alert event, by fingerprint and start, once in ``root``, however late or often it is delivered.

    The table is partitioned by the day an alert started, and a batch is compared with its own days only. A NULL key is a key.
    """
    keys = ["fingerprint", "started_at"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("day", F.to_date("started_at")).dropDuplicates(keys)
        if batch_id > 0:
            stored = spark.read.parquet(root).filter(F.col("batch") < batch_id)  # a repeated batch does not meet itself
            days = fresh.select(F.col("day").alias("fresh_day")).distinct()
            known = stored.join(days, F.expr("day <=> fresh_day"), "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys])
            fresh = fresh.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch={batch_id}")

    return _start(events.writeStream.foreachBatch(merge), checkpoint, interval)


def write_parquet(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None, settings: Mapping[str, str] | None = None) -> StreamingQuery:
    """Append to a table. ``settings`` hold while the query is started, which then keeps them."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            conf.set(k, v)
        return _start(rows.writeStream.format("parquet").option("path", path), checkpoint, interval)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
