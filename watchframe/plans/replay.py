"""Streaming jobs over slices of the given tables, out of order and one a batch, for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from watchframe.operators import normalize
from watchframe.operators.probes import default_catalog
from watchframe.plans import recipes
from watchframe.plans.fixtures import Fixtures
from watchframe.session import work_dir
from watchframe.streaming import jobs


SLICES = 10
ROWS_A_FILE = 50_000  # a file of a stream is read by one task, however few bytes its rows take


def stream_slices(rows: DataFrame, ts: str, path: str, slices: int = SLICES) -> DataFrame:
    """Rows written by spans of time and streamed back about one span a batch, each pair of spans in reverse.

    All spans are cut in one parallel pass; each is then appended to the stream's folder by as many tasks as its size asks for. A
    file holds at most ``ROWS_A_FILE`` rows, so the tasks of a batch grow with its rows: compact rows may be costly ones.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    low, high = low or 0, high or 0
    place = F.floor((F.unix_micros(ts) - low) / F.lit(max(1, high - low + 1)) * slices).cast("int")
    parted = work_dir(spark, "parted")
    rows.withColumn("_span", F.coalesce(place, F.lit(0))).write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("_span").parquet(parted)
    cut = spark.read.schema(StructType([*rows.schema.fields, StructField("_span", IntegerType())])).parquet(parted)
    for i in range(slices):
        cut.filter(F.col("_span") == (i ^ 1 if i ^ 1 < slices else i)).select(rows.columns).write.option("maxRecordsPerFile", ROWS_A_FILE).mode("append").parquet(path)
    n_files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, n_files // slices)).parquet(path)


def stream_events(f: Fixtures) -> DataFrame:
    return stream_slices(f.table("events"), "ts", work_dir(f.spark, "slices"))


def stream_table(f: Fixtures, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = f.spark.read.parquet(f"{f.sf_dir}/{name}.parquet").schema
    df = f.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(f.sf_dir)
    return df.select(*[
        F.col(c.name).cast("timestamp").alias(c.name) if c.dataType.typeName() == "timestamp_ntz" else F.col(c.name)
        for c in schema.fields])


def raw_stream(f: Fixtures) -> DataFrame:
    return f.sql(recipes.RAW_EVENTS, events=stream_events(f)).withColumnRenamed("ts", "ingest_ts")


def normalized(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    root = work_dir(f.spark, "normalize")
    jobs.normalize_to_tables(raw_stream(f), root, f"{root}/checkpoint").awaitTermination()
    accepted = f.spark.read.parquet(f"{root}/accepted")
    return accepted.withColumn("labels", F.from_json("labels", "map<string,string>")), f.spark.read.parquet(f"{root}/rejected")


def observed(f: Fixtures, severities: Sequence[str]) -> DataFrame:
    root = work_dir(f.spark, "observed")
    jobs.normalize_to_tables(raw_stream(f), root, f"{root}/checkpoint", severities=severities).awaitTermination()
    return f.spark.read.parquet(f"{root}/counts")


def sessions(f: Fixtures, subject: Sequence[str]) -> DataFrame:
    """Events arrive out of order; a row far ahead then lets the watermark pass all sessions."""
    root = work_dir(f.spark, "sessions")
    events = f.table("events").select(*subject, "ts")
    stream = stream_slices(events, "ts", f"{root}/in")
    beyond = events.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    beyond.select(*[F.lit(None).cast(events.schema[k].dataType).alias(k) for k in subject], "ts").write.mode("append").parquet(f"{root}/in")
    covered_s = events.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s")).first()["s"] or 0
    # a pair of slices comes in reverse, so a row is at most two slices late
    found = jobs.sessions(stream, subject, silence=f"{2 * covered_s // SLICES + 3600} seconds")
    jobs.write_parquet(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f.spark.read.parquet(f"{root}/out")


def latest(f: Fixtures) -> DataFrame:
    root = work_dir(f.spark, "latest")
    jobs.latest_to_table(f.samples(stream_events(f)), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return jobs.read_latest(f.spark, f"{root}/table")


def counts(f: Fixtures) -> DataFrame:
    root = work_dir(f.spark, "counts")
    events = normalize.accepted(normalize.normalize(raw_stream(f)))
    fresh = jobs.drop_late(events.drop("labels"))
    jobs.count_to_table(fresh, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return jobs.read_counts(f.spark, f"{root}/table")


def alert_hold(f: Fixtures, evaluations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``evaluations`` arrive in six spans of time; a row far ahead then lets the watermark pass them all."""
    root = work_dir(f.spark, "hold")
    stream = stream_slices(evaluations, "at", f"{root}/in", 6)
    ahead = F.col("at") + F.expr("INTERVAL 3 DAYS")
    beyond = evaluations.orderBy(F.col("at").desc()).limit(1).withColumns({
        "at": ahead, "step": F.unix_seconds(ahead), "is_true": F.lit(False), keys[0]: F.lit("beyond")})
    beyond.select(evaluations.columns).coalesce(1).write.mode("append").parquet(f"{root}/in")
    held = jobs.hold_alerts(stream, keys, silence="3 hours")
    jobs.write_parquet(held, f"{root}/out", f"{root}/checkpoint", settings=jobs.STATE_STORE).awaitTermination()
    return f.spark.read.parquet(f"{root}/out")


def alert_dedup(f: Fixtures) -> DataFrame:
    """Events as deliveries of one alert per user and day, each delivered many times, some days late."""
    root = work_dir(f.spark, "dedup")
    deliveries = stream_events(f).select(
        F.col("user_id").alias("fingerprint"), F.date_trunc("day", "ts").alias("started_at"))
    jobs.dedup_to_table(deliveries, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return f.spark.read.parquet(f"{root}/table")


def poll(f: Fixtures, schedule: DataFrame) -> DataFrame:
    """One polling run over the scrape times found in the stream."""
    root = work_dir(f.spark, "poll")
    scrapes = stream_table(f, "customer").select(F.expr(recipes.SCRAPE).alias("ts"))
    jobs.poll_probes(scrapes, f.snapshots(), default_catalog(), root, f"{root}/checkpoint", schedule, None).awaitTermination()
    return f.spark.read.parquet(f"{root}/samples").drop("batch", "run")
