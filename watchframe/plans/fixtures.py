"""Spark frames of the recipes for one data folder."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Template

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchframe.plans import recipes
from watchframe.session import configure


class Snapshots(Mapping):
    """System-view snapshots, each built when a probe first asks for it."""

    def __init__(self, fixtures: Fixtures):
        self._fixtures, self._frames = fixtures, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._fixtures.sql(recipes.SNAPSHOTS[name])
        return self._frames[name]

    def __iter__(self):
        return iter(recipes.SNAPSHOTS)

    def __len__(self) -> int:
        return len(recipes.SNAPSHOTS)


class Fixtures:
    """Given tables and frames derived from them. Everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table, with zone-less timestamps read as UTC instants. Its schema is read once."""
        if name not in self._tables:
            self._tables[name] = self._read(name)
        return self._tables[name]

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[
            F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
            for f in df.schema.fields])

    def sql(self, recipe: str, **frames: DataFrame) -> DataFrame:
        """Run a recipe; ``frames`` replace given tables of that name."""
        text = Template(recipe).safe_substitute(recipes.DIALECT["spark"])
        text = text.replace("{", "{{").replace("}", "}}")
        names = set(re.findall(r"\$([a-z]+)", text))
        text = re.sub(r"\$([a-z]+)", r"{\1}", text)
        return self.spark.sql(text, **{n: frames[n] if n in frames else self.table(n) for n in names})

    def raw_events(self) -> DataFrame:
        raw = self.sql(recipes.RAW_EVENTS)
        return raw.withColumnRenamed("ts", "ingest_ts")

    def snapshots(self) -> Mapping[str, DataFrame]:
        return Snapshots(self)

    def metadata(self, name: str) -> DataFrame:
        return self.sql(recipes.METADATA[name])

    def model(self) -> dict[str, DataFrame]:
        """Metadata tables filled from the given ones, with broken rules planted."""
        return {name: self.sql(text) for name, text in recipes.MODEL.items()}

    def samples(self, events: DataFrame | None = None) -> DataFrame:
        flat = self.sql(recipes.SAMPLES, **({} if events is None else {"events": events}))
        pairs = F.create_map(F.lit("environment"), "environment", F.lit("target"), "target", F.lit("zone"), "zone")
        return flat.select(
            "metric", F.lit("").alias("help"), "ts", "ord", "value", F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("labels"))

    def documents(self) -> DataFrame:
        """Inventory documents as one JSON text each."""
        def channel(*values) -> F.Column:
            return F.struct(*[v.alias(n) for n, v in zip(("id", "channel_type", "target_ref", "credential_ref"), values)])

        own = channel(*[F.col(f"channel_{n}") for n in ("id", "type", "target", "credential")])
        shared = channel(F.lit("pager"), F.lit("webhook"), F.lit("duty"), F.concat(F.lit("kv/p"), F.col("s")))
        secrets = F.create_map(F.lit("db"), F.concat(F.lit("pw"), F.col("s")), F.lit("mail"), F.concat(F.lit("tok"), F.col("s")))
        boards = F.when(F.col("s") % 3 == 0, F.create_map(F.lit("logs"), F.lit("/explore")))
        return self.sql(recipes.DOCUMENTS).select(F.to_json(F.struct(
            "document", F.struct(F.col("grafana_url").alias("base_url"), boards.alias("dashboard_templates")).alias("grafana"),
            F.struct(F.col("loki_url").alias("base_url")).alias("loki"), F.struct(F.col("alert_url").alias("base_url")).alias("alertmanager"),
            F.struct(F.col("otel_url").alias("endpoint")).alias("opentelemetry"),
            F.when(F.col("has_channels"), F.array(own, shared)).alias("notification_channels"), secrets.alias("credential_refs"))).alias("value"))

    def collectors(self) -> DataFrame:
        """Nested collectors, at most four targets each."""
        def probe(name: str, timeout) -> F.Column:
            return F.struct(F.lit(name).alias("name"), F.lit(None).cast("string").alias("query_template"), timeout.alias("timeout_ms"))

        kind = "array<struct<name:string,query_template:string,timeout_ms:int>>"
        own = F.array(probe(" waits ", F.col("own_timeout")), probe("", F.lit(1)), probe("storage", F.lit(0))).cast(kind)
        target = F.struct(
            "name", "environment", "host", "port", "database_name", F.col("credential").alias("credential_ref"),
            F.when(F.col("own_probes"), own).alias("probes"))
        shared = F.array(probe("sessions", F.lit(0)), probe(" blocking", F.lit(1500)), probe("  ", F.lit(7))).cast(kind)
        names = F.when(F.col("chosen").isNotNull(), F.array("chosen", F.lit("tgt-ghost")))
        flat = self.sql(recipes.TARGETS).withColumn("target", target)
        keys = ["id", "kind", "enabled", "c_credential", "c_environment", "scrape_interval", "chosen"]
        nested = flat.groupBy(*keys).agg(F.sort_array(F.collect_list("target")).alias("targets"))
        return nested.select(
            "id", "kind", "enabled", F.col("c_credential").alias("credential_ref"),
            F.struct(F.col("c_environment").alias("environment"), "scrape_interval", names.alias("target_names"), "targets",
                     shared.alias("probes")).alias("config"))
