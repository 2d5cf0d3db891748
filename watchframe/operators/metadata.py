"""Queries over the metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def scheduled_probes(
    targets: DataFrame, environments: DataFrame, assignments: DataFrame, definitions: DataFrame,
    engine: str, collector_id: str, environment_slug: str = "", target_names: Sequence[str] = (),
) -> DataFrame:
    """Active probes per target, in no set order.

    ``collector_id`` is only written out. Join sides are left to the optimizer, which broadcasts
    those it knows to be small.
    """
    t = targets.filter((F.col("engine") == engine) & (F.col("status") == "active"))
    if target_names:
        t = t.filter(F.col("name").isin(*target_names))
    e = environments.select(F.col("id").alias("environment_id"), F.col("slug").alias("environment_slug"))
    if environment_slug:
        e = e.filter(F.col("environment_slug") == environment_slug)
    a = assignments.filter("enabled").select(
        F.col("id").alias("probe_assignment_id"), F.col("database_target_id").alias("target_id"),
        "probe_definition_id", "interval_seconds")
    d = definitions.filter("enabled").select(
        F.col("id").alias("probe_definition_id"), F.col("name").alias("probe_name"),
        F.col("category").alias("probe_category"), "query_template", "timeout_ms")
    t = t.select(
        F.col("id").alias("target_id"), "environment_id", F.col("name").alias("target_name"), "engine", "host", "port",
        F.coalesce("database_name", F.lit("")).alias("database_name"), "credential_ref")
    joined = a.join(t.join(e, "environment_id"), "target_id").join(d, "probe_definition_id")
    # The columns of a schedule.
    return joined.select(
        F.lit(collector_id).alias("collector_id"), "target_id", "environment_slug", "target_name", "engine", "host",
        "port", "database_name", "credential_ref", "probe_assignment_id", "probe_definition_id", "probe_name",
        "probe_category", "query_template", "timeout_ms", "interval_seconds",
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The newest ``n`` rows per key.

    A rank limit is applied before the shuffle as well, so a hot key sends ``n`` rows per task.
    """
    order = [c if isinstance(c, Column) else F.col(c).desc() for c in newest]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def newest_investigations(investigations: DataFrame, key: str = "environment_id", n: int = 10) -> DataFrame:
    return newest_per_key(investigations, [key], [F.col("created_at").desc(), F.col("id")], n)


def newest_alert(alert_events: DataFrame) -> DataFrame:
    return newest_per_key(alert_events, ["application_id", "fingerprint"], [F.col("started_at").desc(), F.col("id")])


def report_runs_by_status(report_runs: DataFrame, status: str, n: int = 10) -> DataFrame:
    chosen = report_runs.filter(F.col("status") == status)
    return newest_per_key(chosen, ["application_id"], [F.col("created_at").desc(), F.col("id")], n)


def link_applications(applications: DataFrame, environments: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve requested (application, environment slug, user email) to their ids."""
    e = environments.select(F.col("id").alias("environment_id"), F.col("slug").alias("environment_slug"))
    a = applications.select(F.col("id").alias("application_id"), "environment_id", F.col("name").alias("application_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return requests.join(a.join(e, "environment_id"), ["application_name", "environment_slug"]).join(u, "user_email")
