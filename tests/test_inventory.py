import json

import pytest
from pyspark.sql import functions as F

from watchframe.functions.timeparse import duration_seconds
from watchframe.operators import audit, inventory
from watchframe.schemas import COLLECTORS, INVENTORY
from watchframe.sources import sinks
from watchframe.sources.inventory import read_document, read_documents


def document(**over):
    doc = {
        "grafana": {"base_url": "http://g:3000", "dashboard_templates": {"logs": "/explore"}}, "loki": {"base_url": "http://l:3100"},
        "alertmanager": {"base_url": "http://a:9093"}, "opentelemetry": {"endpoint": "http://o:4318"},
        "notification_channels": [{"id": "hook", "channel_type": "webhook", "target_ref": "t", "credential_ref": "env/T"}],
        "credential_refs": {"one": "env/ONE"},
        "collectors": [
            {"id": "fleet-a", "kind": "sqlserver", "enabled": True, "credential_ref": "kv/fleet-a", "config": {
                "environment": "prod", "scrape_interval": "30s", "target_names": ["orders-1"], "probes": [{"name": "waits"}, {"name": "sessions"}],
                "targets": [{"name": "orders-1", "host": "h", "port": 1433, "credential_ref": "kv/orders-1"},
                            {"name": "spare", "host": "h", "port": 1433, "environment": " test ", "probes": [{"name": " "}, {"name": " storage "}]}]}},
            {"id": "sidecar", "kind": "otel", "enabled": True, "config": {}},
            {"id": "fleet-b", "kind": "sqlserver", "enabled": False, "credential_ref": "kv/off", "config": {"environment": "prod"}}]}
    doc.update(over)
    return doc


def read(spark, tmp_path, doc):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=1))
    return read_document(spark, str(path))


def test_enabled_collectors_and_inheritance(spark, tmp_path):
    resolved = inventory.resolve_collectors(inventory.collectors_of(read(spark, tmp_path, document())))
    on = inventory.enabled_collectors(resolved, "sqlserver").collect()
    assert [(c.id, c.environment, c.interval_s) for c in on] == [("fleet-a", "prod", 30.0)]
    core, spare = on[0].targets
    assert (core.environment_slug, [p.name for p in core.probes], core.credential_ref) == ("prod", ["waits", "sessions"], "kv/orders-1")
    assert (spare.environment_slug, [p.name for p in spare.probes], spare.credential_ref) == ("test", ["storage"], "kv/fleet-a")
    plan = inventory.inventory_schedule(resolved, "sqlserver").orderBy("probe_name").collect()
    assert [(r.target_name, r.probe_name, r.interval_seconds) for r in plan] == [("orders-1", "sessions", 30), ("orders-1", "waits", 30)]
    assert inventory.collector_violations(resolved).isEmpty()


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("1h1m1.5s", 3661.5), ("500ms", 0.5), ("-2m", -120), ("0", 0), (".5s", 0.5),
                                          ("10us", 0.00001), ("30", None), ("s", None), ("", None), ("1d", None)])
def test_durations(spark, text, seconds):
    got = spark.createDataFrame([(text,)], "t string").select(duration_seconds(F.col("t"))).first()[0]
    assert got is None if seconds is None else got == pytest.approx(seconds)


def collector(id="c", kind="sqlserver", ref="", interval="", names=None, targets=(), enabled=True):
    return (id, kind, enabled, ref, ("e", interval, names, list(targets), [("waits", None, None)]))


def target(name="t", host="h", port=1433, ref="", timeout=0):
    return (name, "", host, port, None, ref, [("p", "", timeout)])


def test_every_collector_rule(spark):
    rows = [
        collector(id=" "), collector(id="dup"), collector(id="dup"), collector(id="k", kind=""), collector(id="bad", interval="soon"),
        collector(id="neg", interval="-1s"), collector(id="ref", ref="plain"),
        collector(id="t", names=["ghost", "a"], targets=[target("a"), target("a"), target(""), target("h", host=""), target("p", port=70000),
                                                        target("r", ref="x"), target("n", timeout=-1)]),
        collector(id="free", names=["ghost"])]
    found = inventory.collector_violations(inventory.resolve_collectors(spark.createDataFrame(rows, COLLECTORS))).collect()
    assert sorted((r.collector_id, r.entity, r.rule) for r in found) == sorted([
        ("", "", "id_missing"), ("dup", "dup", "id_repeated"), ("k", "k", "kind_missing"), ("bad", "bad", "interval_unreadable"),
        ("neg", "neg", "interval_not_positive"), ("ref", "ref", "credential_not_a_reference"),
        ("t", "a", "name_repeated"), ("t", "", "name_missing"), ("t", "h", "host_missing"),
        ("t", "p", "port_range"), ("t", "r", "credential_not_a_reference"),
        ("t", "n", "timeout_negative"), ("t", "ghost", "name_unknown")])


def test_document_rules(spark, tmp_path):
    assert inventory.document_violations(read(spark, tmp_path, document())).isEmpty()
    bad = document(grafana={}, loki={"base_url": "nowhere"}, opentelemetry={"endpoint": "/x"}, notification_channels=[
        {"id": "", "channel_type": "c", "target_ref": "t"}, {"id": "a", "channel_type": "", "target_ref": "t"},
        {"id": "d", "channel_type": "c", "target_ref": "t", "credential_ref": "plain"}, {"id": "d", "channel_type": "c", "target_ref": "t"}])
    rules = sorted((r.entity, r.rule) for r in inventory.document_violations(read(spark, tmp_path, bad)).collect())
    assert rules == sorted([
        ("", "url_missing:grafana"), ("", "url_not_absolute:loki"), ("", "url_not_absolute:opentelemetry"),
        ("", "id_missing"), ("a", "channel_incomplete"), ("d", "credential_not_a_reference"), ("d", "id_repeated")])


def test_documents_are_told_apart(spark, tmp_path):
    channels = [{"id": "d", "channel_type": "c", "target_ref": "t"}]
    rows = [{"id": "one", **document(notification_channels=channels)}, {"id": "two", **document(notification_channels=channels * 2)},
            {"id": "three", **document(loki={}, notification_channels=None)}, {"id": None, **document(grafana=None)}]
    (tmp_path / "rows.json").write_text("\n".join(json.dumps(r) for r in rows))
    docs = read_documents(spark, str(tmp_path / "rows.json"), "id STRING")
    found = inventory.document_violations(docs, ["id"])
    assert sorted((r.id or "", r.entity, r.rule) for r in found.collect()) == [
        ("", "", "url_missing:grafana"), ("three", "", "url_missing:loki"), ("two", "d", "id_repeated")]
    assert inventory.document_violations(docs.limit(0), ["id"]).isEmpty()


def test_redaction_leaves_the_input_alone(spark, tmp_path):
    doc = read(spark, tmp_path, document())
    resolved = inventory.resolve_collectors(inventory.collectors_of(doc))
    red = {r.id: r for r in inventory.redact_collectors(resolved).collect()}
    assert red["fleet-a"].credential_ref == "kv/fleet-a:<redacted>" and red["sidecar"].credential_ref == ""
    assert red["fleet-a"].targets[0].credential_ref == "kv/orders-1:<redacted>"
    assert resolved.filter("id = 'fleet-a'").first().credential_ref == "kv/fleet-a"
    masked = inventory.redact_document(doc).first()
    assert masked.credential_refs == {"one": "<redacted>"} and masked.notification_channels[0].credential_ref == "env/T:<redacted>"
    filled = inventory.with_template_maps(doc).first()
    assert filled.loki.dashboard_templates == {} and filled.grafana.dashboard_templates == {"logs": "/explore"}


def test_diff_counts_disabled_as_removed(spark):
    old = spark.createDataFrame([collector("a"), collector("b"), collector("u"), collector("off")], COLLECTORS)
    new = spark.createDataFrame([collector("b", interval="5s"), collector("c"), collector("u"), collector("off", enabled=False)], COLLECTORS)
    rows = audit.diff(old, new, ["id"], (F.col("kind") == "sqlserver") & F.col("enabled")).collect()
    assert {r.id: r.change for r in rows} == {"a": "removed", "b": "updated", "c": "added", "u": "unchanged", "off": "removed"}


def test_invalid_candidate_never_becomes_current(spark, tmp_path):
    def rules(df):
        return inventory.collector_violations(inventory.resolve_collectors(df))

    root = str(tmp_path / "inventory")
    good, bad = spark.createDataFrame([collector("a")], COLLECTORS), spark.createDataFrame([collector("")], COLLECTORS)
    first, ok = sinks.publish(good, rules, root)
    assert ok and sinks.current_version(spark, root) == first
    second, ok = sinks.publish(bad, rules, root)
    assert not ok and second != first and sinks.current_version(spark, root) == first
    assert [r.id for r in sinks.read_current(spark, root).collect()] == ["a"]
    third, ok = sinks.publish(spark.createDataFrame([collector("b")], COLLECTORS), rules, root)
    assert ok and sinks.current_version(spark, root) == third


def test_equal_content_has_equal_version(spark):
    a = spark.createDataFrame([collector("a"), collector("b")], COLLECTORS)
    b = spark.createDataFrame([collector("b"), collector("a")], COLLECTORS).repartition(3)
    assert audit.table_version(a).first() == audit.table_version(b).first()
    assert audit.table_version(a).first() != audit.table_version(a.limit(1)).first()


def test_document_schema_is_complete(spark, tmp_path):
    assert read(spark, tmp_path, document()).schema.simpleString() == spark.createDataFrame([], INVENTORY).schema.simpleString()
