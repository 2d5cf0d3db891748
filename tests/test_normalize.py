import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchframe.operators import contracts, logs, normalize

INGEST = datetime(2024, 6, 1)
PARSE, TIME, REQUIRED = normalize.REJECT_PARSE, normalize.REJECT_TIMESTAMP, normalize.REJECT_REQUIRED
OK = '"env":"p","app":"a","msg":"m"'


def run(spark, *docs):
    raw = spark.createDataFrame([(i, d, INGEST) for i, d in enumerate(docs)], "i int, value string, ingest_ts timestamp")
    rows = normalize.normalize(raw).withColumn("labels", normalize.text_labels(F.col("labels"))).orderBy("i").collect()
    return rows


CASES = [
    ('{"environment":5,"env":"p","app":"a","msg":"m"}', None),
    ('{"environment":"  ","env":"p","app":"a","msg":"m"}', REQUIRED),
    (f'{{{OK},"timestamp":"2024-01-01T00:00:00"}}', TIME),
    (f'{{{OK},"timestamp":"2024-01-01"}}', TIME),
    (f'{{{OK},"timestamp":"2024-02-30T00:00:00Z"}}', TIME),
    (f'{{{OK},"timestamp":"2024-01-01T00:00:60Z"}}', TIME),
    (f'{{{OK},"timestamp":"2024-01-01t00:00:00z"}}', TIME),
    (f'{{{OK},"timestamp":"x"}}', TIME),
    ('{"env":"p","app":"a","timestamp":"x"}', TIME),  # the timestamp is checked first
    ("{bad", PARSE), ("[1]", PARSE), ("", PARSE), ('"text"', PARSE), (f'{{{OK},"n":{{"x":1e400}}}}', PARSE),
    (f'{{{OK},"n":"1e400"}}', None),
    ("null", REQUIRED), ("{}", REQUIRED),
    (f'{{{OK}}} trailing', None),  # only the first JSON value is read
]


def test_reject_reasons(spark):
    rows = run(spark, *[c for c, _ in CASES])
    assert [r.reject_reason for r in rows] == [reason for _, reason in CASES]


def test_aliases_defaults_and_trimming(spark):
    rows = run(
        spark, '{"environment":5,"env":"p","app":"a","msg":"m"}',
        '{"env":"\\u00a0p\\t","module":" crm ","level":"WARN","text":"m","userId":"u","traceId":"t","ip":"1.2.3.4"}',
        '{"env":"a","env":"b","app":"a","msg":"m"}', f'{{{OK},"component":"","action":"go"}}')
    assert (rows[0].environment, rows[0].severity, rows[0].timestamp) == ("p", "info", INGEST)
    assert (rows[1].environment, rows[1].application, rows[1].severity) == ("p", "crm", "warn")
    assert (rows[1].user_id, rows[1].request_id, rows[1].client_ip) == ("u", "t", "1.2.3.4")
    assert rows[2].environment == "b"  # the last of two equal keys
    assert rows[3].component is None  # an empty first choice hides the next


@pytest.mark.parametrize("text,expected", [
    ("2024-01-01T00:00:00+02:00", datetime(2023, 12, 31, 22)),
    ("2024-01-01T1:00:00Z", datetime(2024, 1, 1, 1)),
    ("2024-01-01T00:00:00,123456789Z", datetime(2024, 1, 1, 0, 0, 0, 123456)),
    ("2024-01-01T00:00:00.5-23:30", datetime(2024, 1, 1, 23, 30, 0, 500000)),
    ("", INGEST),
])
def test_timestamps(spark, text, expected):
    assert run(spark, f'{{{OK},"timestamp":"{text}"}}')[0].timestamp == expected


def test_labels_keep_scalars_only(spark):
    rows = run(
        spark, f'{{{OK},"labels":{{"s":"x","n":1,"b":true,"z":null,"o":{{}},"r":[],"f":0.1234567890123456,"g":1e22}}}}',
        f'{{{OK},"labels":{{"z":null}}}}', f'{{{OK},"labels":"x"}}', f'{{{OK},"labels":null}}')
    assert rows[0].labels == {"s": "x", "n": "1", "b": "true", "f": "0.1234567890123456", "g": "1e+22"}
    assert [r.labels for r in rows[1:]] == [None, None, None]


def test_stored_rule_changes_the_keys(spark):
    raw = spark.createDataFrame([('{"env":"p","app":"a","msg":"m","log.line":"x"}', INGEST, 7)], "value string, ingest_ts timestamp, `my id` int")
    keys = normalize.field_keys_of('{"message": ["log.line", "msg"]}')
    row = normalize.accepted(normalize.normalize(raw, field_keys=keys)).first()
    assert (row.message, row["my id"]) == ("x", 7)


def test_envelope_leaves_out_empty_fields(spark):
    raw = spark.createDataFrame([(f'{{{OK},"user":"u","labels":{{"n":1}}}}', INGEST)], "value string, ingest_ts timestamp")
    events = normalize.accepted(normalize.normalize(raw))
    got = json.loads(events.select(normalize.envelope_json(events)).first()[0])
    assert got == {"timestamp": "2024-06-01T00:00:00Z", "environment": "p", "application": "a", "severity": "info",
                   "message": "m", "user_id": "u", "labels": {"n": 1}}


def test_parse_happens_once_under_filters(spark):
    raw = spark.createDataFrame([(f"{{{OK}}}", INGEST)], "value string, ingest_ts timestamp")
    events = normalize.accepted(normalize.normalize(raw)).filter("environment = 'p'")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_alert_deliveries(spark):
    raw = spark.createDataFrame([("{}",), ("null",), ("[1]",), ("{bad",), ("1",)], "value string")
    assert [r.accepted for r in normalize.alert_deliveries(raw).collect()] == [True, True, False, False, False]


def test_log_policy(spark):
    raw = spark.createDataFrame(
        [(1, f'{{{OK},"user":"u1","ip":"9","labels":{{"session_id":"s","k":"v"}}}}', INGEST),
         (2, f'{{{OK},"labels":{{"k":"{"x" * 257}"}}}}', INGEST),
         (3, f'{{{OK},"labels":{{{",".join(f"{chr(34)}l{i}{chr(34)}:1" for i in range(14))}}}}}', INGEST),
         (4, f'{{{OK},"timestamp":"2024-05-24T23:59:59Z"}}', INGEST),
         (5, f'{{{OK},"timestamp":"2024-05-25T00:00:00Z"}}', INGEST)],
        "event_id int, value string, ingest_ts timestamp")
    records = logs.log_records(normalize.accepted(normalize.normalize(raw)).withColumn("ingest_ts", F.lit(INGEST)), "j", ("source", "c"))
    rows = {r.event_id: r for r in logs.apply_log_policy(records, F.col("ingest_ts")).collect()}
    assert rows[1].labels == {"environment": "p", "application": "a", "k": "v", "source": "c"}
    assert json.loads(rows[1].body)["user_id"] == "u1"
    assert [rows[i].reject_reason for i in range(1, 6)] == [
        None, logs.REJECT_LABEL_LENGTH, logs.REJECT_LABEL_COUNT, logs.REJECT_TOO_OLD, None]


UUID = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"


@pytest.mark.parametrize("contract,doc,rules", [
    ("application_event", '{"timestamp":"2024-01-01T00:00:00Z","environment":"e","application":"a","severity":"s","message":"m"}', []),
    ("application_event", '{"timestamp":"yesterday","environment":"e","application":1,"severity":"s","x":1,"labels":{"k":[]}}',
     ["required:message", "additional", "format:timestamp", "type:application", "value_type:labels"]),
    ("application_event", "nope", ["parse"]), ("application_event", "[]", ["type"]),
    ("alert_evidence", '{"source_type":"s","title":"t","url":"http://h/p","metadata":{"any":[1]}}', []),
    ("alert_evidence", '{"source_type":"s","title":"t","url":"nowhere","metadata":1}', ["format:url", "type:metadata"]),
    ("session_investigation", f'{{"application_id":"{UUID}","time_start":"2024-01-01T00:00:00Z"}}', ["required:time_end"]),
    ("session_investigation", '{"application_id":"7","time_start":"2024-01-01T00:00:00Z","time_end":"2024-01-01T00:00:00Z"}', ["format:application_id"]),
    ("report_payload", f'{{"application_id":"{UUID}","period":{{"start":"2024-01-01T00:00:00Z","end":"2024-01-02T00:00:00Z"}},"sections":[{{"id":"a","title":"t","data":[1]}}]}}', []),
    ("report_payload", f'{{"application_id":"{UUID}","period":{{"start":"2024-01-01T00:00:00Z","to":1}},"sections":[{{"id":1}},{{"id":2,"title":"t","q":1}}]}}',
     ["required:period.end", "additional:period", "required:sections[].title", "type:sections[].id", "additional:sections[]"]),
])
def test_contracts(spark, contract, doc, rules):
    df = spark.createDataFrame([(doc,)], "value string")
    assert sorted(r.rule for r in contracts.contract_violations(df, contract).collect()) == sorted(rules)


@pytest.mark.parametrize("contract", sorted(contracts.CONTRACTS))
def test_a_payload_is_parsed_once_however_many_rules_there_are(spark, contract):
    df = spark.createDataFrame([("{}",)], "value string")
    plan = contracts.contract_violations(df, contract)._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(") == 1
    names = sum(1 + len(p.get("properties", {})) + len(p.get("items", {}).get("properties", {})) for p in contracts.CONTRACTS[contract]["properties"].values())
    assert plan.count("schema_of_variant(") <= names + 4
