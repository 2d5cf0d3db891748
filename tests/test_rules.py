"""Rules and alerts against plain loops over small random data, with chunks far narrower than the data."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from watchframe.operators import alerts, baselines, investigate, rules
from watchframe.operators.islands import gap_to_previous, islands
from watchframe.operators.quantiles import exact_quantiles, median_and_mad

BASE = 1_704_067_200


def at(seconds):
    return datetime.fromtimestamp(BASE + seconds, timezone.utc).replace(tzinfo=None)


def make_samples(seed, n=300, span=3600):
    rng = random.Random(seed)
    out, level = [], {}
    for t in sorted(rng.sample(range(span * 10), n)):
        s = rng.choice("aaab")  # one series holds most rows
        level[s] = 0.0 if rng.random() < 0.1 else level.get(s, 0.0) + rng.randint(0, 5)
        out.append((s, t / 10, level[s]))
    return out


def frame(spark, samples):
    return spark.createDataFrame([(s, at(t), v) for s, t, v in samples], "s string, ts timestamp, value double")


@pytest.mark.parametrize("step,chunk", [(15, 7), (60, 1), (7, 2400)])
def test_instant_vector(spark, step, chunk):
    samples = make_samples(1)
    got = {(r.s, r.step): r.value for r in rules.instant_vector(
        frame(spark, samples), ["s"], step_s=step, start=BASE, end=BASE + 3600, chunk_steps=chunk).collect()}
    want = {}
    first = -(-BASE // step) * step
    for k in range(first, BASE + 3601, step):
        for s in "ab":
            seen = [(t, v) for x, t, v in samples if x == s and k - 300 < BASE + t <= k]
            if seen:
                want[s, k] = max(seen)[1]
    assert got == want


@pytest.mark.parametrize("step,chunk", [(15, 7), (60, 1), (7, 2400)])
def test_rate(spark, step, chunk):
    samples = make_samples(2)
    got = {(r.s, r.step): r for r in rules.rate(
        frame(spark, samples), ["s"], step_s=step, start=BASE, end=BASE + 3600, chunk_steps=chunk).collect()}
    want = {}
    for k in range(-(-BASE // step) * step, BASE + 3601, step):
        for s in "ab":
            w = sorted((BASE + t, v) for x, t, v in samples if x == s and k - 300 < BASE + t <= k)
            if len(w) < 2:
                continue
            increase = w[-1][1] - w[0][1] + sum(p[1] for p, q in zip(w, w[1:]) if q[1] < p[1])
            sampled = w[-1][0] - w[0][0]
            average = sampled / (len(w) - 1)
            lead, tail = w[0][0] - (k - 300), k - w[-1][0]
            lead = average / 2 if lead >= 1.1 * average else lead
            if increase > 0 and w[0][1] >= 0:
                lead = min(lead, sampled * w[0][1] / increase)
            tail = average / 2 if tail >= 1.1 * average else tail
            want[s, k] = (len(w), increase, increase * (sampled + lead + tail) / sampled / 300)
    assert got.keys() == want.keys()
    for key, (n, increase, value) in want.items():
        assert got[key].n == n
        assert math.isclose(got[key].increase, increase, abs_tol=1e-9)
        assert math.isclose(got[key].rate, value, rel_tol=1e-6, abs_tol=1e-9)


def test_rate_shuffles_samples_once_and_their_cells_once(spark):
    df = rules.rate(frame(spark, make_samples(2)), ["s"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def runs_of(points, gap):
    out = []
    for p in sorted(points):
        if out and p - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = p, out[-1][2] + 1
        else:
            out.append([p, p, 1])
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("gap,width,n", [(1, 4, 60), (3, 5, 40), (30, 10, 30), (1, 1, 50), (2, 1000, 60)])
def test_islands(spark, gap, width, n):
    rng = random.Random(gap * width)
    points = {k: rng.sample(range(-50, 100), n) for k in "ab"}
    df = spark.createDataFrame([(k, p, 2) for k, ps in points.items() for p in ps], "k string, p bigint, w int")
    rows = islands(df, ["k"], "p", gap, width, ["w"]).collect()
    for k, ps in points.items():
        assert sorted((r.start, r.end, r.n) for r in rows if r.k == k) == runs_of(ps, gap)
    assert all(r.w == 2 * r.n for r in rows)


@pytest.mark.parametrize("reach,width", [(5, 7), (10, 3), (4, 100)])
def test_gap_to_previous(spark, reach, width):
    points = sorted(random.Random(reach).sample(range(200), 50))
    df = spark.createDataFrame([("k", p) for p in points], "k string, p bigint")
    got = {r.p: r.gap for r in gap_to_previous(df, ["k"], "p", reach, width).collect()}
    assert got == {p: (p - q if q is not None and p - q < reach else None) for q, p in zip([None, *points], points)}


def test_anchored_match(spark):
    df = spark.createDataFrame([("db",), ("xdb",), ("gw",), ("db\n",)], "job string")
    assert [r.job for r in df.filter(rules.matches(F.col("job"), "db|gw")).collect()] == ["db", "gw"]


def test_hold_states_and_events(spark):
    steps = [*range(0, 150, 15), *range(300, 405, 15), *range(600, 735, 15)]  # 10, 7 and 9 steps
    true_steps = spark.createDataFrame([("a", BASE + t) for t in steps], "job string, step bigint")
    spans = alerts.active_intervals(true_steps, ["job"], chunk_steps=4)
    states = {r.step - BASE: r.state for r in alerts.alert_states(spans, ["job"]).collect()}
    assert [t for t, s in sorted(states.items()) if s == "firing"] == [120, 135, 720]
    assert sorted(states) == steps
    rows = alerts.alert_events(spans, ["job"], "Down", "warning", BASE + 730).orderBy("started_s").collect()
    assert [(r.started_s - BASE, r.resolved_s and r.resolved_s - BASE, r.status) for r in rows] == [(120, 150, "resolved"), (720, None, "firing")]
    assert len({r.fingerprint for r in rows}) == 1


def test_annotations(spark):
    events = spark.createDataFrame([("a$1\\b", None)], "job string, zone string")
    row = alerts.annotate(events, {"s": "{{ $labels.job }} in {{$labels.zone}}!"}, ["job", "zone"]).first()
    assert row.s == "a$1\\b in !"


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_match_the_built_in_ones(spark, seed):
    rng = random.Random(seed)
    values = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([rng.gauss(0, 50), float(rng.randint(-3, 3)), 0.0, 1e-300, -1e300])) for _ in range(500)]
    df = spark.createDataFrame(values + [("one", 5.0), ("one", None)], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95, "max": 1.0}).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.05, 0.5, 0.95, 1.0)))).alias("q"), F.count("v").alias("n")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.k].n == r.n
        assert [got[r.k].lo, got[r.k].mid, got[r.k].hi, got[r.k].max] == pytest.approx(r.q, rel=1e-9, abs=1e-300)
    mads = {r.k: r.mad for r in median_and_mad(df, ["k"], "v").collect()}
    for k in ("hot", "one"):
        med = got[k].mid
        dev = sorted(abs(v - med) for x, v in values + [("one", 5.0)] if x == k)
        mid = len(dev) // 2
        assert mads[k] == pytest.approx(dev[mid] if len(dev) % 2 else (dev[mid - 1] + dev[mid]) / 2)


def test_sessions_split_on_pauses(spark):
    df = spark.createDataFrame([("u", at(t)) for t in (0, 1800, 3601, 90000, 90001)], "u string, ts timestamp")
    got = sorted(((r.start_us // 10**6 - BASE), (r.end_us // 10**6 - BASE), r.n_events) for r in investigate.sessions(df, ["u"]).collect())
    assert got == [(0, 1800, 2), (3601, 3601, 1), (90000, 90001, 2)]


def test_baseline_rows_round_trip(spark):
    band = spark.createDataFrame([("app", 1.5, 2.5)], "app string, lower double, upper double")
    rows = baselines.baseline_rows(band, F.col("app"), F.lit("latency"), "30d", "quantile", ["lower", "upper"], F.lit(at(0)))
    back = baselines.stored_parameters(rows, {"lower": "double", "upper": "double"}).first()
    assert (back.application_id, back.method, back.lower, back.upper) == ("app", "quantile", 1.5, 2.5)
