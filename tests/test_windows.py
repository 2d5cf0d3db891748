"""Rolling bands, sweep lines, hash trees and merge tables against plain computation."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchframe.operators import audit, baselines, hash_tree, investigate, rolling, sweep
from watchframe.streaming.merge_table import MergeTable

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def values_of(kind, rng):
    return {
        "plain": lambda: rng.gauss(0, 50), "ties": lambda: float(rng.choice([0, -0.0, 1, 1, 5, -3])),
        "wide": lambda: rng.choice([1e-9, 1e9, -1e12, 3.0]) * rng.random()}[kind]()


@pytest.mark.parametrize("kind,window,chunk_width", [("plain", 3, 2), ("ties", 1, 5), ("wide", 6, 4), ("plain", 40, 64)])
def test_rolling_mad(spark, tmp_path, kind, window, chunk_width):
    rng, rows = random.Random(7), []
    for i in range(900):
        key = rng.choice(["a", "a", "a", "b", None])
        rows.append((key, T0 + timedelta(seconds=rng.randrange(-5 * 60, 30 * 60)), values_of(kind, rng), 1))
    rows += [("a", T0, None, 1), ("a", T0, float("nan"), 1), ("b", T0, float("inf"), 1), ("c", T0 + timedelta(days=9), 4.0, 1), ("d", T0, None, 1)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, value double, at int")
    got = rolling.rolling_mad(df, ["kind"], "value", 60, window, str(tmp_path / "r"), chunk_width=chunk_width).collect()
    held = defaultdict(list)
    for key, ts, value, _ in rows:
        if value is not None and np.isfinite(value):
            held[key, int(ts.timestamp()) // 60].append(value)
    assert Counter((r.kind, r.bucket) for r in got) == Counter((key, at * 60) for key, at in held)
    for r in got:
        values = np.concatenate([held.get((r.kind, r.bucket // 60 - i), []) for i in range(window)])
        middle = np.median(values)
        mad = np.median(np.abs(values - middle))
        assert r.n == len(values) and np.allclose([r.median, r.mad], [middle, mad], rtol=1e-12, atol=0 if kind == "wide" else 1e-12)
        assert np.isclose(r.upper, middle + 3 * 1.4826 * mad) and np.isclose(r.lower, middle - 3 * 1.4826 * mad)


def test_windows_add_and_subtract_buckets_only(spark, tmp_path):
    """A chunk of one key is handed histograms, one row per bucket and cell, however many rows there are."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") % 50 * 60).alias("ts"), (100 + F.floor(F.col("id") / 50) % 2).alias("value"))
    counts = rolling.counted(df, ["k"], "value", 60)
    assert rolling.histograms(counts, ["k"]).count() == 100
    got = rolling.rolling_mad(df, ["k"], "value", 60, 5, str(tmp_path / "r")).collect()
    assert len(got) == 50 and {(r.n, r.median, r.mad) for r in got if r.bucket >= 240} == {(4000, 100.5, 0.5)}


def test_rolling_mad_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "k string, ts timestamp, value double")
    assert rolling.rolling_mad(df, ["k"], "value", 60, 5, str(tmp_path / "r")).count() == 0


@pytest.mark.parametrize("chunk_s", [7, 100, 86_400])
def test_correlated_signals(spark, chunk_s):
    rng = random.Random(chunk_s)
    rows = [(rng.choice(["p", "p", "q", None]), rng.choice("xyz"), rng.randrange(-300, 700)) for _ in range(220)]
    rows += [("edge", "x", 899), ("edge", "y", 901), ("far", "x", 0), ("far", "y", 20), ("same", "x", 5), ("same", "y", 5), ("one", "x", 1), ("one", "x", 2)]
    df = spark.createDataFrame(rows, "env string, job string, started_s long")
    got = {(r.env, r.at_s): (r.n_signals, r.n_alerts) for r in sweep.correlated_signals(df, ["env"], 20, "job", chunk_s=chunk_s).collect()}
    want = {}
    for env, _, at in rows:
        near = [job for e, job, s in rows if e == env and at - 20 < s <= at]
        if len(set(near)) >= 2:
            want[env, at] = (len(set(near)), len(near))
    assert got == want and got["edge", 901] == (2, 2) and got["same", 5] == (2, 2)
    assert ("far", 20) not in got and ("one", 2) not in got
    assert sweep.correlated_signals(df.limit(0), ["env"], 20, "job").count() == 0


def test_running_totals_cross_chunks(spark):
    rows = [("k", t, 1) for t in range(0, 100, 3)] + [("k", t + 40, -1) for t in range(0, 100, 3)]
    got = {r["at"]: r.n for r in sweep.running_totals(spark.createDataFrame(rows, "k string, at long, n long"), ["k"], "at", ["n"], 10).collect()}
    assert got == {at: sum(n for _, t, n in rows if t <= at) for _, at, _ in rows}


def people(spark, edits):
    rows = {i: (i, f"name {i}", i % 7, None if i % 11 == 0 else float(i)) for i in range(4_000)}
    for i, row in edits.items():
        rows.pop(i, None)
        if row is not None:
            rows[i] = row
    return spark.createDataFrame(list(rows.values()), "id long, name string, n int, x double").repartition(3)


@pytest.mark.parametrize("edits", [
    {}, {5: (5, "name 5", 5, 5.5)}, {7: None, 9: (9, None, 2, 9.0), 22: (22, "name 22", 1, 0.0), 5000: (5000, "new", 1, None), 5001: (5001, None, None, None)},
    {i: None for i in range(4_000)}])
def test_trees_find_what_differs(spark, tmp_path, monkeypatch, edits):
    old, new, read = people(spark, {}), people(spark, edits), []
    for name, df in (("old", old), ("new", new)):
        hash_tree.store(df, ["id"], str(tmp_path / name))
    rows_of = hash_tree.rows_of

    def counted(*args):
        read.append(rows_of(*args).count())
        return rows_of(*args)

    monkeypatch.setattr(hash_tree, "rows_of", counted)
    got = hash_tree.diff(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["id"])
    want = audit.diff(old, new, ["id"]).filter("change <> 'unchanged'")
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect())) and got.count() == len(edits)
    if len(edits) < 10:  # a leaf has about one row
        assert sum(read) <= 30 * len(edits)
    if not edits:
        assert read == [0, 0]


def test_tree_sums_ignore_the_order_of_rows(spark, tmp_path):
    a, b = (people(spark, {}).repartition(n).withColumn("_leaf", hash_tree.leaf_of(["id"])) for n in (1, 5))
    one, two = (sorted(map(str, hash_tree.tree(df, ["id", "name", "n", "x"]).collect())) for df in (a, b))
    assert one == two


def test_merge_table(spark, tmp_path):
    rng, table = random.Random(5), MergeTable(spark, str(tmp_path / "t"), ["k"], "v", fanout=3)
    written, state, own = Counter(), {}, Counter()
    write = table._write

    def watched(rows, run):
        write(rows, run)
        written[run] = spark.read.parquet(f"{table.root}/runs/{run}").count()

    table._write = watched
    for batch in range(20):
        rows = [(rng.choice([None, *"abcdefgh"]), batch * 100 + i, f"{batch}.{i}") for i in range(30)]
        for k, v, text in rows:
            state[k] = max(state.get(k, (-1, "")), (v, text))
        frame = spark.createDataFrame(rows, "k string, v long, text string")
        table.add(frame, batch)
        own[batch] = len({k for k, _, _ in rows})
        assert written[f"{batch:09d}-0"] == own[batch]  # a batch writes its own rows, and merges
        levels = Counter(level for level, _ in table.runs(batch))
        assert all(n < 3 for n in levels.values()) and len(levels) <= 4
        if batch in (2, 8, 11):  # a repeated batch, merges included, comes to the same table
            before = table.runs(batch)
            table.add(frame, batch)
            assert table.runs(batch) == before
    assert {r.k: (r.v, r.text) for r in table.read().collect()} == state
    per_level = Counter()
    for run, n in written.items():
        per_level[run.split("-")[1]] += n
    assert all(n <= sum(own.values()) for n in per_level.values()) and len(per_level) <= 4


def test_breaches_of_few_keys_spread(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 = 0, NULL, CAST(id % 2 AS STRING)) AS k", "CAST(id % 1000 AS DOUBLE) AS v", "map('a', id) AS m")
    band = spark.createDataFrame([("0", 500.0), (None, 700.0)], "k string, upper double")
    found = baselines.hybrid_breaches(rows, band, ["k"], "v", 900.0)
    assert found.columns == ["k", "v", "m", "upper", "cause"]
    want = {}
    for i in range(4000):
        k, v = None if i % 3 == 0 else str(i % 2), float(i % 1000)
        upper = {"0": 500.0, None: 700.0}.get(k)
        if v > 900 or (upper is not None and v > upper):
            cause = (k, "static" if v > 900 else "adaptive")
            want[cause] = want.get(cause, 0) + 1
    assert {(r.k, r.cause): r["count"] for r in found.groupBy("k", "cause").count().collect()} == want


def test_sessions_do_not_depend_on_chunks(spark):
    rows = spark.range(3000).selectExpr("id % 4 AS u", "timestamp_seconds((id * 104729) % 900000) AS ts")
    got = [sorted(map(tuple, investigate.sessions(rows, ["u"], chunk_s=c).collect())) for c in (60, 10_800, 864_000)]
    assert got[0] == got[1] == got[2] and sum(r[-1] for r in got[0]) == 3000
