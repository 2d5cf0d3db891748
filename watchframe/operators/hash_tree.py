"""Differences of stored tables by a tree of row hashes, so that only what differs is read and joined.

A version of a table is stored with its rows in order of a leaf, a hash of their key, and with a tree: per leaf the number of rows and
the sums of pieces of their hashes, and on each level above the sums of ``FANOUT`` nodes below. Two versions are compared from the
root down, children only of nodes that differ. The rows of differing leaves alone are then read, which the files' own statistics
on the leaf serve, and joined by key. Sums do not depend on the order of rows, and are added up where the rows lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchframe.operators import audit

FANOUT, LEVELS = 16, 3  # 4,096 leaves
LEAF = "_leaf"


def leaf_of(key: Sequence[str], levels: int = LEVELS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FANOUT ** levels)).cast("int")


def tree(rows: DataFrame, columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """Nodes of all levels over rows that know their leaf: ``level`` (0 at the leaves), ``node``, ``n`` and sums of row hashes."""
    sums = audit.hash_sums(audit.row_version(columns))
    nodes = [rows.groupBy(F.lit(0).alias("level"), F.col(LEAF).alias("node")).agg(F.count("*").alias("n"), *sums)]
    names = [c for c in nodes[0].columns if c not in ("level", "node")]
    for level in range(1, levels + 1):
        up = nodes[0].groupBy(F.lit(level).alias("level"), F.expr(f"node div {FANOUT ** level}").cast("int").alias("node"))
        nodes.append(up.agg(*[F.sum(c).alias(c) for c in names]))
    return reduce(DataFrame.union, nodes)


def store(df: DataFrame, key: Sequence[str], folder: str, levels: int = LEVELS) -> None:
    """Write a version: its rows by leaf, and its tree. Columns named ``_leaf`` are taken by the leaf."""
    rows = df.drop(LEAF).withColumn(LEAF, leaf_of(key, levels))
    rows.repartitionByRange(LEAF, *key).sortWithinPartitions(LEAF).write.parquet(f"{folder}/rows")
    stored = df.sparkSession.read.parquet(f"{folder}/rows")
    tree(stored, [c for c in df.columns if c != LEAF], levels).write.parquet(f"{folder}/tree")


def differing_leaves(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> list[int]:
    """Leaves whose rows differ, by two trees; on each level only children of differing nodes are looked at.

    The driver holds numbers of nodes, as many as a level has at most.
    """
    sums = [c for c in old.columns if c not in ("level", "node")]
    found: list[int] | None = None
    for level in range(levels, -1, -1):
        sides = []
        for df in (old, new):
            side = df.filter(F.col("level") == level)
            if found is not None:
                side = side.filter(F.expr(f"node div {FANOUT}").isin(found))
            sides.append(side.select("node", F.struct(*sums).alias("sums")))
        one, two = (side.withColumnRenamed("sums", name) for side, name in zip(sides, ("one", "two")))
        changed = one.join(two, "node", "full_outer").filter(~F.col("one").eqNullSafe(F.col("two")))
        found = sorted(r["node"] for r in changed.select("node").collect())
        if not found:
            return []
    return found


def rows_of(spark: SparkSession, folder: str, leaves: Sequence[int]) -> DataFrame:
    """The rows of some leaves of a stored version."""
    return spark.read.parquet(f"{folder}/rows").filter(F.col(LEAF).isin(list(leaves))).drop(LEAF)


def diff(spark: SparkSession, old: str, new: str, key: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """Rows added, updated or removed between two stored versions, as ``audit.diff`` reports them; rows of equal leaves are not read."""
    leaves = differing_leaves(spark.read.parquet(f"{old}/tree"), spark.read.parquet(f"{new}/tree"), levels)
    changes = audit.diff(rows_of(spark, old, leaves), rows_of(spark, new, leaves), key)
    return changes.filter(F.col("change") != "unchanged")
