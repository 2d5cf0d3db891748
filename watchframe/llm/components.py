"""Connected components of links, by alternating stars, with every round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS_PER_TASK, LEAST_TASKS = 250_000, 8


def stored(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and Spark knows its size from then on.

    With ``rows``, a bound of the table's short rows, the number of tasks and files follows it, whatever the shuffle's is.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_PER_TASK)))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``links`` (columns ``a``, ``b``).

    Each round ties larger neighbours, then smaller ones, to the smallest neighbour known; the number of rounds grows with the
    logarithm of the component's size. Minima are aggregated before they are joined back, so a node of many links is no
    large group; nothing is collected but two numbers per round. Null nodes are left out; no links give no rows.
    """
    edges = (links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges, seen, turn = stored(edges, f"{folder}/edges-0"), None, 0
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, turn, size = mark, turn + 1, mark[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{folder}/least-{turn}", 2 * size)
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, f"{folder}/large-{turn}", size)
        below = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/below-{turn}", size)
        small = large.join(below, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(below.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/edges-{turn}", size)


class Forest:
    """Union-find over numbers, for what one task compares."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
