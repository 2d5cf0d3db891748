"""A table of newest rows per key that a stream keeps up to date by adding small runs and merging them now and then.

A batch writes its own rows, reduced and sorted by key, as a run of level 0. When a level holds ``fanout`` runs they are merged into
one run of the next level, so a row is written again once per level, a number that grows with the logarithm of the batches. A
manifest per batch lists the runs that make up the table after it; the reader unites these and keeps the newest row of each key.

Runs and manifests carry their batch's number, and a batch's manifest is made from the one before it and its own rows alone, so
a repeated batch overwrites what it wrote and comes to the same table. Runs that no manifest lists any more may be deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

FANOUT = 4
_MANIFEST = "level int, run string"


class MergeTable:
    """``keys`` name a row; of rows with one key the one with the greatest ``newest`` stays."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], newest: str, fanout: int = FANOUT):
        self.spark, self.root, self.keys, self.newest, self.fanout = spark, root, list(keys), newest, fanout

    def _reduced(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.newest).alias("_row"))
        return last.select(*self.keys, "_row.*").select(rows.columns)

    def _write(self, rows: DataFrame, run: str) -> None:
        self._reduced(rows).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.root}/runs/{run}")

    def _open(self, runs: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/runs/{r}" for r in runs])

    def runs(self, batch: int) -> list[tuple[int, str]]:
        """Level and name of the runs after a batch, oldest first; none before the first."""
        if batch < 0:
            return []
        listed = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/after={batch}")
        return sorted(((r["level"], r["run"]) for r in listed.collect()), key=lambda x: (-x[0], x[1]))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows; batches are numbered from 0 without gaps."""
        live = self.runs(batch - 1)
        name = f"{batch:09d}-0"
        self._write(rows, name)
        live.append((0, name))
        level = 0
        while sum(x == level for x, _ in live) >= self.fanout:
            name = f"{batch:09d}-{level + 1}"
            self._write(self._open([run for x, run in live if x == level]), name)
            live = [(x, run) for x, run in live if x != level] + [(level + 1, name)]
            level += 1
        manifest = self.spark.createDataFrame(live, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifests/after={batch}")

    def read(self, batch: int | None = None) -> DataFrame:
        """The table after a batch, by default the last one."""
        if batch is None:
            batch = self.spark.read.parquet(f"{self.root}/manifests").agg(F.max("after")).first()[0]
        return self._reduced(self._open([run for _, run in self.runs(batch)]))
