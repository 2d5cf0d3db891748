"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves, each half has a codebook of its own, and the two codebooks span a grid of cells. Every vector is
listed in the cell of its nearest codewords. As a query it visits cells in order of the sum of both halves' squared distances
to the codewords (multi-sequence traversal: two sorted lists, a heap of the next pairs of positions), until that sum exceeds
the one of its own cell by a margin. The margin is set for ``target_recall``: on a bounded sample, partners at exactly the
cosine asked for are drawn around each vector, the worst case, and the margin covers that share of their cells. What a query
meets is verified by the cosine in double precision, so no link is below the limit.

Codebooks come from ``sample_rows`` vectors at most, the first by a hash, by k-means in numpy on the driver; every vector is
indexed. Vectors of each length have a grid of their own; a length that the sample holds less than twice has one cell. Equal
vectors are one entry with a number of copies. A cell's vectors and its visitors are both split into blocks of about ``block``,
and every block of the one meets every block of the other, so no group is larger than two blocks; a task counts links and
returns sums and the links of a spanning forest, never all pairs. A link counts for both ends, also where only one visited the
other's cell. Counting the links of a dense group of different vectors takes work in the square of its size, as the count itself
asks for it. A codebook has ``most_words`` words at most: in tables of more than ``cell_rows * most_words ** 2`` vectors, 17
million, cells grow with the table and are met block by block, so raise it with the table.

Defined results: vectors that are null, zero, hold null or non-finite components link with nothing, and vectors of different
length not with each other. Copies link with each other. Rows that repeat an id and a vector count as copies. An empty table
gives no rows. A null id is kept and its row reported, with its component.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.components import components, stored


def k_means(points: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    draw = np.random.default_rng(seed)
    words = points[draw.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(turns):
        nearest = distances(points, words).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        words = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words)
    return words


def distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points ** 2).sum(axis=1)[:, None] - 2 * points @ words.T + (words ** 2).sum(axis=1), 0)


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    margin: float = 0.0

    @property
    def dimension(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(points[:, :cut], self.first), distances(points[:, cut:], self.second)

    def cells(self, points: np.ndarray) -> np.ndarray:
        one, two = self.halves(points)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)

    def visits(self, points: np.ndarray) -> Iterator[list[int]]:
        """Cells each point visits, nearest first."""
        one, two = self.halves(points)
        order_one, order_two = one.argsort(axis=1), two.argsort(axis=1)
        one, two = np.take_along_axis(one, order_one, 1), np.take_along_axis(two, order_two, 1)
        width = len(self.second)
        for a, b, names_a, names_b in zip(one.tolist(), two.tolist(), order_one.tolist(), order_two.tolist()):
            limit, cells, heap = a[0] + b[0] + self.margin, [], [(a[0] + b[0], 0, 0)]
            while heap:
                near, i, j = heapq.heappop(heap)
                if near > limit:
                    break
                cells.append(names_a[i] * width + names_b[j])
                # Each pair of positions is reached once: down the second list always, along the first only from its head.
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield cells

    def calibrate(self, points: np.ndarray, cosine: float, target_recall: float, seed: int, draws: int = 4) -> None:
        draw, excess = np.random.default_rng(seed), []
        at = np.arange(len(points))
        one, two = self.halves(points)
        own = one.min(axis=1) + two.min(axis=1)
        for _ in range(draws):
            away = draw.standard_normal(points.shape)
            away -= (away * points).sum(axis=1)[:, None] * points
            away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
            cell = self.cells(cosine * points + np.sqrt(1 - cosine ** 2) * away)
            excess.append(one[at, cell // len(self.second)] + two[at, cell % len(self.second)] - own)
        self.margin = float(np.quantile(np.concatenate(excess), target_recall)) + 1e-9


def as_matrix(values: list, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows are usable vectors of this length; the others are zero."""
    lengths = [len(v) if v is not None else -1 for v in values]
    points = np.full((len(values), dimension), np.nan)
    for i, (value, n) in enumerate(zip(values, lengths)):
        if n == dimension and n > 0:
            points[i] = [np.nan if x is None else x for x in value]
    largest = np.abs(points).max(axis=1, initial=0)
    good = np.isfinite(points).all(axis=1) & (largest > 0) & (dimension > 0)
    points[~good] = 0
    points = points / np.where(good, largest, 1)[:, None]  # so that the square sum neither overflows nor vanishes
    return points / np.where(good, np.linalg.norm(points, axis=1), 1)[:, None], good


def fit(sample: list, n_rows: int, cosine: float, target_recall: float, cell_rows: int, most_words: int, seed: int) -> dict[int, Grid]:
    """A grid for each length of vector that the sample holds twice."""
    grids = {}
    for length in {len(v) for v in sample if v}:
        points, good = as_matrix([v for v in sample if v and len(v) == length], length)
        points = points[good]
        if len(points) < 2:
            continue
        words = int(np.clip(round((n_rows * len(points) / len(sample) / cell_rows) ** 0.5), 1, most_words))
        cut = length // 2
        grid = Grid(k_means(points[:, :cut], words, seed), k_means(points[:, cut:], words, seed + 1))
        grid.calibrate(points, cosine, target_recall, seed + 2)
        grids[length] = grid
    return grids


def one_cell(length: int) -> Grid:
    return Grid(np.zeros((1, length // 2)), np.zeros((1, length - length // 2)), 4.0)


def assign(entries: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Usable entries: ``entry``, ``copies``, the length ``dim``, ``cell``, the cells they visit and their unit vector."""
    names = ["entry", "copies", "dim", "cell", "visits", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                values = part.column(2).to_pylist()
                for length in {len(v) for v in values if v}:
                    grid = grids.get(length) or one_cell(length)
                    points, good = as_matrix(values, length)
                    points, keep = points[good], pa.array(good)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).filter(keep), part.column(1).filter(keep), pa.array(np.full(len(points), length, np.int32)),
                        pa.array(grid.cells(points), pa.int32()), pa.array(list(grid.visits(points)), pa.list_(pa.int32())),
                        pa.array([p.tobytes() for p in points], pa.binary())], names)

    return entries.select("entry", "copies", "embedding").mapInArrow(
        run, "entry long, copies long, dim int, cell int, visits array<int>, unit binary")


def compare(queries: DataFrame, listed: DataFrame, cosine: float) -> DataFrame:
    """Per block of visitors and block of a cell: ``a`` with ``n``, the copies it is linked with, where ``b`` is null; else a link of
    a spanning forest. A visitor that a listed vector does not visit in turn counts for that one here, too.
    """
    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or there.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        P = np.frombuffer(b"".join(there["unit"]), float).reshape(len(there), -1)
        entries, copies = there["entry"].to_numpy(), there["copies"].to_numpy()
        seen = [set(cells) for cells in there["visits"]]
        unseen = {home: np.array([home not in cells for cells in seen]) for home in set(asked["home"])}
        a, b, n = [], [], []
        group = np.arange(len(there))  # class of each listed vector within this task
        back = np.zeros(len(there), np.int64)  # copies of visitors that a listed vector does not visit
        for at in range(0, len(asked), 1_000):
            part = asked.iloc[at:at + 1_000]
            ids, homes, own = part["entry"].to_numpy(), part["home"].to_numpy(), part["copies"].to_numpy()
            Q = np.frombuffer(b"".join(part["unit"]), float).reshape(len(part), -1)
            near = (Q @ P.T >= cosine) & (ids[:, None] != entries)
            total = near @ copies
            for i in np.flatnonzero(total):
                partners = np.flatnonzero(near[i])
                back[partners] += own[i] * unseen[homes[i]][partners]
                a.append(ids[i])
                b.append(None)
                n.append(total[i])
                classes, first = np.unique(group[partners], return_index=True)
                for k in partners[first]:
                    a.append(ids[i])
                    b.append(entries[k])
                    n.append(0)
                if len(classes) > 1:
                    group[np.isin(group, classes)] = classes[0]
        for k in np.flatnonzero(back):
            a.append(entries[k])
            b.append(None)
            n.append(back[k])
        return pd.DataFrame({"a": np.array(a, "int64"), "b": pd.array(b, "Int64"), "n": np.array(n, "int64")})

    key = ["dim", "cell", "part", "visitors"]
    return queries.groupBy(*key).cogroup(listed.groupBy(*key)).applyInPandas(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, folder: str, cosine: float = 0.95, target_recall: float = 0.995, cell_rows: int = 64, most_words: int = 512,
                    sample_rows: int = 20_000, block: int = 2_000, seed: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``. ``folder`` is shared and new."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding"))
    # Equal vectors: an entry is numbered by a hash of its vector and told apart by the vector itself.
    entries = rows.groupBy("embedding").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    entries = stored(entries.withColumn("entry", F.xxhash64("embedding")), f"{folder}/entries")
    n_rows = entries.count()
    sample = [r[0] for r in entries.orderBy("entry").limit(sample_rows).select("embedding").collect()]
    grids = fit(sample, n_rows, cosine, target_recall, cell_rows, most_words, seed)
    assigned = stored(assign(entries, grids), f"{folder}/assigned")
    visitors = spark.read.parquet(f"{folder}/assigned").select(F.explode("visits").alias("cell"), "dim", F.col("cell").alias("home"), "entry", "copies", "unit")
    blocks = assigned.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    asked = visitors.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("visitor_parts"))
    sizes = stored(blocks.join(asked, ["dim", "cell"]), f"{folder}/cells", n_rows)

    def of(parts: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("entry", F.lit(salt)), F.col(parts)).cast("int")

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    listed = assigned.join(sizes, ["dim", "cell"]).select(
        "dim", "cell", of("parts", seed).alias("part"), each("visitor_parts").alias("visitors"), "entry", "copies", "visits", "unit")
    queries = visitors.join(sizes, ["dim", "cell"]).select(
        "dim", "cell", each("parts").alias("part"), of("visitor_parts", seed + 1).alias("visitors"), "home", "entry", "copies", "unit")
    found = stored(compare(queries, listed, cosine), f"{folder}/links")
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where(F.col("b").isNotNull()), f"{folder}/components")
    usable = (assigned.select("entry", F.lit(True).alias("usable")).join(counts, F.col("entry") == F.col("a"), "left")
              .join(roots, F.col("entry") == F.col("node"), "left")
              .select("entry", "usable", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "entry").alias("root")))
    usable = stored(usable, f"{folder}/usable", n_rows)
    named = stored(entries.drop("embedding").join(usable, "entry").groupBy("root").agg(F.min("first_id").alias("component_id")), f"{folder}/named", n_rows)
    of_entry = stored(entries.join(usable.join(named, "root"), "entry").select("embedding", F.col("n") + F.col("copies") - 1, "component_id")
                      .toDF("embedding", "n_links", "component_id"), f"{folder}/result")
    result = rows.join(of_entry, "embedding", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
