"""Best-fit packing of tokenized documents into sequences of a fixed capacity, planned over a histogram of lengths.

Documents longer than the capacity are cut into full pieces, the first of which may be shorter. Only the number of pieces of
each length goes to the driver, ``capacity`` numbers at most. There best-fit runs from the longest length down, over counts:
open sequences with the same room form one class, a contiguous range of sequence numbers; the class with the least room that
fits takes as many pieces of the length in each of its sequences as go in, and is left as one class or, at the end of a count,
as up to three. So the plan's size follows the capacity, never the number of documents: a class is at most halved in room by
each length it takes, so it is touched log2(capacity) times, and a length adds three classes at most.

Pieces then take the planned slots by joining on their rank within their length. A rank is the number of pieces of the length in
the parts before, one sum for each part and length, plus the place within the part, counted while the part was written; so no
length is ever ordered in one task, however many pieces share it. A part is what one committed task wrote.

Defined results: a null or empty text has the end id alone. Texts of any length are cut whole. A null id is kept. Repeated rows
are packed as often as they occur. An empty table gives no rows and no sequences. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchframe.llm.components import stored
from watchframe.llm.encoding import binary_offsets, id_encoder
from watchframe.llm.texts import whole_text

STEPS = np.dtype([("length", "i8"), ("rank", "i8"), ("each", "i8"), ("sequence", "i8"), ("offset", "i8")])


def cut(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text",
        with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: the document's id, ``piece``, ``start``, ``length``, ``ids_crc32``, the ``part`` of the
    task and the ``place`` among the part's pieces of this length; ``ids``, unsigned 32 bits each, if asked for.
    """
    names = [id_column, "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = id_encoder(path), uuid.uuid4().int >> 65, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for texts, ids in encoder.encode(batch.column(1)):
                ends = binary_offsets(ids) // 4
                flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[:ends[-1]]
                flat = np.insert(flat, ends[1:], end_id)
                sizes = np.diff(ends).astype(np.int64) + 1
                pieces = -(-sizes // capacity)
                first = sizes - (pieces - 1) * capacity
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                data = memoryview(flat.astype("<u4").tobytes())
                bounds = list(zip((begin * 4).tolist(), ((begin + length) * 4).tolist()))
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                new = np.concatenate(([True], np.diff(sorted_length) != 0))
                within = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                place = np.empty(len(order), np.int64)
                place[order] = seen[sorted_length] + within
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(at, len(texts)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array([zlib.crc32(data[a:b]) for a, b in bounds], pa.int64()),
                           pa.array(np.full(len(row), part)), pa.array(place)]
                if with_ids:
                    columns.append(pa.array([bytes(data[a:b]) for a, b in bounds], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)

    rows = docs.select(F.col(id_column), whole_text(text_column).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, part long, place long"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit over counts, longest first. A step says where pieces of ``length`` go from ``rank`` on: the k-th of them into
    sequence ``sequence + k // each``, at ``offset + k % each * length``.
    """
    rooms: list[int] = []  # rooms of open classes, in order
    classes: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of sequences
    steps, sequences = [], 0

    def keep(room: int, first: int, size: int) -> None:
        if room and size:
            if room not in classes:
                insort(rooms, room)
            classes.setdefault(room, []).append((first, size))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, size = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room = capacity
                first, size = sequences, -(-left // (capacity // length))
                sequences += size
            each = room // length
            steps.append((length, rank, each, first, capacity - room))
            full, some = divmod(min(left, each * size), each)
            keep(room - each * length, first, full)
            keep(room - some * length, first + full, int(some > 0))
            keep(room, first + full + (some > 0), size - full - (some > 0))
            taken = full * each + some
            rank, left = rank + taken, left - taken
    return np.array(steps, STEPS)


def pack(docs: DataFrame, folder: str, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
         text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids``
    if asked for. Within a sequence, pieces lie without gaps from 0. ``folder`` is shared and new.
    """
    pieces = stored(cut(docs, path, capacity, end_id, id_column, text_column, with_ids), f"{folder}/pieces")
    parts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), f"{folder}/parts")
    steps = plan({r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    kept = [c for c in pieces.columns if c not in ("part", "place", "ids")]
    last = ["ids"] if with_ids else []
    ranked = pieces.join(parts.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select(*kept, *last, (F.col("before") + F.col("place")).alias("rank"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Steps in order of length and rank; a piece's step is the last one that is not after it.
        order = np.lexsort((steps["rank"], steps["length"]))
        at = steps[order]
        key = at["length"] << 48 | at["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            step = at[np.searchsorted(key, length << 48 | rank, "right") - 1]
            k = rank - step["rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(step["sequence"] + k // step["each"]),
                 pa.array(step["offset"] + k % step["each"] * length), *(batch.column(c) for c in last)], names)

    names = [*kept, "sequence_id", "offset", *last]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*kept).schema)
    return ranked.mapInArrow(take, f"{schema}, sequence_id long, offset long" + (", ids binary" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: ``sequence_id``, ``length`` and ``ids``. No sequence holds more than
    the capacity, so no group is large.
    """
    laid = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("laid"))
    return laid.select("sequence_id", "length", F.expr("aggregate(laid, cast('' as binary), (all, one) -> concat(all, one.ids))").alias("ids"))
