"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a row of frames: length of the payload (unsigned 64 bits), masked CRC-32C of those eight bytes, the payload,
masked CRC-32C of the payload, all little endian. That is the public framing of TFRecord files. A payload is the document
id (signed 64 bits), a byte that is 0 where the id is null, and the ids, unsigned 16 bits each if the vocabulary allows, else
32. Beside each data file lies an index of fixed-width entries: document id and that byte, offset and length of its frame, ids
before it in the file. A reader can so fetch any
frame in any order with one seek.

Documents are dealt to files by ranges of their id and sorted within them, so the files in order hold ascending ids. A task
writes its file under a name of its own, then returns a row about it; only the names in the committed table of those rows
count, so a repeated or lost attempt leaves a stray file and nothing else. Files are opened through pyarrow's file systems,
which know shared and remote stores.

Defined results: a null text is an empty one and has the end id only. A null document id is kept; its records come last.
Repeated ids keep one record each, in no set order among them. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchframe.llm.encoding import binary_offsets, grouped, id_encoder
from watchframe.llm.texts import whole_text

POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected; fixed value
MASK_DELTA = 0xA282EAD8  # added by the masking; fixed value of the format
BLOCK = 256  # bytes that one lane of the checksum takes
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])
HEAD = "<qB"  # what a payload begins with: the document id, 0 where it is null, and whether it is there
WRITE_BYTES = 4_000_000
FILE_BYTES = 512_000_000  # of input, for each file


@lru_cache(maxsize=1)
def _byte_tables() -> np.ndarray:
    """Four tables: the checksum register after a byte, and that followed by one to three zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    tables = [table]
    for _ in range(3):
        tables.append(tables[0][tables[-1] & 0xFF] ^ (tables[-1] >> np.uint32(8)))
    return np.array(tables)


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values on each of their four bytes."""
    return (tables[0][register & 0xFF] ^ tables[1][(register >> np.uint32(8)) & 0xFF]
            ^ tables[2][(register >> np.uint32(16)) & 0xFF] ^ tables[3][register >> np.uint32(24)])


@lru_cache(maxsize=1)
def _block_shifts() -> list[np.ndarray]:
    """Maps of the register over 2**k blocks of zero bytes, each by squaring the one before."""
    byte, tables = np.arange(256, dtype=np.uint32), _byte_tables()
    one = np.array([byte << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK // 4):
        one = _apply(tables[::-1], one)
    shifts = [one]
    for _ in range(39):
        shifts.append(_apply(shifts[-1], shifts[-1]))
    return shifts


def crc32c(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of consecutive stretches of ``data`` with the given lengths.

    The checksum is linear, so blocks of all stretches are taken side by side, each from an empty register, and their
    registers are moved over the blocks behind them and added up. A stretch is filled up with zeros in front, which an empty
    register does not see; the usual starting value is added to its first four bytes instead.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    blocks = np.maximum(1, -(-(np.maximum(lengths, 4)) // BLOCK))
    ends = np.cumsum(blocks) * BLOCK
    space = np.zeros(int(ends[-1]), np.uint8)
    source = np.frombuffer(data, np.uint8)
    begins = ends - lengths
    moved = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    space[np.arange(len(source)) + moved] = source
    long = lengths >= 4
    for k in range(4):
        space[begins[long] + k] ^= 0xFF
    tables, words = _byte_tables()[::-1], space.view("<u4").reshape(-1, BLOCK // 4)
    register = np.zeros(len(words), np.uint32)
    for k in range(BLOCK // 4):
        register = _apply(tables, register ^ words[:, k])
    behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(words))
    for k, shift in enumerate(_block_shifts()[:int(behind.max()).bit_length()]):
        moved = np.flatnonzero(behind >> k & 1)
        register[moved] = _apply(shift, register[moved])
    sums = np.bitwise_xor.reduceat(register, np.cumsum(blocks) - blocks)
    ends_of = np.cumsum(lengths)
    for i in np.flatnonzero(~long):  # too short to hold the starting value
        value = 0xFFFFFFFF
        for byte in data[ends_of[i] - lengths[i]:ends_of[i]]:
            value = int(_byte_tables()[0][(value ^ byte) & 0xFF]) ^ (value >> 8)
        sums[i] = value
    return sums ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    turned = (sums >> np.uint32(15)) | (sums << np.uint32(17))
    return turned + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The frames of some payloads."""
    lengths = np.fromiter(map(len, payloads), np.uint64, len(payloads))
    heads = lengths.astype("<u8").tobytes()
    head_sums = masked(crc32c(heads, np.full(len(payloads), 8)))
    sums = masked(crc32c(b"".join(payloads), lengths))
    return [heads[8 * i:8 * i + 8] + struct.pack("<I", a) + payload + struct.pack("<I", b)
            for i, (payload, a, b) in enumerate(zip(payloads, head_sums.tolist(), sums.tolist()))]


def unframe(frames: list[bytes], check: bool = True) -> list[bytes]:
    """The payloads of some frames; a wrong length or checksum raises ValueError."""
    payloads = [one[12:-4] for one in frames]
    if check and frames:
        lengths = np.fromiter(map(len, payloads), np.int64, len(payloads))
        heads = b"".join(one[:8] for one in frames)
        tail = b"".join(one[8:12] + one[-4:] for one in frames)
        sums = np.frombuffer(tail, "<u4").reshape(-1, 2)
        if (not np.array_equal(np.frombuffer(heads, "<u8"), lengths.astype(np.uint64))
                or not np.array_equal(sums[:, 0], masked(crc32c(heads, np.full(len(frames), 8))))
                or not np.array_equal(sums[:, 1], masked(crc32c(b"".join(payloads), lengths)))):
            raise ValueError("a record is damaged")
    return payloads


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, files: int | None = None, id_column: str = "doc_id",
          text_column: str = "text", wide: bool = False) -> DataFrame:
    """Write the ids of every document, ``end_id`` after each; return the committed table of files.

    ``folder`` must be shared by all executors. ``files`` is the number of ranges, by default that of shuffle partitions, or one
    for each ``FILE_BYTES`` of the input if that is more.
    The table has one row per file: ``name``, ``first_id``, ``last_id``, ``n_docs``, ``n_tokens``, ``n_bytes``, ``wide``.
    """
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scan_bytes(docs) // FILE_BYTES))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, name = id_encoder(path), uuid.uuid4().hex
        store, at = _open(folder)
        end = np.array([end_id], "<u4" if wide else "<u2").tobytes()
        data = index = None
        first = last = None
        n_docs = n_tokens = n_bytes = 0
        for batch in batches:
            row = 0
            for texts, ids in ((t, i) for part in grouped(batch.column(1), WRITE_BYTES) for t, i in encoder.encode(part)):
                take = len(texts)
                doc_ids = batch.column(0).slice(row, take)
                row += take
                ends = binary_offsets(ids) // 4
                flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[:ends[-1]]
                packed = memoryview(flat.astype("<u4" if wide else "<u2").tobytes())
                cuts = (ends * (4 if wide else 2)).tolist()
                there = np.logical_not(doc_ids.is_null().to_numpy(zero_copy_only=False))
                known = doc_ids.fill_null(0).to_numpy()
                payloads = [struct.pack(HEAD, d, t) + packed[a:b] + end for d, t, a, b in zip(known.tolist(), there.tolist(), cuts, cuts[1:])]
                frames = frame(payloads)
                entries = np.zeros(take, ENTRY)
                entries["doc_id"], entries["has_id"] = known, there
                entries["length"] = sizes = np.fromiter(map(len, frames), np.uint64, take)
                entries["offset"] = n_bytes + np.cumsum(sizes) - sizes
                counts = (np.diff(ends) + 1).astype(np.uint64)
                entries["before"] = n_tokens + np.cumsum(counts) - counts
                if data is None:
                    data = store.open_output_stream(f"{at}/{name}.records")
                    index = store.open_output_stream(f"{at}/{name}.index")
                    first = doc_ids[0].as_py()
                data.write(b"".join(frames))
                index.write(entries.tobytes())
                last = doc_ids[take - 1].as_py()
                n_docs, n_tokens, n_bytes = n_docs + take, n_tokens + int(counts.sum()), n_bytes + int(sizes.sum())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "first_id": first, "last_id": last, "n_docs": n_docs,
                                               "n_tokens": n_tokens, "n_bytes": n_bytes, "wide": wide}], SCHEMA)

    if not wide and vocabulary_size(path, end_id) > 1 << 16:
        raise ValueError("ids of this vocabulary need wide=True")
    order = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    schema = "name string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long, wide boolean"
    dealt.mapInArrow(save, schema).write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


SCHEMA = pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_tokens", "n_bytes")), ("wide", pa.bool_())])


def scan_bytes(docs: DataFrame) -> int:
    """The planner's estimate of a table's bytes, 0 where it knows none; it only sets how much goes to a file."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else 0


def vocabulary_size(path: str, end_id: int) -> int:
    return max(id_encoder(path).library.get_vocab_size(with_added_tokens=True), end_id + 1)


def starts(files: DataFrame) -> DataFrame:
    """The table of files with ``start``: the ids in the files before. One small row per file meets in one task."""
    order = Window.orderBy(F.col("first_id").asc_nulls_last(), F.col("last_id").asc_nulls_last(), "name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def read(files: DataFrame, folder: str, entries: int = 2_000, check: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """Read records back: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` as little-endian unsigned 32-bit
    integers.

    Each file is cut into runs of ``entries`` index entries, which are dealt over the tasks. With ``shuffle_seed`` the runs
    and the records within them are visited in a seeded order, by their offsets in the index.
    """
    spark = files.sparkSession
    runs = starts(files).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_docs") - 1) / entries))))
    runs = runs.select("name", "run", "start", "wide")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(tasks, F.xxhash64(F.lit(shuffle_seed or 0), "name", "run"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, at), head = _open(folder), struct.calcsize(HEAD)
        for batch in batches:
            for name, run, start, is_wide in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{at}/{name}.index") as index:
                    index.seek(run * entries * ENTRY.itemsize)
                    table = np.frombuffer(index.read(entries * ENTRY.itemsize), ENTRY)
                with store.open_input_file(f"{at}/{name}.records") as data:
                    data.seek(int(table["offset"][0]))
                    raw = data.read(int(table["offset"][-1] + table["length"][-1] - table["offset"][0]))
                base = table["offset"] - table["offset"][0]
                visit = np.arange(len(table))
                if shuffle_seed is not None:
                    visit = np.random.default_rng([shuffle_seed, run, int(table["doc_id"][0]) & 0x7FFFFFFF]).permutation(len(table))
                frames = [raw[a:a + n] for a, n in zip(base[visit].tolist(), table["length"][visit].tolist())]
                ids = [p[head:] if is_wide else np.frombuffer(p, "<u2", offset=head).astype("<u4").tobytes() for p in unframe(frames, check)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(table["doc_id"][visit], mask=table["has_id"][visit] == 0), pa.array((table["before"][visit] + np.uint64(start)).astype(np.int64)),
                    pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return dealt.mapInArrow(load, "doc_id long, start long, ids binary")


def digests(records: DataFrame) -> DataFrame:
    """Per record: ``doc_id``, ``start``, ``n_tokens`` and the unsigned CRC-32 of its ids."""
    return records.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
