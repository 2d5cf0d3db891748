"""Runs of periodic words, by a dictionary of basic factors.

For each power of two the dictionary names the factors of that many words: two factors have one name if they are equal and of
the same document. The names of the next power come from pairs of names; a factor that occurs once needs none, as nothing longer
that begins there can repeat, so the dictionary shrinks fast in plain text. For a length, the next occurrence of each factor is
looked up among those that lie with it within twice that length. Within a run of period q, occurrences of a factor of q words or
more are q apart, so they form arithmetic progressions and propose q; a factor shorter than q may recur within the period, a
factor of 2q words or more proposes nothing new. Hence each length proposes the periods over half of it up to itself, and every
period has one length.

Progressions with the same step that begin at neighbouring words are parts of one run, so a proposal is extended by walking over
neighbours as long as the step stays, and counts once: the run reaches from the first neighbour to the end of the last one's
second factor, and its neighbours on both sides break the period. The step is the smallest period, as a smaller one would be met
first. Runs shorter than three periods may be missed, so ``least_exponent`` is 3 or more; all others are found.

Documents are laid end to end in flat arrays, about ``GROUP_WORDS`` words at a time, so work per document is small; one document
is held whole. There is no shuffle.

Defined results: null and empty texts and texts of white space have no words, no runs and an empty collapsed text. A null id is
kept; repeated rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.encoding import grouped
from watchframe.llm.texts import whole_text

GROUP_BYTES = 6_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words in a row, the words by number, and where each text's words begin, with the end of the last.

    Words end at ASCII white space only.
    """
    cut = pc.ascii_split_whitespace(texts)
    words = cut.flatten()
    there = pc.not_equal(words, "")
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    coded = words.filter(there).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, before[cut.offsets.to_numpy()]


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of equal codes, and which codes occur twice or more."""
    _, names, counts = np.unique(codes, return_inverse=True, return_counts=True)
    return names, counts[names] > 1


def find(words: np.ndarray, bounds: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, in order of start and period. ``bounds`` cuts the words into documents."""
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    names, again = numbered(words + np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1))
    at, names = np.flatnonzero(again), names[again]
    starts, lengths, periods = [], [], []
    longest, size = int(sizes.max(initial=0)), 1
    while len(at) and (size // 2 + 1) * least_exponent <= longest:
        order = np.argsort(names, kind="stable")  # by name, then place
        here, step = at[order][:-1], np.diff(at[order])
        near = (np.diff(names[order]) == 0) & (step <= size) & (step > size // 2)
        order = np.argsort(here[near])
        here, step = here[near][order], step[near][order]
        if len(here):
            first = np.flatnonzero(np.concatenate(([True], (np.diff(here) != 1) | (np.diff(step) != 0))))
            count = np.diff(np.concatenate((first, [len(here)])))
            length = count - 1 + size + step[first]
            enough = length >= np.maximum(least_length, least_exponent * step[first])
            starts.append(here[first][enough])
            lengths.append(length[enough])
            periods.append(step[first][enough])
        name_at = np.full(len(words), -1, np.int64)
        name_at[at] = names
        at = at[at + 2 * size <= end[at]]
        at = at[name_at[at + size] >= 0]
        names, again = numbered(name_at[at] * (int(names.max()) + 1) + name_at[at + size])
        at, names, size = at[again], names[again], 2 * size
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = map(np.concatenate, (starts, lengths, periods))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeats(words: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per document: its id, ``n_words``, ``runs`` (``start``, ``length`` and ``period`` in words, by start, then period) and
    ``collapsed``, the words joined by one blank without those that a run repeats.
    """
    if least_exponent < 3:
        raise ValueError("runs of fewer than three periods may be missed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(1), GROUP_BYTES):
                words, spelled, bounds = words_of(texts)
                start, length, period = find(words, bounds, least_length, least_exponent)
                kept = ~repeats(len(words), start, length, period)
                ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
                left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled.take(pa.array(words[kept])))
                of = np.searchsorted(start, bounds)  # runs before each document
                fields = [pa.array(start - np.repeat(bounds[:-1], np.diff(of))), pa.array(length), pa.array(period)]
                found = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.diff(bounds)), found,
                                                  pc.binary_join(left, " ")], names)
                at += len(texts)

    names = [id_column, "n_words", "runs", "collapsed"]
    rows = docs.select(F.col(id_column), (whole_text() if text is None else F.coalesce(text, F.lit(""))).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, words: Column) -> Column:
    """Words of which those from a place on repeat, in a tenth of all documents; place and period follow the id's checksum."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    return F.when((h % 10 == 0) & (n > 0), F.transform(words, lambda w, i: F.when(i < a, w).otherwise(words[a + (i - a) % p]))).otherwise(words)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: ``n_runs``, the longest run with its exponent in thousandths, digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("long"), (-r["start"]).alias("early"), (-r["period"]).alias("short"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    told = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    return told.select(
        id_column, F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.early")).alias("start"), F.col("longest.long").alias("length"),
        (-F.col("longest.short")).alias("period"), F.expr("1000 * longest.long div -longest.short").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
