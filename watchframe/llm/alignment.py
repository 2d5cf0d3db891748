"""Alignment of two tokenizers' tokens of the same texts, and corpus counts of the id pairs they link.

A byte-level vocabulary (A) encodes a blank and the text, a vocabulary of pieces (B) the text, before which it puts that blank
itself. Both cut the same bytes, so each token is a range of bytes. In each batch ``pandas.merge_asof``, keyed by document, finds
for the start of every A token the B token that covers it, and for the start of every B token the A token that covers it. Two tokens
overlap just if one's start lies in the other, so the union of both directions holds every overlapping pair; tokens that start
together are found both ways and count once. Tokens that end together end a group, so a group begins where both start.

Texts go through once. What a batch links is kept as numbers into its own table of different id pairs, two or four bytes a link.
Pair counts of all batches are added up by Spark, and the totals go back to each batch by its table; so the shuffles hold
batches' tables and packed links, never a row per link, and no table of the whole vocabulary's pairs is held anywhere.

Defined results: texts that are null, empty, or whose A or B bytes differ from the blank and the text, have no tokens; all their
numbers are 0 and their groups empty. A null id is kept; repeated rows are separate documents, each counted; an empty table
gives no rows; other columns are not read. Strings of special tokens inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.byte_pairs import byte_symbols
from watchframe.llm.components import stored
from watchframe.llm.encoding import binary_offsets, grouped, id_encoder, strings
from watchframe.llm.texts import whole_text

GROUP_BYTES = 2_000_000  # of texts that are aligned together; an id, a range and two links of each token are held at a time
SHIFT = 32  # an id pair is the B id, shifted, and the A id
SEPARATORS = (",", "|", ";")


def data_of(values: pa.Array) -> memoryview:
    """The bytes of a binary array's values, end to end."""
    ends = binary_offsets(values)
    return memoryview(values.buffers()[2] or b"")[ends[0]:ends[-1]]


class Aligner:
    """Two vocabularies; one per worker and pair of files."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        self.a = id_encoder(bytes_path, plain_special=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        byte_of = byte_symbols()
        spelled = {i: t for t, i in self.a.library.get_vocab(with_added_tokens=True).items()}
        added = {i: t.content.encode() for i, t in self.a.library.get_added_tokens_decoder().items()}
        self.a_bytes = pa.array([added[i] if i in added else bytes(byte_of[c] for c in spelled[i]) for i in range(len(spelled))], pa.binary())
        model = self.b
        self.b_bytes = pa.array([bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
                                 for i in range(model.get_piece_size())], pa.binary())
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.decimal = pa.array([f"{i}{s}".encode() for s in SEPARATORS for i in range(self.width)], pa.binary())

    def tokens(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: the ids of all texts in a row, and the number of each text's; none where the bytes differ."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        a = self.a._encode(spaced)
        a_ids, a_size = np.frombuffer(data_of(a), "<u4").astype(np.int64), np.diff(binary_offsets(a)) // 4
        listed = self.b.encode(strings(texts), num_threads=1)
        b_size = np.fromiter(map(len, listed), np.int64, len(listed))
        b_ids = np.fromiter(chain.from_iterable(listed), np.int64, int(b_size.sum()))
        want, ends = data_of(spaced.cast(pa.binary())), binary_offsets(spaced)
        good = np.diff(ends) > 1
        for ids, size, table in ((a_ids, a_size, self.a_bytes), (b_ids, b_size, self.b_bytes)):
            told = table.take(pa.array(ids))
            have, cuts = data_of(told), binary_offsets(told)[np.concatenate(([0], np.cumsum(size)))]
            if not good.all() or len(have) != len(want) or have != want:
                good &= [have[c:d] == want[e:f] for c, d, e, f in zip(cuts, cuts[1:], ends, ends[1:])]
        return tuple((ids[np.repeat(good, size)], np.where(good, size, 0)) for ids, size in ((a_ids, a_size), (b_ids, b_size)))

    def align(self, texts: pa.Array) -> Alignment:
        (a, a_size), (b, b_size) = self.tokens(texts)
        number = np.arange(len(texts))
        frames = []
        for ids, size, table in ((a, a_size, self.a_bytes), (b, b_size, self.b_bytes)):
            length = np.diff(binary_offsets(table)).astype(np.int64)[ids]
            frames.append(pd.DataFrame({"at": np.cumsum(length) - length, "doc": np.repeat(number, size), "token": np.arange(len(ids))}))
        left, right = frames
        cover = right.assign(start=right["at"])
        of_a = pd.merge_asof(left, cover, on="at", by="doc", suffixes=("_a", "_b"))
        of_b = pd.merge_asof(right, left.assign(start=left["at"]), on="at", by="doc", suffixes=("_b", "_a"))
        a_begins = (of_a["at"] == of_a["start"]).to_numpy()  # both tokens start here
        b_begins = (of_b["at"] == of_b["start"]).to_numpy()
        only_b = of_b[~b_begins]
        link_a = np.concatenate([of_a["token_a"], only_b["token_a"]]).astype(np.int64)
        link_b = np.concatenate([of_a["token_b"], only_b["token_b"]]).astype(np.int64)
        doc = np.concatenate([of_a["doc"], only_b["doc"]]).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        return Alignment(a, b, a_size, b_size, a_begins, b_begins, link_a[order], link_b[order], np.bincount(doc, minlength=len(texts)))

    def groups(self, found: Alignment) -> pa.Array:
        """Per text its groups as ``a1,a2|b1;a3|b2``: the decimal A and B ids in order."""
        side = np.concatenate([np.zeros(len(found.a), np.int64), np.ones(len(found.b), np.int64)])
        group = np.concatenate([np.cumsum(found.a_begins), np.cumsum(found.b_begins)])
        order = np.argsort(2 * group + side, kind="stable")
        side, group, ids = side[order], group[order], np.concatenate([found.a, found.b])[order]
        last = np.concatenate([np.diff(2 * group + side) != 0, [True]])[:len(ids)]
        told = self.decimal.take(pa.array(ids + self.width * np.where(last, 1 + side, 0)))
        sizes = found.a_size + found.b_size
        ends = binary_offsets(told)[np.concatenate(([0], np.cumsum(sizes)))]
        data = data_of(told)
        return pa.array([bytes(data[c:max(c, d - 1)]).decode() for c, d in zip(ends.tolist(), ends[1:].tolist())], pa.string())


class Alignment:
    """Tokens of some texts in a row, where groups begin, and links as numbers of tokens, in order of text."""

    def __init__(self, a, b, a_size, b_size, a_begins, b_begins, link_a, link_b, n_links):
        self.a, self.b, self.a_size, self.b_size = a, b, a_size, b_size
        self.a_begins, self.b_begins, self.link_a, self.link_b, self.n_links = a_begins, b_begins, link_a, link_b, n_links

    def n_groups(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.a_size)), self.a_size)[self.a_begins], minlength=len(self.a_size))


@lru_cache(maxsize=2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    return Aligner(bytes_path, pieces_path)


def alignments(docs: DataFrame, bytes_path: str, pieces_path: str, id_column: str = "doc_id", text_column: str = "text",
               digest: bool = False) -> DataFrame:
    """One row per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (or their SHA-256 with ``digest``, an empty
    text without tokens), and for the counts the ``part``, the ``links`` as numbers into the part's table of pairs, and on
    the first row of a part that table: ``pairs`` with their number in ``times``. Store it before it is read twice: a part is
    what one batch of one task wrote.
    """
    names = [id_column, "n_a", "n_b", "n_groups", "n_links", "groups", "part", "links", "wide", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(bytes_path, pieces_path)
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(1), GROUP_BYTES):
                found, n = both.align(texts), len(texts)
                coded = pa.array(found.b[found.link_b] << SHIFT | found.a[found.link_a]).dictionary_encode()
                wide = len(coded.dictionary) > 1 << 16
                numbers = memoryview(coded.indices.to_numpy().astype("<u4" if wide else "<u2").tobytes())
                ends = (np.concatenate(([0], np.cumsum(found.n_links))) * (4 if wide else 2)).tolist()
                groups = both.groups(found)
                if digest:
                    groups = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in strings(groups)])
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), *(pa.array(x.astype(np.int64)) for x in (found.a_size, found.b_size, found.n_groups(), found.n_links)),
                    groups, pa.array(np.full(n, uuid.uuid4().int >> 65)), pa.array([bytes(numbers[c:d]) for c, d in zip(ends, ends[1:])], pa.binary()),
                    pa.array(np.full(n, wide)), pa.array([coded.dictionary.to_pylist()] + [None] * (n - 1), pa.list_(pa.int64())),
                    pa.array([times.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))], names)
                at += n

    rows = docs.select(F.col(id_column), whole_text(text_column).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, part long, links binary, "
                                "wide boolean, pairs array<long>, times array<long>")


def tables(aligned: DataFrame) -> DataFrame:
    """The parts' tables of pairs: ``part``, ``number``, ``pair`` and ``times``."""
    zipped = aligned.where(F.col("pairs").isNotNull()).select("part", F.posexplode(F.arrays_zip("pairs", "times")).alias("number", "one"))
    return zipped.select("part", "number", F.col("one.pairs").alias("pair"), F.col("one.times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of every id pair in the corpus: ``pair``, ``b_id``, ``a_id``, ``count``, and whether none of its B id's pairs has more."""
    counts = tables(aligned).groupBy("pair").agg(F.sum("times").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", SHIFT).alias("b_id"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("a_id"), "count")
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("pair", "b_id", "a_id", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Aligned documents with ``n_best``, their links whose pair is its B id's best, and ``count_sum``, the counts of all links added.

    ``aligned`` and ``counts`` are stored tables. The counts go to each part's table, then meet the part's packed links.
    """
    told = tables(aligned).join(counts.select("pair", "count", "best"), "pair").select("part", "number", "count", "best")
    kept = [id_column, "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
        number = told.column("number").to_numpy()
        count[number], best[number] = told.column("count").to_numpy(), told.column("best").to_numpy()
        ends = np.concatenate(([0], np.cumsum(docs.column("n_links").to_numpy())))
        wide = docs.num_rows and docs.column("wide")[0].as_py()
        links = np.frombuffer(b"".join(strings(docs.column("links").combine_chunks())), "<u4" if wide else "<u2")
        sums = [np.concatenate(([0], np.cumsum(value[links])))[ends] for value in (best, count)]
        out = docs.select(kept)
        for name, total in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(np.diff(total), pa.int64()))
        return out

    rows = aligned.select(*kept, F.col("part").alias("own_part"), "links", "wide")  # a name apart from the tables' side
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.groupBy("own_part").cogroup(told.groupBy("part")).applyInArrow(run, f"{schema}, n_best long, count_sum long")


def aligned_counts(docs: DataFrame, folder: str, bytes_path: str, pieces_path: str, id_column: str = "doc_id", text_column: str = "text",
                   digest: bool = False) -> DataFrame:
    """Alignment and link counts of every document; ``folder`` is shared and new."""
    aligned = stored(alignments(docs, bytes_path, pieces_path, id_column, text_column, digest), f"{folder}/aligned")
    counts = stored(pair_counts(aligned), f"{folder}/counts")
    return scored(aligned, counts, id_column)
