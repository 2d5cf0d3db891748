"""Token counts of a byte-level BPE vocabulary, by merging with a heap and a linked list.

Every piece of a text starts as one symbol per byte. The adjacent pair of lowest rank, leftmost among equals, is popped
from a heap and merged until no pair of the vocabulary is left; links to both neighbours make a merge constant work, so a
piece of n bytes costs O(n log n) however long it is. The count is the number of bytes less the number of merges: no token
id is looked up or emitted. Counts of pieces and fragments are kept in bounded caches of the Python worker.

Defined results: a null text is an empty one and has 0 tokens. The vocabulary's special strings inside a text count as one
token each, as the library does by default. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.texts import Cache, fragments, whole_text

# How the public vocabulary cuts texts into pieces; fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES, CACHED_FRAGMENTS = 600_000, 600_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, by the public rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairCounter:
    """Counts tokens; one per worker and vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        model, cutter = vocabulary["model"], vocabulary["pre_tokenizer"]
        if vocabulary["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        byte_of = byte_symbols()
        number = {symbol: byte for symbol, byte in byte_of.items()}  # symbols: the bytes, then what merges make
        self.ranks: dict[int, int] = {}  # by left symbol * 2**20 + right symbol
        self.made: list[int] = []  # symbol that the merge of each rank makes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.made.append(number.setdefault(left + right, len(number)))
            self.ranks.setdefault(number[left] << 20 | number[right], rank)
        special = [t["content"] for t in vocabulary["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PIECES)
        self.pieces, self.fragments = Cache(CACHED_PIECES), Cache(CACHED_FRAGMENTS)

    def merges(self, piece: bytes) -> int:
        """How many merges the piece undergoes. Heap entries are rank * length + position; a merged symbol becomes -1."""
        rank_of, made, symbols = self.ranks.get, self.made, list(piece)
        n = len(symbols)
        heap = [rank * n + i for i in range(n - 1) if (rank := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return 0
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        done = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            j, symbol = right[i], symbols[i]
            if symbol < 0 or j >= n or rank_of(symbol << 20 | symbols[j]) != rank:
                continue  # one of the two has been merged since
            symbols[i] = symbol = made[rank]
            symbols[j] = -1
            done += 1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (rank := rank_of(symbol << 20 | symbols[after])) is not None:
                    heappush(heap, rank * n + i)
            before = left[i]
            if before >= 0 and (rank := rank_of(symbols[before] << 20 | symbol)) is not None:
                heappush(heap, rank * n + before)
        return done

    def of_plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        pieces = self.cut.findall(text)
        fresh, known = self.pieces.missing(set(pieces)), self.pieces.entries
        for piece in fresh:
            raw = piece.encode()
            known[piece] = len(raw) - self.merges(raw)
        total = sum(map(known.__getitem__, pieces))
        self.pieces.forget(fresh)
        return total

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.of_plain, parts))
        words = fragments(text)
        if words is None:
            return self.of_plain(text)
        fresh, known = self.fragments.missing(set(words)), self.fragments.entries
        for word in fresh:
            known[word] = self.of_plain(word)
        total = sum(map(known.__getitem__, words))
        self.fragments.forget(fresh)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    return PairCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes`` of UTF-8, ``n_tokens`` and whether these exceed ``limit``.

    No shuffle: each task counts the texts it reads.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            n = [counts.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names)

    names = [id_column, "n_bytes", "n_tokens"]
    rows = docs.select(F.col(id_column), F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"),
                       whole_text(text_column).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return (rows.mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
