"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Words, that is runs of word marks with what follows them, are encoded together: their symbols lie in one flat numpy array.
Each round looks up the rank of every adjacent pair, takes the segmented minimum per word, merges the leftmost
non-overlapping occurrences of that pair in all words at once and compacts the arrays, until no word holds a pair of the
vocabulary. The library merges one pair at a time, best score first and leftmost among equals. Merging several at once
differs from that only if a merge makes a pair of the same or a better rank with a neighbour, merged or not yet; a word
where this happens repeats the round with its leftmost merge alone, so the ids are always the library's. Characters outside the vocabulary become byte pieces.

Defined results: a null text is an empty one and has no ids. Text of any length is encoded whole. Repeated rows give
repeated results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.texts import Cache, give_back, text_groups, whole_text

MARK = "▁"  # stands for a blank; fixed value of the format
NONE = np.iinfo(np.int32).max
CACHED_WORDS = 500_000


class PieceEncoder:
    """Encodes with the pieces of a model file; one per worker and file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model, size = self.library, self.library.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        piece_of = {i: model.id_to_piece(i) for i in usable}
        self.ids = {piece: i for i, piece in piece_of.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces of this model cross words")
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("this model has no byte pieces")
        self.byte_ids = byte_ids
        # Single characters of pieces that are no piece by themselves are symbols too, after the pieces.
        lone = sorted({c for piece in self.ids for c in piece} - self.ids.keys())
        symbols = self.ids | {c: size + k for k, c in enumerate(lone)}
        self.size, self.base, self.unknown = size, size + len(lone) + 1, size + len(lone)
        self.of_point = np.full(0x110000, self.unknown, np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1:
                self.of_point[ord(symbol)] = i
        scores = sorted({model.get_score(i) for i in usable}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for i, piece in piece_of.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(rank_of[model.get_score(i)])
                    merged.append(i)
        self._hash(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(merged, np.int32))
        self.text_of = [str(i) for i in range(size)]
        self.symbols = list(range(self.base))  # one object of each, for all words that are kept
        self.words = Cache(CACHED_WORDS)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Lay the pairs out in a table with linear probing, at most an eighth full."""
        self.bits = max(10, int(len(keys) * 8 - 1).bit_length())
        self.keys, self.ranks, self.merged = (np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32),
                                              np.zeros(1 << self.bits, np.int32))
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - at), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.ranks[at[put]], self.merged[at[put]] = keys[left[put]], ranks[left[put]], merged[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each position, NONE where there is none, and where it stands in the table."""
        key = symbols.astype(np.int64) * self.base
        key[:-1] += symbols[1:]
        at = self._slot(key)
        there = self.keys[at]
        other = np.flatnonzero((there != key) & (there != -1))
        while len(other):  # another pair holds the slot
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[other]]
            other = other[(there != key[other]) & (there != -1)]
        return np.where(last, NONE, self.ranks[at]), at

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, all words merged in common rounds."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, origin = self.of_point[points], np.arange(len(points))
        active = np.arange(len(words))  # number of each word still in the arrays
        found: list[tuple[int, ...] | None] = [None] * len(words)
        while len(active):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            last = np.zeros(len(symbols), bool)
            last[starts + lengths - 1] = True
            rank, at = self.pairs(symbols, last)
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                size = lengths[done]
                self._finish(found, active[done], symbols[gone], origin[gone], np.cumsum(size) - size, size, points)
                if done.all():
                    break
                keep = np.repeat(~done, lengths)
                symbols, origin, rank, at = symbols[keep], origin[keep], rank[keep], at[keep]
                active, lengths, least = active[~done], lengths[~done], least[~done]
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            word = np.repeat(np.arange(len(active)), lengths)
            chosen = self._leftmost(np.flatnonzero(rank == least[word]))
            symbols, origin, lengths = self._merge(symbols, origin, lengths, word, at, chosen, least)
            # _merge leaves words with several merges unsafe to merge at once with their leftmost merge only
        return found  # type: ignore[return-value]

    @staticmethod
    def _leftmost(hits: np.ndarray) -> np.ndarray:
        """Of positions of overlapping pairs in a row, every second one from the left."""
        if not len(hits):
            return hits
        begins = np.concatenate(([True], np.diff(hits) != 1))
        run = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
        return hits[(np.arange(len(hits)) - run) % 2 == 0]

    def _merge(self, symbols, origin, lengths, word, at, chosen, least):
        """Merge at the chosen positions; where that makes a pair as good as the merged one, only at the first of the word."""
        for careful in (False, True):
            new, gone = symbols.copy(), np.zeros(len(symbols), bool)
            new[chosen] = self.merged[at[chosen]]
            gone[chosen + 1] = True
            kept = ~gone
            merges = np.bincount(word[chosen], minlength=len(lengths))
            shorter = lengths - merges
            if careful or not (merges > 1).any():
                break
            new_symbols = new[kept]
            starts = np.concatenate(([0], np.cumsum(shorter)[:-1]))
            last = np.zeros(len(new_symbols), bool)
            last[starts + shorter - 1] = True
            best = np.minimum.reduceat(self.pairs(new_symbols, last)[0], starts)
            unsafe = (merges > 1) & (best <= least)
            # what the left one of two merges side by side makes may also pair with the untouched right one
            beside = chosen[:-1][(chosen[1:] == chosen[:-1] + 2) & (word[chosen[1:]] == word[chosen[:-1]])]
            together = np.stack([new[beside], symbols[beside + 2]], axis=1).ravel()
            ends = np.arange(len(together)) % 2 == 1
            tempting = beside[self.pairs(together, ends)[0][::2] <= least[word[beside]]] if len(beside) else beside
            unsafe[word[tempting]] = True
            if not unsafe.any():
                break
            first = np.concatenate(([True], np.diff(word[chosen]) != 0))
            chosen = chosen[first | ~unsafe[word[chosen]]]
        return new[kept], origin[kept], shorter

    def _finish(self, found, numbers, symbols, origin, starts, lengths, points) -> None:
        unknown = np.logical_or.reduceat(symbols >= self.size, starts)
        flat, begins, ends = list(map(self.symbols.__getitem__, symbols.tolist())), starts.tolist(), (starts + lengths).tolist()
        for number, begin, end, strange in zip(numbers.tolist(), begins, ends, unknown.tolist()):
            part = flat[begin:end]
            if strange:
                part = list(chain.from_iterable(
                    [symbol] if symbol < self.size else [self.byte_ids[b] for b in chr(points[origin[begin + k]]).encode()]
                    for k, symbol in enumerate(part)))
            found[number] = tuple(part)

    def split(self, text: str) -> list[str]:
        """The words of a text with their marks, the mark before the text included."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.words.entries
        # A known word is replaced by its ids at once, so that only the strings of new ones are held for all texts.
        split = [list(map(known.get, words, words)) for words in map(self.split, texts)]
        fresh = list(self.words.missing({word for words in split for word in words if type(word) is str}))
        if fresh:
            known.update(zip(fresh, self.encode_words(fresh)))
        ids = [list(chain.from_iterable(word if type(word) is tuple else known[word] for word in words)) for words in split]
        self.words.forget(fresh)
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def in_groups(texts: list[str], characters: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that the arrays of a round stay bounded."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", group: int = 2_000_000,
           with_ids: bool = True) -> DataFrame:
    """One row per document: its id, ``ids`` (unless ``with_ids`` is off), ``n_tokens``, ``ids_sha256`` of the decimal ids
    joined by commas and ``decoded_sha256`` of the text the ids decode to. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column(1), group):
                ids = pieces.encode(texts)
                joined = [",".join(map(pieces.text_of.__getitem__, one)) for one in ids]
                back = pieces.library.decode(ids, num_threads=1)
                columns = [batch.column(0).slice(at, len(texts)), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                           pa.array(map(len, ids), pa.int64()),
                           pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                           pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)
                give_back()

    names = [id_column, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = docs.select(F.col(id_column), whole_text(text_column).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    return rows.mapInArrow(run, f"`{id_column}` {kind}, {ids}n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The texts of ``ids``: one row per document with its id and ``text``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            texts = [library.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    rows = encoded.select(F.col(id_column), "ids")
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, text string")
