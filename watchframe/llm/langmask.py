"""Language identification by Bloom filters of character n-grams that hold a bit per language.

The filters of all languages are sliced by bit: one array of slots, each with a mask of languages, so the slots of an n-gram,
combined by AND, give at once all languages that contain it. Per text, set bits are counted for each language over all its
n-grams. A language's filter answers wrongly with a known rate (its share of set bits to the power of the number of hashes),
so counts are corrected for that; the largest corrected count decides. N-grams that all languages contain are not counted. Filters are filled on the driver from a bounded sample
of labelled texts per language (``most_texts``, the first by a hash of the id), with the n-grams that occur in at least
``least_texts`` of them; their size is fixed by parameters. Every whole text is judged in the tasks, without a shuffle.

Defined results: a null text, an empty one and one without letters are ``und`` with score 0, as is every text if nothing was
learned. Equal counts go to the language whose name sorts first. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchframe.llm.texts import whole_text

UNDETERMINED = "und"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
GROUP_CHARACTERS = 1_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself in lower case if it is a letter, else 0."""
    points = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            points[c] = ord(low) if len(low) == 1 else c
    return points


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts with the number of each's text, and how many letters each text has.

    Other characters count as one break however many they are; an n-gram has a letter, and no break inside.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = letters()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    n_letters = np.bincount(text[points > 0], minlength=len(texts))
    keep = np.append(True, (points[1:] > 0) | (points[:-1] > 0))  # one break of each run
    points, text = points[keep], text[keep]
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    size = len(points) - n + 1
    code, whole = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        part = points[k:k + size]
        code = code * np.uint64(0x110001) + part
        if 0 < k < n - 1:
            whole &= part > 0
    whole &= text[:size] == text[n - 1:]
    return code[whole], text[:size][whole], n_letters


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # a row of bytes of language bits per slot
    hashes: int
    n: int

    def _at(self, code: np.ndarray, k: int) -> np.ndarray:
        mixed = (code ^ (code >> np.uint64(31))) * np.uint64(MULTIPLIERS[k])
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(MULTIPLIERS[-1 - k]) >> np.uint64(64 - self.bits)).astype(np.int64)

    @property
    def bits(self) -> int:
        return len(self.slots).bit_length() - 1

    def add(self, language: int, code: np.ndarray) -> None:
        for k in range(self.hashes):
            self.slots[self._at(code, k), language // 8] |= np.uint8(1 << language % 8)

    def contain(self, code: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram."""
        mask = self.slots[self._at(code, 0)]
        for k in range(1, self.hashes):
            mask &= self.slots[self._at(code, k)]
        return mask

    def false_rate(self) -> np.ndarray:
        full = [np.count_nonzero(self.slots[:, i // 8] >> np.uint8(i % 8) & 1) / len(self.slots) for i in range(len(self.languages))]
        return np.array(full) ** self.hashes

    def judge(self, texts: list[str], rate: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the best language's share of all corrected counts."""
        code, text, n_letters = grams(texts, self.n)
        mask = self.contain(code)
        everywhere = np.ones(len(code), bool)  # an n-gram of all languages decides nothing
        for i in range(len(self.languages)):
            everywhere &= (mask[:, i // 8] >> np.uint8(i % 8) & 1).astype(bool)
        if len(self.languages) > 1:
            mask, text = mask[~everywhere], text[~everywhere]
        total = np.bincount(text, minlength=len(texts))
        counts = np.array([np.bincount(text[(mask[:, i // 8] >> np.uint8(i % 8) & 1).astype(bool)], minlength=len(texts))
                           for i in range(len(self.languages))], float).reshape(len(self.languages), len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        right = np.maximum(counts - total * rate[:, None], 0) / np.maximum(1 - rate[:, None], 1e-9)
        best, all_of_it = right.argmax(axis=0), right.sum(axis=0)
        share = np.where(all_of_it > 0, right.max(axis=0) / np.maximum(all_of_it, 1e-9), 0.0)
        named = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), n_letters.tolist())]
        return named, np.where(n_letters > 0, share, 0.0).tolist()


def fit(samples: dict[str, list[str]], n: int = 4, least_texts: int = 3, slot_bits: int = 20, hashes: int = 3) -> Filters:
    """Filters of the n-grams that at least ``least_texts`` of a language's texts have, or all of them if it has fewer."""
    languages = sorted(samples)
    filters = Filters(languages, np.zeros((1 << slot_bits, max(1, -(-len(languages) // 8))), np.uint8), hashes, n)
    for i, language in enumerate(languages):
        found = [np.unique(grams([text], n)[0]) for text in samples[language]]
        codes, counts = np.unique(np.concatenate(found), return_counts=True)
        filters.add(i, codes[counts >= min(least_texts, len(found))])
    return filters


def train(labelled: DataFrame, most_texts: int = 1_000, id_column: str = "doc_id", text_column: str = "text", label: str = "lang", **options) -> Filters:
    """Fit on at most ``most_texts`` texts of each language, the first by a hash of their id.

    A share of the hash range that holds about four times as many rows of a language, by its number of rows, is cut off first, so
    few rows are ordered; should repeated ids leave less than asked for, the share grows. The pairs of id and label are chosen
    without the texts and, ``most_texts`` for each language, broadcast to where texts are read; of rows equal in both, one text
    comes to the driver.
    """
    rows = labelled.select(F.col(id_column).alias("__id"), F.col(label).cast("string").alias("__label"), whole_text(text_column).alias("__text"))
    rows = rows.where(F.col("__id").isNotNull() & F.col("__label").isNotNull())
    counts = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    order, factor, most = Window.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id"), 4, max(counts.values(), default=0)
    while True:
        limits = [(name, min(1 << 40, (factor * most_texts << 40) // n + 1)) for name, n in counts.items()]
        limit = labelled.sparkSession.createDataFrame(limits, "__label string, limit long")
        near = rows.select("__id", "__label").join(F.broadcast(limit), "__label").where(place < F.col("limit")).distinct()
        chosen = near.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most_texts).select("__id", "__label").collect()
        if factor * most_texts >= most or min(Counter(r["__label"] for r in chosen).get(name, 0) for name in counts) >= most_texts:
            break
        factor *= 16
    chosen = labelled.sparkSession.createDataFrame(chosen, rows.select("__id", "__label").schema)
    sample = rows.join(F.broadcast(chosen), ["__id", "__label"]).groupBy("__id", "__label").agg(F.min("__text").alias("__text")).toPandas()
    sample = sample.sort_values(["__id", "__text"])
    return fit({language: rows["__text"].tolist() for language, rows in sample.groupby("__label")}, **options)


def identify(docs: DataFrame, filters: Filters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``lang_pred`` and ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from watchframe.llm.pieces import in_groups

        rate = filters.false_rate()
        for batch in batches:
            at = 0
            for texts in in_groups(batch.column(1).to_pylist(), GROUP_CHARACTERS):
                named, share = filters.judge(texts, rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(named, pa.string()), pa.array(share, pa.float64())],
                                                 [id_column, "lang_pred", "score"])
                at += len(texts)

    rows = docs.select(F.col(id_column), whole_text(text_column).alias("__text"))
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, lang_pred string, score double")
