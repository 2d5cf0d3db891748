"""Quality rules on repetition inside a text, from suffix arrays over its words.

Suffixes of all texts of a group are ordered together by prefix doubling in numpy, texts kept apart; only suffixes that are
still tied are sorted again. The ranks of every doubling are kept, so the longest common prefix of neighbours in the suffix
array comes from a descending search over them. Each suffix's deepest interval of common prefixes gives the longest repeat
that starts there. Starts whose repeat does not merely continue the one before it are occurrences of maximal repeated
substrings. Their spans, united, give the covered fraction. A text is kept if it passes the base rules, its repeats of
``least`` words or more cover no more than ``most_covered`` of the characters of its words, and its longest repeat has no
more than ``most_repeat`` words.

Memory follows the longest text, not the table. Defined results: a null or empty text has no words and fails the base rules;
repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.pieces import in_groups

SPACE_BYTES = " \t\n\x0b\x0c\r"  # what separates words; fixed value
SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5  # words of a base window
GROUP_CHARACTERS = 2_000_000


def longest_repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there and starts elsewhere in its text too.

    ``words`` holds numbers from 0; ``lengths`` says how many words each text has.
    """
    n = len(words)
    repeat = np.zeros(n, np.int64)
    if n < 2:
        return repeat
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    base = int(words.max()) + 2
    at = np.arange(n)
    following = np.where(at + 1 < end, np.append(words[1:], 0) + 1, 0)
    # Rank of a suffix: where its group of equal prefixes begins in the order of all suffixes.
    rank, tied, size, levels = np.zeros(n, np.int64), at, 2, []
    key = (text * base + words) * base + following
    old = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        tied, key, old = tied[order], key[order], old[order]
        place = np.arange(len(tied))
        outer = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        begins = np.append(True, key[1:] != key[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(begins, place, 0)) - outer
        levels.append(rank.astype(np.int32))
        alone = begins & np.append(begins[1:], True)
        tied = np.sort(tied[~alone])
        if not len(tied):
            break
        old = rank[tied]
        ahead = tied + size
        key = old * (n + 1) + np.where(ahead < end[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        size *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = at
    close = levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]  # two words in common at least
    first = suffixes[:-1][~close]
    second = suffixes[1:][~close]
    single = (text[first] == text[second]) & (words[first] == words[second])
    for side in (first[single], second[single]):
        repeat[side] = 1
    a, b = suffixes[:-1][close], suffixes[1:][close]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ends = end[a]
        fits = (np.maximum(a, b) + common < ends)
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where(fits & (levels[k][x] == levels[k][y]), 2 << k, 0)
    fits = np.maximum(a, b) + common < end[a]
    x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
    common += fits & (words[x] == words[y])
    np.maximum.at(repeat, a, common)
    np.maximum.at(repeat, b, common)
    return repeat


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more."""
    starts = np.flatnonzero(repeat >= least)
    edge = np.bincount(starts, minlength=len(repeat) + 1) - np.bincount(starts + repeat[starts], minlength=len(repeat) + 1)
    return np.cumsum(edge)[:len(repeat)] > 0


def maximal_starts(repeat: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Starts of repeats that do not just continue the repeat of the word before."""
    continues = np.append(False, (repeat[:-1] > repeat[1:]) & (text[:-1] == text[1:]))
    return (repeat >= least) & ~continues


def measure(texts: list[str], least: int) -> dict[str, np.ndarray]:
    """The measures of some texts."""
    split = [text.encode().split() for text in texts]  # bytes are split at exactly the six white-space characters
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [word for words in split for word in words]
    number = {word: i for i, word in enumerate(set(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    repeat = longest_repeats(words, lengths)
    text = np.repeat(np.arange(len(texts)), lengths)

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.bincount(text[marks], minlength=len(texts))

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, np.where(repeat >= least, repeat, 0))
    repeated_lines = []
    for one in texts:
        lines = [line for line in one.split("\n") if line.strip(SPACE_BYTES)]
        repeated_lines.append(len(lines) - len(set(lines)))
    marks = covered(repeat, least)
    characters = np.fromiter((len(word) if word.isascii() else len(word.decode()) for word in flat), np.int64, len(flat)) if marks.any() else np.zeros(len(flat), np.int64)
    return {
        "n_words": lengths,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACE_BYTES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(repeated_lines, np.int64),
        "n_repeat_words": per_text(covered(repeat, WINDOW)),
        "covered_chars": np.bincount(text, np.where(marks, characters, 0), len(texts)).astype(np.int64),
        "n_maximal_repeats": per_text(maximal_starts(repeat, text, least)),
        "longest_repeat": longest,
    }


def repetition(docs: DataFrame, least: int = 8, most_covered: float = 0.25, most_repeat: int = 50, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``. No shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "n_maximal_repeats", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_groups(batch.column(1).to_pylist(), GROUP_CHARACTERS):
                found = measure(texts, least)
                columns = [pa.array(np.asarray(found[name], np.int64)) for name in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], [id_column, *names])
                at += len(texts)

    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    kind = rows.schema[id_column].dataType.simpleString()
    measured = rows.mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"{name} long" for name in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = (F.col("covered_chars") <= most_covered * F.col("word_chars")) & (F.col("longest_repeat") <= most_repeat)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
