"""Small helpers the operators share: reading tables, whole texts, groups of texts, fragments that tokenize alone, bounded caches, freed memory."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Byte-level tokenizers cut this pattern's matches; fixed value of the public vocabulary.
SPACES = " \n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, an empty one where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text falls into ``part`` of ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: in WATCHFRAME_TOKENIZERS, or beside the installed package of such files."""
    folder = os.environ.get("WATCHFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def fragments(text: str) -> list[str] | None:
    """Cut a text where a byte-level tokenizer always cuts, or None if its white space is not that plain.

    Before a blank or a line feed that follows something else, and after a line feed that precedes something
    else, one piece ends whatever stands around it. Such fragments are words, so they repeat and can be cached.
    The mark that is put between them must not occur in the text.
    """
    if "\x1f" in text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
        return None
    if text[:1] in SPACES or text[-1:] in SPACES:  # also the empty text
        return None
    for space in "\t\r\x0b\x0c\x1c\x1d\x1e\x85\xa0     　":
        if space in text:
            return None
    if not text.isascii() and any(" " <= c <= " " for c in set(text)):
        return None
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")


def text_groups(column: pa.Array, characters: int, most: int | None = None) -> Iterator[list[str]]:
    """The texts of a column of a batch, in runs of about so many characters and at most so many texts; only one run is taken out at a time."""
    group, size = [], 0
    for value in column:
        group.append(value.as_py())
        size += len(group[-1])
        if size >= characters or len(group) == most:
            yield group
            group, size = [], 0
    if group:
        yield group


def give_back() -> None:
    """Return freed memory to the system. A Python worker outlives its task, and what its allocators keep adds to the executor's memory."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


class Cache:
    """Results by word, at most ``most``; it empties itself when it is full."""

    def __init__(self, most: int):
        self.most, self.entries = most, {}

    def missing(self, words: set) -> set:
        """The words that have no result yet, after making room for them."""
        fresh = words.difference(self.entries)
        if len(self.entries) + len(fresh) > self.most:
            self.entries.clear()
            return words
        return fresh

    def forget(self, words: set, longest: int = 64) -> None:
        """Drop long words, which hardly repeat."""
        for word in words:
            if len(word) > longest:
                del self.entries[word]
