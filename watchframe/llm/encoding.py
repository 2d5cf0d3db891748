"""Ids of byte-level texts by the tokenizers library, with the ids of fragments kept between texts."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from watchframe.llm.byte_pairs import byte_symbols

KEPT_FRAGMENTS = 350_000  # of one generation; there are two
LONGEST_KEPT = 64  # longer fragments hardly repeat
GROUP_BYTES = 8_000_000  # of texts that are cut together
# Texts whose white space is more than single blanks and line feeds.
ODD_SPACE = (r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
             r"|[ \n][ \n]")
# One piece of letters, a blank before it or not, and one of ASCII signs after it. All these letters are single letters of the
# pattern that cuts texts, and no contraction can begin with a sign before another sign.
WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def binary_offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a binary array begins in its data, and the end of the last one."""
    return np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)


def strings(values: pa.Array) -> list:
    """The values as Python objects; several times as fast as to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


def grouped(values: pa.Array, limit: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Slices of a string or binary array of about so many bytes."""
    ends, at = binary_offsets(values), 0
    while at < len(values):
        end = min(len(values), int(np.searchsorted(ends, ends[at] + limit, "left")) + 1)
        end = max(at + 1, min(end, len(values)))
        yield values.slice(at, end - at)
        at = end


class IdEncoder:
    """Ids by the library, of kept fragments where a text has only plain white space; one per worker and file.

    A text with single blanks and line feeds is cut before each blank and around each line feed, where the vocabulary's own
    pattern always cuts. Different fragments of a group of texts are looked up once. What is not known is cut into a word and
    the signs after it where it is that plain, and these go to the library's merging model; all other fragments and texts go
    through the whole library. Kept fragments are in two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back.

    With ``plain_special`` the special strings of the vocabulary are ordinary text, else each is its id, the library's default.
    """

    def __init__(self, path: str, plain_special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain_special
        self.model = self.library.model
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if not (plain_special and t.special)]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cutter = told["pre_tokenizer"]
        self.plain = (not told["normalizer"] and cutter["type"] == "ByteLevel" and not cutter["add_prefix_space"]
                      and cutter.get("use_regex", True))
        self.symbols = {byte: ord(symbol) for symbol, byte in byte_symbols().items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", one.ids).tobytes() for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern."""
        if piece.isascii():
            piece = piece.replace(" ", "Ġ")
        else:
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different fragments."""
        if len(self.young) > KEPT_FRAGMENTS:
            self.old = {word: ids for word, ids in self.young.items() if len(word) <= LONGEST_KEPT}
            self.young = {}
        young, old, odd = self.young, self.old, []
        found = list(map(young.get, words))
        for at, ids in enumerate(found):
            if ids is not None:
                continue
            word = words[at]
            ids = old.get(word)
            if ids is None:
                match = WORD.fullmatch(word)
                if match is None:
                    odd.append(at)
                    continue
                core, signs = match.groups()
                ids = young.get(core) or old.get(core) or self._piece(core)
                if signs:
                    young[core] = ids
                    end = young.get(signs)
                    if end is None:
                        end = young[signs] = old.get(signs) or self._piece(signs)
                    ids += end
            found[at] = young[word] = ids
        for start in range(0, len(odd), 20_000):
            part = odd[start:start + 20_000]
            for at, ids in zip(part, self._ids([words[at] for at in part])):
                found[at] = young[words[at]] = ids
        return found

    def _encode(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, ODD_SPACE) if self.plain else pa.array([True] * len(texts))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        plain = texts.filter(pc.invert(odd))
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x1f "), "\n", "\x1f\n\x1f")
        cut = pc.split_pattern(marked, "\x1f")
        words = cut.flatten().dictionary_encode()
        flat = pa.array(self._known(strings(words.dictionary)), pa.binary()).take(words.indices)
        ends = binary_offsets(flat)[cut.offsets.to_numpy()] if len(plain) else np.zeros(1, np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(ends.tobytes()), flat.buffers()[2]])
        if len(plain) == len(texts):
            return ids
        whole = self._ids(strings(texts.filter(odd)))
        order = np.empty(len(texts), np.int64)
        there = odd.to_numpy(zero_copy_only=False)
        order[~there], order[there] = np.arange(len(plain)), len(plain) + np.arange(len(whole))
        return pa.concat_arrays([ids, pa.array(whole, pa.binary())]).take(pa.array(order))

    def encode(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Groups of the texts, each with the ids of every text as little-endian unsigned 32-bit integers."""
        for group in grouped(texts):
            yield group, self._encode(group)

    def byte_lengths(self) -> np.ndarray:
        """Bytes each id stands for, by id."""
        size = self.library.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        bytes_of = byte_symbols()
        lengths = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            lengths[i] = len(added[i].encode()) if i in added else sum(c in bytes_of for c in token)
        return lengths


@lru_cache(maxsize=4)
def id_encoder(path: str, plain_special: bool = False) -> IdEncoder:
    return IdEncoder(path, plain_special)
