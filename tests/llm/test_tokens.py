"""Token counts, SentencePiece ids and binary records against the libraries."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from watchframe.llm import byte_pairs, encoding, pieces, records, weighted_minhash
from watchframe.llm.texts import fragments, text_groups, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ALPHABET = "ab  \n\t▁é漢🙂\x00\x1f'the1029 aaaa____==== 　\x85<|endoftext|>"
DOCS = [(1, "The cat's  hat.\nIt sat\n\n"), (2, None), (3, ""), (4, "word " * 4000), (5, "a" * 3000), (5, "a" * 3000), (6, "x<|endoftext|>y 漢字 \x1f z")]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTES)


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", 7, True) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, ids boolean")


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_counts_and_ids_are_the_libraries(text):
    library = tokenizers.Tokenizer.from_file(BYTES) if not hasattr(test_counts_and_ids_are_the_libraries, "t") else test_counts_and_ids_are_the_libraries.t
    test_counts_and_ids_are_the_libraries.t = library
    assert byte_pairs.counter(BYTES).count(text) == len(library.encode(text, add_special_tokens=False).ids)
    encoder = pieces.encoder(PIECES)
    assert encoder.encode([text]) == [encoder.library.encode(text)]


def test_words_of_equal_ranks_and_long_words():
    encoder = pieces.encoder(PIECES)
    texts = [" " * n for n in range(1, 40)] + ["ab" * 3000, "=-" * 2000, "a" * 5000, "the" * 999]
    assert encoder.encode(texts) == encoder.library.encode(texts)


def test_caches_stay_bounded():
    counter = byte_pairs.PairCounter(BYTES)
    counter.pieces.most = counter.fragments.most = 50
    rng = random.Random(1)
    for _ in range(200):
        counter.count(" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20)))
    assert len(counter.pieces.entries) <= 50 and len(counter.fragments.entries) <= 50


@given(st.text("ab \n\t", max_size=20))
def test_fragments_are_the_text(text):
    parts = fragments(text)
    assert parts is None or "".join(parts) == text


def test_token_counts(docs, library):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in byte_pairs.token_counts(docs, BYTES, limit=100).collect())
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 100) for i, t in DOCS)
    assert got == want
    assert byte_pairs.token_counts(docs.limit(0), BYTES).count() == 0


def test_sentencepiece_round_trip(docs):
    library = pieces.encoder(PIECES).library
    encoded = pieces.encode(docs, PIECES)
    for r in encoded.collect():
        text = dict(DOCS)[r.doc_id] or ""
        ids = library.encode(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sorted((r.doc_id, r.text) for r in pieces.decode(encoded, PIECES).collect()) == sorted((i, library.decode(library.encode(t or ""))) for i, t in DOCS)


def crc_by_bits(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c(b"123456789", np.array([9]))[0] == 0xE3069283  # the check value of the algorithm
    rng = random.Random(2)
    parts = [rng.randbytes(n) for n in [0, 1, 3, 4, 5, 255, 256, 257, 1000, 5000]]
    got = records.crc32c(b"".join(parts), np.array([len(p) for p in parts]))
    assert got.tolist() == [crc_by_bits(p) for p in parts]


def test_damage_is_found():
    one, two = records.frame([b"first", b"second record"])
    assert records.unframe([one, two]) == [b"first", b"second record"]
    with pytest.raises(ValueError):
        records.unframe([one, two[:-6] + b"!" + two[-5:]])


@pytest.mark.parametrize("wide", [False, True])
def test_records(spark, tmp_path, docs, library, wide):
    docs = docs.union(spark.createDataFrame([(None, "no id", "en", 1, True), (None, None, None, None, None)], docs.schema))
    folder = str(tmp_path / "records")
    files = records.write(docs, folder, BYTES, files=3, wide=wide)
    got = [tuple(r) for r in records.digests(records.read(files, folder, entries=1)).orderBy("start").collect()]
    want = {}
    for i, t in [*DOCS, (None, "no id"), (None, None)]:
        ids = library.encode(t or "").ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 5, 6, None, None]
    starts = np.cumsum([0] + [r[2] for r in got]).tolist()
    assert [r[1] for r in got] == starts[:-1]
    assert all(sorted(r[2:] for r in got if r[0] == i) == sorted(w) for i, w in want.items())
    mixed = records.read(files, folder, shuffle_seed=4).collect()
    assert sorted(r.start for r in mixed) == starts[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60) | st.text(max_size=30), max_size=5), st.booleans())
def test_kept_fragments_give_the_librarys_ids(texts, plain_special):
    encoder = encoding.id_encoder(BYTES, plain_special)
    for _ in range(2):
        got = [ids for _, part in encoder.encode(pa.array(texts, pa.string())) for ids in part.to_pylist()]
        assert got == encoder._ids(texts)


def test_generations_of_fragments_stay_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_FRAGMENTS", 100)
    encoder, rng = encoding.IdEncoder(BYTES), random.Random(3)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdef", k=rng.choice([2, 5]))) + rng.choice(["", ".", ","]) for _ in range(30))]
        assert encoder._encode(pa.array(texts)).to_pylist() == encoder._ids(texts)
        assert len(encoder.old) <= 240 and len(encoder.young) <= 240


def test_records_of_an_empty_table(spark, tmp_path, docs):
    folder = str(tmp_path / "none")
    assert records.read(records.write(docs.limit(0), folder, BYTES), folder).count() == 0


def peak_of(work):
    """What a call returns, and the most bytes it held beyond that."""
    tracemalloc.start()
    try:
        got = work()
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return got, most - now


def test_known_words_are_not_held_as_strings():
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(2_000)) for _ in range(50)]
    encoder = pieces.PieceEncoder(PIECES)
    encoder.encode(texts[:10])
    got, most = peak_of(lambda: encoder.encode(texts))
    assert got == encoder.library.encode(texts)
    assert most < 30 * 100_000  # a string of its own takes 50 bytes and more


def test_samples_are_drawn_in_blocks():
    rng = np.random.default_rng(5)
    counts = np.append(rng.integers(1, 999, 1_500), 400_000)
    code, weight = rng.integers(1 << 50, size=counts.sum(), dtype=np.uint64), rng.uniform(0.5, 3, counts.sum())
    sampler = weighted_minhash.Sampler(2, 1, 11)
    got, most = peak_of(lambda: sampler.bands_of(code, weight, counts))
    assert most < 60 * len(code)
    ends = np.cumsum(counts)
    for i in (0, 1, 700, 1_499, 1_500):
        one = slice(ends[i] - counts[i], ends[i])
        assert (got[i] == sampler.bands_of(code[one], weight[one], counts[i:i + 1])[0]).all()
    assert sampler.bands_of(code[:0], weight[:0], counts[:0]).shape == (0, 2)


def test_text_groups():
    column = pa.array(["aaaa", "", "b", "cc", "dddddddd", ""])
    assert list(text_groups(column, 5)) == [["aaaa", "", "b"], ["cc", "dddddddd"], [""]]
    assert list(text_groups(column, 99, 4)) == [["aaaa", "", "b", "cc"], ["dddddddd", ""]]
    assert list(text_groups(column[:0], 5)) == []
