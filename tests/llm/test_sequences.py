"""Packing, periodic runs and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from watchframe.llm import alignment, packing, periods
from watchframe.llm.byte_pairs import byte_symbols
from watchframe.llm.texts import tokenizer_path

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [(1, "The cat's  hat.\nIt sat\n\n"), (2, None), (3, ""), (4, "word " * 700), (5, "same text"), (5, "same text"), (None, "no id"),
         (6, "x<|endoftext|>y 漢字 \x1f \u2581z 🙂"), (7, "a b " * 40 + "c"), (8, " \t\n"), (9, "one two three " * 9 + "one two x x x x x x x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "p", 3, True) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, part string, runs int, links boolean").repartition(3)


def sequences_by_item(lengths, capacity):
    """Best-fit of single items, longest first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 40))
def test_the_plan_is_best_fit(lengths, capacity):
    counts = Counter(lengths)
    steps = packing.plan(dict(counts), capacity)
    placed = defaultdict(list)
    for length, n in counts.items():
        mine = [s for s in steps if s["length"] == length]
        for rank in range(n):
            step = max((s for s in mine if s["rank"] <= rank), key=lambda s: s["rank"])
            k = rank - step["rank"]
            placed[step["sequence"] + k // step["each"]].append((step["offset"] + k % step["each"] * length, length))
    rooms = []
    for laid in placed.values():
        at = 0
        for offset, length in sorted(laid):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert sorted(rooms) == sequences_by_item(lengths, capacity)


def test_the_plans_size_follows_the_capacity():
    rng = random.Random(1)
    steps = packing.plan({n: rng.randrange(1, 10 ** 9) for n in range(1, 2049)}, 2048)
    assert len(steps) < 11 * 4 * 2048


@pytest.mark.parametrize("capacity", [1, 16, 100])
def test_packing(spark, docs, tmp_path, capacity):
    library = tokenizers.Tokenizer.from_file(BYTES)
    packed = packing.pack(docs, str(tmp_path / "packing"), BYTES, capacity=capacity, with_ids=True)
    rows, want, lengths = packed.collect(), Counter(), []
    for i, text in TEXTS:
        ids = library.encode(text or "").ids + [0]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        lengths += [b - a for a, b in zip(cuts, cuts[1:])]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    laid = defaultdict(list)
    for r in rows:
        laid[r.sequence_id].append((r.offset, r.length, r.ids))
    for one in laid.values():
        one.sort()
        assert [o for o, _, _ in one] == np.cumsum([0] + [n for _, n, _ in one])[:-1].tolist()
    assert sorted(capacity - sum(n for _, n, _ in one) for one in laid.values()) == sequences_by_item(lengths, capacity)
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    assert whole == {s: (sum(n for _, n, _ in one), b"".join(x for _, _, x in one)) for s, one in laid.items()}


def test_nothing_to_pack(docs, tmp_path):
    packed = packing.pack(docs.limit(0), str(tmp_path / "none"), BYTES, with_ids=True)
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def plain_runs(words, least_length=6, least_exponent=4):
    found = []
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(words[x] == words[x + r] for x in range(i, i + size - r)) for r in range(1, q))
            if size >= max(least_length, least_exponent * q) and not smaller:
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=6), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
def test_runs_of_many_documents(parts):
    docs = [[c for word, n in one for c in word * n] for one in parts]
    texts = pa.array([" ".join(one) for one in docs])
    words, spelled, bounds = periods.words_of(texts)
    start, length, period = periods.find(words, bounds, 6, 4)
    got = [[] for _ in docs]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        doc = int(np.searchsorted(bounds, s, "right")) - 1
        got[doc].append((s - int(bounds[doc]), n, q))
    assert got == [plain_runs(one) for one in docs]


def expected_digest(doc_id, words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_runs_and_digests(docs):
    want = Counter(expected_digest(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in TEXTS)
    assert Counter(tuple(r) for r in periods.digests(periods.runs(docs)).collect()) == want
    by_id = {r.doc_id: r for r in periods.runs(docs).collect()}
    assert [tuple(r) for r in by_id[7].runs] == [(0, 80, 2)] and by_id[7].collapsed == "a b c" and by_id[7].n_words == 81
    assert by_id[2].runs == [] and by_id[2].collapsed == "" and by_id[8].n_words == 0
    assert periods.runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.runs(docs, least_exponent=2)


def test_planted_words(spark):
    rows = [(i, [f"w{k}" for k in range(i % 37)]) for i in range(400)] + [(None, ["x"] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>")
    n_planted = 0
    for r in df.select("doc_id", "words", periods.planted(F.col("doc_id"), F.col("words")).alias("got")).collect():
        h, n, want = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()), len(r.words), r.words
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w if i < a else r.words[a + (i - a) % p] for i, w in enumerate(r.words)]
            n_planted += want != r.words
        assert r.got == want
    assert n_planted > 5


def plain_alignment(texts):
    """Per text ids of both sides, groups and links, by walking along both."""
    library, pieces = tokenizers.Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    spelled, byte_of, out = {i: t for t, i in library.get_vocab().items()}, byte_symbols(), []
    for text in texts:
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        one = [bytes(byte_of[c] for c in spelled[i]) for i in a]
        two = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(one) != b"".join(two) or b"".join(two) != (" " + text).encode():
            out.append(None)
            continue
        i, j, end_a, end_b, links, groups = 0, 0, len(one[0]), len(two[0]), [], [([a[0]], [b[0]])]
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if i == len(a):
                break
            if step_a and step_b:
                groups.append(([], []))
            if step_a:
                end_a += len(one[i])
                groups[-1][0].append(a[i])
            if step_b:
                end_b += len(two[j])
                groups[-1][1].append(b[j])
        out.append((a, b, groups, links))
    return out


@pytest.mark.parametrize("group", [1, 2_000_000])
def test_alignment(spark, docs, tmp_path, monkeypatch, group):
    plain = plain_alignment([t for _, t in TEXTS])
    count = Counter(link for one in plain if one for link in one[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (i, _), one in zip(TEXTS, plain):
        if one is None:
            want[i, 0, 0, 0, 0, "", 0, 0] += 1
        else:
            a, b, groups, links = one
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            want[i, len(a), len(b), len(groups), len(links), told, sum(count[x] == most[x[1]] for x in links), sum(map(count.__getitem__, links))] += 1
    assert sum(one is None for one in plain) == 3  # null, empty, and the one that holds the word mark
    found = alignment.aligned_counts(docs, str(tmp_path / "aligned"), BYTES, PIECES)
    assert Counter(tuple(r) for r in found.collect()) == want
    counts = {(r.a_id, r.b_id): r["count"] for r in alignment.pair_counts(spark.read.parquet(str(tmp_path / "aligned/aligned"))).collect()}
    assert counts == count
    both = alignment.aligner(BYTES, PIECES)
    texts = [t or "" for _, t in TEXTS]
    assert [both.align(pa.array([t])).n_links.tolist() for t in texts] == [[len(one[3]) if one else 0] for one in plain]


def test_nothing_to_align(docs, tmp_path):
    assert alignment.aligned_counts(docs.limit(0), str(tmp_path / "none"), BYTES, PIECES).count() == 0
