"""Secret scan, repetition, toxicity and language against plain rules and held-out rows."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchframe.llm import langmask, repetition, secret_scan, toxicity

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PLAIN = [("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
         ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def spans_by_hand(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, e, ok) in enumerate(PLAIN) for m in e.finditer(text) if ok(m)]
    return ",".join(x[2] for x in sorted(found))


def test_trigram_queries():
    query = secret_scan.trigram_query(ASSIGN.pattern)
    assert {frozenset(("tok", "oke", "ken"))} < set(query) and len(query) == 6
    assert secret_scan.trigram_query("[0-9a-f]+") == secret_scan.ANY
    assert secret_scan.trigram_query("a.b") == secret_scan.ANY and secret_scan.trigram_query("(abc)?") == secret_scan.ANY
    assert secret_scan.trigram_query("(?:abc|de)x*fgh") == frozenset([frozenset(["fgh"])])


def test_scan_matches_plain_search(spark):
    rng = random.Random(3)
    bits = ["password", "PassWD", "token", "token", "api_key", "ApiKey", "secret", "=", ": ", "'", '"', " ", "AKIA", "AKIAQWERTYUIOP12", "0123456789abcdef", "abcdefgh1", "é🙂", "x", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(400)] + [None, "", "a " * 50_000 + "token=abcdefgh9", "token=token: abcdefghijk"]
    rows = [(i if i % 50 else None, t, "r", [1]) for i, t in enumerate(texts)] + [(1, texts[1], "r", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string, spans array<int>")
    got = secret_scan.scan(docs, carry=["rules"])
    written = [(r.doc_id, r.text, r.s) for r in got.select("doc_id", "text", secret_scan.written(F.filter("spans", lambda s: s["rule"] < 3)).alias("s")).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(written, key=key) == sorted(((i, t or "", spans_by_hand(t or "")) for i, t, _, _ in rows), key=key)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_other_rules_and_masks(spark):
    text = "k -----BEGIN RSA PRIVATE KEY----- xoxb-123456789012-abcdef é token='abcdefgh12' end"
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(
        secret_scan.redact(F.col("text"), F.col("spans")).alias("t"), F.transform("spans", lambda s: s["kind"]).alias("k")).first()
    assert row.k == ["private_key", "chat_token", "assign"]
    assert row.t == "k <secret> <secret> é <secret>' end"


def test_many_secrets_in_one_text(spark):
    rng = random.Random(9)
    parts = [rng.choice(["token=abcdefgh%d ", "é🙂 ", "secret: x ", "AKIAQWERTYUIOP%06d ", "%032x|", "token='AKIAQWERTYUIOP%06d' "]) for _ in range(40_000)]
    text = "".join(p % i if "%" in p else p for i, p in enumerate(parts))
    docs = spark.createDataFrame([(1, text), (2, "token=abcdefgh1 " * 256), (3, "token=abcdefgh1 " * 257 + "é")], "doc_id long, text string")
    scanned = secret_scan.scan(docs, secret_scan.BASE)
    begun = time.time()
    got = {r.doc_id: r for r in scanned.select("doc_id", secret_scan.written(F.col("spans")).alias("s"),
                                               secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert time.time() - begun < 30
    assert got[1].s == spans_by_hand(text) and got[1].s.count(",") > 25_000
    covered, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in got[1].s.split(","))):
        covered += [text[at:a], "<secret>"] if a >= at else []
        at = max(at, b)
    assert got[1].t == "".join(covered) + text[at:]
    assert got[2].t == "<secret> " * 256 and got[3].t == "<secret> " * 257 + "é"


def repeats_by_hand(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_longest_repeats(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(rng.choice([0, 1, 2, 3, 17, 60]))] for _ in range(12)]
    got = repetition.longest_repeats(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
    assert got.tolist() == [k for t in texts for k in repeats_by_hand(t)]


def test_repetition_rules(spark):
    unique = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, unique), (2, None), (3, ""), (4, "one two"), (5, "same line here\n" * 30), (6, unique + " " + passage + " " + unique.replace("w", "v") + " " + passage),
            (7, "# a b\x0bc $%"), (7, "# a b\x0bc $%"), (8, "x " * 20_000), (9, "a b\n \n \na b\na  b")]
    frame = spark.createDataFrame([(i, t, 5, True) for i, t in docs], "doc_id long, text string, n_words int, kept boolean")
    got = {r.doc_id: r for r in repetition.repetition(frame).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6, 8)] == [True, False, False, False, False, False, False]
    assert [got[i].base_failed for i in (1, 2, 3, 5, 6)] == [False, True, True, True, True] or not got[6].base_failed
    assert got[6].longest_repeat == 60 and got[8].n_words == 20_000 and got[5].n_dup_lines == 29
    assert (got[7].n_words, got[7].word_chars, got[7].n_symbols) == (4, 7, 3) and got[9].n_dup_lines == 1
    for i, text in docs:
        words = (text or "").encode().split()
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
        assert got[i].n_repeat_words == len(inside)
    assert repetition.repetition(frame.limit(0)).count() == 0


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(80)}" for _ in range(8)) for _ in range(rng.randint(1, 9))]
        bad = rng.random() < 0.3
        if bad:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['vilex', 'nastyq'])} thing"
        rows.append((i, ". ".join(sentences) + ".", int(bad)))
    return rows


def fitted_by_hand(texts, toxic, least, rounds, step, shrink):
    """The same descent with plain loops over documents, sentences and words."""
    def parts(text):
        return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s] or [""]

    def feats(sentence):
        return [f for w in set(re.findall(r"[^\W\d_]+", sentence.lower())) for f in [w, *(f"^{w[:n]}" for n in (4, 5) if len(w) > n)]]

    bags = [[feats(s) for s in parts(t)] for t in texts]
    seen = Counter(f for bag in bags for f in {f for sentence in bag for f in sentence})
    names = sorted(f for f, c in seen.items() if c >= least)
    w, m, v = ({f: 0.0 for f in names} for _ in range(3))
    n = len(texts)
    bias, mb, vb = math.log(sum(toxic) / n / max(1.0, sum(map(len, bags)) / n)), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = dict.fromkeys(names, 0.0), 0.0
        for bag, y in zip(bags, toxic):
            p = [1 / (1 + math.exp(-bias - sum(w.get(f, 0.0) for f in s))) for s in bag]
            clean = math.prod(1 - x for x in p)
            for s, x in zip(bag, p):
                # -d log(chance of the label) / d z of the sentence
                d = (-clean * x / (1 - clean) if y else x) / n
                gb += d
                for f in s:
                    if f in g:
                        g[f] += d
        rate = step * math.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        for f in names:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.999 * v[f] + 0.001 * g[f] ** 2
            scale = rate / (math.sqrt(v[f]) + 1e-6)
            moved = w[f] - scale * m[f]
            w[f] = math.copysign(max(abs(moved) - scale * shrink, 0), moved)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb ** 2
        bias -= rate * mb / (math.sqrt(vb) + 1e-6)

    def score(text):
        return 1 - math.prod(1 - 1 / (1 + math.exp(-bias - sum(w.get(f, 0.0) for f in feats(s)))) for s in parts(text))

    return bias, w, score


def test_toxicity_is_the_plain_descent(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("lorem", "dol", "vile") for b in ("", "ish", "ness", "q")]
    texts = ["\n".join(". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2))) for _ in range(60)] + ["", "..."]
    toxic = [int("vileness" in t.split()) for t in texts]
    model = toxicity.fit(texts, np.array(toxic), least_documents=4, rounds=25)
    bias, weights, score = fitted_by_hand(texts, toxic, 4, 25, 0.15, 1e-4)
    assert model.bias == pytest.approx(bias, abs=1e-9)
    assert {f: model.weights.get(f, 0.0) for f in weights} == pytest.approx(weights, abs=1e-9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == pytest.approx({i: score(t or "") for i, t in [*enumerate(texts), (99, None)]}, abs=1e-9)


def test_toxicity_takes_the_first_labels_by_hash(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.unionAll(docs.where("doc_id < 50").withColumn("text", F.lit("a second text")))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).repartition(9)
    labels = labels.unionAll(labels.where("doc_id < 3000")).unionAll(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int"))
    kept = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: kept.append((texts, toxic.tolist())))
    toxicity.train(docs, labels, most_rows=100)
    first = spark.range(4000).orderBy(F.xxhash64("id")).limit(100).collect()
    want = sorted((r.id, "a second text" if r.id < 50 else f"t{r.id}", r.id % 3 == 0) for r in first)
    assert kept == [([t for _, t, _ in want], [y for _, _, y in want])]
    many = labels.where("doc_id = 7").unionAll(spark.range(3000).select(F.lit(7).cast("long"), F.lit(1)))
    toxicity.train(docs, many, most_rows=10)  # one id repeated: all there is to choose from
    assert kept[1] == (["a second text"] * 2, [False, True])


def test_toxicity_learns_which_sentence(spark):
    rows = toxic_corpus(600, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.5), (901, "", 0.5), (902, "fine " * 30_000 + ". vilex", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(902, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_rows=400)
    got = {r.doc_id: r for r in toxicity.score(docs, model, with_spans=True).collect()}
    held = [(got[i].predicted, y, t, got[i]) for i, t, y in rows if not i % 5]
    assert sum(p == y for p, y, _, _ in held) / len(held) > 0.95
    for p, y, t, r in held:
        if p and y:
            assert re.search("vilex|nastyq", t[r.worst_start:r.worst_end]) and r.offending
    assert got[900].score == got[901].score < 0.5 and 0 <= got[902].score <= 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_language_by_masks(spark):
    rng = random.Random(4)
    syllables = {"xa": ["tha", "ing", "wor", "ley"], "yb": ["çao", "nho", "eix", "ara"], "zc": ["sch", "keit", "über", "ung"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "12 34 !!", "xa"), (902, "", "yb"), (903, "tha" * 100_000, "xa"), (903, "thaing", "xa")], "doc_id long, text string, lang string")
    filters = langmask.train(docs.where("doc_id % 4 <> 2"), most_texts=50)
    assert filters.languages == ["xa", "yb", "zc"] and (filters.false_rate() < 1e-3).all()
    got = {r.doc_id: r for r in langmask.identify(docs, filters).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = langmask.train(docs.limit(0))
    assert {r.lang_pred for r in langmask.identify(docs, empty).collect()} == {"und"}


def test_filters_of_many_languages():
    samples = {f"l{i:02d}": [f"{chr(0x4E00 + 40 * i + j)}{chr(0x4E01 + 40 * i + j)}" * 3 for j in range(20)] for i in range(20)}
    filters = langmask.fit(samples, n=2, least_texts=1, slot_bits=14)
    assert filters.slots.shape == (1 << 14, 3)
    named, _ = filters.judge([texts[0] for texts in samples.values()], filters.false_rate())
    assert named == list(samples)


def test_a_label_belongs_to_its_row(spark):
    """Rows of one id with different labels teach their own language each; the sample is exact and bounded."""
    words = {"en": "the house and the garden were shown with them", "de": "das haus und der garten wurden ihnen gezeigt"}
    rows = [(i // 2, f"{words[l]} {i}", l) for i in range(60) for l in [("en", "de")[i % 2]]]
    rows += [(0, f"{words['en']} {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (5, 30, 1000):
        filters = langmask.train(docs, most_texts=most)
        judged = langmask.identify(spark.createDataFrame([(1, words["en"]), (2, words["de"])], "doc_id long, text string"), filters)
        assert {r.doc_id: r.lang_pred for r in judged.collect()} == {1: "en", 2: "de"}


def test_masks_against_sets_of_grams():
    """Counts are those of plain sets of n-grams, plus what the filters answer wrongly, less the rate of that."""
    samples = {"a": ["abcd bcde", "cdef abca"], "b": ["xyzx yzxy", "zxyz abcd"]}
    filters = langmask.fit(samples, n=3, least_texts=1, slot_bits=16)
    sets = {l: {int(g) for t in texts for g in langmask.grams([t], 3)[0]} for l, texts in samples.items()}
    for text, want in (("abcdef", "a"), ("xyzxyz", "b"), ("zxyzx", "b")):
        codes = {int(g) for g in langmask.grams([text], 3)[0]}
        hits = {l: len(codes & known) for l, known in sets.items()}
        named, share = filters.judge([text], filters.false_rate())
        assert named == [want] and hits[want] == max(hits.values()) and 0 < share[0] <= 1


def test_a_carried_text_is_sent_to_be_scored_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "AT_A_TIME", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a bad day. fine", "worst", "x\nbad"] * 4)], "doc_id long, text string")
    model = toxicity.Model(-2.0, {"bad": 3.0, "^wors": 1.5})
    carried, plain = toxicity.score(docs, model, carry=["text"]), toxicity.score(docs, model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.score, r.predicted) for r in carried.collect()} == {r.doc_id: (r.score, r.predicted) for r in plain.collect()}
    assert {r.doc_id: r.text for r in carried.collect()} == texts
    assert "__text" not in carried._jdf.queryExecution().optimizedPlan().toString()
