"""Near-duplicates, vector links and mixing against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece

import corpus_pipeline
from watchframe.llm import components, mixing, multi_index, weighted_minhash
from watchframe.llm.queries import ORACLE, mix_documents
from watchframe.llm.texts import tokenizer_path

DOCS = "doc_id long, text string, lang string, key int, class_id string"


def classes_by_hand(texts, similarity=0.8, idf_weight=0.25):
    first = {}
    for i in sorted(texts, key=lambda i: i):
        first.setdefault(texts[i], i) if (texts[i] or "").split() else None
    bags = {}
    for text, i in first.items():
        w = text.encode().split()
        bags[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    df = Counter(s for bag in bags.values() for s in bag)
    n = max(2, len(bags) + sum(1 for t in texts.values() if not (t or "").split()))
    weight = {i: {s: c * (1 + idf_weight * np.log(n / df[s]) / np.log(n)) for s, c in bag.items()} for i, bag in bags.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in bags:
        for j in bags:
            if i < j:
                common = sum(min(x, weight[j][s]) for s, x in weight[i].items() if s in weight[j])
                if common >= similarity * (sum(weight[i].values()) + sum(weight[j].values()) - common):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: root(first.get(t, i)) if (t or "").split() else i for i, t in texts.items()}


def near_corpus(seed, groups, copies):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(rng.choice(copies)):
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return dict(enumerate(texts + [None, "", " \n", texts[0], "long " * 3000 + "tail", "one"]))


@pytest.mark.parametrize("seed,copies,block", [(1, [1, 2, 5], 400), (2, [30, 60], 20)])
def test_near_duplicates(spark, tmp_path, seed, copies, block):
    texts = near_corpus(seed, 8, copies)
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in texts.items()], DOCS)
    got = weighted_minhash.near_duplicates(docs, str(tmp_path / "a"), block=block, parts=16).collect()
    want = classes_by_hand(texts)
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_groups_of_a_component_of_many_classes_stay_bounded(spark, tmp_path, monkeypatch):
    """Articles that share half their words, each with a copy: one component of candidates, many classes."""
    rng, largest = random.Random(9), []
    shared = [f"s{k}" for k in range(40)]
    texts = []
    for i in range(150):
        words = shared + [f"w{i}x{rng.randrange(10 ** 6)}" for _ in range(40)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    compare = weighted_minhash.link_blocks

    def watched(rows, similarity):
        by = ["component", "block", *(["guests"] if "guests" in rows.columns else [])]
        largest.append(max((r["count"] for r in rows.groupBy(by).count().collect()), default=0))
        return compare(rows, similarity)

    monkeypatch.setattr(weighted_minhash, "link_blocks", watched)
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], DOCS)
    got = weighted_minhash.near_duplicates(docs, str(tmp_path / "a"), block=60, bands=60, rows=1, parts=16).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(300)}
    assert len(largest) == 2 and largest[1] <= 2 * 60 + 50


def test_one_of_each_keeps_columns_and_null_ids(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", 1, "x"), (2, "a b c d e f", "de", 2, "y"), (2, "a b c d e f", "de", 2, "y"), (None, "other text of six words here", "fr", 3, "z"),
            (3, None, "en", 1, "x"), (4, None, "en", 1, "x"), (5, "lone", None, None, None), (5, "lone", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = weighted_minhash.one_of_each(docs, str(tmp_path / "b"), parts=16)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.key or 0) for r in kept.collect()) == [(0, 3), (1, 1), (3, 1), (4, 1), (5, 0)]
    assert weighted_minhash.near_duplicates(docs.limit(0), str(tmp_path / "c"), parts=16).count() == 0


def test_samples_collide_as_often_as_sets_agree():
    sampler, rng = weighted_minhash.Sampler(2000, 1, 3), np.random.default_rng(1)
    code = np.sort(rng.integers(1 << 60, size=60, dtype=np.uint64))
    w1, w2 = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    bands = sampler.bands_of(np.concatenate([code, code]), np.concatenate([w1, w2]), np.array([60, 60]))
    assert abs((bands[0] == bands[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.04


def test_components(spark, tmp_path):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 401 + i) for i in range(50)] + [(7, 7)]
    up = list(range(500))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = components.components(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "c")).collect()
    assert {r.node: r.root for r in got} == {i: root(i) for a, b in links if a != b for i in (a, b)} and len(got) == len({r.node for r in got})
    assert components.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d")).count() == 0


def test_vector_links(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = base[:12].repeat(25, axis=0) + rng.normal(scale=0.04, size=(300, 16))
    vectors = [(i, v) for i, v in enumerate([*base, *near, base[0], base[0], 3 * base[1]])]
    rows = [(i, [float(x) for x in v], 1) for i, v in vectors]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0], 1), (906, [1e300] * 16, 1), (907, [1e-300] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in multi_index.near_duplicates(frame, str(tmp_path / "v"), block=40).collect()}
    points = np.array([v for _, v in vectors] + [np.ones(16), np.ones(16)])
    ids = [i for i, _ in vectors] + [906, 907]
    points /= np.linalg.norm(points, axis=1)[:, None]
    linked = points @ points.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in ids] == linked.sum(axis=1).tolist()
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, y in zip(*np.nonzero(linked)):
        a, b = sorted((root(ids[x]), root(ids[y])))
        up[b] = a
    assert {i: got[i].component_id for i in ids} == {i: root(i) for i in ids}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert multi_index.near_duplicates(frame.limit(0), str(tmp_path / "w")).count() == 0


def all_pairs(rows):
    """Links and component of each id by comparing all vectors of one length."""
    ids = [i for i, _ in rows]
    links, up = Counter(), {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, v) in enumerate(rows):
        for j, w in rows[:k]:
            if len(v) == len(w) and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (links[i], root(i), root(i) == i) for i in ids}


def jittered(rng, base, n, scale):
    return [base + rng.normal(scale=scale, size=len(base)) for _ in range(n)]


@pytest.mark.parametrize("case", ["one repeated vector", "one component", "several lengths", "dense cluster"])
def test_vectors_of_any_length(spark, tmp_path, monkeypatch, case):
    rng, largest = np.random.default_rng(4), []
    vectors = {
        "one repeated vector": [np.arange(1.0, 65.0)] * 50,
        "one component": [np.array([x]) for x in (1.0, 2.0, -1.0, -3.0, 1.0, 0.5)],
        "several lengths": [*rng.normal(size=(60, 8)), *[np.ones(5)] * 5, *[np.ones(3)] * 4, *jittered(rng, np.ones(12), 20, 0.1), np.ones(7)],
        "dense cluster": [*jittered(rng, np.ones(16), 300, 0.05), *rng.normal(size=(200, 16))],
    }[case]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    compare = multi_index.compare

    def watched(queries, listed, cosine):
        for side in (queries, listed):
            largest.append(max(r["count"] for r in side.groupBy("dim", "cell", "part", "visitors").count().collect()))
        return compare(queries, listed, cosine)

    monkeypatch.setattr(multi_index, "compare", watched)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = multi_index.near_duplicates(frame, str(tmp_path / "v"), block=20, cell_rows=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == all_pairs(rows)
    assert max(largest) <= 45


def test_links_count_for_both_ends(spark):
    """A visitor that the listed vector does not visit in turn is counted there as well."""
    unit = np.array([1.0, 0.0]).tobytes()
    near = np.array([0.99, np.sqrt(1 - 0.99 ** 2)]).tobytes()
    asked = spark.createDataFrame([(2, 4, 0, 0, 9, 1, 5, unit)], "dim int, cell int, part int, visitors int, home int, entry long, copies long, unit binary")
    for visits, want in (([4], [(1, 3)]), ([4, 9], [(1, 3)])):
        listed = spark.createDataFrame([(2, 4, 0, 0, 7, 3, visits, near)], "dim int, cell int, part int, visitors int, entry long, copies long, visits array<int>, unit binary")
        got = sorted((r.a, r.n) for r in multi_index.compare(asked, listed, 0.95).collect() if r.b is None)
        assert got == want + ([(7, 5)] if 9 not in visits else [])


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), margin=6.0)
    points = rng.normal(size=(20, 8))
    one, two = grid.halves(points)
    for i, cells in enumerate(grid.visits(points)):
        total = (one[i][:, None] + two[i]).ravel()
        assert cells == [c for c in np.argsort(total) if total[c] <= total.min() + 6.0]


LEVELS = {"a": "a", "b": "b"}


def shares_by_hand(tree, budget):
    """tree: capacity, or a list of (weight, tree)."""
    def capacity(t):
        return t if isinstance(t, int) else sum(capacity(c) for _, c in t)

    if isinstance(tree, int):
        return [min(tree, budget)]
    order = sorted(range(len(tree)), key=lambda i: (capacity(tree[i][1]) / tree[i][0], i))
    given, rest, heavy, open_ = {}, budget, sum(w for w, _ in tree), None
    for i in order:
        w, child = tree[i]
        if open_ is None and capacity(child) * heavy > rest * w:
            open_ = (rest, heavy)
        given[i] = capacity(child) if open_ is None else min(capacity(child), open_[0] * w // open_[1])
        rest, heavy = rest - capacity(child), heavy - w
    return [x for i, (_, child) in enumerate(tree) for x in shares_by_hand(child, given[i])]


def test_mixing(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), "a1" if k < 6 else "a2", f"b{k % 3}", 0) for i in range(300) for k in [rng.choice([0] * 8 + list(range(9)))]]
    rows += [(1000, None, "a2", None, 0), (None, "x y z", None, "b1", 0), (7, rows[7][1], rows[7][2], rows[7][3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, copies int")
    weights = spark.createDataFrame([("a2", 3), ("a1/b1", 2)], "path string, weight long")
    total = sum(len((t or "").split()) for _, t, _, _, _ in rows)
    taken = mixing.mix(docs, str(tmp_path / "m"), {"a": F.col("a"), "b": F.col("b")}, weights=weights, most_epochs=2, seed=3)
    assert taken.columns == ["doc_id", "text", "a", "b", "copies", "mix_tokens", "mix_budget"]
    sizes, budget_of, spent = Counter(), {}, Counter()
    for _, t, a, b, _ in rows:
        sizes[a or "", b or ""] += len((t or "").split())
    for r in taken.collect():
        assert r.mix_tokens == len((r.text or "").split()) and 1 <= r.copies <= 2
        budget_of[r.a or "", r.b or ""] = r.mix_budget
        spent[r.a or "", r.b or ""] += r.copies * r.mix_tokens
    leaves = sorted(sizes)
    tops = sorted({a for a, _ in leaves})
    tree = [({"a2": 3}.get(a, 1), [({("a1", "b1"): 2}.get(leaf, 1), 2 * sizes[leaf]) for leaf in leaves if leaf[0] == a]) for a in tops]
    want = dict(zip(leaves, shares_by_hand(tree, total)))
    assert budget_of == {leaf: x for leaf, x in want.items() if leaf in budget_of}
    assert all(want[leaf] <= spent[leaf] < want[leaf] + 18 for leaf in leaves if want[leaf])
    again = mixing.repeated(taken, ["doc_id", "a"])
    assert again.count() == sum(r.copies for r in taken.collect())
    assert mixing.mix(docs.limit(0), str(tmp_path / "e"), {"a": F.col("a")}).count() == 0


def test_mixing_cuts_ties_as_the_twin(spark, tmp_path):
    """Null and repeated ids share their place; a budget may end among them, and among equal rows."""
    duckdb = pytest.importorskip("duckdb")
    from watchframe.llm import queries

    rows = [(None, "a b", "en", "s1")] * 400 + [(5, "c d e", "de", "s2")] * 300 + [(5, "f", "de", "s2")] * 300 + [(i, "g h", "en", "s3") for i in range(9, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    got = queries.mix_documents(spark, docs, str(tmp_path / "m")).select("copies", "doc_id", "lang", "mix_budget", "mix_tokens", "source")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(f"SELECT copies, doc_id, lang, mix_budget, mix_tokens, source FROM ({queries.ORACLE['op7_source_mix']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    for budget in (100, 101, 777):
        taken = mixing.mix(docs.where("doc_id is null"), str(tmp_path / f"b{budget}"), {"lang": docs["lang"]}, total=budget).collect()
        assert budget <= sum(r.copies * r.mix_tokens for r in taken) < budget + 2


def test_buckets_of_a_large_leaf(spark):
    from pyspark.sql import functions as F

    places = [0, 1, 2 ** 17, 2 ** 40 + 12345, 2 ** 47, 2 ** 48 - 1]
    for n in (1, 7, 40_000, 2 ** 31):
        df = spark.createDataFrame([(p, n) for p in places], "at long, n long")
        got = [r[0] for r in df.select(mixing.bucket_of(F.col("at"), F.col("n"))).collect()]
        assert got == [((p >> 17) * n) >> 31 for p in places] and got == sorted(got) and 0 <= got[0] and got[-1] < n


def test_pipeline(spark, tmp_path):
    base = [" ".join(f"w{random.Random(i).randrange(900)}x{k}" for k in range(40)) for i in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "src0", len(base[3])), (101, base[4] + " tail", "en", "src1", 0), (102, "clean start token=abcdefgh12 end of text", "en", "src1", 40), (103, None, None, None, None)]
    rows += [(200 + i, f"{t} vilex. more", "en", "src2", 0) for i, t in enumerate(f"text {i} of its own kind {i * 7} here" for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "in")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] >= 200)) for r in rows], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    left = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, folder).write.parquet(f"{folder}/{name}")
        left = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id: r for r in left.collect()})
        assert name == "sentencepiece" or left.columns == docs.columns
    assert not any(i >= 200 for i in seen[0]) and set(range(30)) | {100, 101, 102, 103} == set(seen[0])
    assert set(seen[1]) == set(range(30)) | {102, 103}
    assert seen[2][102].text == "clean start <secret> end of text" and seen[2][102].n_chars == 32 and seen[2][103].text is None
    assert set(seen[4]) <= set(seen[1]) and len(seen[4]) > 15
    assert mix_documents(spark, docs.limit(0), str(tmp_path / "mix")).count() == 0


def test_pipeline_is_a_chain_of_plain_steps(spark, tmp_path):
    rng = random.Random(4)
    texts = near_corpus(6, 40, [1, 1, 2, 4])
    texts |= {500: "a clean start token=abcdefgh12 and " + " ".join(f"k{rng.randrange(99)}" for _ in range(30)), 501: None, 502: "", 503: "word " * 4_000}
    toxic = {900 + i: f"text {i} of its own kind {i * 7} here vilex. more" for i in range(40)}
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0"] * 4 + ["src1", "src2"]), len(t or ""), "x") for i, t in (texts | toxic).items()]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] >= 900)) for r in rows], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())

    kept = {i for i, root in classes_by_hand(texts).items() if i == root}
    assert 501 in kept and len(kept) < len(texts) - 10
    masked = [(i, t.replace("abcdefgh12", "").replace("token=", "<secret>") if i == 500 else t, lang, source, n, x) for i, t, lang, source, n, x in rows if i in kept]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(masked, columns=["doc_id", "text", "lang", "source", "n_chars", "copies"]))
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({ORACLE['op7_source_mix']})").fetchall())
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for i, text, *_ in masked:
        ids = model.encode(text or "")
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), model.decode(ids))]
        if copies.get(i):
            want[(i, len(ids), *digest)] += copies[i]
    assert got == want and max(got.values()) > 1
