"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is the multiset of its runs of five words (of all its words, if it has fewer). A shingle weighs its count in the text
times ``1 + idf_weight * ln(N / df) / ln N``, where df of the N different texts hold it. Two texts are linked if the sum of
the smaller weights over the sum of the larger ones is ``similarity`` or more. A class is what links connect; equal texts
are one class from the start and count as one text.

1. Shingle hashes go, packed by batch and part of the hash range, to one task per part, which counts texts per shingle and
   sends back only shingles that two texts share. What a text does not share weighs the same for all, so its sum is known.
2. Linked texts share at least ``similarity`` of their weight. Texts that share less with all others together are done.
   For the rest, samples are drawn over the shared shingles, which can only make linked texts collide more often, and
   hashed in bands. Texts that collide in a band are candidates; a star to the smallest in each bucket keeps that linear.
3. Components of candidates are verified in blocks of ``block`` texts. In a component of several blocks, a few of its texts
   join every block, so that what belongs together grows together; then all texts outside its largest class, in blocks as
   well, are compared with every block. So any two candidates are compared, or already of one class, and no group holds more
   than about two blocks.

Hashes have 40 bits and those of their part, samples 64 bits. Defined results: null and empty texts, and texts of white
space only, are linked with nothing; a class is named by its smallest id, null ids last; rows that repeat an id share its
result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.components import Forest, components, stored
from watchframe.llm.texts import Cache, give_back, text_groups, whole_text

WORDS = 5
HASH_BITS = 40
GROUP_TEXTS, GROUP_CHARACTERS = 1_000, 4_000_000
CACHED_WORDS = 400_000
TABLE_BITS = 16  # variates of the sampling are drawn from tables of 2**16 entries, addressed by the shingle's hash
PART_CHARACTERS, LEAST_PARTS = 8_000_000, 64
SAMPLED_TOGETHER = 250_000  # shingles, or one text
SHARED_TEXTS = 32  # of a component of several blocks, about so many texts join every block


def text_key(doc_id: Column, text: Column) -> Column:
    """Equal texts have equal keys; a text without words has a key of its own row's id."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.xxhash64(F.lit("no words"), doc_id))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.words = Cache(CACHED_WORDS)

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64-bit hashes of all shingles, the number of each's text, and how many each text has."""
        known, flat, lengths = self.words.entries, [], np.zeros(len(texts), np.int64)
        for k, words in enumerate(text.encode().split() for text in texts):
            flat.extend(map(known.get, words, words))  # a known word is replaced by its hash at once
            lengths[k] = len(words)
        fresh = self.words.missing({word for word in flat if type(word) is bytes})
        for word in fresh:
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter((word if type(word) is int else known[word] for word in flat), np.uint64, len(flat))
        self.words.forget(fresh)
        begins = np.cumsum(lengths) - lengths
        counts = np.where(lengths >= WORDS, lengths - WORDS + 1, (lengths > 0).astype(np.int64))
        text = np.repeat(np.arange(len(texts)), counts)
        first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
        code, ends = np.zeros(len(first), np.uint64), np.repeat(begins + lengths, counts)
        for k in range(WORDS):
            at = first + k
            inside = at < ends
            code = code * np.uint64(0x9E3779B97F4A7C15)
            code[inside] += hashes[at[inside]] | np.uint64(1)
        return mixed(code), text, counts


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(payload: pa.Buffer, *kinds: str) -> list[np.ndarray]:
    sizes, at, found = np.frombuffer(payload, "<u4", len(kinds)), 4 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        found.append(np.frombuffer(payload, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return found


SENT = ("<i8", "<u4", "<u4", "<u4", "u1", "<u4", "<u4")  # keys, totals, counts; hash low, high; where the count is over 1, it
SHARED = ("<i8", "<u4", "<u4", "<u8", "<u4", "<u4")  # keys, totals, counts; hash, count, df


def scatter(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows ``part``, ``payload`` with the different shingles of some texts in a part of the hash range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, at = batch.column(0).to_numpy(), 0
            for texts in text_groups(batch.column(1), GROUP_CHARACTERS, GROUP_TEXTS):
                unique, first = np.unique(keys[at:at + len(texts)], return_index=True)
                found = list(_scatter(shingler, unique, [texts[i] for i in first], parts))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["part", "payload"])
                at += len(texts)
                give_back()

    return keyed.select("key", "text").mapInArrow(run, "part int, payload binary")


def _scatter(shingler: Shingler, keys: np.ndarray, texts: list[str], parts: int) -> Iterator[tuple[int, bytes]]:
    code, text, totals = shingler.shingles(texts)
    part = (code >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)
    low = code & np.uint64((1 << HASH_BITS) - 1)
    joint = np.sort(part << np.uint64(50) | text.astype(np.uint64) << np.uint64(HASH_BITS) | low)
    new = np.flatnonzero(np.append(len(joint) > 0, joint[1:] != joint[:-1]))
    times = np.diff(np.append(new, len(joint)))
    joint = joint[new]
    edges = np.searchsorted(joint, np.arange(parts + 1, dtype=np.uint64) << np.uint64(50)) if parts < 1 << 14 else None
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if a == b:
            continue
        there, counts = np.unique((joint[a:b] >> np.uint64(HASH_BITS)).astype(np.int64) & ((1 << 10) - 1), return_counts=True)
        value, often = joint[a:b] & np.uint64((1 << HASH_BITS) - 1), np.flatnonzero(times[a:b] > 1)
        yield p, _pack(keys[there].astype("<i8"), totals[there].astype("<u4"), counts.astype("<u4"), (value & np.uint64(0xFFFFFFFF)).astype("<u4"),
                       (value >> np.uint64(32)).astype("u1"), often.astype("<u4"), times[a:b][often].astype("<u4"))


def gather(parts_of: DataFrame, parts: int) -> DataFrame:
    """Rows ``bucket``, ``payload``: shingles that two different texts share, with the number of texts, back to the texts."""
    def run(key, group):
        give_back()  # what the group before has left
        part = key[0].as_py()
        columns = list(zip(*(_unpack(p.as_buffer(), *SENT) for p in group.column("payload"))))
        keys, totals, counts, low, high = (np.concatenate(c) for c in columns[:5])
        times = np.ones(len(low), np.uint32)
        base = 0
        for entries, often, value in zip(columns[3], columns[5], columns[6]):
            times[base + often] = value
            base += len(entries)
        _, first = np.unique(keys, return_index=True)  # equal texts of several batches
        once = np.zeros(len(keys), bool)
        once[first] = True
        owner = np.repeat(np.arange(len(keys)), counts)
        code = high.astype(np.uint64) << np.uint64(32) | low
        keep = once[owner]
        owner, code, times = owner[keep], code[keep], times[keep]
        order = np.argsort(code)
        ordered = code[order]
        begins = np.flatnonzero(np.append(len(code) > 0, ordered[1:] != ordered[:-1]))
        size = np.diff(np.append(begins, len(code)))
        df = np.empty(len(code), np.uint32)
        df[order] = np.repeat(size, size)
        keep = df > 1
        owner, code, times, df = owner[keep], code[keep], times[keep], df[keep]
        bucket = (keys.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((owner, bucket[owner]))
        owner, code, times, df = owner[order], code[order] | np.uint64(part) << np.uint64(HASH_BITS), times[order], df[order]
        edges = np.searchsorted(bucket[owner], np.arange(parts + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part_of = slice(edges[b], edges[b + 1])
            there, n = np.unique(owner[part_of], return_counts=True)
            rows.append((int(b), _pack(keys[there], totals[there], n.astype("<u4"), code[part_of], times[part_of], df[part_of])))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return parts_of.groupBy("part").applyInArrow(run, "bucket int, payload binary")


class Sampler:
    """Consistent samples of weighted sets: equal to those of another set with the chance of their weighted Jaccard."""

    def __init__(self, bands: int, rows: int, seed: int):
        draw = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.rate = draw.gamma(2.0, 1.0, n)
        self.shift = draw.uniform(0.0, 1.0, n)
        self.log_c = np.log(draw.gamma(2.0, 1.0, n))
        self.turns = draw.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows

    def bands_of(self, code: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of band hashes per set; sets have ``counts`` entries each, at least one, in order of their hashes."""
        out, ends, a = np.zeros((len(counts), self.bands), np.uint64), np.cumsum(counts), 0
        while a < len(counts):
            start = ends[a] - counts[a]
            b = max(a + 1, int(np.searchsorted(ends, start + SAMPLED_TOGETHER, side="right")))
            self._sample(code[start:ends[b - 1]], weight[start:ends[b - 1]], counts[a:b], out[a:b])
            a = b
        return out.view(np.int64)

    def _sample(self, code: np.ndarray, weight: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        begins = np.cumsum(counts) - counts
        log_w, spread = np.log(weight), mixed(code)
        owner = np.repeat(np.arange(len(counts)), counts)
        for k, turn in enumerate(self.turns):
            at = (mixed(spread ^ turn) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            rate, shift = self.rate[at], self.shift[at]
            t = np.floor(log_w / rate + shift)
            log_a = self.log_c[at] - rate * (t - shift) - rate
            least = np.minimum.reduceat(log_a, begins)
            hit = np.flatnonzero(log_a == least[owner])
            first = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            sample = mixed(code[first] * np.uint64(0x9E3779B97F4A7C15) + t[first].astype(np.int64).astype(np.uint64))
            band = k // self.rows
            out[:, band] = mixed(out[:, band] + sample + np.uint64(k + 1))


def sketch(back: DataFrame, n_texts: int, similarity: float, idf_weight: float, bands: int, rows: int, seed: int) -> DataFrame:
    """Texts that may have a partner: ``key``, ``norm`` (sum of all weights), ``bands``, and their shared shingles."""
    spread = idf_weight / np.log(max(n_texts, 2))

    def idf(df: np.ndarray) -> np.ndarray:
        return 1 + spread * np.log(max(n_texts, 2) / df)

    def run(key, group):
        give_back()
        columns = list(zip(*(_unpack(p.as_buffer(), *SHARED) for p in group.column("payload"))))
        keys, totals, counts, code, times, df = (np.concatenate(c) for c in columns)
        unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
        owner = np.repeat(of, counts)
        order = np.lexsort((code, owner))
        owner, code, times, df = owner[order], code[order], times[order], df[order]
        weight = times * idf(df)
        shared = np.bincount(owner, weight, len(unique))
        norm = shared + (totals[first] - np.bincount(owner, times, len(unique))) * idf(np.array(1.0))
        alive = shared >= similarity * norm * (1 - 1e-9)
        keep = alive[owner]
        owner, code, weight = owner[keep], code[keep], weight[keep]
        counts = np.bincount(owner, minlength=len(unique))[alive]
        found = {"key": unique[alive], "norm": norm[alive]}
        made = sampler.bands_of(code, weight, counts) if len(counts) else np.zeros((0, bands), np.int64)
        ends = np.cumsum(counts)
        cut = [slice(e - c, e) for e, c in zip(ends.tolist(), counts.tolist())]
        return pa.table({
            "key": pa.array(found["key"], pa.int64()), "norm": pa.array(found["norm"], pa.float64()),
            "bands": pa.array(list(made), pa.list_(pa.int64())),
            "codes": pa.array([code[c].tobytes() for c in cut], pa.binary()),
            "weights": pa.array([weight[c].astype("<f4").tobytes() for c in cut], pa.binary())})

    sampler = Sampler(bands, rows, seed)
    return back.groupBy("bucket").applyInArrow(run, "key long, norm double, bands array<long>, codes binary, weights binary")


def similar_pairs(norm: np.ndarray, codes: list[bytes], weights: list[bytes], ask: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each text number of ``ask``, the numbers of all texts that are similar, itself included, by an index of shingles."""
    counts = np.array([len(c) // 8 for c in codes])
    code, weight = np.frombuffer(b"".join(codes), "<u8"), np.frombuffer(b"".join(weights), "<f4").astype(float)
    owner = np.repeat(np.arange(len(codes)), counts)
    order = np.argsort(code, kind="stable")
    sorted_code, sorted_owner, sorted_weight = code[order], owner[order], weight[order]
    ends = np.cumsum(counts)
    for i in ask.tolist():
        own, w = code[ends[i] - counts[i]:ends[i]], weight[ends[i] - counts[i]:ends[i]]
        a, b = np.searchsorted(sorted_code, own), np.searchsorted(sorted_code, own, side="right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(sorted_owner[at], np.minimum(sorted_weight[at], np.repeat(w, n)), len(codes))
        yield i, np.flatnonzero(common >= (similarity - 1e-6) * (norm[i] + norm - common))


def link_blocks(texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` that connect what is similar within each ``component`` and ``block``.

    With a column ``visitor``, only rows that are marked by it are compared, with the others and among each other; ``guests`` numbers
    the blocks of visitors, if there are several.
    """
    def run(frame):
        frame = frame.drop_duplicates("key")
        keys, visitor = frame["key"].to_numpy(), frame["visitor"].to_numpy(bool)
        ask = np.flatnonzero(visitor) if visitor.any() else np.arange(len(keys))
        forest, links = Forest(len(keys)), []
        for i, partners in similar_pairs(frame["norm"].to_numpy(), frame["codes"].tolist(), frame["weights"].tolist(), ask, similarity):
            links += [(keys[i], keys[j]) for j in partners.tolist() if forest.join(i, j)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return texts.groupBy("component", "block", *(["guests"] if "guests" in texts.columns else [])).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, folder: str, similarity: float = 0.8, idf_weight: float = 0.25, bands: int = 16, rows: int = 4,
                    parts: int | None = None, block: int = 400, seed: int = 11, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``class_id``, ``text_key`` and ``kept``, true where it gives its class the name.

    ``folder`` is shared and new. ``parts`` is the number of parts of the hash range, by default one for each ``PART_CHARACTERS`` of
    text, 64 at least and 16,383, 130 GB of text, at most; give larger parts more memory beyond that, as a part must fit a task.
    """
    spark = docs.sparkSession
    text = whole_text(text_column)
    keyed = docs.select(F.col(id_column).alias("doc_id"), text_key(F.col(id_column), text).alias("key"), text.alias("text"))
    ids = stored(keyed.select("doc_id", "key", F.length("text").alias("size")), f"{folder}/ids")
    total = ids.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = parts or min(max(LEAST_PARTS, -(-total // PART_CHARACTERS)), (1 << 14) - 1)
    texts = stored(ids.groupBy("key").agg(F.min("doc_id").alias("first_id")), f"{folder}/texts")
    n_texts = texts.count()
    back = gather(scatter(keyed, parts), parts)
    vectors = stored(sketch(back, n_texts, similarity, idf_weight, bands, rows, seed), f"{folder}/vectors")
    # Candidates: a star in each bucket of each band.
    members = vectors.select("key", F.posexplode("bands").alias("band", "bucket"))
    least = stored(members.groupBy("band", "bucket").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"), f"{folder}/buckets")
    stars = members.join(least, ["band", "bucket"]).select(F.col("key").alias("a"), "b")
    near = stored(components(stars, f"{folder}/candidates").select(F.col("node").alias("key"), F.col("root").alias("component")), f"{folder}/components", n_texts)
    sizes = stored(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), f"{folder}/sizes", n_texts)
    # Verification within blocks.
    placed = near.join(sizes, "component").withColumn("home", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).cast("int"))
    everywhere = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) * F.col("size") < SHARED_TEXTS << 20)
    blocks = F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    compared = placed.select("key", "component", F.explode(blocks).alias("block"), F.lit(False).alias("visitor"))
    payload = vectors.select("key", "norm", "codes", "weights")
    links = stored(link_blocks(compared.join(payload, "key"), similarity), f"{folder}/links")
    # What is outside the largest class of a component of several blocks meets all of its blocks.
    large = placed.where(F.col("blocks") > 1)
    if not sizes.where(F.col("blocks") > 1).isEmpty():
        found = stored(components(links, f"{folder}/linked"), f"{folder}/classes", n_texts)
        large = large.join(found, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("root", "key"))
        large = stored(large.select("key", "component", "blocks", "home", "label"), f"{folder}/large", n_texts)
        main = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        outside = large.join(stored(main, f"{folder}/main", n_texts), "component").where(F.col("label") != F.col("main"))
        # Visitors are in blocks, too: each meets each block of the component, so a group holds two blocks at most.
        outside = stored(outside.select("key", "component", "blocks"), f"{folder}/outside", n_texts)
        guests = stored(outside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("guest_blocks")), f"{folder}/guests", n_texts)
        visits = outside.join(guests, "component").select(
            "key", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("guest_blocks")).cast("int").alias("guests"), F.lit(True).alias("visitor"))
        visits = stored(visits, f"{folder}/visits")
        home = large.join(guests, "component").select(
            "key", "component", F.col("home").alias("block"), F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("guests"), F.lit(False).alias("visitor"))
        place = ["key", "component", "block", "guests"]
        home = home.join(visits.select(*place), place, "left_anti")
        more = link_blocks(home.unionByName(visits).join(payload, "key"), similarity)
        links = links.union(stored(more, f"{folder}/more-links"))
    roots = stored(components(links, f"{folder}/final"), f"{folder}/roots", n_texts)
    named = texts.join(roots, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    named = stored(named, f"{folder}/named", n_texts)
    names = stored(named.groupBy("root").agg(F.min("first_id").alias("class_id")), f"{folder}/names", n_texts)
    classes = stored(named.join(names, "root").select("key", "class_id"), f"{folder}/result", n_texts)
    result = ids.join(classes, "key").select(F.col("doc_id").alias(id_column), "class_id", F.col("key").alias("text_key"))
    return result.withColumn("kept", F.col(id_column).eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that give their class its name; of rows equal in id and text, one."""
    found = near_duplicates(docs, folder, id_column=id_column, text_column=text_column, **options)
    keepers = stored(found.where("kept").select(F.col(id_column).alias("__id"), F.col("text_key").alias("__kept")).distinct(), f"{folder}/keepers")
    rows = docs.withColumn("__key", text_key(F.col(id_column), whole_text(text_column)))
    rows = rows.join(keepers, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept")), "left_semi")
    return rows.dropDuplicates([id_column, "__key"]).drop("__key")
