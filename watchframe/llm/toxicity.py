"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A document is a bag of sentences. A sentence's score is the logistic function of a bias and the weights of its different
words, each the sum of weights of the word and of its beginnings; a document is toxic unless none of its sentences is: 1 - product of (1 - score). Only documents are labelled; the
gradient of the documents' likelihood flows to the sentences, so the model learns which of them offend. It is fitted on a
bounded sample of labelled rows (``most_rows``, taken in the order of a hash of the id), in numpy on the driver; scoring runs
in the tasks over every whole text and needs no shuffle.

Defined results: a null or empty text has one sentence without words. Labels that are null are left out of training; with no
label of one of the kinds, every score is the share of toxic labels (0 without labels). Repeated rows give repeated results; for
training, rows with one id and label are one, with the text that sorts first. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.texts import give_back, whole_text

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)
CACHED_WORDS = 400_000
AT_A_TIME = 500  # rows scored and handed on together, of the many that arrive in a batch


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text; at least one."""
    spans, start = [], 0
    for gap in SENTENCE.finditer(text):
        if gap.start() > start:
            spans.append((start, gap.start()))
        start = gap.end()
    if start < len(text) or not spans:
        spans.append((start, len(text)))
    return spans


def words_of(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """A word and, for languages that build long words, its beginnings; ``^`` marks these."""
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


class WordWeights(dict):
    """Weight of each word met; it empties itself when it is full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        weight = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return weight


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    prior: float | None = None  # the score of every text where there was nothing to learn

    def scores(self, text: str, spans: list[tuple[int, int]], look: WordWeights) -> np.ndarray:
        """Score of each sentence."""
        if self.prior is not None:
            return np.full(len(spans), self.prior)
        z = [self.bias + sum(map(look.__getitem__, words_of(text[a:b]))) for a, b in spans]
        return 1 / (1 + np.exp(-np.array(z)))


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def fit(texts: list[str], toxic: np.ndarray, least_documents: int = 8, rounds: int = 150, step: float = 0.15,
        shrink: float = 1e-4) -> Model:
    """Maximum likelihood with shrinkage of the weights (absolute values), by Adam over all rows of the sample."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(0.0, {}, float(toxic.mean()) if len(toxic) else 0.0)
    number: dict[str, int] = {}
    parts, sizes, n_sentences, seen = [], [], [], []
    for text in texts:
        bag = [[number.setdefault(f, len(number)) for w in words_of(text[a:b]) for f in features(w)] for a, b in sentences(text)]
        parts.append(np.fromiter((f for sentence in bag for f in sentence), np.int32))
        sizes.append(np.fromiter(map(len, bag), np.int32, len(bag)))
        n_sentences.append(len(bag))
        seen.append(np.unique(parts[-1]))
    documents_of = np.bincount(np.concatenate(seen), minlength=len(number))
    usual = documents_of >= least_documents
    new = np.cumsum(usual) - 1
    names = [f for f, i in number.items() if usual[i]]
    word, sizes = np.concatenate(parts), np.concatenate(sizes)
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)[usual[word]]
    word = new[word[usual[word]]]
    document = np.repeat(np.arange(len(texts)), n_sentences)
    n_rows, n_bags = len(sizes), len(texts)
    weights, bias = np.zeros(len(names)), np.log(toxic.mean() / max(1.0, n_rows / n_bags))
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, weights[word], n_rows)
        part = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(document, np.logaddexp(0, z), n_bags), 1e-9)  # -log of the chance that none is toxic
        pull = np.where(toxic, -1 / np.expm1(total), 1.0)
        slope = part * pull[document] / n_bags
        gradient, gb = np.bincount(word, slope[sentence_of], len(names)), slope.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb ** 2
        rate = step * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        scale = rate / (np.sqrt(v) + 1e-6)
        moved = weights - scale * m
        weights = np.sign(moved) * np.maximum(np.abs(moved) - scale * shrink, 0)
        bias -= rate * mb / (np.sqrt(vb) + 1e-6)
    return Model(float(bias), {f: float(x) for f, x in zip(names, weights) if x != 0})


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 6_000, id_column: str = "doc_id", text_column: str = "text",
          label: str = "toxic") -> Model:
    """Fit on at most ``most_rows`` labelled rows, the first by a hash of their id.

    A share of the hash range that holds about four times as many rows, by the number of labels, is cut off first, so few rows
    are ordered whatever the number of partitions; should repeated ids leave less than asked for, the share grows. The pairs of
    id and label, ``most_rows`` at most, are broadcast to where texts are read; of rows equal in both, one text comes to the
    driver.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(label).alias("__label"))
    n, factor = rows.count(), 4
    while True:
        share = min(1.0, factor * most_rows / max(1, n))
        near = rows.where(F.xxhash64("__id") < F.lit(int(share * 2.0 ** 64) - 2 ** 63)) if share < 1 else rows
        chosen = near.distinct().orderBy(F.xxhash64("__id"), "__id", "__label").limit(most_rows).collect()
        if share == 1 or len(chosen) >= most_rows:
            break
        factor *= 16
    chosen = docs.sparkSession.createDataFrame(chosen, rows.schema)
    texts = docs.select(F.col(id_column).alias("__id"), whole_text(text_column).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = texts.groupBy("__id", "__label").agg(F.min("__text").alias("__text")).toPandas().sort_values(["__id", "__label"])
    return fit(sample["__text"].tolist(), sample["__label"].to_numpy() == 1)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5,
          with_spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: its id, ``score``, ``predicted``, ``worst_start`` and ``worst_end`` of the sentence with the
    highest score; ``with_spans`` adds ``offending``, the spans of all sentences that score ``threshold`` or more.
    ``carry`` names columns to keep, with their names.
    """
    carry = list(carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordWeights(model.weights)
        for batch in (whole.slice(i, AT_A_TIME) for whole in batches for i in range(0, whole.num_rows, AT_A_TIME)):
            found = []
            for text in (value.as_py() or "" for value in batch.column(source)):
                spans = sentences(text) if model.prior is None else [(0, len(text))]
                each = model.scores(text, spans, look)
                k = int(each.argmax())
                row = {"score": noisy_or(each), "worst_start": spans[k][0], "worst_end": spans[k][1]}
                if with_spans:
                    row["offending"] = [{"start": a, "end": b, "score": float(s)} for (a, b), s in zip(spans, each) if s >= threshold]
                found.append(row)
            table = pa.RecordBatch.from_pylist(found, schema=out)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *table.columns], names)
            give_back()

    out = pa.schema([("score", pa.float64()), ("worst_start", pa.int64()), ("worst_end", pa.int64())]
                    + ([("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))] if with_spans else []))
    keep = list(dict.fromkeys([id_column, *carry]))
    # a text that is carried goes to the tasks once, not a second time to be scored
    source = text_column if text_column in keep and docs.schema[text_column].dataType.simpleString() == "string" else "__text"
    rows = docs.select(*([whole_text(text_column).alias("__text")] if source == "__text" else []), *[F.col(c) for c in keep])
    names = [*keep, *out.names]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "worst_start long", "worst_end long"]
    if with_spans:
        kinds.append("offending array<struct<start: long, end: long, score: double>>")
    return rows.mapInArrow(run, ", ".join(kinds)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
