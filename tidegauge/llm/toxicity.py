"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words and their beginnings, hashed. A document is toxic if any
sentence is: its score joins the sentences by noisy-or, 1 - prod(1 - p). The gradient of the document labels flows
through that product to the sentences, so the trained model also tells where the offence stands.

The classifier is fitted on a bounded sample of labelled documents (``sample_per_class`` of each class, chosen by hash),
weighted back to the classes' true shares. Every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, held_out, table
from tidegauge.plans.registry import Query

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Toxicity:
    bits: int = 18
    longest_sentence: int = 64
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    sample_per_class: int = 3000
    epochs: int = 20
    batch: int = 200
    rate: float = 0.05
    penalty: float = 2e-5
    shrink: float = 0.3  # soft threshold a step, times the rate
    least_docs: int = 15  # sample documents that a feature occurs in
    threshold: float = 0.7
    seed: int = 11


def token_features(token: bytes, options: Toxicity) -> list[int]:
    """Hashed features of one word: itself and its beginnings, in letters only."""
    mask, out = (1 << options.bits) - 1, []
    for word in _LETTERS.findall(token.decode("utf-8", "replace").lower()):
        out.append(zlib.crc32(b"w" + word.encode()) & mask)
        out.extend(zlib.crc32(b"p" + word[:n].encode()) & mask for n in options.prefixes if n < len(word))
    return out


def sentences(text: bytes, longest: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and the number of the sentence of each; long ones are cut after ``longest`` words."""
    tokens = text.replace(b"\n", b" .\n ").split()
    return tokens, _numbers(np.fromiter((_ends(t) for t in tokens), dtype=bool, count=len(tokens)), longest)


def _ends(token: bytes) -> bool:
    core = token.rstrip(b"#*$%&|<>\"')]")
    return core[-1:] in (b".", b"!", b"?")


def _numbers(ends: np.ndarray, longest: int) -> np.ndarray:
    if not len(ends):
        return np.empty(0, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(ends[:-1])])
    start = np.maximum.accumulate(np.where(np.diff(number, prepend=-1) > 0, np.arange(len(number)), 0))
    piece = (np.arange(len(number)) - start) // longest
    return np.cumsum((np.diff(number, prepend=-1) > 0) | (np.diff(piece, prepend=0) > 0)) - 1


def _featurised(options: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}
        for batch, texts in chunks(batches):
            words, places = [], []
            for text in texts:
                tokens, number = sentences(text, options.longest_sentence)
                row: list[int] = []
                where: list[int] = []
                for token, s in zip(tokens, number.tolist()):
                    if (features := cache.get(token)) is None:
                        features = cache[token] = token_features(token, options)
                    row.extend(features)
                    where.extend([s] * len(features))
                words.append(np.array(row, dtype=np.int32)), places.append(np.array(where, dtype=np.int32))
            if len(cache) > 300_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features", "sentence"])

    return run


def _sum_at(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n)


def fit(documents: list[tuple[int, np.ndarray, np.ndarray]], weights: tuple[float, float], options: Toxicity) -> tuple[np.ndarray, float]:
    """Weights and intercept of the sentence model, by stochastic descent on the noisy-or likelihood (Adam steps)."""
    size = 1 << options.bits
    w, bias = np.zeros(size + 1), -4.0
    if len({y for y, _, _ in documents}) < 2:
        return w[:size], bias
    w[size] = bias
    seen = np.zeros(size + 1, dtype=np.int64)
    for _, f, _ in documents:
        seen[np.unique(f)] += 1
    off = np.flatnonzero(seen < options.least_docs)
    off = off[off < size]
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(options.seed)
    for _ in range(options.epochs):
        order = rng.permutation(len(documents))
        for start in range(0, len(order), options.batch):
            some = [documents[k] for k in order[start : start + options.batch]]
            counts = [int(s[-1]) + 1 if len(s) else 1 for _, _, s in some]
            base = np.concatenate([[0], np.cumsum(counts)])
            features = np.concatenate([f for _, f, _ in some])
            sentence = np.concatenate([s + b for (_, _, s), b in zip(some, base)])
            owner = np.repeat(np.arange(len(some)), counts)
            y = np.array([d[0] for d in some])
            z = _sum_at(w[features], sentence, base[-1]) + w[size]
            none = np.maximum(_sum_at(np.logaddexp(0, z), owner, len(some)), 1e-9)  # -log of no toxic sentence
            # for label 1 the likelihood is log(1 - exp(-none)); for label 0 it is -none
            pull = np.where(y == 1, -1 / np.expm1(np.minimum(none, 50)), 1.0) * np.where(y == 1, weights[1], weights[0]) / len(some)
            slope = pull[owner] / (1 + np.exp(-z))
            gradient = _sum_at(slope[sentence], features, size + 1) + options.penalty * w
            gradient[size] = slope.sum()
            gradient[off] = 0.0
            step += 1
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            w -= options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w[:size] = np.sign(w[:size]) * np.maximum(np.abs(w[:size]) - options.rate * options.shrink, 0.0)
    return w[:size], float(w[size])


SCORES = "doc_id long, score double, worst_sentence int, worst_score double, offending array<int>"


def _scored(model, options: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        known: dict[bytes, int] = {}
        value, ends = np.zeros(0), np.zeros(0, dtype=bool)
        for batch, texts in chunks(batches):
            if len(known) > 500_000:
                known, value, ends = {}, np.zeros(0), np.zeros(0, dtype=bool)
            words = [t.replace(b"\n", b" .\n ").split() for t in texts]
            new = set().union(*words).difference(known)
            value = np.concatenate([value, [weights[f].sum() if (f := token_features(t, options)) else 0.0 for t in new]])
            ends = np.concatenate([ends, np.array([_ends(t) for t in new], dtype=bool)])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            score, worst, most, bad = [], [], [], []
            for tokens in words:
                if not tokens:
                    score.append(0.0), worst.append(None), most.append(None), bad.append([])
                    continue
                at = np.array([known[t] for t in tokens])
                number = _numbers(ends[at], options.longest_sentence)
                z = _sum_at(value[at], number, 0) + bias
                p = 1 / (1 + np.exp(-z))
                score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                worst.append(int(z.argmax())), most.append(float(p.max())), bad.append(np.flatnonzero(p >= 0.5).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(worst, pa.int32()), pa.array(most, pa.float64()), pa.array(bad, pa.list_(pa.int32()))],
                names=["doc_id", "score", "worst_sentence", "worst_score", "offending"])

    return run


def train(docs: DataFrame, labels: DataFrame, options: Toxicity = Toxicity()) -> tuple[np.ndarray, float]:
    """Fit on documents (doc_id, text) that ``labels`` (doc_id, toxic) marks; of repeated labels the highest counts."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().toLocalIterator() if r.toxic in (0, 1)}
    share = [min(1.0, options.sample_per_class / max(1, totals.get(k, 0))) for k in (0, 1)]
    place = F.pmod(F.xxhash64("doc_id", F.lit(options.seed)), F.lit(1 << 20)) / (1 << 20)
    chosen = marks.where(place < F.when(F.col("toxic") == 1, share[1]).when(F.col("toxic") == 0, share[0]).otherwise(0))
    # the sample is bounded by its parameter
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    featured = sample.mapInArrow(_featurised(options), "doc_id long, toxic int, features array<int>, sentence array<int>")
    frame = featured.orderBy("doc_id", "toxic").toArrow()
    rows = [(y, f, s) for y, f, s in zip(frame.column("toxic").to_pylist(), _arrays(frame.column("features")), _arrays(frame.column("sentence")))]
    lift = [1 / max(share[k], 1e-9) for k in (0, 1)]
    mean = sum(totals.values()) / max(1e-9, sum(totals.get(k, 0) * share[k] for k in (0, 1))) if totals else 1.0
    model = fit(rows, (lift[0] / mean, lift[1] / mean), options)
    del frame, rows
    pa.default_memory_pool().release_unused()  # the driver has other work to do
    return model


def _arrays(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield values[a:b]


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], options: Toxicity = Toxicity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score each row of ``docs``: doc_id, score, and the sentences (by number) that carry it.

    Null, empty and blank texts have no sentence and score 0. Repeated rows score alike. With labels of one class
    only there is nothing to learn: every sentence then has the same low probability. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared, options), SCORES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, options = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Toxicity()
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)), options)
    scored = score_documents(docs, model, options)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= options.threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score", "offending")


def stage_reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored as toxic go."""
    options = Toxicity()
    model = train(docs, table(spark, sf_dir, "labels"), options)
    bad = score_documents(docs, model, options).where((F.col("score") >= options.threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


QUERIES: dict[str, Query] = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
