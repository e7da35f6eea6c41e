"""Finding benchmark items in documents, paraphrased ones too, by latent semantic retrieval.

Documents are cut into short overlapping passages, weighted by TF-IDF. The latent space comes from a randomised
singular value decomposition of all documents' passages over the benchmark's vocabulary: how often two words share a
passage is counted exactly, and those counts are multiplied, partition by partition. A passage whose weight lies largely in that
vocabulary is compared with all items by cosine in the latent space; for each hit the longest common subsequence of the
item and the surrounding words decides, together with a check that the item's end, its answer, is there as well.

A benchmark is worked off in blocks of ``block_items``, so what goes to the tasks is bounded whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, table
from tidegauge.plans.registry import Query
from tidegauge.session import settle

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PAIRS_KEPT = 2_000_000  # pairs of words that a task holds before it passes them on
_MARKS = b""".,;:!?"'()[]{}|%*&#$<>"""


@dataclass(frozen=True)
class Leaks:
    """Parameters. The latent space is fitted on the passages of all documents, and every passage is searched."""

    window: int = 16
    stride: int = 8
    known_weight: float = 0.09  # least share of a passage's squared weight in the benchmark's vocabulary
    cosine: float = 0.5
    common: float = 0.6  # least share of an item's words in the common subsequence
    answer: float = 0.5  # the same of its last words
    answer_share: float = 0.2
    block_items: int = 256
    block_words: int = 64_000
    seed: int = 7


def words_of(text: bytes) -> list[bytes]:
    """Words without case and punctuation."""
    return text.translate(_LOWER, _MARKS).split()


def _word_ids(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids of all words (-1: unknown), and where each text ends."""
    get, flat, ends = vocabulary.get, [], []
    for text in texts:
        flat.extend([get(w, -1) for w in words_of(text)])
        ends.append(len(flat))
    return np.array(flat, dtype=np.int32), np.array(ends, dtype=np.int64)


def _windows(ends: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word of every passage; the last passage of a text reaches its end."""
    begins = np.concatenate([[0], ends[:-1]])
    size = ends - begins
    number = np.where(size > 0, np.maximum(1, -(-(size - window) // stride) + 1), 0)
    text = np.repeat(np.arange(len(ends)), number)
    first = np.repeat(begins, number) + stride * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    return text, first, np.minimum(first + window, ends[text])


COUNTS = "first int, second int, n long"


def _corpus_counts(vocabulary, options: Leaks):
    """How many documents hold each word of the vocabulary (``second`` -1; the last word: all documents), and how often two
    words, ``first`` <= ``second``, share a passage, by occurrences."""

    def rows(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(n)], names=["first", "second", "n"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts, span = np.zeros(len(known) + 1, dtype=np.int64), len(known) + 1
        parts, held_pairs = [], 0
        for _, texts in chunks(batches):
            ids, ends = _word_ids(texts, known)
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            held = ids >= 0
            pairs = np.unique(owner[held] * np.int64(len(known)) + ids[held])
            counts[:-1] += np.bincount(pairs % len(known), minlength=len(known))
            counts[-1] += len(texts)
            _, first, last = _windows(ends, options.window, options.window)
            parts.append(np.unique(_pair_codes(*_passage_rows(ids, first, last), span), return_counts=True))
            held_pairs += len(parts[-1][0])
            if held_pairs > PAIRS_KEPT:
                parts = [merged(parts)]
                held_pairs = len(parts[0][0])
                if held_pairs > PAIRS_KEPT // 2:
                    yield rows(parts[0][0] // span, parts[0][0] % span, parts[0][1])
                    parts, held_pairs = [], 0
        at = np.nonzero(counts)[0]
        yield rows(at, np.full(len(at), -1), counts[at])
        if parts:
            codes, n = merged(parts)
            yield rows(codes // span, codes % span, n)

    return run


def _pair_codes(words: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """first * span + second for each two occurrences in one passage, an occurrence with itself included. Two occurrences
    of the same word count in both orders."""
    words, out = words.astype(np.int64), [words.astype(np.int64) * (span + 1)]
    for apart in range(1, len(words)):
        same = np.flatnonzero(row[apart:] == row[:-apart])
        if not len(same):
            break
        a, b = words[same], words[same + apart]
        out += [np.minimum(a, b) * span + np.maximum(a, b), a[a == b] * (span + 1)]
    return np.concatenate(out)


def _passage_rows(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of the given passages, and the passage of each."""
    size = last - first
    row = np.repeat(np.arange(len(first)), size)
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    held = ids[at] >= 0
    return ids[at[held]], row[held]


def _project(words: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the sparse passage matrix times ``basis``, a slice of entries at a time."""
    out = np.zeros((n, basis.shape[1]), dtype=np.float32)
    for start in range(0, len(words), 20_000):
        w, r = words[start : start + 20_000], row[start : start + 20_000]
        edges = np.flatnonzero(np.diff(r, prepend=-1))
        if len(edges):
            out[r[edges]] += np.add.reduceat(basis[w] * idf[w, None], edges, axis=0)
    return out


def _gram_times(weights, basis):
    """The passages' Gram matrix, given by its counted entries, times ``basis``: one row a word of a task's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = weights.value, basis.value
        total = np.zeros(q.shape)
        for batch in batches:
            first, second, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            entry, order = n * idf[first].astype(np.float64) * idf[second], np.argsort(first, kind="stable")
            for start in range(0, len(order), 20_000):
                o = order[start : start + 20_000]
                edges = np.flatnonzero(np.diff(first[o], prepend=-1))
                total[first[o][edges]] += np.add.reduceat(q[second[o]] * entry[o, None], edges, axis=0)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["word", "row"])

    return run


def _add_gram(total: np.ndarray, words: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray, basis: np.ndarray) -> None:
    seen = _project(words, row, n, idf, basis)
    order = np.argsort(words, kind="stable")
    for start in range(0, len(order), 20_000):
        o = order[start : start + 20_000]
        w = words[o]
        edges = np.flatnonzero(np.diff(w, prepend=-1))
        if len(edges):
            total[w[edges]] += np.add.reduceat(seen[row[o]] * idf[w, None], edges, axis=0)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; the columns of the table are the bits of one integer."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, state = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        if y in where:
            met = state & where[y]
            state = (state + met | state - met) & full
    return len(a) - state.bit_count()


FOUND = "doc_id long, item_id long, cosine double, common double, answer double, word long"


def _search(model, options: Leaks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, unknown, term_vectors, item_vectors, items = model.value
        square = np.concatenate([idf.astype(np.float64) ** 2, [unknown**2]])  # -1 picks the last
        for batch, texts in chunks(batches):
            ids, ends = _word_ids(texts, vocabulary)
            if not len(ids):
                continue
            text, first, last = _windows(ends, options.window, options.stride)
            weight = np.concatenate([[0.0], np.cumsum(square[ids])])
            known = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, square[ids], 0.0))])
            near = np.flatnonzero(known[last] - known[first] >= options.known_weight * np.maximum(weight[last] - weight[first], 1e-9))
            best: dict[tuple[int, int], tuple] = {}
            for start in range(0, len(near), 4096):
                some = near[start : start + 4096]
                words, row = _passage_rows(ids, first[some], last[some])
                latent = _project(words, row, len(some), idf, term_vectors)
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
                cosine = latent @ item_vectors.T
                for p, k in zip(*np.nonzero(cosine >= options.cosine)):
                    w, (item_id, sequence) = some[p], items[k]
                    begin = ends[text[w] - 1] if text[w] else 0
                    around = ids[max(begin, first[w] - len(sequence)) : min(ends[text[w]], last[w] + len(sequence))].tolist()
                    tail = sequence[-max(1, math.ceil(options.answer_share * len(sequence))) :]
                    share = common_subsequence(sequence, around) / len(sequence)
                    answer = common_subsequence(tail, around) / len(tail)
                    if share >= options.common and answer >= options.answer:
                        found = (share, answer, float(cosine[p, k]), -int(first[w] - begin))
                        best[int(text[w]), item_id] = max(best.get((int(text[w]), item_id), found), found)
            if best:
                doc = batch.column(0).to_pylist()
                rows = [(doc[t], item, f[2], f[0], f[1], -f[3]) for (t, item), f in sorted(best.items())]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "cosine", "common", "answer", "word"), r)) for r in rows], schema=pa.schema(
                    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64()), ("word", pa.int64())]))

    return run


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Add up rows word by word; a word's entries lie in one task, so there are about as many rows as words."""
    out = np.zeros(shape)
    for batch in parts.toArrow().to_batches():
        np.add.at(out, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
    return out


def _find_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], options: Leaks) -> DataFrame:
    context = docs.sparkSession.sparkContext
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    known = context.broadcast(vocabulary)
    counted = settle(docs.mapInArrow(_corpus_counts(known, options), COUNTS).groupBy("first", "second").agg(F.sum("n").alias("n")))
    df = np.zeros(len(vocabulary) + 1)
    for row in counted.where("second < 0").toLocalIterator():
        df[row.first] = row.n
    n_docs = df[-1]
    idf = np.log((n_docs + 1) / (df[:-1] + 0.5)).clip(0.05).astype(np.float32)
    unknown = float(np.log((n_docs + 1) / 0.5))

    sequences = [(item, [vocabulary[w] for w in words]) for item, words in items]
    ids = np.array([w for _, s in sequences for w in s], dtype=np.int32)
    row = np.repeat(np.arange(len(sequences)), [len(s) for _, s in sequences])
    rank = min(len(vocabulary), len(sequences))
    basis = np.random.default_rng(options.seed).standard_normal((len(vocabulary), min(len(vocabulary), rank + 8))).astype(np.float32)
    weights = context.broadcast(idf)
    pairs = counted.where("second >= 0")
    entries = pairs.unionByName(pairs.where("first < second").select(F.col("second").alias("first"), F.col("first").alias("second"), "n")).repartition("first")
    product = basis
    for _ in range(2):
        basis = np.linalg.qr(product)[0].astype(np.float32)
        of_docs = _summed(entries.mapInArrow(_gram_times(weights, context.broadcast(basis)), "word int, row array<double>"), basis.shape)
        of_items = np.zeros(basis.shape, dtype=np.float32)
        _add_gram(of_items, ids, row, len(sequences), idf, basis)
        # items count as much as the passages of the corpus, so that the space keeps them apart
        product = of_items / max(1e-9, np.linalg.norm(of_items)) + 0.5 * of_docs / max(1e-9, np.linalg.norm(of_docs))
    values, vectors = np.linalg.eigh(basis.T @ product)
    space = (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)
    item_vectors = _project(ids, row, len(sequences), idf, space)
    item_vectors /= np.maximum(np.linalg.norm(item_vectors, axis=1, keepdims=True), 1e-9)
    model = context.broadcast((vocabulary, idf, unknown, space, item_vectors, sequences))
    return docs.mapInArrow(_search(model, options), FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, options: Leaks = Leaks(), doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, cosine, common and answer (shares of the item's words and
    of its last words found in order), word (where the best passage begins).

    Null and blank texts, of documents or items, match nothing; an empty benchmark gives no rows. Rows that repeat a
    document or an item give one row per pair, the best. Items with equal texts are all reported. Whole texts are
    searched, in chunks of bounded memory. Columns besides those named are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    found: list[DataFrame] = []
    block: list[tuple[int, list[bytes]]] = []
    for item in asked.orderBy("item_id", "text").toLocalIterator():
        if words := words_of(item.text.encode()):
            if block and (len(block) >= options.block_items or sum(len(w) for _, w in block) + len(words) > options.block_words):
                found.append(settle(_find_block(rows, block, options)))
                block = []
            block.append((item.item_id, words))
    if block:
        found.append(_find_block(rows, block, options))
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    best = F.max_by(F.struct("cosine", "common", "answer", "word"), F.struct("common", "answer", "cosine"))
    return union.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


QUERIES: dict[str, Query] = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLES: dict[str, str] = {}
