"""Language identification of texts and of the spans of mixed ones.

Every word gets a score for every language from its character n-grams. Script ranges narrow the candidates: a word is not
scored for languages that are not written in its script. Viterbi over the words, with a penalty for switching, labels
spans; a document's language is the one that holds most of its letters.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, held_out, table
from tidegauge.plans.registry import Query

#: Code point ranges of scripts; letters elsewhere count as script "other". Fixed values.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x9FFF),),
}
_NAMES = [*SCRIPTS, "other"]


@dataclass(frozen=True)
class Languages:
    bits: int = 15
    longest: int = 4  # characters of an n-gram
    damping: float = 0.4  # n-grams of a word overlap; this share of their log-probability counts
    smoothing: float = 0.3
    penalty: float = 12.0
    script_share: float = 0.01  # least share of a language's letters for a script to be its own
    outside: float = -60.0  # score of a word in a language that is not written in its script


@lru_cache(1)
def _script_table() -> np.ndarray:
    """Script of each code point; -1 for what is no letter."""
    out = np.full(sys.maxunicode + 1, len(SCRIPTS), dtype=np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[a : b + 1] = k
    out[[not chr(p).isalpha() for p in range(len(out))]] = -1
    return out


_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def spelled(words: list[bytes], options: Languages) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Letters of each word by script, and for each length its n-grams as (hashed places, numbers of their words).

    All words are taken at once, in lower case and without other characters, each between two marks.
    """
    text = b" ".join(words).decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script, word = _script_table()[points], np.cumsum(points == 0x20)
    at = np.flatnonzero(script >= 0)
    points, script, word = points[at], script[at], word[at]
    scripts = np.bincount(word * len(_NAMES) + script, minlength=len(words) * len(_NAMES)).reshape(len(words), len(_NAMES))
    letters = scripts.sum(axis=1)
    filled = np.flatnonzero(letters)
    sizes = letters[filled] + 2
    ends, of = np.cumsum(sizes), np.repeat(filled, sizes)
    marked, inner = np.empty(len(of), dtype=np.uint64), np.ones(len(of), dtype=bool)
    marked[ends - sizes], marked[ends - 1] = ord("^"), ord("$")
    inner[ends - sizes] = inner[ends - 1] = False
    marked[inner] = points

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rolled = np.zeros(len(marked), dtype=np.uint64)
        for n in range(1, min(options.longest, len(marked)) + 1):
            rolled = rolled[: len(marked) - n + 1] * _BASE + marked[n - 1 :]
            inside = of[: len(rolled)] == of[n - 1 :]
            place = (rolled[inside] + np.uint64(n << 56)) * _MIX
            place ^= place >> np.uint64(31)
            place *= _MIX
            yield (place >> np.uint64(64 - options.bits)).astype(np.int64), of[: len(rolled)][inside]

    return scripts, grams()


def _counted(options: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << options.bits
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, counter in words.items():
                g = grams.setdefault(lang, np.zeros(size))
                s = scripts.setdefault(lang, np.zeros(len(_NAMES)))
                n = np.fromiter(counter.values(), dtype=float, count=len(counter))
                by_script, found = spelled(list(counter), options)
                s += n @ by_script
                for place, of in found:
                    g += np.bincount(place, weights=n[of], minlength=size)
        for lang in grams:
            counts = np.concatenate([grams[lang], scripts[lang]])
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "place", "n"])

    return run


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_shares: np.ndarray  # by n-gram and language
    scripts: np.ndarray  # by script and language: whether the language is written in it


def train(docs: DataFrame, options: Languages = Languages(), text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams and scripts of each language over all rows with a language. Its size is that of one table a language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counted(options), "lang string, place int, n double").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names, places, n = counts.column("lang").to_pylist(), counts.column("place").to_numpy(), counts.column("n").to_numpy()
    languages = sorted(set(names))
    size = 1 << options.bits
    whole = np.zeros((size + len(_NAMES), len(languages)))
    number = {name: k for k, name in enumerate(languages)}
    whole[places, [number[x] for x in names]] = n
    grams, scripts = whole[:size], whole[size:]
    log_shares = np.log((grams + options.smoothing) / (grams.sum(axis=0) + options.smoothing * size))
    return Model(languages, log_shares.astype(np.float32), scripts >= options.script_share * np.maximum(1, scripts.sum(axis=0)))


def word_scores(words: list[bytes], model: Model, options: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each word by language, and its number of letters. A word without letters says nothing.

    A word belongs to the script of most of its letters, of equals to the one listed first.
    """
    by_script, found = spelled(words, options)
    scores = np.zeros((len(words), len(model.languages)))
    for place, of in found:
        for k in range(scores.shape[1]):
            scores[:, k] += np.bincount(of, weights=model.log_shares[place, k], minlength=len(words))
    scores *= options.damping
    allowed = model.scripts[by_script.argmax(axis=1)]
    outside = ~allowed & allowed.any(axis=1, keepdims=True)
    scores = np.where(outside, scores.max(axis=1, keepdims=True) + options.outside, scores)
    letters = by_script.sum(axis=1)
    scores[letters == 0] = 0
    return scores.astype(np.float32), letters


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi labels of each text's words; all texts take a step at once."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.array([len(scores[k]) for k in order])
    if not len(sizes) or not sizes[0]:
        return [np.empty(0, dtype=np.int64) for _ in scores]
    flat = np.concatenate([scores[k] for k in order])
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # texts longer than t
    best = flat[offset[: active[0]]].astype(np.float64)
    back: list[np.ndarray] = [np.empty(0)]
    lanes = np.arange(flat.shape[1])
    for t in range(1, int(sizes[0])):
        now = best[: active[t]]
        top = now.argmax(axis=1)
        least = now[np.arange(len(top)), top][:, None] - penalty
        stay = now >= least
        back.append(np.where(stay, lanes, top[:, None]).astype(np.int16))
        best[: active[t]] = np.where(stay, now, least) + flat[offset[: active[t]] + t]
    labels = np.zeros(len(flat), dtype=np.int64)
    state = best.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = active[t]
        labels[offset[:n] + t] = state[:n]
        if t:
            state[:n] = back[t][np.arange(n), state[:n]]
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(scores)
    for k, start, size in zip(order, offset, sizes):
        out[k] = labels[start : start + size]
    return out


LABELS = "doc_id long, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"


def _labelled(shared, options: Languages):
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names, n = model.languages, len(model.languages)
        known: dict[bytes, int] = {}
        scores, letters = np.zeros((0, n), dtype=np.float32), np.zeros(0, dtype=np.int64)
        for batch, texts in chunks(batches, limit=4 << 20):
            if len(known) > 400_000:
                known, scores, letters = {}, np.zeros((0, n), dtype=np.float32), np.zeros(0, dtype=np.int64)
            words = [t.split() for t in texts]
            new = list(set().union(*words).difference(known)) if n else []
            if new:
                got = word_scores(new, model, options)
                scores, letters = np.concatenate([scores, got[0]]), np.concatenate([letters, got[1]])
                known.update(zip(new, range(len(known), len(known) + len(new))))
            at = [np.array([known[w] for w in one], dtype=np.int64) for one in words] if n else []
            paths = best_paths([scores[a] for a in at], options.penalty) if n else []
            pred, sure, spans = [], [], []
            for k in range(batch.num_rows):
                weight = np.bincount(paths[k], weights=letters[at[k]], minlength=n) if n else np.zeros(0)
                if not weight.sum():
                    pred.append("und"), sure.append(0.0), spans.append([])
                    continue
                pred.append(names[int(weight.argmax())]), sure.append(float(weight.max() / weight.sum()))
                cuts = np.flatnonzero(np.diff(paths[k], prepend=-1, append=-1))
                spans.append([{"first": int(a), "last": int(b) - 1, "lang": names[paths[k][a]]} for a, b in zip(cuts[:-1], cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, spans_type)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, options: Languages = Languages(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Label each row of ``docs``: doc_id, lang_pred, score (share of letters in that language), spans by word number.

    Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. Equal shares go
    to the language first in the alphabet. Repeated rows get the same; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_labelled(docs.sparkSession.sparkContext.broadcast(model), options), LABELS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 4, 2)
    return identify(docs, train(docs.where(~test))).select("doc_id", test.alias("held_out"), "lang_pred", "score", "spans")


QUERIES: dict[str, Query] = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
