"""Language-model scores of texts from a probabilistic suffix tree over words.

The tree predicts the next token from the longest suffix of the tokens before it that is one of its states. A context of
up to ``depth`` words becomes a state if it is frequent and its next-token distribution diverges from that of the context
one word shorter; both tests use the counts of all training texts. Next-token distributions are smoothed with those of
the shorter states, down to the smoothed shares of single tokens, so probabilities of all tokens add up to one.

States are numbered level by level: a context is its parent state (the context without its first word) and that first
word, so its key is exact. Contexts hold frequent words only, at most ``1 / frequent``; a level has at most
``1 / frequency`` states. States and the next tokens they have seen often, at most ``1 / sent`` a level, are sent to the
tasks that score, and are of bounded size however large the corpus. Rarer words and rarer next tokens of a state have no
such bound: all their occurrences, of training texts and others, meet by a shuffle, where they are counted and scored.
Each such group is small, as it holds only what is rare. Groups are dealt to buckets; a piece of texts (a load) sends each
bucket one row with its occurrences as compressed columns, and gets one row with the sums of its texts back.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, held_out, table
from tidegauge.plans.registry import Query
from tidegauge.session import settle

#: The six ASCII blanks.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass(frozen=True)
class Tree:
    """Shares are of all training tokens; each bounds what it selects by its inverse."""

    depth: int = 3
    frequency: float = 1e-5  # of a context
    entry: float = 0.0  # of a context with a next token, for the context to tell it from those never seen after it; 0: all are told
    sent: float = 2e-6  # of a context with a next token that is sent to the tasks; rarer ones are counted where they meet
    frequent: float = 2e-6  # of a word in a context
    least: int = 2  # occurrences of any of these
    gain: float = 12.0  # least divergence of a context from its suffix, in nats over all its occurrences


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    texts: int

    def base(self, count):
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts with their number, of the others with 0; a row a word and task, or more."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch, texts in chunks(batches):
        train = batch.column(batch.schema.get_field_index("train")).to_pylist()
        counts.update([w for t, use in zip(texts, train) if use for w in t.lower().split()])
        for t, use in zip(texts, train):
            if not use:
                for w in t.lower().split():
                    counts.setdefault(w, 0)
        if len(counts) > 400_000:
            yield rows()
            counts.clear()
    yield rows()


class _Tokens:
    """Tokens of some texts as numbers: START, the words, END. Words are places in ``listed``; others are -1."""

    def __init__(self, texts: list[bytes], listed: pa.Array):
        raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        inside = ~_BLANK[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0] * bool(inside[:1].any()), edges, [len(raw)] * bool(inside[-1:].any())]).astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        spelled = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
        number = pc.fill_null(pc.index_in(spelled.dictionary, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        words = number[spelled.indices.to_numpy()] if len(starts) else np.zeros(0, dtype=np.int64)
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        sizes = np.diff(np.searchsorted(starts, firsts), append=len(starts))
        text = np.repeat(np.arange(len(texts)), sizes)
        sizes = sizes + 2
        self.start, self.end = len(listed), len(listed) + 1
        self.span = len(listed) + 2
        self.text = np.repeat(np.arange(len(texts)), sizes)
        begins = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.text)) - begins[self.text]  # of START: 0
        self.ids = np.full(len(self.text), -1, dtype=np.int64)
        self.ids[begins], self.ids[begins + sizes - 1] = self.start, self.end
        self.ids[np.arange(len(words)) + 2 * text + 1] = words
        self.spelled, self.word_of = spelled, text

    def contexts(self, parent: np.ndarray, k: int) -> np.ndarray:
        """Key of the context of ``k`` words before each token, -1 without one; ``parent`` has the states of k - 1."""
        older = np.full(len(self.ids), -1, dtype=np.int64)
        older[k:] = self.ids[:-k] if k < len(self.ids) else self.ids[:0]
        return np.where((parent >= 0) & (older >= 0) & (self.place >= k), parent * self.span + older, -1)


def _in_sorted(values: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 where it is missing."""
    if not len(table_):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
    return np.where(table_[at] == values, at, -1)


def _walk(tokens: _Tokens, states: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: (k, key of the context of k words before each token, its state or -1)."""
    state = np.where(tokens.place > 0, 0, -1)  # the root
    for k, known in enumerate([*states, None], 1):
        key = tokens.contexts(state, k)
        state = np.full(len(key), -1, dtype=np.int64) if known is None else np.where(key >= 0, _in_sorted(key, known), -1)
        yield k, key, state


COUNTS = "state long, symbol int, n long"


def _count_next(shared):
    """Next-token counts of the states of the last level known; other tokens than listed ones are -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, states = shared.value
        for _, texts in chunks(batches):
            tokens = _Tokens(texts, listed)
            for k, _, state in _walk(tokens, states):
                if k < len(states):
                    continue
                use = np.flatnonzero(state >= 0)
                both, n = np.unique(state[use] * (tokens.span + 1) + tokens.ids[use] + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // (tokens.span + 1)), pa.array((both % (tokens.span + 1) - 1).astype(np.int32)), pa.array(n)], names=["state", "symbol", "n"])
                break

    return run


@dataclass(frozen=True)
class Model:
    """Listed words with their base, and per level: keys of the states, whether each is kept, and its numbers.

    ``shorter`` is what a state leaves to the shorter one, ``total`` what it divides by; ``keys`` (state and next token) and
    ``counts`` are its stored next tokens, sorted.
    """

    listed: pa.Array
    base: np.ndarray  # of the listed words, START (never predicted) and END
    states: list[np.ndarray]
    kept: list[np.ndarray]
    shorter: list[np.ndarray]
    total: list[np.ndarray]
    keys: list[np.ndarray]
    counts: list[np.ndarray]
    whole: bool  # whether next tokens that are not stored may have been seen too

    def offsets(self) -> np.ndarray:
        """What is added to the states of each level to number them through."""
        return np.cumsum([0, *map(len, self.states)])

    def suffixes(self) -> list[np.ndarray]:
        """For each level and state of any level, numbered through: its suffix of that level (itself included), -1 without one."""
        offsets, levels = self.offsets(), len(self.states)
        out = [np.full(offsets[-1], -1, dtype=np.int64) for _ in range(levels)]
        for k in range(levels):
            own = slice(offsets[k], offsets[k + 1])
            out[k][own] = np.arange(offsets[k], offsets[k + 1])
            for j in range(k):
                out[j][own] = out[j][offsets[k - 1] + self.states[k] // (len(self.listed) + 2)]
        return out

    def log10_tokens(self, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each token, and what is missing to tell it.

        That is the first level whose count is not known here (0: none), the state of that level, and the last state, numbered
        through. Of a word that is not listed, the logarithm is to be added to its
        base, and the first level is 1.
        """
        p = np.where(tokens.ids >= 0, 10 ** self.base[tokens.ids], 1.0)
        first = ((tokens.ids < 0) & (tokens.place > 0)).astype(np.int32)
        at_first, last = np.full(len(p), -1, dtype=np.int64), np.full(len(p), -1, dtype=np.int32)
        offsets = self.offsets()
        for k, _, state in _walk(tokens, self.states):
            if k > len(self.states):
                break
            at = np.flatnonzero((state >= 0) & self.kept[k - 1][np.maximum(state, 0)]) if len(self.states[k - 1]) else np.zeros(0, dtype=np.int64)
            found = _in_sorted(state[at] * tokens.span + tokens.ids[at], self.keys[k - 1])
            found = np.where(tokens.ids[at] >= 0, found, -1)
            if self.whole:
                last[at] = offsets[k - 1] + state[at]
                new = at[(found < 0) & (first[at] == 0)]
                first[new], at_first[new] = k, state[new]
                at, found = at[first[at] == 0], found[first[at] == 0]
            n = np.where(found >= 0, self.counts[k - 1][np.maximum(found, 0)] if len(self.counts[k - 1]) else 0.0, 0.0)
            p[at] = (n + self.shorter[k - 1][state[at]] * p[at]) / self.total[k - 1][state[at]]
        log = np.where((tokens.place > 0) & ((first == 0) | (not self.whole)), np.log10(p), 0.0)
        return log, first, at_first, last


def _longer(counted: DataFrame, keys: np.ndarray, following: np.ndarray, after: np.ndarray, span: int, least: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The contexts one word longer than the states of ``keys`` that occur at least ``least`` times.

    Such a context is a state and its next word, and both it without its last word and it without its first word are as
    frequent. So the counts of next tokens already tell all of them, and only their next tokens need to be counted.
    ``following`` and ``after`` lead from a state one word shorter and its next word to the state of both.
    """
    often = counted.where((F.col("n") >= least) & F.col("symbol").between(0, span - 3)).toPandas()  # at most 1 / frequency rows
    state, word = often["state"].to_numpy(dtype=np.int64), often["symbol"].to_numpy(dtype=np.int64)
    suffix = after[_in_sorted(keys[state] // span * span + word, following)] if len(often) else state
    key = suffix * span + keys[state] % span
    order, pair = np.argsort(key), state * span + word
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    by_pair = np.argsort(pair)
    frame = pd.DataFrame({"context": key[order], "total": often["n"].to_numpy(dtype=np.int64)[order]})
    return frame, pair[by_pair], place[by_pair]


def grow_tree(rows: DataFrame, words: DataFrame, totals: Totals, tree: Tree = Tree()) -> Model:
    """Train on the texts of ``rows``; ``words`` (word, n) has the numbers of all their words."""
    spark = rows.sparkSession
    context = spark.sparkContext
    share = lambda part: max(tree.least, part * totals.tokens)
    often = words.where(F.col("n") >= share(tree.frequent)).orderBy("word").toPandas()  # at most 1 / frequent rows
    listed = pa.array([w.encode() for w in often["word"]], pa.large_binary())
    span = len(listed) + 2
    base = np.concatenate([totals.base(often["n"].to_numpy(dtype=np.float64)), [0.0, totals.base(totals.texts)]])
    known = [(i, int(n)) for i, n in enumerate(often["n"])] + [(span - 1, totals.texts)]
    rest = totals.tokens - sum(n for _, n in known)
    shorter = spark.createDataFrame([(0, i, float(n), float(totals.tokens)) for i, n in [*known, (-1, rest)] if n > 0], "state long, symbol int, _n double, _total double")
    states: list[np.ndarray] = []
    levels: list[tuple[pd.DataFrame, DataFrame]] = []
    least = share(tree.frequency)
    # every word is followed by a token, so a word or text counts as often as the context it begins
    begins = [(i, n) for i, n in [*known[:-1], (span - 2, totals.texts)] if n >= least]
    frame = pd.DataFrame(begins, columns=["context", "total"], dtype=np.int64)
    following, after = frame["context"].to_numpy(), np.arange(len(frame))  # state and next word, and the state they lead to
    for depth in range(tree.depth):
        if frame.empty:
            break
        frame["state"] = np.arange(len(frame))
        states = [*states, frame["context"].to_numpy(dtype=np.int64)]
        shared = context.broadcast((listed, states))
        counted = settle(rows.select("text").mapInArrow(_count_next(shared), COUNTS).groupBy("state", "symbol").agg(F.sum("n").alias("n")))
        shared.destroy()
        numbered = spark.createDataFrame(frame[["state", "context", "total"]])
        level = counted.join(F.broadcast(numbered), "state").select("state", F.floor(F.col("context") / span).alias("parent"), "symbol", "n", "total")
        parents = shorter.withColumnRenamed("state", "parent")
        facts = level.join(parents, ["parent", "symbol"], "left").groupBy("state").agg(
            F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("_n") / F.col("_total")))).alias("gain"),
            F.sum(F.when(F.col("symbol") < 0, F.col("n")).otherwise(1)).alias("types")).toPandas().set_index("state")
        frame["gain"], frame["types"] = frame["state"].map(facts["gain"]).fillna(0.0), frame["state"].map(facts["types"])
        levels.append((frame, level))
        shorter = level.select("state", "symbol", F.col("n").cast("double").alias("_n"), F.col("total").cast("double").alias("_total"))
        if depth + 1 < tree.depth:
            frame, following, after = _longer(counted, states[-1], following, after, span, least)

    # a state keeps its suffixes
    kept = [frame["gain"].to_numpy() >= tree.gain for frame, _ in levels]
    for k in range(len(levels) - 1, 0, -1):
        kept[k - 1][states[k][kept[k]] // span] = True
    left, total, keys, counts = [], [], [], []
    for (frame, level), keep in zip(levels, kept):
        chosen = spark.createDataFrame(pd.DataFrame({"state": np.flatnonzero(keep)}), "state long")
        stored = level.where((F.col("symbol") >= 0) & (F.col("n") >= share(tree.entry or tree.sent))).join(F.broadcast(chosen), "state", "left_semi")
        entries = stored.select("state", "symbol", "n").toPandas()  # at most 1 / entry or 1 / sent rows
        key = entries["state"].to_numpy(dtype=np.int64) * span + entries["symbol"].to_numpy(dtype=np.int64)
        order, n = np.argsort(key), entries["n"].to_numpy(dtype=np.float64)
        keys.append(key[order]), counts.append(n[order])
        own = np.bincount(entries["state"].to_numpy(dtype=np.int64), weights=n, minlength=len(frame))
        whole, types = frame["total"].to_numpy(dtype=np.float64), frame["types"].to_numpy(dtype=np.float64)
        left.append(types + whole - own if tree.entry else types), total.append(whole + types)
    return Model(listed, base, states, kept, left, total, keys, counts, not tree.entry)


MET = "bucket int, load long, kind int, n int, cells binary, words binary"
LISTED, WORDS, OWN = 0, 1, 2  # kinds of rows: rarer next tokens of states, words that are not listed, and what texts know alone
PER_BUCKET = 1 << 21  # training tokens for each bucket


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by columns of numbers from 0 on, the first one foremost; sorted as one number where it holds them all."""
    spans = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(spans) >= 1 << 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for column, span in zip(columns[1:], spans[1:]):
        key = key * span + column
    return np.argsort(key, kind="stable")


def _buckets(tokens: int, span: int) -> int:
    """Number of buckets, without a divisor in common with the number of symbols, so that no symbol fills one."""
    n = 16 + tokens // PER_BUCKET
    while math.gcd(n, span) > 1:
        n += 1
    return n


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of eight-byte numbers, byte by byte, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T) for c in columns]
    return pa.compress(np.concatenate([x.reshape(-1) for x in planes]), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kinds: str) -> list[np.ndarray]:
    """The columns again, each its own to write to (a view of a single row would not be)."""
    raw = np.frombuffer(pa.decompress(blob, 8 * n * len(kinds), codec="zstd", asbytes=True), dtype=np.uint8).reshape(len(kinds), 8, n)
    return [x.T.copy().reshape(-1).view({"i": np.int64, "f": np.float64}[k]) for x, k in zip(raw, kinds)]


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=0)


def _text_words(shared, totals: Totals):
    """For each load a row for each bucket with its occurrences there, and one with what the task itself can tell of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        end_known, offsets = int(totals.texts > 0), model.offsets()
        buckets = _buckets(totals.tokens, len(model.listed) + 2)
        load = TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches):
            load += 1
            rows: list[tuple] = []
            ids = batch.column(0)
            train = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = _Tokens(texts, model.listed)
            predicted, here = tokens.place > 0, len(texts)
            listed = predicted & (tokens.ids >= 0)
            log, first, at_first, last = model.log10_tokens(tokens)
            n_tokens = np.bincount(tokens.text[predicted], minlength=here)
            n_known = np.bincount(tokens.text[listed], minlength=here) - 1 + end_known
            base = np.bincount(tokens.text[listed], weights=model.base[tokens.ids[listed]], minlength=here)
            score = np.bincount(tokens.text, weights=log, minlength=here)
            own = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n_tokens, n_known, base, score]
            rows.append((load % buckets, load, OWN, here, _packed(own), None))

            def send(kind: int, at: np.ndarray, bucket: np.ndarray, group: np.ndarray, words: list[bytes]) -> None:
                order = _order([bucket, group, last[at] + 1])  # texts are in order already
                at, bucket, group = at[order], bucket[order], group[order]
                text, state = tokens.text[at], last[at].astype(np.int64)
                new = np.ones(len(at), dtype=bool)
                new[1:] = (np.diff(bucket) != 0) | (np.diff(group) != 0) | (np.diff(state) != 0) | (np.diff(text) != 0)
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(at)))
                bucket, group, state, text = bucket[starts], group[starts], state[starts], text[starts]
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own_group, spelled = group[a:b], None
                    if kind == WORDS:
                        used, own_group = np.unique(own_group, return_inverse=True)
                        spelled = zlib.compress(b" ".join([words[k] for k in used]), 1)
                    cells = _packed([_steps(own_group), state[a:b] + 1, text[a:b], times[a:b] << 1 | train[text[a:b]]])
                    rows.append((int(bucket[a]), load, kind, int(b - a), cells, spelled))

            at = np.flatnonzero((first > 0) & (tokens.ids >= 0))
            group = (offsets[first[at] - 1] + at_first[at]) * tokens.span + tokens.ids[at]
            send(LISTED, at, group % buckets, group // buckets, [])
            at = np.flatnonzero((first > 0) & (tokens.ids < 0))
            if len(at):
                spelling = np.full(len(first), -1, dtype=np.int64)
                spelling[predicted & (tokens.ids != tokens.end)] = tokens.spelled.indices.to_numpy()
                distinct, place = np.unique(spelling[at], return_inverse=True)
                words = tokens.spelled.dictionary.take(pa.array(distinct)).to_pylist()
                send(WORDS, at, np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)[place], place.astype(np.int64), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "load", "kind", "n", "cells", "words"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``met``, cut anew so that none of its groups is split."""
    rest: list[pa.RecordBatch] = []  # rows of the last group met
    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column(0)
        if rest and rest[0].column(0)[0].as_py() != name[0].as_py():
            yield pa.concat_batches(rest)
            rest = []
        cut = pc.index(pc.equal(name, name[-1]), pa.scalar(True)).as_py()  # where the last group starts
        if cut:
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _sum_of(group: np.ndarray, state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of ``n`` over the rows of its group and state."""
    _, which = np.unique(group * (state.max(initial=0) + 1) + state, return_inverse=True)
    return np.bincount(which, weights=n)[which] if len(which) else n


SUMS = "load long, kind int, n int, cells binary"


def _score_met(shared, totals: Totals):
    """What the texts of each load get for their rarer words and next tokens, from buckets of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        suffixes, offsets, span = model.suffixes(), model.offsets(), len(model.listed) + 2
        buckets = _buckets(totals.tokens, span)
        shorter, total = (np.concatenate([*x, [0.0]]) for x in (model.shorter, model.total))

        def log10_pairs(group: np.ndarray, last: np.ndarray, learned: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each group (a word: below 0) and last state: log10 probability, the word's base, and whether it is known."""
            word = group < 0
            n = np.bincount(name, weights=learned)[name]
            base = np.where(word, totals.base(n), 0.0)
            own, token = np.where(word, 0, group // span), np.where(word, 0, group % span)
            first = np.where(word, 0, np.searchsorted(offsets, own, side="right"))  # a level
            p = 10 ** np.where(word, base, model.base[token])
            for k, suffix in enumerate(suffixes, 1):
                at = np.flatnonzero(first > k)  # the task that sent them has the counts of these levels too
                state = suffix[own[at]]
                found = _in_sorted((state - offsets[k - 1]) * span + token[at], model.keys[k - 1])
                p[at] = (np.where(found >= 0, model.counts[k - 1][found], 0.0) + shorter[state] * p[at]) / total[state] if len(at) else p[at]
                at = np.flatnonzero((first <= k) & (last >= 0))
                at = at[suffix[last[at]] >= 0]
                state = suffix[last[at]]
                p[at] = (_sum_of(name[at], state, learned[at]) + shorter[state] * p[at]) / total[state]
            return np.log10(p), base, word & (n > 0)

        def of_bucket(rows: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[bytes]] | None:
            parts, spelled = [], []
            for bucket, load, kind, n, cells, words in zip(*(c.to_pylist() for c in rows.columns)):
                if kind == OWN:
                    continue
                group, last, text, times = _unpacked(cells, n, "iiii")
                group = np.cumsum(group)
                if kind == WORDS:
                    group = -1 - len(spelled) - group
                    spelled += zlib.decompress(words).split(b" ")
                else:
                    group = group * buckets + bucket
                parts.append((np.full(n, load), group, last - 1, text, times))
            if not parts:
                return None
            load, group, last, text, times = map(np.concatenate, zip(*parts))
            word = group < 0
            if spelled:
                group[word] = -1 - pa.array(spelled, pa.large_binary()).dictionary_encode().indices.to_numpy()[-1 - group[word]]
            order = _order([group - group.min(), last + 1])
            load, group, last, text, times = load[order], group[order], last[order], text[order], times[order]
            changed = np.diff(group, prepend=group[0] - 1) != 0
            new = changed | (np.diff(last, prepend=last[0] - 1) != 0)
            starts, pair = np.flatnonzero(new), np.cumsum(new) - 1
            often = times >> 1
            learned = np.add.reduceat(often * (times & 1), starts).astype(np.float64)
            log, base, known = log10_pairs(group[starts], last[starts], learned, (np.cumsum(changed) - 1)[starts])
            loads, place = np.unique(load, return_inverse=True)
            both, to = np.unique(place * (int(text.max()) + 1) + text, return_inverse=True)
            sums = [np.bincount(to, weights=x[pair] * often) for x in (known, base, log)]
            of, text = np.divmod(both, int(text.max()) + 1)
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            cells = [_packed([_steps(text[a:b]), sums[0][a:b].astype(np.int64), sums[1][a:b], sums[2][a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
            return loads, np.diff(cuts).tolist(), cells

        for batch in _whole_groups(batches):
            of = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            own = batch.filter(pc.equal(batch.column(2), OWN))
            yield pa.RecordBatch.from_arrays([own.column(k) for k in (1, 2, 3, 4)], names=["load", "kind", "n", "cells"])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (out := of_bucket(batch.slice(a, b - a))) is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0]), pa.array([LISTED] * len(out[0]), pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["load", "kind", "n", "cells"])

    return run


def _sum_load(rows: pa.Table) -> pa.Table:
    """The texts of a load with all their sums."""
    kinds, sizes, cells = (rows.column(k).to_pylist() for k in ("kind", "n", "cells"))
    at = kinds.index(OWN)
    doc_id, null, n_tokens, n_known, base, score = _unpacked(cells[at], sizes[at], "iiiiff")
    for kind, n, blob in zip(kinds, sizes, cells):
        if kind != OWN:
            text, known, more_base, more = _unpacked(blob, n, "iiff")
            text = np.cumsum(text)
            n_known[text] += known
            base[text] += more_base
            score[text] += more
    return pa.table({"doc_id": pa.array(doc_id, mask=null.astype(bool)), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score})


def score_texts(docs: DataFrame, train, tree: Tree = Tree(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score each row of ``docs``, learning from the rows where the column ``train`` is true.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (tokens by their smoothed share) and score (the tree's
    log10 probability). A text's tokens are its words, A-Z lower-cased, and one end; null and blank texts have the end
    alone. Repeated rows score alike, and each counts in training. With nothing to learn from, every token is the unknown
    one. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = settle(rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = rows.where("train").count()
    sums = words.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    totals = Totals((sums.tokens or 0) + texts, (sums.distinct or 0) + int(texts > 0), texts)
    model = grow_tree(rows.where("train"), words, totals, tree)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    met = rows.mapInArrow(_text_words(shared, totals), MET).repartition("bucket").sortWithinPartitions("bucket")
    summed = met.mapInArrow(_score_met(shared, totals), SUMS).groupBy("load").applyInArrow(
        _sum_load, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = held_out(F.col("doc_id"), 10, 0)
    out = score_texts(table(spark, sf_dir, "documents"), ~test)
    return out.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Query] = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
