"""Periodic runs: maximal stretches of a text whose words repeat with some period.

Longest common extensions (LCE) come from a difference cover: a few residues modulo 7 such that any two positions reach,
within six words, two positions whose residues both belong to it. Only the suffixes at those positions are sorted, by
prefix doubling over blocks of seven words; a sparse table of range minima over their neighbours' common prefixes then
gives the LCE of any two of them at once. An LCE of two arbitrary positions compares the few words up to the
synchronised ones and looks the rest up; extensions to the left use the same over the reversed words.

Runs come from a harmonic grid: for every period p, the words at multiples of p are compared with the words p further
on, n/1 + n/2 + ... comparisons in all. A stretch that repeats with period p holds such a pair of equal words, whose
extensions to both sides give its ends. Of several periods with one stretch the smallest is its period.

Texts of a task are handled in batches of bounded size, one array of word numbers with a number of its own behind each
text, so that no extension leaves a text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, table
from tidegauge.plans.registry import Query

LEAST_WORDS = 12  # of a run
PERIOD = 7  # of the difference cover
COVER = (1, 2, 4)  # their differences modulo 7 are all residues
BATCH_BYTES = 2 << 20
GRID_PAIRS = 1 << 20  # pairs compared at a time


def _shifts() -> np.ndarray:
    """For residues (a, b) the least shift that brings both into the cover."""
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(h for h in range(PERIOD) if (a + h) % PERIOD in COVER and (b + h) % PERIOD in COVER)
    return out


SHIFT = _shifts()


def _ranks(parts: list[np.ndarray], spans: list[int]) -> np.ndarray:
    """Dense ranks of tuples, given column by column with the number of values of each."""
    key, span = parts[0], spans[0]
    for part, size in zip(parts[1:], spans[1:]):
        if span * size >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key, span = key * size + part, span * size
    return np.unique(key, return_inverse=True)[1]


class Extensions:
    """LCE of any two positions of a sequence of numbers from 0 to ``span`` - 1."""

    def __init__(self, words: np.ndarray, span: int):
        n = len(words)
        self.words = np.concatenate([words, np.full(PERIOD, span, dtype=np.int64)])  # what follows the end equals nothing
        at = np.concatenate([np.arange(c, n + 1, PERIOD) for c in COVER])  # residue by residue; the last block of each reaches the end
        self.place = np.full(n + PERIOD, -1, dtype=np.int64)
        self.place[at] = np.arange(len(at))
        blocks = np.concatenate([np.full(len(range(c, n + 1, PERIOD)), i) for i, c in enumerate(COVER)])
        m = self.count = len(at)
        rank = _ranks([self.words[at + t] for t in range(PERIOD)], [span + 1] * PERIOD) if m else np.zeros(0, dtype=np.int64)
        sizes = np.bincount(rank)
        rank = (np.cumsum(sizes) - sizes)[rank]  # the place of the first of its equals
        # ranks[j]: equal for suffixes that agree in their first 2**j blocks
        ranks, width = [rank], 1
        while m and (tied := np.bincount(rank, minlength=m)[rank] > 1).any():
            ahead = np.arange(m) + width
            inside = (ahead < m) & (blocks[np.minimum(ahead, m - 1)] == blocks)
            follow = np.where(inside, rank[np.minimum(ahead, m - 1)] + 1, 0)
            renewed, some = rank.copy(), np.flatnonzero(tied)  # suffixes told apart already keep their order
            key = renewed[some] * (m + 1) + follow[some]
            order = np.argsort(key, kind="stable")
            groups = renewed[some][order]
            first = np.concatenate([[True], np.diff(key[order]) != 0])
            starts = np.concatenate([[True], np.diff(groups) != 0])
            here = np.arange(len(some))
            offset = here - np.maximum.accumulate(np.where(starts, here, 0))
            last = np.maximum.accumulate(np.where(first, here, 0))
            renewed[some[order]] = groups + offset[last]
            rank = renewed
            ranks.append(rank)
            width *= 2
        self.rank = rank
        order = np.argsort(rank)
        self._neighbours(ranks, at[order], order)

    def _neighbours(self, ranks: list[np.ndarray], at: np.ndarray, order: np.ndarray) -> None:
        """Common prefixes of neighbours in sorted order, and the sparse table of their range minima."""
        m = self.count
        one, two = order[:-1].copy(), order[1:].copy()
        same = np.zeros(max(m - 1, 0), dtype=np.int64)
        open_ = np.ones(max(m - 1, 0), dtype=bool)
        for level in range(len(ranks) - 1, -1, -1):
            equal = open_ & (ranks[level][np.minimum(one, max(m - 1, 0))] == ranks[level][np.minimum(two, max(m - 1, 0))])
            step = np.where(equal, 1 << level, 0)
            one, two, same = one + step, two + step, same + step * PERIOD
            open_ &= (one < m) & (two < m)
        here, there = at[:-1] + same, at[1:] + same
        going = np.ones(len(same), dtype=bool)
        top = len(self.words) - 1
        for _ in range(PERIOD):
            going &= self.words[np.minimum(here, top)] == self.words[np.minimum(there, top)]
            here, there, same = here + going, there + going, same + going
        self.minima = [same]
        width = 1
        while 2 * width <= len(same):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from the positions ``a`` and ``b`` (a < b) on."""
        shift = SHIFT[a % PERIOD, b % PERIOD]
        found = np.zeros(len(a), dtype=np.int64)
        going = np.ones(len(a), dtype=bool)
        for _ in range(PERIOD - 1):
            going &= (found < shift) & (self.words[np.minimum(a + found, len(self.words) - 1)] == self.words[np.minimum(b + found, len(self.words) - 1)])
            found += going
        synchronised = np.flatnonzero(found == shift)
        one, two = self.place[a[synchronised] + shift[synchronised]], self.place[b[synchronised] + shift[synchronised]]
        inside = (one >= 0) & (two >= 0)
        synchronised, one, two = synchronised[inside], self.rank[one[inside]], self.rank[two[inside]]
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(float))[1] - 1
        rest = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            rest[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        found[synchronised] += rest
        return found


def runs_of(words: np.ndarray, sizes: np.ndarray, span: int, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, sorted by start and period.

    ``words`` holds texts from the longest to the shortest, a number that occurs once behind each; ``sizes`` their words.
    """
    ends = np.cumsum(sizes + 1)
    ahead = Extensions(words, span)
    n = len(words)
    behind = Extensions(words[::-1].copy(), span)
    longest = int(sizes[0]) // 2 if len(sizes) else 0
    periods = np.arange(1, longest + 1)
    # texts with room for two periods come first
    reach = np.concatenate([[0], ends])[np.searchsorted(-sizes, -2 * periods, side="right")]
    pairs = np.maximum((reach - 1) // periods, 0)
    out, start = [np.zeros((0, 3), dtype=np.int64)], 0
    total = np.cumsum(pairs)
    while start < longest:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + GRID_PAIRS, side="right")))
        number = pairs[start:stop]
        p = np.repeat(periods[start:stop], number)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(number) - number, number)) * p
        near = np.flatnonzero(words[i] == words[i + p])
        i, p = i[near], p[near]
        forth = ahead.lce(i, i + p)
        # the words before i against those before i + p, read from the right
        back = np.zeros(len(i), dtype=np.int64)
        some = np.flatnonzero(i > 0)
        back[some] = behind.lce(n - (i[some] + p[some]), n - i[some])
        long = (forth + back >= p) & (forth + back + p >= least)
        i, p, forth, back = i[long], p[long], forth[long], back[long]
        out.append(np.unique(np.column_stack([i - back, i + p + forth, p]), axis=0))
        start = stop
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (np.diff(found[:, :2], axis=0) != 0).any(axis=1)
    found = found[first]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


@dataclass
class TextRuns:
    """A text's words and its runs as word numbers (start, length, period), by start and period."""

    words: list[bytes]
    runs: list[tuple[int, int, int]]

    def kept(self) -> list[bytes]:
        """The words outside all repetitions: a run keeps its first period."""
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        for start, length, period in self.runs:
            change[start + period] += 1
            change[start + length] -= 1
        inside = np.cumsum(change[:-1]) > 0
        return [w for w, gone in zip(self.words, inside) if not gone]


def text_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[TextRuns]:
    """The runs of several texts, given as words, in one go."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    number: dict[bytes, int] = {}
    known = [[number.setdefault(w, len(number)) for w in texts[k]] for k in order]
    sizes = np.array([len(w) for w in known], dtype=np.int64)
    words = np.concatenate([np.array([*w, len(number) + i], dtype=np.int64) for i, w in enumerate(known)]) if known else np.zeros(0, dtype=np.int64)
    starts, ends, periods = runs_of(words, sizes, len(number) + len(known), least)
    firsts = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.searchsorted(firsts, starts, side="right") - 1
    out = [TextRuns(words, []) for words in texts]
    for k, start, end, period in zip(owner.tolist(), (starts - firsts[owner]).tolist(), (ends - firsts[owner]).tolist(), periods.tolist()):
        out[order[k]].runs.append((start, end - start, period))
    return out


def repeated_from(words: list[bytes], start: int, period: int) -> list[bytes]:
    """``words`` whose part from ``start`` on repeats its first ``period`` words."""
    return [*words[:start], *(words[start + (i - start) % period] for i in range(start, len(words)))]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail for one id in ten, where crc32 of the id says so; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    start = g % n
    return repeated_from(words, start, 1 + (n - start) // (3 + g % 8))


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def _judge(batches: Iterator[pa.RecordBatch], least: int, planted: bool, spelled: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    names = names if spelled else names[:9]
    kinds = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()} | {c: pa.list_(pa.int64()) for c in ("starts", "lengths", "periods")}
    for batch, texts in chunks(batches, limit=BATCH_BYTES):
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        words = [t.split() for t in texts]
        if planted:
            words = [rewritten(w, k) for w, k in zip(words, ids)]
        rows = []
        for doc_id, found in zip(ids, text_runs(words, least)):
            best = min(found.runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{s},{length},{p}\n" for s, length, p in found.runs)
            rest = b" ".join(found.kept())
            row = [doc_id, len(found.words), len(found.runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                   hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()]
            rows.append([*row, *([list(c) for c in zip(*found.runs)] or [[], [], []]), rest.decode()] if spelled else row)
        yield pa.record_batch([pa.array([r[k] for r in rows], kinds.get(c, pa.int64())) for k, c in enumerate(names)], names)


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, planted: bool = False, spelled: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): all runs of at least ``least`` words and two periods, and the text without repeats.

    Words are split at the six ASCII blanks and numbered from 0. Returns doc_id, n_words, n_runs; start, length, period
    and exponent_milli of the longest run (of equal ones the first, then the one with the smallest period; null without
    runs); sha256 of the listed runs and of the collapsed text; with ``spelled`` also starts, lengths and periods of all runs
    and the collapsed text. Null and empty texts have no words and no runs. Repeated rows are judged each, rows without
    an id too; other columns are ignored. ``planted`` first gives one text in ten a periodic tail.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = SCHEMA if spelled else ", ".join(SCHEMA.split(", ")[:9])
    return slim.mapInArrow(partial(_judge, least=least, planted=planted, spelled=spelled), schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True, spelled=False).drop("n_words")


QUERIES: dict[str, Query] = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}  # tests/llm compares the runs with brute force
