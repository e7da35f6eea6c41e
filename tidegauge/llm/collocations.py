"""Collocations: phrases whose words stand together more often than their parts alone would suggest.

Layout of external stream estimation: the counts of all phrases are kept as two sorted streams, one in prefix order
(language, then words from the first) and one in suffix order (language, then words from the last). In prefix order a
phrase stands right behind its own beginnings, so one pass that remembers the last count seen of every length knows the
counts of all first parts; in suffix order the same pass knows the counts of all last parts, and either pass sees which
one-word extensions nearly always go with a phrase. The two passes are then merged phrase by phrase. No count is looked
up in a hash table; streams are cut into ranges (``sliced``), and what a range needs of the ranges before it is one
count per length.

Counts are exact. A phrase can only be frequent if both phrases one word shorter are, so a longer phrase is counted only
where a bit filter lets both pass. The filter has 16 bits per frequent phrase, at most ``FILTER_BITS`` in all; a
fuller filter lets more through and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, table
from tidegauge.operators.ordered import SLICE, SLOT, sliced
from tidegauge.plans.registry import Query
from tidegauge.session import settle

LEAST = 30  # occurrences of a phrase
LONGEST = 4  # words of a phrase
SCALE = 2_000_000  # of the score
COVERED = 80  # percent of a phrase's occurrences that lie in one longer phrase, from which on it is dropped
FILTER_BITS = 1 << 28  # 32 MB
PART_BYTES = 3 << 20
SALTS = 1024

BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
_KIND = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: blank, 2: end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of some texts: their ids in ``spelled``, the piece and the language of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = _LOWER[raw][inside]
        spelled = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        self.spelled, self.ids = spelled.dictionary, spelled.indices.to_numpy().astype(np.int64)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        place = {lang: i for i, lang in enumerate(self.langs)}
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        self.lang = np.array([place[lang] for lang in langs])[np.searchsorted(firsts, starts, side="right") - 1]

    def hashes(self, size: int) -> np.ndarray:
        """A hash of (language, words) for the phrase of ``size`` words that starts at each word."""
        word = np.array([xxhash.xxh64_intdigest(w) for w in self.spelled.to_pylist()], dtype=np.uint64)[self.ids]
        h = np.array([xxhash.xxh64_intdigest(lang) for lang in self.langs], dtype=np.uint64)[self.lang]
        for j in range(size):
            h = h[:len(word) - j]
            h = (h ^ word[j:]) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def phrases(self, size: int, bits: np.ndarray | None) -> np.ndarray:
        """Where phrases of ``size`` words start that stay in their piece and of which both shorter ones pass."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        fits = self.piece[:n] == self.piece[size - 1:]
        if bits is not None:
            passes = _passes(self.hashes(size - 1), bits)
            fits &= passes[:n] & passes[1:n + 1]
        return np.flatnonzero(fits)

    def counted(self, size: int, bits: np.ndarray | None) -> tuple[list[str], pa.Array, np.ndarray]:
        """Language, phrase and number of the distinct phrases."""
        at = self.phrases(size, bits)
        key, span = self.lang[at].astype(np.int64), max(len(self.langs), 1)
        for j in range(size):
            if span * max(len(self.spelled), 1) >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                span = len(found)
            key = key * len(self.spelled) + self.ids[at + j]
            span *= max(len(self.spelled), 1)
        _, first, number = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        words = [self.spelled.take(pa.array(self.ids[at + j])) for j in range(size)]
        joined = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return [self.langs[i] for i in self.lang[at]], joined, number


def _places(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(n_bits - 1), (hashes >> np.uint64(32)) & np.uint64(n_bits - 1)


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for place in _places(hashes, len(bits) * 64):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts that end with a piece; one without any end of a piece stays whole."""
    start = 0
    while len(text) - start > limit and (end := _BREAK.search(text, start + limit)):
        yield text[start:end.start()]
        start = end.end()
    yield text[start:]


def _count_batches(batches: Iterator[pa.RecordBatch], size: int, bits, limit: int) -> Iterator[pa.RecordBatch]:
    mask = None if bits is None else np.frombuffer(bits.value, dtype=np.uint64)

    def counted(texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
        words = _Words(texts, langs)
        lang, phrase, number = words.counted(size, mask)
        if size == 1:  # the empty phrase counts all words
            total = np.bincount(words.lang, minlength=len(words.langs))
            lang, number = lang + words.langs, np.concatenate([number, total])
            phrase = pa.concat_arrays([phrase, pa.array([b""] * len(words.langs), pa.large_binary())])
        return pa.record_batch([pa.array(lang, pa.string()), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(number, pa.int64())], ["lang", "phrase", "n"])

    for batch, texts in chunks(batches, limit=limit):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        if len(texts) == 1:
            for part in _parts(texts[0], limit):
                yield counted([part], langs)
        else:
            yield counted(texts, langs)


def _filter_places(batches: Iterator[pa.RecordBatch], size: int, n_bits: int) -> Iterator[pa.RecordBatch]:
    """Places in the filter of phrases (lang, phrase) that all have ``size`` words."""
    for batch in batches:
        if batch.num_rows:
            words = _Words([p.encode() for p in batch.column(1).to_pylist()], batch.column(0).to_pylist())
            both = np.concatenate(_places(words.hashes(size)[::size], n_bits)).astype(np.int64)
            yield pa.record_batch([pa.array(both, pa.int64())], ["place"])


def _filter(frequent: DataFrame, size: int, most_bits: int):
    """Broadcast bit filter over the phrases of ``frequent``, of ``size`` words; as large as their number asks, up to ``most_bits``."""
    wanted = 16 * max(frequent.count(), 64)
    n_bits = min(most_bits, 1 << int(wanted - 1).bit_length())
    places = frequent.select("lang", "phrase").mapInArrow(partial(_filter_places, size=size, n_bits=n_bits), "place long")
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    bits = np.zeros(n_bits // 64, dtype=np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most_bits: int = FILTER_BITS,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, phrase, size, f): exact counts of all phrases of up to ``longest`` words that occur ``least`` times.

    The phrase '' of size 0 counts all words of a language. ``docs`` has text and lang; null texts are empty, null
    languages 'und'. Occurrences stay within a piece and may overlap.
    """
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    out, bits = None, None
    for size in range(1, longest + 1):
        rows = slim.mapInArrow(partial(_count_batches, size=size, bits=bits, limit=part_bytes), "lang string, phrase string, n long")
        counted = settle(
            rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
            .withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(size)))
        if bits is not None:
            bits.destroy()
        out = counted if out is None else out.unionByName(counted)
        if size < longest:
            bits = _filter(counted.where("size > 0"), size, most_bits)
    return out


def _parts_in_order(phrases: DataFrame, words: Column, longest: int, name: str) -> DataFrame:
    """Add, along the stream ordered by (lang, ``words``), the count of the first k words for k below ``longest``."""
    stream = sliced(phrases.withColumn("_words", words), ["lang", "_words"])
    lengths = range(1, longest)
    upto = Window.partitionBy(SLICE).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    ends = stream.groupBy(SLICE).agg(*[F.max_by("f", F.when(F.col("size") == k, F.col(SLOT))).alias(f"_e{k}") for k in lengths])
    carried = ends.select(F.col(SLICE).alias("_s"), *[F.last(f"_e{k}", ignorenulls=True).over(before).alias(f"_c{k}") for k in lengths])
    seen = stream.select("*", *[F.last(F.when(F.col("size") == k, F.col("f")), ignorenulls=True).over(upto).alias(f"_l{k}") for k in lengths])
    joined = seen.join(carried, F.col(SLICE) == F.col("_s"))
    return joined.select(*phrases.columns, *[F.coalesce(f"_l{k}", f"_c{k}").alias(f"{name}{k}") for k in lengths])


def _pick(name: str, length: Column, longest: int) -> Column:
    return F.coalesce(*[F.when(length == k, F.col(f"{name}{k}")) for k in range(1, longest)])


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED,
                 most_bits: int = FILTER_BITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """All phrases of 2 to ``longest`` words with their score, less those covered by a longer one.

    Returns lang, phrase, size, a (occurrences), k (words before the cut that counts), l, r (occurrences of the part
    before and after it), n (words of the language), score. Every cut scores floor(2000000 a / (l + r)) in exact
    decimals; the lowest counts, of equal ones that with the smallest k. A phrase goes where a longer one that
    contains it has at least ``covered`` percent of its occurrences; then one of the one-word extensions has.
    Empty input gives no rows; repeated rows count again; other columns of ``docs`` are ignored.
    """
    counts = phrase_counts(docs, least, longest, most_bits, part_bytes)
    phrases = counts.where("size > 0").withColumn("words", F.split("phrase", " "))
    ahead = settle(_parts_in_order(phrases, F.col("words"), longest, "l"))
    behind = settle(_parts_in_order(phrases.select("lang", "phrase", "size", "f", "words"), F.reverse("words"), longest, "r"))
    nearly = lambda name: F.col("f").cast("decimal(20,0)") * 100 >= _pick(name, F.col("size") - 1, longest).cast("decimal(20,0)") * covered
    short = lambda first: F.array_join(F.slice("words", first, F.col("size") - 1), " ").alias("phrase")
    dropped = ahead.where((F.col("size") > 2) & nearly("l")).select("lang", short(1)).unionByName(
        behind.where((F.col("size") > 2) & nearly("r")).select("lang", short(2))).distinct()

    exact = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, longest):
        left, right = F.col(f"l{k}"), _pick("r", F.col("size") - k, longest)
        cut = F.struct(exact(left).alias("l"), exact(right).alias("r"), exact(F.col("f")).alias("a"))
        cuts.append(F.when(F.col("size") > k, F.struct(
            _quotient(cut).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    merged = ahead.where("size > 1").hint("merge").join(behind.drop("size", "f", "words"), ["lang", "phrase"])
    scored = merged.withColumn("_cut", F.array_min(F.array_compact(F.array(*cuts)))).join(dropped.hint("merge"), ["lang", "phrase"], "left_anti")
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return scored.join(words, "lang").select(
        "lang", "phrase", "size", F.col("f").alias("a"), "_cut.k", "_cut.l", "_cut.r", "n", "_cut.score")


def _quotient(cut: Column) -> Column:
    """floor(SCALE * a / (l + r)) of whole decimals."""
    dividend, divisor = cut["a"] * F.lit(SCALE), cut["l"] + cut["r"]
    rest = dividend % divisor
    return ((dividend - rest) / divisor).cast("long")


def best_per_language(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of every language by score, a, and phrase, numbered from 1.

    Each of many parts of a language is cut to ``most`` rows first, so no task ranks a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank")
    whole = Window.partitionBy("lang").orderBy(*order)
    return first.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= most)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language over all documents."""
    best = best_per_language(collocations(table(spark, sf_dir, "documents")), 2000)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece_id, coalesce(lang, 'und') AS lang, piece FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), w AS (
  SELECT piece_id, lang, generate_subscripts(v, 1) AS pos, unnest(v) AS word FROM (
    SELECT piece_id, lang, regexp_extract_all(piece, '[^ \t]+') AS v FROM p)
), s AS (
  SELECT lang, [word, lead(word, 1) OVER q, lead(word, 2) OVER q, lead(word, 3) OVER q] AS four
  FROM w WINDOW q AS (PARTITION BY piece_id ORDER BY pos)
), g AS MATERIALIZED (
  SELECT lang, words, len(words) AS m, count(*) AS f
  FROM (SELECT lang, four[1:m] AS words, four[m] AS last_word FROM s, (VALUES (1), (2), (3), (4)) t(m))
  WHERE last_word IS NOT NULL GROUP BY lang, words
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE f >= 30 AND m > 1),
inner_words AS MATERIALIZED (
  SELECT c.lang, c.f AS longer, c.words[i:i + s - 1] AS words FROM c, (VALUES (2), (3)) t(s), range(1, 4) r(i) WHERE s < c.m AND i + s - 1 <= c.m
), inner_parts AS (
  SELECT DISTINCT lang, words FROM inner_words JOIN g USING (lang, words) WHERE 100 * longer >= 80 * f
), halves AS MATERIALIZED (
  SELECT lang, words, f AS a, k, words[1:k] AS first_words, words[k + 1:] AS last_words FROM c, range(1, 4) t(k) WHERE k < c.m
), lefts AS MATERIALIZED (
  SELECT * FROM halves JOIN (SELECT lang, words AS first_words, f AS l FROM g) USING (lang, first_words)
), cut AS MATERIALIZED (
  SELECT *, (2000000::HUGEINT * a) // (l + r) AS score FROM lefts JOIN (SELECT lang, words AS last_words, f AS r FROM g) USING (lang, last_words)
), best AS (SELECT lang, words, min((score, k, l, r, a)) AS s FROM cut GROUP BY lang, words),
kept AS (SELECT * FROM best ANTI JOIN inner_parts USING (lang, words)),
ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, s,
    row_number() OVER (PARTITION BY lang ORDER BY s[1] DESC, s[5] DESC, encode(array_to_string(words, ' '))) AS rank FROM kept
)
SELECT lang, rank, phrase, s[5]::BIGINT AS a, s[3]::BIGINT AS l, s[4]::BIGINT AS r, n, s[1]::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Query] = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES: dict[str, str] = {"op11_phrase_collocations": SQL}
