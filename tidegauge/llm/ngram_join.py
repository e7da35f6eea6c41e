"""Set-similarity join of documents on word n-grams, partitioned vertically along a global n-gram order.

One order holds for all documents: n-grams ascend by the count of their cell in a counting sketch, ties by hash. Rare
ones come first, so the head of a document's set meets few others. The order is cut into fragments. Two sets that are
similar enough share a gram in their heads; such pairs are candidates. For each candidate the overlap is counted
fragment by fragment, and the partial counts are summed per pair.

Equal sets form one node, so copies are never paired. Links are only needed to know what is connected: each node is
first tried against one hub, connected nodes are merged, and only pairs across components that are still apart are
enumerated. That last step is complete, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import chunks, small, table, words_of
from tidegauge.plans.registry import Query
from tidegauge.session import settle

CELLS = 1 << 22  # cells of the sketch; it takes 16 MB whatever the corpus holds
BLOCK = 1 << 16
FRAGMENTS = 8
TOGETHER = 32  # tables of so many tasks are added before the sums of all
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _gram_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; a shorter text is one gram, an empty one none."""
    words = [words_of(t.lower()) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=object)
    flat[:] = [w for one in words for w in one]
    with np.errstate(over="ignore"):
        hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, dtype=np.uint64)
        rolled = hashes[: max(0, len(hashes) - width + 1)].copy()
        for k in range(1, width):
            rolled = rolled * _PRIME + hashes[k : len(hashes) - width + 1 + k]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
    out, start = [], 0
    for one, end in zip(words, ends):
        if len(one) >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        elif one:
            whole = hashlib.blake2b(b" ".join(one) + b"\n", digest_size=8).digest()
            out.append(np.frombuffer(whole, dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        start = end
    return out


def _node(grams: np.ndarray) -> int:
    """Identity of a set: 63 bits of a cryptographic hash of its sorted grams."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "big") >> 1


def _at_least(percent: int, size: np.ndarray | int) -> np.ndarray | int:
    return -((-percent * size) // 100)


SETS = "doc_id long, n_shingles long, node long, block int, part int, cells binary"


def _packed(cells: np.ndarray) -> bytes:
    """Counts of a block; most are small, and a task fills few of its cells more than once."""
    return zlib.compress(cells.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=np.int32)


def _sets_and_sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int32)
        task = TaskContext.get()
        part = task.partitionId() // TOGETHER if task else 0
        for batch, texts in chunks(batches):
            grams = _gram_sets(texts, width)
            np.add.at(cells, (np.concatenate(grams) & np.uint64(CELLS - 1)).astype(np.int64), np.int32(1))
            ids = batch.column(0)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(g) for g in grams], pa.int64()), pa.array([_node(g) if len(g) else None for g in grams], pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "n_shingles", "node", "block", "part", "cells"])
        blocks = [b for b in range(CELLS // BLOCK) if cells[b * BLOCK : (b + 1) * BLOCK].any()]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64())] * 3 + [pa.array(blocks, pa.int32()), pa.array([part] * n, pa.int32()),
             pa.array([_packed(cells[b * BLOCK : (b + 1) * BLOCK]) for b in blocks], pa.binary())], names=["doc_id", "n_shingles", "node", "block", "part", "cells"])

    return run


def _added(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.int64)
        for blob in pdf["cells"]:
            total += _unpacked(blob)
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"cells": [_packed(np.minimum(total, 2**31 - 1).astype(np.int32))]}
        return pd.DataFrame(row)

    return run


def _order(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Count of every cell, where the fragments begin in the order of ``_places``, and the count beyond which a cell is hot.

    The tables of all tasks are added in two levels.
    """
    sums = (
        sketch.groupBy("block", "part").applyInPandas(_added(["block", "part"]), "block int, part int, cells binary")
        .groupBy("block").applyInPandas(_added(["block"]), "block int, cells binary")
    )
    counts = np.zeros(CELLS, dtype=np.int32)
    for row in sums.toLocalIterator():  # 64 blocks of fixed size
        counts[row.block * BLOCK : (row.block + 1) * BLOCK] = _unpacked(row.cells)
    values, sizes = np.unique(counts, return_counts=True)
    mass = np.cumsum(values.astype(np.int64) * sizes)
    pivots = []
    for f in range(1, FRAGMENTS) if mass[-1] else ():
        goal = -(-f * int(mass[-1]) // FRAGMENTS)
        at = int(np.searchsorted(mass, goal))
        value = int(values[at])
        nth = -(-(goal - int(mass[at]) + value * int(sizes[at])) // value) - 1  # cell of that count
        pivots.append(value * CELLS + int(np.flatnonzero(counts == value)[nth]))
    return counts, np.array(pivots, dtype=np.int64), 1000 + 8 * int(mass[-1]) // CELLS


def _places(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each gram's cell in the global order: by count, then by number."""
    cell = (grams & np.uint64(CELLS - 1)).astype(np.int64)
    return counts[cell].astype(np.int64) * CELLS + cell


POSTINGS = "gram long, node long, meta long"  # meta: size of the set, position, whether indexed, whether hot


def _heads(width: int, percent: int, sketch):
    """The first grams of each set, in the global order: enough of them that similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, _, limit), seen = sketch.value, set()
        for _, texts in chunks(batches):
            parts: list[tuple[np.ndarray, int, int, int]] = []
            for grams in _gram_sets(texts, width):
                n = len(grams)
                if not n or (node := _node(grams)) in seen:
                    continue
                seen.add(node)
                order = np.lexsort((grams, _places(grams, counts)))
                head = n - _at_least(percent, n) + 1
                parts.append((grams[order[:head]], node, n, n - _at_least(200 * percent // (100 + percent), n) + 1))
            if len(seen) > 1_000_000:  # only saves repeats inside a task
                seen.clear()
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            grams = np.concatenate([p[0] for p in parts])
            pos = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
            indexed = pos < np.repeat([p[3] for p in parts], sizes)
            meta = np.repeat(np.array([p[2] for p in parts], dtype=np.int64), sizes) << 32 | pos.astype(np.int64) << 2
            meta |= indexed.astype(np.int64) << 1 | (counts[(grams & np.uint64(CELLS - 1)).astype(np.int64)] > limit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(np.repeat(np.array([p[1] for p in parts], dtype=np.int64), sizes)), pa.array(meta)], names=["gram", "node", "meta"])

    return run


FILTER_BITS = 1 << 23  # 1 MB; a fuller filter lets more documents through to the exact join, and drops none


def _filter_places(ids: np.ndarray) -> np.ndarray:
    """Two places of each id in the filter."""
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.uint64) * _PRIME
        mixed ^= mixed >> np.uint64(31)
        return np.stack([mixed & np.uint64(FILTER_BITS - 1), (mixed >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def _filter_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[_filter_places(batch.column(0).to_numpy())] = True
    packed = np.packbits(bits).reshape(16, -1)
    used = np.flatnonzero(packed.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])


def _joined_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in pdf["bits"]])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [bits.tobytes()]})


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter over ids, built in tasks."""
    parts = ids.coalesce(64).mapInArrow(_filter_of, "block int, bits binary").groupBy("block").applyInPandas(_joined_bits, "block int, bits binary")
    packed = np.zeros((16, FILTER_BITS // 8 // 16), dtype=np.uint8)
    for row in parts.toLocalIterator():  # 16 blocks of 64 KB
        packed[row.block] = np.frombuffer(row.bits, dtype=np.uint8)
    return packed.reshape(-1)


def _segments(width: int, sketch, wanted):
    """The whole set of each text, cut at the pivots of the global order; texts whose id the filter lacks are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, pivots, _), bits = sketch.value, wanted.value
        for batch, texts in chunks(batches):
            node, piece, values, owner = [], [], [], []
            ids = batch.column(0)
            a, b = _filter_places(ids.fill_null(0).to_numpy(zero_copy_only=False))
            test = lambda at: bits[at >> 3] >> (7 - (at & 7)) & 1
            use = (test(a) & test(b)).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            for i, grams in zip(ids.filter(pa.array(use)).to_pylist(), _gram_sets([t for t, u in zip(texts, use) if u], width)):
                key, where = _node(grams), np.searchsorted(pivots, _places(grams, counts), side="right")
                for f in np.unique(where):
                    owner.append(i), node.append(key), piece.append(int(f)), values.append(grams[where == f].view(np.int64))
            if node:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int64()), pa.array(node, pa.int64()), pa.array(piece, pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["id", "node", "fragment", "grams"])

    return run


def _segments_of(pairs: DataFrame, rows: DataFrame, sets: DataFrame, width: int, sketch) -> DataFrame:
    """Segments of the nodes that occur in ``pairs``, each from one document."""
    nodes = small(settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    carriers = settle(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")))
    wanted = rows.sparkSession.sparkContext.broadcast(_id_filter(carriers.where("_id is not null").select("_id")))
    found = rows.mapInArrow(_segments(width, sketch, wanted), "id long, node long, fragment int, grams array<long>")
    return settle(found.join(small(carriers).withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "fragment", "grams"))


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed partial overlaps reach the threshold."""
    known = small(pairs)
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("_ga")).join(known, "a")
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("_gb")).join(small(settle(pairs.select("b").distinct())), "b", "left_semi")
    partial = left.join(right, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("_ga", "_gb")).alias("_part"))
    # a row read twice gives a segment twice
    once = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("_part").alias("_part"))
    return once.groupBy("a", "b", "na", "nb").agg(F.sum("_part").alias("overlap")).where(
        100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _long_enough(percent: int):
    """Least overlap that sizes na and nb need."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _with_ends(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` and, as their own components, the nodes of ``links`` that they lack."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if labels is None:
        return settle(ends.select("node", F.col("node").alias("comp")))
    return settle(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))))


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge ``labels`` (node, comp) along ``links`` (a, b): every label becomes the smallest one it can reach.

    Each turn hangs labels on their smallest neighbour and shortens the chains; the number of turns grows with the
    logarithm of the longest chain.
    """
    while True:
        end = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        edges = links.join(end("a"), "a").join(end("b"), "b").where("ca <> cb").select(
            F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("parent"))
        parents = settle(edges.groupBy("comp").agg(F.min("parent").alias("parent")))
        if parents.isEmpty():
            return labels
        for _ in range(2):
            above = parents.select(F.col("comp").alias("parent"), F.col("parent").alias("_above"))
            parents = parents.join(above, "parent", "left").select("comp", F.coalesce("_above", "parent").alias("parent"))
        labels = settle(labels.join(parents, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")))


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """For each node one hub: of the nodes that lead the lists it stands in, the one it shares most of its head with.

    A list is led by the node whose head is shared most: the text that a group of near copies was made from has the
    fewest grams of its own.
    """
    own = Window.partitionBy("node")  # at most the head of one set
    ranked = settle(postings.withColumn("density", F.count("*").over(own) / F.max("n").over(own)))
    hubs = ranked.groupBy("gram").agg(F.max_by(F.struct("node", "n", "pos"), F.struct("density", "node")).alias("_hub"))
    met = ranked.join(hubs, "gram").where(F.col("node") != F.col("_hub.node")).select(
        F.col("node").alias("a"), F.col("n").alias("na"), "pos", F.col("_hub.node").alias("b"), F.col("_hub.n").alias("nb"), F.col("_hub.pos").alias("pos_b"))
    common = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pos").alias("i"), F.max("pos_b").alias("j"))
    able = common.where(F.col("c") + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1) >= _long_enough(percent))
    # one head ends first in the global order, and what two sets share besides lies behind it; a hub may lead a part of
    # the lists only, hence the factor, and what is left out here meets in the last step
    behind = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100) - 1
    able = able.where(4 * F.col("c") + F.greatest(behind("na"), behind("nb")) >= _long_enough(percent))
    return able.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("c", "b")).alias("_best")).select("a", "na", "_best.b", "_best.nb")


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Posting rows with their component (of nodes that ``labels`` lack: their own), of grams that still stand in two."""
    moved = small(labels.where("node <> comp"))
    rows = postings.join(moved, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = rows.groupBy("gram").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("gram")
    return rows.join(apart, "gram")


def _cross_pairs(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs, of different components, that may be similar.

    Rows of a gram's largest component are not paired among each other, so a large group of near copies costs its
    size times the number of nodes outside it. The first common gram of a similar pair lies in the head of the
    longer set and in the shorter head of the shorter one, and leaves enough grams behind it.
    """
    mixed = settle(_mixed(postings, labels))
    major = mixed.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"))
    minor = mixed.join(major, "gram").where("comp <> major").select(
        "gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("indexed").alias("ia"), F.col("comp").alias("ca"), "major")
    every = mixed.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("indexed").alias("ib"), F.col("comp").alias("cb"))
    return (
        minor.join(every, "gram")
        .where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))))
        .where(F.when(F.col("na") > F.col("nb"), F.col("ib")).when(F.col("na") < F.col("nb"), F.col("ia")).otherwise(F.col("ia") & F.col("ib")))
        .where(1 + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1) >= _long_enough(percent))
        .select("a", "b", "na", "nb").distinct()
    )


def similar_groups(docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents by links of Jaccard similarity of at least ``percent`` / 100 on ``width``-word shingles.

    Returns per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links). Null and
    blank texts have no shingles and stand alone; rows with a null id get a null component unless linked to an id.
    Repeated rows fall into one component. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = settle(rows.mapInArrow(_sets_and_sketch(width), SETS))
    sets = first.where("block is null").select("doc_id", "n_shingles", "node")
    sketch = spark.sparkContext.broadcast(_order(first.where("block is not null").select("block", "part", "cells")))

    # a gram that is not hot has a short list, as the sketch never counts too few; hot ones are kept unseen
    heads = rows.select("doc_id", "text").mapInArrow(_heads(width, percent, sketch), POSTINGS)
    is_hot = F.col("meta").bitwiseAND(1) == 1
    one_gram = Window.partitionBy("gram", F.when(is_hot, F.col("node")).otherwise(F.lit(0)))
    unpacked = [F.shiftright("meta", 32).cast("int").alias("n"), F.shiftright("meta", 2).bitwiseAND((1 << 30) - 1).cast("int").alias("pos"),
                (F.shiftright("meta", 1).bitwiseAND(1) == 1).alias("indexed")]
    postings = settle(
        heads.select("*", F.min("node").over(one_gram).alias("_lo"), F.max("node").over(one_gram).alias("_hi"), F.lag("node").over(one_gram.orderBy("node")).alias("_same"))
        .where((is_hot | (F.col("_lo") != F.col("_hi"))) & (F.col("_same").isNull() | (F.col("_same") != F.col("node"))))
        .select("gram", "node", *unpacked))

    def links_of(pairs: DataFrame) -> DataFrame:
        return settle(_verified(pairs, _segments_of(pairs, rows, sets, width, sketch), percent))

    links = links_of(settle(_hub_pairs(postings, percent)))
    labels = merge_components(_with_ends(None, links), links)
    links = links_of(settle(_cross_pairs(postings, labels, percent)))
    labels = merge_components(_with_ends(labels, links), links)

    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_least"))
    grouped = classes.join(labels, "node")
    least = grouped.groupBy("comp").agg(F.min("_least").alias("_all"))
    linked = grouped.join(least, "comp").select("node", F.col("_all").alias("_least"))
    alone = classes.join(labels, "node", "left_anti").select("node", "_least")
    return sets.join(alone.unionByName(linked), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest id stays."""
    groups = similar_groups(docs).where("component_id is null or doc_id <> component_id").where("doc_id is not null").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN both_ways ON a = d)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT min(c) FROM reach WHERE d = s.doc_id) AS component_id FROM s
"""

QUERIES: dict[str, Query] = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLES: dict[str, str] = {"op6_ngram_jaccard_join": SQL}
