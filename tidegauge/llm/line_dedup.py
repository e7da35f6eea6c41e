"""Corpus-wide removal of repeated lines: equal lines, and lines one edit from an earlier one.

Lines are compared trimmed and lower-cased, from ``min_chars`` characters on. A line is removed where an equal line, or
one within one inserted, deleted or replaced character, stands earlier in the order of (doc_id, position).

A line and its one-edit neighbour agree in their front or in their back half. Half keys find the few lines that have
such a relative at all; only these emit their deletion neighbourhood, which is the other half with each character left
out in turn. Equal variants join; the edit distance of each pair so found is then computed. A variant and place can only
be shared by as many distinct lines as there are characters, so no group is large, however often a line is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import small, table
from tidegauge.plans.registry import Query
from tidegauge.session import settle

MIN_CHARS = 20


def _norm(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, norm, len) of the lines that take part."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.select("doc_id", "pos", _norm(F.col("line")).alias("norm")).withColumn("len", F.length("norm")).where(F.col("len") >= min_chars)


def _front(m: Column) -> Column:
    return F.floor(m / 2).cast("int")


def _half(norm: Column, length: Column, m: Column, side: str) -> Column:
    """The half of a line that stands for a base length ``m``: its first characters, or its last ones."""
    front = _front(m)
    return F.substring(norm, F.lit(1), front) if side == "front" else F.substring(norm, length - (m - front) + 1, m - front)


def _rest(norm: Column, length: Column, m: Column, side: str) -> Column:
    """What the half key leaves open."""
    front = _front(m)
    return F.substring(norm, front + 1, length - front) if side == "front" else F.substring(norm, F.lit(1), length - (m - front))


SIDES = [(side, less) for side in ("front", "back") for less in (0, 1)]


def _half_key(side: str, less: int) -> Column:
    m = F.col("len") - less
    return F.xxhash64(F.lit(side), m, _half(F.col("norm"), F.col("len"), m, side))


def _near_earlier(docs: DataFrame, classes: DataFrame, min_chars: int) -> DataFrame:
    """Classes (hash, len) that stand within one edit of an earlier class."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("key")) for k in range(len(SIDES))])
    keyed = classes.select("hash", "len", "rank", F.explode(keys).alias("_k")).select("hash", "len", "rank", "_k.kind", "_k.key")
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    related = settle(keyed.join(shared, "key", "left_semi"))

    # only one line of each class in question is fetched again
    wanted = related.select("hash", "len", "rank.doc_id", "rank.pos").distinct()
    own = docs.join(small(settle(wanted.select("doc_id").distinct())), "doc_id", "left_semi")
    texts = settle(_lines(own, min_chars).join(wanted, ["doc_id", "pos", "len"]).where(F.xxhash64("norm") == F.col("hash")).select("hash", "len", "norm").distinct())

    rows = related.join(texts, ["hash", "len"])
    rest, less = F.lit(None).cast("string"), F.lit(0)
    for k, (side, minus) in enumerate(SIDES):
        rest = F.when(F.col("kind") == k, _rest(F.col("norm"), F.col("len"), F.col("len") - minus, side)).otherwise(rest)
        less = F.when(F.col("kind") == k, F.lit(minus)).otherwise(less)
    rows = rows.select("hash", "len", "rank", "key", rest.alias("rest"), less.alias("less"))
    place = F.explode(F.sequence(F.when(F.col("less") == 0, 0).otherwise(1), F.length("rest")))
    without = F.when(F.col("_i") == 0, F.col("rest")).otherwise(F.concat(F.expr("substring(rest, 1, _i - 1)"), F.expr("substring(rest, _i + 1)")))
    variants = rows.withColumn("_i", place).select(
        "hash", "len", "rank", F.when(F.col("less") == 1, "longer").when(F.col("_i") == 0, "whole").otherwise("replaced").alias("role"),
        # a replaced character leaves its place open; an inserted one may have been anywhere
        F.xxhash64("key", F.when(F.col("less") == 1, F.lit(0)).otherwise(F.col("_i")), without).alias("variant"))
    equal = Window.partitionBy("variant")
    entry = F.struct("rank", "hash", "len")
    of = lambda role: F.min(F.when(F.col("role") == role, entry)).over(equal)
    partner = F.when(F.col("role") == "replaced", of("replaced")).when(F.col("role") == "whole", of("longer")).otherwise(of("whole"))
    pairs = settle(
        variants.withColumn("other", partner).where("other.rank < rank")
        .select("hash", "len", F.col("other.hash").alias("hash2"), F.col("other.len").alias("len2")).distinct())
    second = texts.select(F.col("hash").alias("hash2"), F.col("len").alias("len2"), F.col("norm").alias("norm2"))
    within = F.levenshtein("norm", "norm2", 1)
    return pairs.join(texts, ["hash", "len"]).join(second, ["hash2", "len2"]).where(within >= 0).select("hash", "len").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Remove repeated and nearly repeated lines from all documents, keeping the earliest.

    Returns per row of ``docs``: doc_id, text (what is left, joined by line feeds), n_lines, n_dropped. Null texts stay
    null; texts that lose nothing stay as they are. Rows without an id have no place in the order: they stay whole
    and remove nothing. Rows that share an id are one document read again and lose the same lines. Columns of ``docs``
    besides the two named are ignored; with ``carry`` the whole row comes along as the struct ``row``.
    """
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *whole)
    marked = _lines(rows, min_chars).select("doc_id", "pos", "len", F.xxhash64("norm").alias("hash"), *[_half_key(side, less).alias(f"k{k}") for k, (side, less) in enumerate(SIDES)])
    classes = settle(
        marked.groupBy("hash", "len").agg(F.min(F.struct("doc_id", "pos")).alias("rank"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(len(SIDES))]))
    near = settle(_near_earlier(rows, classes, min_chars))
    kept = classes.join(near, ["hash", "len"], "left_anti").select("rank.doc_id", "rank.pos").groupBy("doc_id").agg(F.collect_list("pos").alias("_kept"))

    places = F.transform("_lines", lambda line, i: F.when(F.length(_norm(line)) >= min_chars, i))
    joined = rows.join(kept, "doc_id", "left").withColumn("_lines", F.split("text", "\n", -1))
    judged = joined.withColumn("_dropped", F.when(F.col("doc_id").isNull(), F.array().cast("array<int>")).otherwise(
        F.array_except(F.array_compact(places), F.coalesce("_kept", F.array().cast("array<int>")))))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped")), lambda i: F.get("_lines", i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return judged.select(
        "doc_id", F.when(F.size("_dropped") > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"),
        n_lines.alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"), *["row"] * carry)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and a digest of the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage_dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents keep the lines that stand nowhere earlier; those of which nothing is left go."""
    cleaned = dedup_lines(docs, carry=True).where("n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    renewed = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[renewed[c].alias(c) if c in renewed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), n AS (SELECT doc_id, pos, line, lower(trim(line, ' ' || chr(9) || chr(13))) AS norm FROM l),
c AS (SELECT norm, length(norm) AS len, min((doc_id, pos)) AS rank FROM n WHERE length(norm) >= 20 GROUP BY norm),
x AS (SELECT *, len - d AS m, d FROM c, (VALUES (0), (1)) t(d)),
h AS (
  SELECT norm, rank, d, m, 'f' AS side, left(norm, CAST(m // 2 AS BIGINT)) AS half FROM x
  UNION ALL SELECT norm, rank, d, m, 'b', right(norm, CAST(m - m // 2 AS BIGINT)) FROM x
), near AS (
  SELECT DISTINCT a.norm FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.d + b.d < 2
  WHERE b.rank < a.rank AND levenshtein(a.norm, b.norm) <= 1
), kept AS (SELECT rank FROM c ANTI JOIN near USING (norm)),
k AS (SELECT n.*, length(norm) < 20 OR (doc_id, pos) IN (SELECT rank FROM kept) AS keep FROM n)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS text_sha256 FROM k GROUP BY doc_id
"""

QUERIES: dict[str, Query] = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {"op8_line_dedup": SQL}
