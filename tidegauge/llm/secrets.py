"""Scanning texts for secrets: fixed patterns, and strings that look random under character Markov models.

Two models of character pairs are trained from labelled samples, one of random strings and one of ordinary words. A long
run of key characters that no pattern took is a secret if its log-likelihood ratio is high enough. All work stays in the
row of a document; only the pair counts shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.plans.registry import Query

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is as long as it can be, so the least length may stand in the pattern
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEYLIKE = "[A-Za-z0-9+/_=-]"


@dataclass(frozen=True)
class Secrets:
    least: int = 16  # characters of a run that the models judge
    ratio: float = 0.6  # log-likelihood ratio a character, in nats, that a secret has at least
    sample_docs: int = 5000  # documents that ordinary words and random samples are drawn from; values of patterns come from all
    smoothing: float = 0.5


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """(start, kind, end) of all matches in code points, left to right, without overlap.

    What lies between the matches, and their own lengths, add up to the places.
    """
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if least else 0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), value.alias("value"))
    span = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        hit = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")).cast(span))
        return F.struct(end.alias("at"), F.when(hit, F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    return F.aggregate(both, start, step, lambda s: s["found"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def _scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with _text and their pattern spans, _base. Texts without a match are only searched once a pattern."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    t = F.col("_text")
    assign = F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, 0, least=8)).otherwise(_none())
    access = F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(_none())
    hexes = F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none())
    return rows.withColumn("_base", F.concat(assign, access, hexes))


def _pairs(token: Column) -> Column:
    """Pairs of a token's characters as places in one table; 0 stands for its ends and for any other character."""
    n = len(ALPHABET) + 1
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    code = lambda i: F.coalesce(F.array_position(letters, F.substring(token, i, F.lit(1))), F.lit(0)).cast("int")
    codes = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.length(token)), code), F.array(F.lit(0)))
    # a lambda's argument is worked out once, what it captures for every element again
    bound = F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(c, i) * n + F.get(c, i + 1)))
    return F.get(bound, F.lit(0))


def train(docs: DataFrame, options: Secrets = Secrets(), doc_id: str = "doc_id", text: str = "text", samples: DataFrame | None = None) -> list[float]:
    """Log-likelihood ratios of all character pairs.

    Labelled samples are the values that patterns matched (random), digests of ids in base 64 and 16 (random), and the
    other key-like runs of at least 8 characters that occur in several documents (ordinary, each once: what people name
    comes back, what a generator made does not); ``samples`` (token, random) adds more. The result has one number for
    each pair of the fixed alphabet.
    """
    rows = _scanned(docs, doc_id, text)
    n_docs = max(1, docs.count())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, options.sample_docs / n_docs) * (1 << 20))
    values = rows.where(F.size("_base") > 0).select(F.explode("_base.value").alias("token"), F.lit(True).alias("random"))
    # few documents give several digests each, so that the random model has as many samples
    numbered = rows.where(part).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(options.sample_docs / min(n_docs, options.sample_docs))))).alias("k"))
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "k"), 256)
    digests = numbered.select(F.explode(F.array(F.base64(F.unhex(digest)), digest)).alias("token"), F.lit(True).alias("random"))
    words = rows.where(part).select("doc_id", F.explode(F.regexp_extract_all("_text", F.lit(rf"(?<!{KEYLIKE}){KEYLIKE}{{8,}}"), F.lit(0))).alias("token"), F.col("_base.value").alias("_v"))
    plain = words.where(~F.exists("_v", lambda v: v.contains(F.col("token")))).groupBy("token").agg(
        F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("token", F.lit(False).alias("random"))
    labelled = values.unionByName(digests).unionByName(plain)
    if samples is not None:
        labelled = labelled.unionByName(samples.select(F.col("token").cast("string"), F.col("random").cast("boolean")).where("token is not null and random is not null"))
    counted = labelled.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count()
    n = len(ALPHABET) + 1
    counts = {True: [0.0] * (n * n), False: [0.0] * (n * n)}
    for r in counted.toLocalIterator():
        counts[r.random][r.pair] = float(r["count"])

    # pairs are smoothed with the shares of their second characters: what follows a rare character is not known to be anything
    single = {label: [sum(row[k::n]) + options.smoothing for k in range(n)] for label, row in counts.items()}

    def log_share(label: bool, k: int) -> float:
        row, alone = counts[label][k // n * n : k // n * n + n], single[label]
        prior = options.smoothing * n * alone[k % n] / sum(alone)
        return math.log((counts[label][k] + prior) / (sum(row) + options.smoothing * n))

    return [log_share(True, k) - log_share(False, k) for k in range(n * n)]


def find_secrets(docs: DataFrame, options: Secrets = Secrets(), ratios: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each row of ``docs``: doc_id, base and all (arrays of start, kind, end; code points, end exclusive).

    Null and empty texts have none. Kinds are numbered as in ``KINDS``; arrays are sorted by start, then kind. A run
    that touches a pattern's span is left to the pattern. Repeated rows get the same; other columns are ignored.
    """
    ratios = ratios or train(docs, options, doc_id, text)
    rows = _scanned(docs, doc_id, text)
    of_pair = F.from_json(F.lit("[" + ",".join(f"{r:.9f}" for r in ratios) + "]"), "array<double>")
    mean = lambda token: F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.get(of_pair, p)) / (F.length(token) + 1)
    # a run with letters and digits
    mixed = rf"(?<!{KEYLIKE})(?=[A-Z0-9+/_=-]*[a-z]|[0-9+/_=-]*[A-Z])(?=[A-Za-z+/_=-]*[0-9]){KEYLIKE}{{{options.least},}}+"
    t = F.col("_text")
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_runs", F.when(t.rlike(mixed), _spans(t, mixed, 3)).otherwise(_none()))
    rows = rows.withColumn("_more", F.filter("_runs", lambda s: free(s) & (mean(s["value"]) >= options.ratio)))
    plain = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return rows.select("doc_id", plain(F.col("_base")).alias("base"), plain(F.concat("_base", "_more")).alias("all"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


QUERIES: dict[str, Query] = {"op7_secret_scans": op7_secret_scans}
ORACLES: dict[str, str] = {}
