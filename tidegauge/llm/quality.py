"""Quality rules by distribution divergence: a document's histograms against those of languages.

Two histograms are taken of each text: of character classes, and of common words. Each language's reference is the same
histogram over all its documents. A document that is long enough, and lies far from every language by Jensen-Shannon
distance, is not kept. Everything is worked out inside the row of a document; only the small reference tables shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE, WORD, table
from tidegauge.plans.registry import Query

SYMBOLS = "#*$%&|<>"
#: Character classes, each a pattern; what none of them takes is the last class.
CLASSES = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": r"[\x20\x09-\x0D]", "point": r"[.,;:!?'()\"-]", "symbol": r"[#*$%&|<>]",
}


@dataclass(frozen=True)
class Quality:
    min_words: int = 50  # shorter texts are not judged by divergence
    common_words: int = 40  # words of a language's reference, by count
    class_limit: float = 0.19  # largest distance of the class histogram
    word_limit: float = 0.45  # largest distance of the common-word histogram
    longest_common: int = 8  # characters of a common word at most
    min_language_docs: int = 20  # languages with fewer documents give no reference
    reference_symbols: float = 0.01  # texts with a larger share of symbols teach nothing


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _class_counts(text: Column) -> Column:
    """Characters of each class. Most are lower-case letters; the other classes are counted in what is left of them.

    What is used more than once is passed to a function, so that no pattern runs twice over a text.
    """
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    first, *others = CLASSES.values()
    rest = F.regexp_replace(text, f"{first}+", "")

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def counted(rest: Column) -> Column:
        known = F.array(length(rest), *[_count(rest, p) for p in others])
        return once(known, lambda c: F.array(
            length(text) - F.get(c, F.lit(0)), *[F.get(c, F.lit(k)) for k in range(1, len(others) + 1)],
            F.aggregate(c, 2 * F.get(c, F.lit(0)), lambda left, n: left - n)))

    return once(rest, counted)


def _repeat_words(words: Column) -> tuple[Column, Column, Column]:
    """Words that lie in a 3-word window found twice or more, each counted once.

    Windows are hashed; most texts have no two alike. Those of the others are sorted with their places; equal neighbours
    are repeats. The sorted places then tell how many words they cover.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    ordered = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # each place beside the hashes before and after it
    flagged = F.transform("_ordered", lambda x, k: F.when(
        (x["h"] == F.get("_ordered", k - 1)["h"]) | (x["h"] == F.get("_ordered", k + 1)["h"]), x["i"]))
    return hashes, F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), ordered), flagged


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _classes, _words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    trimmed = F.btrim(F.col("_text"), F.lit(SPACE))
    rows = rows.select(
        "doc_id", "_text", F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>")).alias("_words"),
        _class_counts(F.col("_text")).alias("_classes"), lines.alias("_filled"))
    hashes, order, flagged = _repeat_words(F.col("_words"))
    rows = rows.withColumn("_hashes", F.when(F.size("_words") >= 4, hashes)).withColumn("_ordered", order)
    rows = rows.withColumn("_at", F.sort_array(F.array_compact(flagged)))
    covered = F.aggregate(F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    blank, symbol = list(CLASSES).index("blank"), list(CLASSES).index("symbol")
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), (F.length("_text") - F.get("_classes", F.lit(blank))).cast("long").alias("word_chars"),
        F.get("_classes", F.lit(symbol)).alias("n_symbols"), (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "_classes", "_words")


@dataclass(frozen=True)
class Reference:
    """What is known of the languages: shares of character classes, and of common words over their joint list."""

    languages: list[str]
    classes: list[list[float]]
    words: list[str]
    shares: list[list[float | None]]  # by language and word; None where the word is not common in the language


def language_references(docs: DataFrame, rules: Quality = Quality(), text: str = "text", lang: str = "lang") -> Reference:
    """Learn the references from all documents that name their language.

    What reaches the driver is one row a language, and ``common_words`` words of each.
    """
    n = len(CLASSES) + 1
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).where("lang is not null")
    # symbols alone are counted twice, as a filter on all classes would work them out a second time
    rows = rows.where(_count(F.col("_text"), CLASSES["symbol"]) <= rules.reference_symbols * F.length("_text"))
    sums = rows.withColumn("_c", _class_counts(F.col("_text"))).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(_count(F.col("_text"), WORD)).alias("n_words"), *[F.sum(F.get("_c", F.lit(k))).alias(f"c{k}") for k in range(n)])
    found = list(sums.orderBy("lang").toLocalIterator())
    kept = [r for r in found if r.n_docs >= rules.min_language_docs and sum(r[f"c{k}"] for k in range(n))]
    # longer words only count towards the whole
    words = rows.select("lang", F.explode(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).alias("word")).where(F.length("word") <= rules.longest_common)
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    whole = {r.lang: r.n_words for r in found}
    common: dict[str, dict[str, float]] = {}
    for r in counted.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= rules.common_words).toLocalIterator():
        common.setdefault(r.lang, {})[r.word] = r.n / whole[r.lang]
    listed = sorted({w for r in kept for w in common.get(r.lang, {})})
    classes = [[r[f"c{k}"] / sum(r[f"c{j}"] for j in range(n)) for k in range(n)] for r in kept]
    return Reference([r.lang for r in kept], classes, listed, [[common.get(r.lang, {}).get(w) for w in listed] for r in kept])


def _terms(p: Column, q: Column) -> Column:
    """What a bin of shares ``p`` and ``q`` adds to twice the Jensen-Shannon divergence in bits."""
    return (F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)) + (F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0))


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _word_index(spark: SparkSession, words: list[str]) -> tuple[Column, Column, list[Column]]:
    """A hash index over the listed words: salt and last slot, and the first word of each slot, the second, and so on.

    Of 32 salts the first is taken whose fullest slot has the fewest words, one as a rule.
    """
    size = 1 << (math.ceil(math.log2(len(words) + 1)) + 6)
    numbered = spark.createDataFrame([(w, k) for k, w in enumerate(words)] or [("", -1)], "w string, k int").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    slots: dict[int, dict[int, list[int]]] = {}
    for r in numbered.select("k", "salt", F.pmod(F.xxhash64("w", "salt"), F.lit(size)).cast("int").alias("s")).where("k >= 0").orderBy("k", "salt").toLocalIterator():
        slots.setdefault(r.salt, {}).setdefault(r.s, []).append(r.k)
    fullest = {t: max(map(len, x.values())) for t, x in sorted(slots.items())}
    salt = min(fullest, key=fullest.get, default=0)
    layout = slots.get(salt, {})
    level = lambda n: F.from_json(F.lit("[" + ",".join(str(layout[s][n]) if len(layout.get(s, [])) > n else "-1" for s in range(size)) + "]"), "array<int>")
    return F.lit(salt), F.lit(size - 1), [level(n) for n in range(fullest.get(salt, 1))]


def judge(docs: DataFrame, rules: Quality = Quality(), reference: Reference | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Judge each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance, nearest.

    ``nearest`` is the language with the smallest class distance. Null and empty texts have no words and fail. Without
    any reference nothing is rejected by divergence, and the distances are null. Rows are judged one by one, so
    repeated rows get the same; a null language only means that the row teaches nothing. Other columns are ignored.
    """
    reference = reference or language_references(docs, rules, text, lang)
    rows = measured(docs, doc_id, text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not reference.languages:
        nothing = F.lit(None).cast("double")
        return rows.select(*base, (~F.col("base_failed")).alias("kept"), nothing.alias("class_distance"), nothing.alias("word_distance"), F.lit(None).cast("string").alias("nearest"))
    listed = F.array(*[F.lit(w) for w in reference.words]) if reference.words else F.array().cast("array<string>")
    # places of the common words among the words of the text, sorted, so that equal ones stand together
    salt, mask, levels = _word_index(docs.sparkSession, reference.words)
    slot = lambda w: F.xxhash64(w, salt).bitwiseAND(mask).cast("int")

    def listed_in(level: Column) -> Column:
        return F.zip_with("_words", F.transform("_words", lambda w: F.get(level, slot(w))), lambda w, k: F.when(F.get(listed, k) == w, k))

    found = F.concat(*[listed_in(level) for level in levels])
    rows = rows.withColumn("_found", F.sort_array(F.array_compact(found)))
    ends = F.array_compact(F.transform("_found", lambda x, k: F.when(F.coalesce(F.get("_found", k + 1) != x, F.lit(True)), k)))
    rows = rows.withColumn("_ends", ends)
    runs = F.transform("_ends", lambda e, k: F.struct(F.get("_found", e).alias("w"), ((e - F.coalesce(F.get("_ends", k - 1), F.lit(-1))) / F.col("n_words")).alias("p")))
    rows = rows.withColumn("_runs", runs)
    letters = _sum(F.transform("_classes", lambda c: c.cast("double")))
    per_language = []
    for k, name in enumerate(reference.languages):
        classes = F.array(*[F.lit(float(q)) for q in reference.classes[k]])
        by_class = _root(_sum(F.zip_with("_classes", classes, lambda c, q: _terms(c / letters, q))))
        shares = F.array(*[F.lit(None if q is None else float(q)).cast("double") for q in reference.shares[k]]) if reference.words else F.array().cast("array<double>")
        known = float(sum(q for q in reference.shares[k] if q is not None))
        mine = F.filter("_runs", lambda r: F.get(shares, r["w"]).isNotNull())
        # bins that the text lacks add their whole share; the last bin is all other words
        met = F.aggregate(mine, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("p")), lambda s, r: F.struct(
            (s["t"] + _terms(r["p"], F.get(shares, r["w"])) - F.get(shares, r["w"])).alias("t"), (s["p"] + r["p"]).alias("p")))
        by_word = F.transform(F.array(met), lambda m: _root(m["t"] + known + _terms(F.greatest(1 - m["p"], F.lit(0.0)), F.lit(max(0.0, 1 - known)))))
        per_language.append(F.struct(by_class.alias("c"), F.get(by_word, F.lit(0)).alias("w"), F.lit(name).alias("name")))
    judged = rows.withColumn("_by", F.when(F.col("n_words") > 0, F.array(*per_language)))
    fits = F.exists("_by", lambda d: (d["c"] <= rules.class_limit) & (d["w"] <= rules.word_limit))
    nearest = F.get(F.sort_array("_by"), F.lit(0))
    return judged.select(
        *base, (~F.col("base_failed") & ((F.col("n_words") < rules.min_words) | F.coalesce(fits, F.lit(False)))).alias("kept"),
        nearest["c"].alias("class_distance"), nearest["w"].alias("word_distance"), nearest["name"].alias("nearest"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


QUERIES: dict[str, Query] = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
