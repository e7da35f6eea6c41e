"""URL verdicts by a bit-parallel wildcard automaton.

All glob rules are packed one after another into a few 64-bit words per URL. Each step reads one character of every URL
in a batch: states shift on, a character mask keeps those that read it, and states that stand for ``*`` stay. So all
patterns run at once, and the work is the length of the URLs times the number of words, whatever the rules are.

Canonical form: a dot, the lower-cased host, a separator byte that no UTF-8 text holds, the path. The dot lets a domain
pattern fit its subdomains. In a glob a line feed stands for the separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_lower, table
from tidegauge.plans.registry import Query


SEPARATOR = 0xFF


@dataclass(frozen=True)
class Rule:
    """A pattern over canonical URLs (``*`` any run, ``?`` one byte), its verdict, and the name it goes by."""

    glob: str
    verdict: str
    name: str | None = None


def domain_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, where the path begins with the rule's."""
    host, slash, path = rule.partition("/")
    return Rule(f"*.{host}\n{slash}{path}*", verdict, rule)


RULES = (domain_rule("net/", "block"), domain_rule("example.net/en/", "allow"), domain_rule("example.com/de/", "block"), domain_rule("org/fr/", "allow"))
#: What decides where no rule fits: blocked if any of these globs fits.
GLOBS = tuple(Rule(g, "block") for g in ("*casino*\n*", "*pills*\n*", "*.free-*\n*", "*.ads-*\n*", "*spam*\n*", "*.*bets.*\n*", "*\n/*/ads/*", "*\n*.exe"))


class Automaton:
    """Shift-And masks of all rules over multiword states."""

    def __init__(self, rules: tuple[Rule, ...]):
        starts, ends, loops, reads = [], [], [], []
        for rule in rules:
            starts.append(len(reads))
            reads.append(None)  # a state before any character; it reads none
            loops.append(False)
            for c in rule.glob.encode():
                if c == ord("*"):
                    loops[-1] = True
                else:
                    reads.append(SEPARATOR if c == ord("\n") else c)
                    loops.append(False)
            ends.append(len(reads) - 1)
        self.words = -(-max(1, len(reads)) // 64)
        self.start, self.loop = self._mask(starts), self._mask([k for k, x in enumerate(loops) if x])
        self.ends = np.array(ends, dtype=np.int64)
        self.masks = np.zeros((256, self.words), dtype=np.uint64)
        for c in range(256):
            self.masks[c] = self._mask([k for k, x in enumerate(reads) if x == c or x == ord("?")])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """For each text and rule whether the rule fits the whole text. Texts of like length run together."""
        fits = np.zeros((len(texts), len(self.ends)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        for begin in range(0, len(order), 4096):
            some = order[begin : begin + 4096]
            sizes = np.array([len(texts[k]) for k in some])
            flat = np.frombuffer(b"".join(texts[k] for k in some), dtype=np.uint8)
            offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            state = np.repeat(self.start[None, :], len(some), axis=0)
            for j in range(int(sizes[-1])):
                live = int(np.searchsorted(sizes, j, side="right"))  # from here on texts are longer than j
                old = state[live:]
                moved = old << np.uint64(1)
                moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
                state[live:] = moved & self.masks[flat[offset[live:] + j]] | old & self.loop
            last = state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64) & np.uint64(1)
            fits[some] = last.astype(bool)
        return fits


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge(rules: tuple[Rule, ...], globs: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules + globs)
        length = np.array([len(r.name or "") for r in rules] or [0])
        by_length = np.argsort(-length, kind="stable")
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                names = part.schema.names
                hosts, paths = part.column(names.index("host")).to_pylist(), part.column(names.index("path")).to_pylist()
                fits = automaton.matches([b"." + h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in zip(hosts, paths)])
                rule, verdict, glob = [], [], []
                for row in fits:
                    own = next((k for k in by_length if k < len(rules) and row[k]), None)
                    hit = next((g.glob for g, x in zip(globs, row[len(rules) :]) if x), None)
                    rule.append(None if own is None else rules[own].name)
                    verdict.append(rules[own].verdict if own is not None else "block" if hit else "allow")
                    glob.append(hit)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())], names=[*names, "rule", "verdict", "pattern"])

    return run


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = GLOBS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge each row of ``pages``: page_id, host, path, rule, verdict, pattern.

    The longest rule that fits decides, of equal ones the first. Where none fits, any matching glob blocks, and
    ``pattern`` names the first. A null url, or one without ``://``, has an empty host and path. Rows are judged one by one, so
    repeated ones get the same; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return rows.mapInArrow(_judge(rules, globs), "page_id long, host string, path string, rule string, verdict string, pattern string")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    def like(glob: str) -> str:
        return "'" + glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_").replace("\n", "' || chr(10) || '") + "'"

    globs = "\n    ".join(f"WHEN canon LIKE {like(g.glob)} ESCAPE '\\' THEN '{g.glob}'".replace(f"THEN '{g.glob}'", "THEN '" + g.glob.replace("\n", "' || chr(10) || '") + "'") for g in GLOBS)
    ranked = sorted(RULES, key=lambda r: -len(r.name))
    hosts = {r.name: r.name.split("/", 1) for r in ranked}
    fits = {n: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')" for n, (h, p) in hosts.items()}
    cases = " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in ranked)
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in ranked)
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT page_id, host, path, '.' || host || chr(10) || path AS canon, CASE {cases} END AS rule FROM u),
g AS (SELECT *, CASE {globs} END AS pattern FROM r)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM g
"""


QUERIES: dict[str, Query] = {"op3_url_filters": op3_url_filters}
ORACLES: dict[str, str] = {"op3_url_filters": _sql()}
