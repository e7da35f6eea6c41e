"""Collocations, periodic runs and WARC archives against brute force, round trips and odd inputs."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import collocations, runs, warc

ODD = "doc_id long, text string, lang string, phrase string, words long, n long, runs string, size string"


def rows_of(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, lang, "x", 7, 8, "y", None) for i, t, lang in rows], ODD)


# -- collocations


def gram_counts(rows, longest):
    words, grams = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                grams.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    return words, grams


def brute_collocations(rows, least, longest, covered):
    words, f = gram_counts(rows, longest)
    candidates = {g for g in f if len(g) > 2 and f[g] >= least}

    def inside(g, h):
        return g[0] == h[0] and any(h[i:i + len(g) - 1] == g[1:] for i in range(1, len(h) - len(g) + 2))

    out = {}
    for g in candidates:
        if any(len(h) > len(g) and inside(g, h) and 100 * f[h] >= covered * f[g] for h in candidates):
            continue
        cuts = [(2_000_000 * f[g] // (f[g[:k + 1]] + f[(g[0], *g[k + 1:])]), k, f[g[:k + 1]], f[(g[0], *g[k + 1:])]) for k in range(1, len(g) - 1)]
        score, k, left, right = min(cuts)
        out[g[0], " ".join(g[1:])] = (len(g) - 1, f[g], k, left, right, words[g[0]], score)
    return out


def chatter(rng, n):
    vocabulary = "of the a it in red blue house cat dog New York".split()
    out = []
    for _ in range(n):
        out.append(rng.choice(["new york city hall", "hot dog", *vocabulary, *vocabulary]) + rng.choice(["", "", "", "", ".", ",\n", "!\t"]))
    return " ".join(out)


@pytest.mark.parametrize("most_bits", [1 << 28, 64])
def test_collocations_equal_brute_force_however_full_the_filter_is(spark, most_bits):
    rng = random.Random(3)
    rows = [(k, chatter(rng, rng.randrange(1, 200)), rng.choice(["en", "de", None])) for k in range(40)]
    rows += [(50, None, "en"), (51, "", None), (52, " \t . \n", "en"), (53, "ü ß ü ß ü ß ü ß", "de"), (1, rows[1][1], rows[1][2]), (None, "new york city hall", "en")]
    rows.append((60, chatter(rng, 6000), "long"))  # one text of many parts
    got = collocations.collocations(rows_of(spark, rows), least=3, covered=80, most_bits=most_bits, part_bytes=500)
    assert got.columns == ["lang", "phrase", "size", "a", "k", "l", "r", "n", "score"]
    found = {(r.lang, r.phrase): tuple(r[2:]) for r in got.collect()}
    assert found == brute_collocations(rows, 3, 4, 80)
    assert ("en", "new york city hall") in found and ("en", "york city") not in found


def test_phrase_counts_are_exact(spark):
    rows = [(1, "a b a b a. A b", "en"), (2, "a b", "en")]
    got = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(rows_of(spark, rows), least=1).collect()}
    words, grams = gram_counts(rows, 4)
    assert got == {("en", ""): words["en"]} | {(g[0], " ".join(g[1:])): n for g, n in grams.items()}


def test_best_phrases_break_ties_by_bytes_and_number_from_one(spark):
    rows = [("en", "é b", 5, 9), ("en", "z b", 5, 9), ("en", "a", 4, 9), ("en", "low", 9, 1), ("de", "x", 1, 1)]
    scored = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(r.lang, r["rank"], r.phrase) for r in collocations.best_per_language(scored, 3).orderBy("lang", "rank").collect()]
    assert got == [("de", 1, "x"), ("en", 1, "z b"), ("en", 2, "é b"), ("en", 3, "a")]


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 10 ** 17 + 3
    rows = [(big, 3 * big, 7)]
    cut = F.struct(F.col("a").cast("decimal(20,0)").alias("a"), F.col("l").cast("decimal(20,0)").alias("l"), F.col("r").cast("decimal(20,0)").alias("r"))
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._quotient(cut).alias("q")).first().q
    assert got == 2_000_000 * big // (3 * big + 7)


def test_no_documents_have_no_collocations(spark):
    assert collocations.collocations(rows_of(spark, [])).count() == 0


# -- periodic runs


def brute_runs(words, least):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, 2 * p):
                found.setdefault((start, length), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8, 50])) for _ in range(rng.choice([0, 1, 5, 20, 60, 150]))]
    if len(words) > 20 and rng.random() < 0.6:
        words = runs.repeated_from(words, rng.randrange(len(words)), rng.randint(1, len(words) // 3))
    return words * rng.choice([1, 1, 2])


def test_runs_of_batches_equal_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        for least in (2, 12):
            assert [t.runs for t in runs.text_runs(texts, least)] == [brute_runs(w, least) for w in texts]


def test_common_extensions_equal_a_plain_comparison():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 6, 7, 8, 40, 300):
        words = rng.integers(0, 2, n)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        if not pairs:
            continue
        a, b = np.array(pairs).T
        plain = [next((k for k in range(n - y) if words[x + k] != words[y + k]), n - y) for x, y in pairs]
        assert runs.Extensions(words, 2).lce(a, b).tolist() == plain


def expected_runs(doc_id, text, planted):
    words = (text or "").encode().split()
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words, 12)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()), kept.decode()


def test_periodic_runs_of_documents(spark):
    rng = random.Random(2)
    rows = [(k, b" ".join(some_words(rng)).decode(), None) for k in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, " \n\x0b ", "en"), (103, "ha " * 5000, "en"), (None, "no id " * 9, "en"), (104, "x y z " * 4 + " x", "en"), (3, rows[3][1], "en")]
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for planted in (False, True):
        got = runs.periodic_runs(rows_of(spark, rows), planted=planted)
        found = sorted(((r.doc_id is None, r.doc_id or 0, *[r[c] for c in columns], r.collapsed) for r in got.collect()), key=str)
        want = [(i is None, i or 0, *expected_runs(i, t, planted)[0], expected_runs(i, t, planted)[1]) for i, t, _ in rows]
        assert found == sorted(want, key=str)
    assert runs.periodic_runs(rows_of(spark, [])).count() == 0


# -- WARC


PAGES = "page_id long, url string, html string, payload string, first long, warc_type string, _check long"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2) for i, u, h in rows], PAGES)


def some_pages():
    rows = [(k, f"http://h{k}.example/p?q={k}", f"<html>page {k} é\r\n\r\nWARC/1.1\r\n</html>") for k in range(30)]
    rows += [(40, "http://a.example/", rows[3][2]), (2000, None, rows[3][2]), (41, "http://evil.example/\r\nWARC-Type: warcinfo\r\n", "x"), (42, "u", None),
             (43, "u", ""), (44, "http://é.example/ a", "z" * 300_000), (None, "n", rows[3][2]), (None, "n", "only without id"), (45, "r", "twice"), (45, "r", "twice")]
    return rows


def brute_pages(rows, least=0):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(same) if same and len(payload) >= least else None
        repeat = first is not None and first != i
        out.append((i, len(payload), warc.sha1_base32(payload), "revisit" if repeat else "response", first if repeat else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_pages_come_back_from_their_archives(spark, tmp_path, least):
    rows = some_pages()
    warc.write_pages(pages_of(spark, rows).repartition(3), f"file://{tmp_path}/w", least)
    got = [tuple(r) for r in warc.read_pages(spark, f"file://{tmp_path}/w").collect()]
    assert sorted(got, key=str) == brute_pages(rows, least)


def test_payloads_come_back_whole_and_filters_reach_the_reader(spark, tmp_path):
    rows = some_pages()
    warc.write_pages(pages_of(spark, rows), str(tmp_path / "w"), splitBytes=200)
    found = spark.read.format("warc").option("splitBytes", 200).load(str(tmp_path / "w"))
    assert found.rdd.getNumPartitions() > 10
    payloads = {r.record_id: bytes(r.payload) for r in found.where("warc_type = 'response'").collect()}
    assert payloads["urn:page:7"] == rows[7][2].encode() and payloads["urn:page:44"] == b"z" * 300_000
    assert found.where("warc_type = 'warcinfo'").count() >= 1 and found.where("warc_type = 'none'").count() == 0
    one = found.where("warc_type in ('response', 'revisit') and target_uri like 'http://h5.%' and content_length > 10")
    assert [r.record_id for r in one.collect()] == ["urn:page:5"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "content_length" in plan.split("BatchScan")[0]  # stays with Spark
    assert "StartsWith" not in plan.split("BatchScan")[0] and "warc_type" not in plan.split("BatchScan")[0].split("Filter")[-1]
    revisit = found.where("warc_type = 'revisit' and record_id = 'urn:page:40'").first()
    assert revisit.refers_to == "urn:page:3" and revisit.payload_length == len(rows[3][2].encode()) and revisit.headers["WARC-Profile"] == warc.REVISIT


def test_unwanted_payloads_are_stepped_over(tmp_path):
    body = b"x" * 1_000_000
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(warc.record("resource", {"WARC-Record-ID": f"<urn:r:{k}>"}, body, "text/plain") for k in range(5)))
    from pyspark.sql.types import _parse_datatype_string

    reader = warc.WarcReader(str(path), _parse_datatype_string("record_id string, content_length long"), 1 << 20)
    reads = []
    original = warc._Block.read
    warc._Block.read = lambda self, most: reads.append(most) or original(self, most)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc._Block.read = original
    assert [r["record_id"] for r in rows] == [f"urn:r:{k}" for k in range(5)] and rows[0]["content_length"] == 1_000_000 and not reads


def test_foreign_archives_plain_and_gzipped(spark, tmp_path):
    records = [warc.record("response", {"WARC-Record-ID": f"<urn:r:{k}>", "WARC-Target-URI": f"http://x/{k}"},
                           warc.http_head(3) + b"%03d" % k, "application/http; msgtype=response") for k in range(50)]
    records.append(b"WARC/1.0\r\nwarc-type: metadata\r\nX-Folded: a\r\n b\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    warc.register(spark)
    for path in (tmp_path / "plain.warc", tmp_path / "packed.warc.gz"):
        found = spark.read.format("warc").load(str(path))
        assert sorted(bytes(r.payload).decode() for r in found.where("warc_type = 'response'").collect()) == [f"{k:03d}" for k in range(50)]
        assert [r.record_id for r in found.where("target_uri = 'http://x/7'").select("record_id").collect()] == ["urn:r:7"]
        assert found.where("warc_type = 'metadata'").first().headers["X-Folded"] == "a b"
    assert spark.read.format("warc").load(str(tmp_path)).where("record_id = 'urn:r:3'").count() == 2


def test_leftovers_of_lost_tasks_are_never_read(spark, tmp_path):
    warc.write_pages(pages_of(spark, some_pages()[:5]), str(tmp_path / "w"))
    (tmp_path / "w" / "lost.warc").write_bytes(warc.record("response", {"WARC-Record-ID": "<urn:page:999>"}, b"half", "text/plain")[:-6])
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 5


def test_no_pages_make_an_empty_archive(spark, tmp_path):
    warc.write_pages(pages_of(spark, []), str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0
