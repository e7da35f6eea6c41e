"""The text operators against brute force on small rows, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, quality, secrets, suffix_tree, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, rank string, _kept string"
SYLLABLES = "an er th in on re ed nd ha at en es of or nt ti to ea is st".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.choice([1, 2, 2, 3]))) for _ in range(n))


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "x", None) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(8)]
    rows = [(k, t, "en", "a") for k, t in enumerate(base)]
    rows.append((20, base[0], "en", "a"))
    words = base[1].split()
    words[30] = "changed"
    rows.append((21, " ".join(words), "en", None))
    words[50] = "again"
    rows.append((22, " ".join(words), "de", "b"))
    rows += [(30, None, None, None), (31, "", "en", "b"), (32, " \n\t ", "en", "b"), (33, "two words", "en", "b"), (34, "Two  WORDS", "en", "b"), (35, prose(rng, 9000), "en", "b")]
    rows += [(36, "fünf kleine Wörter hier", "de", "b"), (1, base[1], "en", "a"), (None, base[2], "en", "a"), (None, None, None, None)]
    return rows


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


# -- n-gram join


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    return [(i, len(s), i if not s else min((j for j in groups[find(k)] if j is not None), default=None)) for k, (i, s) in enumerate(sets)]


def test_groups_equal_brute_force(spark, corpus):
    got = sorted(map(repr, map(tuple, ngram_join.similar_groups(docs_of(spark, corpus)).collect())))
    assert got == sorted(map(repr, brute_groups(corpus)))


def test_chains_of_near_copies_are_followed_to_the_end(spark):
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = []
    for k in range(24):
        rows.append((100 - k, " ".join(base), "en", "a"))
        base = list(base)
        base[rng.randrange(80)] = f"w{k}"
    assert sorted(map(tuple, ngram_join.similar_groups(docs_of(spark, rows)).collect())) == sorted(brute_groups(rows))


def test_one_document_of_each_group_stays(spark, corpus):
    docs = docs_of(spark, corpus)
    kept = ngram_join.keep_one_per_group(spark, docs, "")
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 20 not in ids and 21 not in ids and ids[1] == 2 and ids[None] == 2 and ids[30] == 1 and 34 not in ids


# -- lines


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    stock = [prose(rng, 8) for _ in range(6)]
    stock += [stock[0][:9] + "#" + stock[0][10:], stock[1] + "x", stock[2][1:], stock[3].upper(), stock[0][:12] + "%" + stock[0][13:]]
    rows = [(k, "\n".join(rng.choices([*stock, "short", "", "  "], k=12)), "en", "a") for k in range(12)]
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, prose(rng, 5000), "en", "a"), (None, stock[0], "en", "a"), (3, rows[3][1], "en", "a")]
    seen, dropped = {}, {}
    lines = sorted({(i, p, line.strip(" \t\r").lower()) for i, t, *_ in rows if t is not None and i is not None for p, line in enumerate(t.split("\n"))})
    first = {}
    for i, p, n in lines:
        if len(n) >= 20:
            first.setdefault(n, (i, p))
    near = {n for n in first if any(first[o] < first[n] and edit_at_most_one(n, o) for o in first if o != n)}
    for i, p, n in lines:
        dropped[i, p] = len(n) >= 20 and (n in near or first[n] != (i, p))
    want = {}
    for i, t, *_ in rows:
        left = t if t is None or i is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not dropped[i, p])
        want.setdefault(i, []).append((left, 0 if t is None else t.count("\n") + 1))
    got = by_id(line_dedup.dedup_lines(docs_of(spark, rows)), "text", "n_lines")
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    staged = line_dedup.stage_dedup_lines(spark, docs_of(spark, rows), "")
    assert staged.columns == docs_of(spark, rows[:1]).columns
    assert all(r.n_chars == len(r.text) for r in staged.collect() if r.text is not None)


# -- benchmark


def test_leaks_are_found_and_clean_texts_left(spark, corpus):
    rng = random.Random(21)
    items = [prose(rng, n) for n in (15, 25, 40, 60)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(9, None), (10, " ")], "item_id long, text string")
    changed = items[3].split()
    for k in range(0, 48, 8):
        changed[k] = "altered"
    rows = [*corpus, (60, prose(rng, 200) + " " + items[0] + " " + prose(rng, 200), "en", "a"), (61, items[1].upper(), "en", "a"),
            (62, prose(rng, 90) + " " + " ".join(changed), "en", "a"), (63, prose(rng, 3000) + " " + items[2] + ".", "en", "a")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(60, 0), (61, 1), (62, 3), (63, 2)}
    blocks = decontaminate.find_leaks(docs_of(spark, rows), bench, replace(decontaminate.Leaks(), block_items=2))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    assert decontaminate.find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs_of(spark, []), bench).count() == 0


def test_latent_space_counts_the_passages_of_all_documents(spark):
    rng = random.Random(5)
    vocabulary = {w.encode(): k for k, w in enumerate("abcdefg")}
    rows = [(i, " ".join(rng.choice("abcdefgxyz") for _ in range(rng.randrange(60)))) for i in range(1500)] + [(2000, None)]
    want = Counter()
    for _, text in rows:
        words = (text or "").split()
        for start in range(0, len(words), 16):
            seen = Counter(vocabulary[w.encode()] for w in words[start:start + 16] if w.encode() in vocabulary)
            want.update({(a, b): seen[a] * seen[b] for a in seen for b in seen if a <= b})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.sparkContext.broadcast(vocabulary)
    got = docs.mapInArrow(decontaminate._corpus_counts(known, decontaminate.Leaks()), decontaminate.COUNTS).groupBy("first", "second").sum("n").collect()
    assert {(a, b): n for a, b, n in got if b >= 0} == want
    assert {a: n for a, b, n in got if b < 0} == {len(vocabulary): 1501} | {k: sum(w.decode() in (t or "") for _, t in rows) for w, k in vocabulary.items()}


def test_common_subsequence_equals_the_table_of_prefixes():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 20))], [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


# -- toxicity


def test_toxic_documents_and_sentences_are_found(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(240):
        parts = [prose(rng, 12) + "." for _ in range(5)]
        if k % 4 == 0:
            parts[k % 5] = prose(rng, 5) + " " + rng.choice(["vile", "nasty"]) + " " + prose(rng, 4) + "."
        rows.append((k, " ".join(parts), "en", "a"))
        marks.append((k, k % 4 == 0))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, prose(rng, 4000), "en", "a"), (None, "nasty", "en", "a"), (0, rows[0][1], "en", "a")]
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in marks if i % 3] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    options = replace(toxicity.Toxicity(), least_docs=3, rate=0.1, batch=10)  # small batches, for enough steps on few documents
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, labels, options)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model, options).collect()}
    test = [k for k in range(240) if k % 3 == 0]
    assert np.mean([(got[k].score >= 0.5) == (k % 4 == 0) for k in test]) > 0.95
    found = [got[k].worst_sentence == k % 5 for k in test if k % 4 == 0]
    assert np.mean(found) > 0.9
    assert got[900].score == got[901].score == 0.0 and 0 <= got[902].score <= 1
    nothing = toxicity.train(docs, labels.limit(0), options)
    assert toxicity.score_documents(docs, nothing, options).where("score is null or score > 1").count() == 0


# -- quality


def test_base_counts_equal_brute_force(spark, corpus):
    rows = [*corpus, (70, "a b c a b c a b c d\nx y\nx y\n\n \nx y", "en", "a"), (71, "a b c\x85d e a\tb\rc", "en", "a"), (72, "# $ % & * | < > #a " * 30, "en", "a")]
    got = by_id(quality.judge(docs_of(spark, rows), replace(quality.Quality(), min_language_docs=2)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k, z in enumerate(zip(w, w[1:], w[2:])) if seen[z] > 1 for d in range(3)}
        filled = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(filled) - len(set(filled)), len(cover), len(w) < 50 or 2 * len(cover) > len(w))
        assert want in got[i], (i, want, got[i])


def test_no_pattern_runs_twice_over_a_text(spark):
    counts = quality._class_counts(F.col("t"))
    assert str(counts).lower().count("regexp_count(") == len(quality.CLASSES) - 1
    assert spark.createDataFrame([("a B#",)], "t string").select(counts.alias("c")).first().c == [1, 1, 0, 1, 0, 1, 0]


def test_slots_hold_one_word_as_a_rule(spark):
    words = sorted("w%d" % k for k in range(150))
    salt, mask, levels = quality._word_index(spark, words)
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "w string, k int")
    slot = F.xxhash64("w", salt).bitwiseAND(mask).cast("int")
    assert len(levels) == 1 and rows.where(F.get(levels[0], slot) != F.col("k")).count() == 0
    assert len(quality._word_index(spark, [])[2]) == 1


def test_texts_far_from_every_language_go(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 120), "en", "a") for k in range(40)] + [(90, " ".join(w + "%%%" for w in prose(rng, 120).split()), "en", "a"), (91, prose(rng, 130), None, "a")]
    kept = by_id(quality.judge(docs_of(spark, rows)), "kept")
    assert kept[90] == [False] and kept[91] == [True] and all(kept[k] == [True] for k in range(40))
    assert quality.judge(docs_of(spark, [])).count() == 0


# -- URLs


def test_automaton_equals_globs_one_by_one():
    rng = random.Random(9)
    pieces = ["a", "b", "/", "*", "?", "ab", "."]
    rules = tuple(url_filter.Rule("".join(rng.choices(pieces, k=rng.randrange(1, 9))), "block") for _ in range(60))
    texts = ["".join(rng.choices("ab/.", k=rng.randrange(0, 14))).encode() for _ in range(300)] + [b"ab" * 400]
    fits = url_filter.Automaton(rules).matches(texts)
    for k, rule in enumerate(rules):
        pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in rule.glob), re.S)
        assert [bool(pattern.fullmatch(t.decode())) for t in texts] == fits[:, k].tolist(), rule


def test_urls_are_judged_by_the_longest_rule(spark):
    urls = ["http://EXAMPLE.net/en/1", "http://a.example.net/de/", "http://example.com/de/x?y#z", "https://x.org/fr/", "http://net", "http://net/", "http://notnet/",
            "http://casino.example.org/", None, "no scheme", "http://x.org/FR/", "http://a/b.net\n/c", "", "http://x.example.com:80/de/", "http://x.org/fr/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    verdicts = [(got[k].rule, got[k].verdict) for k in range(len(urls))]
    assert verdicts == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), ("net/", "block"), (None, "allow"),
                        (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow")]
    assert (got[0].host, got[0].path, got[8].host, got[2].path) == ("example.net", "/en/1", "", "/de/x")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# -- language model


def test_scores_equal_brute_force(spark, corpus):
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    tree = suffix_tree.Tree(frequency=1e-3, entry=1e-3, gain=1.0, frequent=5e-3)
    got = suffix_tree.score_texts(docs_of(spark, corpus), train, tree).collect()
    lowered = [(i, (t or "").encode().lower().split()) for i, t, *_ in corpus]
    counts = Counter(w for i, ws in lowered if i is not None and i % 3 for w in [*ws, b"\n"])
    n, v = sum(counts.values()), len(counts)
    base = {}
    for i, ws in lowered:
        base.setdefault(i, []).append((len(ws) + 1, sum(w in counts for w in [*ws, b"\n"]), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, b"\n"])))
    assert len(got) == len(corpus)
    for r in got:
        assert r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == (a, b) and abs(r.base_score - c) < 1e-6 * max(1, -c) for a, b, c in base[r.doc_id]), r
        assert r.score < 0


def brute_tree(tree, train):
    """{context: counts} of the kept contexts, and the probability of a token after the tokens before it."""
    tokens = [["<", *words, ">"] for words in train]
    single = Counter(w for ts in tokens for w in ts[1:])
    n, v = sum(single.values()), len(single)
    least = lambda share: max(tree.least, share * n)
    listed = {w for w, c in single.items() if c >= least(tree.frequent) and w != ">"}
    shown = lambda w: w if w in listed or w == ">" else None
    counts = {(): Counter(shown(w) for ts in tokens for w in ts[1:])}
    levels = [{(): counts[()]}]
    for k in range(1, tree.depth + 1):
        found = {}
        for ts in tokens:
            for i in range(k, len(ts)):
                context = tuple(ts[i - k:i])
                if all(c in listed or c == "<" for c in context) and (k == 1 or context[1:] in levels[-1]):
                    found.setdefault(context, Counter())[shown(ts[i])] += 1
        levels.append({c: x for c, x in found.items() if sum(x.values()) >= least(tree.frequency)})
        counts |= levels[-1]

    def gain(c):
        own, up = counts[c], counts[c[1:]]
        a, b = sum(own.values()), sum(up.values())
        return sum(x * math.log((x / a) / (up[w] / b)) for w, x in own.items())

    kept = {c for c in counts if c and gain(c) >= tree.gain}
    kept = {c for c in counts if c and any(d[len(d) - len(c):] == c for d in kept)}

    def probability(before, w):
        p = (single[w] + 0.1) / (n + 0.1 * (v + 1))
        for k in range(1, tree.depth + 1):
            c = tuple(before[-k:])
            if len(before) < k or c not in kept:
                break
            own = counts[c]
            stored = {x: m for x, m in own.items() if x is not None and m >= least(tree.entry)}
            types, total = sum(m if x is None else 1 for x, m in own.items()), sum(own.values())
            p = (stored.get(shown(w), 0) + (types + total - sum(stored.values())) * p) / (total + types)
        return p

    return kept, single, probability


def test_tree_scores_equal_brute_force_and_probabilities_add_up(spark):
    rng = random.Random(8)
    follow = {w: rng.choices(SYLLABLES, k=2) for w in SYLLABLES}

    def story(n):
        words = [rng.choice(SYLLABLES)]
        while len(words) < n:
            expected = follow.get(words[-1], SYLLABLES)
            words.append(rng.choice(expected) if rng.random() < 0.8 else rng.choice([*SYLLABLES, "Rare%d" % rng.randrange(400)]))
        return words

    rows = [(k, " ".join(story(rng.randrange(1, 60))), "en", "a") for k in range(150)]
    rows += [(200, None, "en", "a"), (201, " \n ", "en", "a"), (202, "unseen words", "en", "a"), (2, rows[2][1], "en", "a"), (None, rows[3][1], "en", "a"), (203, " ".join(story(5000)), "en", "a")]
    train = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 200)
    learned = [(t or "").lower().split() for i, t, *_ in rows if i is not None and i % 3 and i < 200]
    for tree in (suffix_tree.Tree(depth=3, frequency=1e-3, entry=1e-3, frequent=2e-3, gain=3.0), suffix_tree.Tree(depth=2, least=1, gain=-1.0)):
        kept, single, probability = brute_tree(tree, learned)
        assert {len(c) for c in kept} == set(range(1, tree.depth + 1))
        got = suffix_tree.score_texts(docs_of(spark, rows), train, tree).collect()
        want = {}
        for i, t, *_ in rows:
            ts = ["<", *(t or "").lower().split(), ">"]
            want.setdefault(i, []).append(sum(math.log10(probability(ts[:j], ts[j])) for j in range(1, len(ts))))
        assert len(got) == len(rows)
        for r in got:
            assert any(abs(r.score - x) < 1e-6 * max(1, -x) for x in want[r.doc_id]), (r, want[r.doc_id])
        for before in (["<"], ["<", "an"], ["<", "an", follow["an"][0], "er"], ["<", "rare1", "unseen"]):
            assert sum(probability(before, w) for w in single) + probability(before, "never seen") == pytest.approx(1)
        held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 0]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50


def test_rare_next_tokens_and_rare_words_count_for_their_states(spark):
    rng = random.Random(12)
    words = [w for _ in range(30) for w in rng.choices(SYLLABLES, k=200)]
    for k in range(0, len(words) - 40, 40):  # a word that is always followed by the same two, the second seen a few times in all
        words[k:k + 3] = ["lead", "follow", "Odd%d" % (k // 160)]
    rows = [(k, " ".join(words[k * 60:k * 60 + 60]), "en", "a") for k in range(100)] + [(2, " ".join(words[120:180]), "en", "a"), (200, None, "en", "a"), (201, "lead follow odd1 never lead odd1", "en", "a")]
    train = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 200)
    learned = [["<", *(t or "").lower().split(), ">"] for i, t, *_ in rows if i % 3 and i < 200]
    single = Counter(w for ts in learned for w in ts[1:])
    n, v = sum(single.values()), len(single)
    for tree in (suffix_tree.Tree(frequency=1e-3, frequent=8e-4, sent=4e-3, gain=1.0), suffix_tree.Tree(frequency=1e-3, frequent=8e-4, gain=1.0)):
        kept, *_ = brute_tree(tree, [ts[1:-1] for ts in learned])
        assert ("follow",) in kept and {len(c) for c in kept} == {1, 2, 3}
        after = {c: Counter(ts[j] for ts in learned for j in range(len(c), len(ts)) if tuple(ts[j - len(c):j]) == c) for c in kept}
        often = {w for w, c in single.items() if c >= tree.frequent * n}

        def probability(before, w):
            p = (single[w] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(1, tree.depth + 1):
                own = after.get(tuple(before[-k:]))
                if len(before) < k or own is None:
                    break
                types = sum(1 if x in often else m for x, m in own.items())
                p = (own[w] + types * p) / (sum(own.values()) + types)
            return p

        want = {}
        for i, t, *_ in rows:
            ts = ["<", *(t or "").lower().split(), ">"]
            want[i] = sum(math.log10(probability(ts[:j], ts[j])) for j in range(1, len(ts)))
        got = suffix_tree.score_texts(docs_of(spark, rows), train, tree).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.score == pytest.approx(want[r.doc_id], rel=1e-9), r
        assert probability(["<", "lead", "follow"], "odd1") > 10 * single["odd1"] / n


def test_groups_of_sorted_batches_are_not_split():
    import pyarrow as pa

    names = ["a", "a", "b", "b", "b", "b", "b", "c", "d", "d"]
    for cuts in ([0, 1, 2, 10], [0, 4, 5, 6, 7, 8, 10], [0, 2, 2, 7, 10], [0, 10]):
        batches = [pa.RecordBatch.from_arrays([pa.array(names[a:b], pa.string())], names=["met"]) for a, b in zip(cuts, cuts[1:])]
        out = [b.column(0).to_pylist() for b in suffix_tree._whole_groups(iter(batches))]
        assert sum(out, []) == names and all(x[-1] != y[0] for x, y in zip(out, out[1:]))


def test_sketch_of_a_task_is_small_and_counts_every_gram():
    import pyarrow as pa

    rng = random.Random(15)
    texts = [prose(rng, 120) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    rows = [r for out in ngram_join._sets_and_sketch(5)(iter([batch])) for r in out.to_pylist()]
    blobs = [r["cells"] for r in rows if r["block"] is not None]
    assert sum(int(ngram_join._unpacked(b).sum()) for b in blobs) == sum(r["n_shingles"] or 0 for r in rows)
    assert ngram_join.CELLS >= 1 << 22 and sum(map(len, blobs)) < 1 << 20


def test_nothing_to_learn_from(spark, corpus):
    out = suffix_tree.score_texts(docs_of(spark, corpus), F.lit(False))
    assert out.count() == len(corpus) and out.where("train_tokens <> 0 or n_known <> 0").count() == 0
    assert suffix_tree.score_texts(docs_of(spark, []), F.lit(True)).count() == 0


# -- secrets


def brute_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_pattern_spans_equal_brute_force_and_random_strings_are_found(spark, corpus):
    rng = random.Random(12)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = ["é𝄞 token = \"abcdefgh1\" x", "token: short", "secret=api_key: abcdefghij", "AKIAAAAABBBBCCCCDD AKIA12", "f" * 31 + " " + "0a" * 20, "Password='0123456789abcdef0123456789abcdef'",
             f"deploy {key} now", "token=a token=bbbbbbbbb", "passwd\" : x.y/z+9=-_ end"]
    rows = [*corpus, *[(100 + k, t, "en", "a") for k, t in enumerate(texts)], (200, "token=abcdefgh " * 700, "en", "a")]
    names = ["".join(rng.choice(SYLLABLES).capitalize() for _ in range(6)) + rng.choice(["", "_2", "-v1"]) for _ in range(400)]
    samples = spark.createDataFrame([(n, False) for n in names] + [(None, True), ("unmarked", None)], "token string, random boolean")
    docs = docs_of(spark, rows)
    got = by_id(secrets.find_secrets(docs, ratios=secrets.train(docs, samples=samples)), "base", "all")
    for i, t, *_ in rows:
        assert brute_secrets(t or "") in [[tuple(s) for s in base] for base, _ in got[i]], i
    assert (7, 3, 47) in [tuple(s) for s in got[106][0][1]]
    assert all(base == every for i, t, *_ in corpus for base, every in got[i])
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0


# -- languages


def test_languages_and_spans(spark):
    rng = random.Random(14)
    greek = {a: b for a, b in zip("abdeghinorst", "αβδεγηινορστ")}
    other = ["ung", "lich", "keit", "ver", "sch", "ein"]
    rows = []
    for k in range(60):
        rows.append((3 * k, prose(rng, 40), "en", "a"))
        rows.append((3 * k + 1, " ".join("".join(rng.choices(other, k=2)) for _ in range(40)), "de", "a"))
        rows.append((3 * k + 2, "".join(greek.get(c, c) for c in prose(rng, 40)), "el", "a"))
    model = language_id.train(docs_of(spark, rows[:150]))
    mixed = rows[150][1] + " " + rows[151][1]
    test = [*rows[150:], (500, mixed, None, "a"), (501, None, "en", "a"), (502, "", "en", "a"), (503, "123 ... 4", "en", "a"), (504, rows[150][1] * 300, "en", "a"), (None, rows[151][1], None, "a")]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, test), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[150:])
    assert [s.lang for s in got[500].spans] == ["en", "de"] and abs(got[500].spans[0].last - 39) <= 1
    assert [got[k].lang_pred for k in (501, 502, 503)] == ["und"] * 3 and got[504].lang_pred == "en" and got[None].lang_pred == "de"
    empty = language_id.train(docs_of(spark, []))
    assert language_id.identify(docs_of(spark, test), empty).where("lang_pred <> 'und'").count() == 0


def test_paths_equal_plain_viterbi():
    rng = np.random.default_rng(1)
    scores = [rng.normal(size=(n, 3)) for n in (1, 7, 0, 30)]
    for got, s in zip(language_id.best_paths(scores, 1.5), scores):
        best = None
        if not len(s):
            assert not len(got)
            continue
        total = lambda path: sum(s[t, x] for t, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        value = {x: (s[0, x], [x]) for x in range(3)}
        for t in range(1, len(s)):
            value = {x: max(((v - 1.5 * (p[-1] != x) + s[t, x], p + [x]) for v, p in value.values()), key=lambda q: q[0]) for x in range(3)}
        best = max(v for v, _ in value.values())
        assert abs(total(got.tolist()) - best) < 1e-9


# -- mixing


def test_margins_are_met_and_draws_follow_probabilities(spark):
    rng = random.Random(15)
    rows = [(k, prose(rng, rng.choice([40, 200, 700])), rng.choice(["en", "en", "en", "de"]), rng.choice("aaab")) for k in range(1200)]
    rows += [(5000, None, None, None), (5001, "", "en", "a"), (None, "a b", "en", "a"), (7, rows[7][1], "en", "a")]
    goal = {"source": {"a": 0.5, "b": 0.5}}
    out = mixing.mix_sources(docs_of(spark, rows), replace(mixing.Mix(), targets=goal, rate=0.3, flatten=1.0, rounds=20)).toPandas()
    assert len(out) == len(rows) and out.probability.between(0, 1).all()
    weight = (out.tokens * out.probability).groupby(out.source).sum()
    assert abs(weight["a"] / weight.sum() - 0.5) < 0.02
    drawn = out[out.kept].groupby("source").tokens.sum()
    assert abs(drawn["a"] / drawn.sum() - 0.5) < 0.08
    assert out[out.doc_id == 5000].iloc[0].source == "unknown"
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    staged = mixing.stage_mix(spark, docs_of(spark, rows[:50]), "")
    assert staged.columns[:8] == docs_of(spark, rows[:1]).columns


def test_digest_of_no_span_is_that_of_the_empty_text(spark):
    row = spark.createDataFrame([(1,)], "a int").select(F.sha2(secrets._listed(secrets._none()), 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"").hexdigest()


def test_next_tokens_are_counted_for_states_only():
    import numpy as np
    import pyarrow as pa

    from tidegauge.llm import suffix_tree as T

    class Shared:
        value = (pa.array([b"a", b"b", b"c"], pa.large_binary()), [np.array([0, 1]), np.array([1])])  # span 5: "a", "b", and "b a"

    batch = pa.RecordBatch.from_arrays([pa.array(["b a c b a", "c a b"], pa.string())], names=["text"])
    rows = [tuple(r.values()) for out in T._count_next(Shared)(iter([batch])) for r in out.to_pylist()]
    assert sorted(rows) == [(0, 2, 1), (0, 4, 1)]  # "b a" before c and before the end


def test_sketches_of_neighbouring_tasks_are_added_first(spark):
    rng = random.Random(16)
    docs = docs_of(spark, [(k, prose(rng, 80), "en", "a") for k in range(60)]).repartition(12)
    found = docs.select("doc_id", "text").mapInArrow(ngram_join._sets_and_sketch(5), ngram_join.SETS)
    sketch = found.where("block is not null").select("block", "part", "cells")
    assert sketch.select("part").distinct().count() == 1  # one row a block goes on, whatever the tasks hold
    counts, pivots, limit = ngram_join._order(sketch)
    total = found.agg(F.sum("n_shingles")).first()[0]
    assert counts.nbytes == 4 * ngram_join.CELLS and counts.sum() == total and limit == 1000 + 8 * total // ngram_join.CELLS
    # fragments hold equal shares of the order by count and number of a cell
    order = sorted((int(c), int(k)) for k, c in zip(counts.nonzero()[0], counts[counts > 0]))
    mass, want = 0, []
    for c, k in order:
        mass += c
        while len(want) < ngram_join.FRAGMENTS - 1 and mass * ngram_join.FRAGMENTS >= (len(want) + 1) * total:
            want.append(c * ngram_join.CELLS + k)
    assert pivots.tolist() == want


def test_rare_next_tokens_travel_in_one_row_for_each_bucket(spark):
    rng = random.Random(17)
    rows = [(k, " ".join([*rng.choices(SYLLABLES, k=200), "Rare%d" % k]), "en", "a") for k in range(200)]
    docs = docs_of(spark, rows).select("doc_id", "text", F.lit(True).alias("train")).coalesce(1)
    words = docs.mapInArrow(suffix_tree._count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = sum(len(t.split()) + 1 for _, t, *_ in rows)
    totals = suffix_tree.Totals(tokens, words.count() + 1, len(rows))
    model = suffix_tree.grow_tree(docs, words, totals, suffix_tree.Tree(frequency=1e-3, frequent=8e-4, sent=2e-2, gain=-1.0))
    shared = spark.sparkContext.broadcast(model)
    met = docs.mapInArrow(suffix_tree._text_words(shared, totals), suffix_tree.MET).collect()
    inner = [r for r in met if r.kind != suffix_tree.OWN]
    sent = sum(r.n for r in inner)
    assert sent > 30_000 and sum(r.kind == suffix_tree.OWN for r in met) == 1
    assert len(inner) == len({(r.load, r.bucket, r.kind) for r in inner}) <= 2 * suffix_tree._buckets(tokens, len(model.listed) + 2)
    assert sum(len(r.cells) + len(r.words or b"") for r in inner) < 8 * sent
    assert {r.n for r in met if r.kind == suffix_tree.OWN} == {len(rows)}


def test_a_load_may_hold_a_single_text(spark):
    rng = random.Random(18)
    rows = [(k, " ".join([*rng.choices(SYLLABLES, k=200), "Rare%d" % (k // 2)]), "en", "a") for k in range(8)]
    tree = suffix_tree.Tree(depth=2, frequency=1e-3, frequent=8e-4, sent=2e-2, gain=-1.0)
    together, alone = (
        {r.doc_id: r for r in suffix_tree.score_texts(docs_of(spark, rows).repartition(n), F.lit(True), tree).collect()} for n in (1, 24))
    assert len(together) == len(alone) == len(rows)
    for k, r in alone.items():
        want = together[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want.n_tokens, want.n_known, want.train_tokens)
        assert abs(r.base_score - want.base_score) < 1e-9 * -want.base_score and abs(r.score - want.score) < 1e-9 * -want.score
