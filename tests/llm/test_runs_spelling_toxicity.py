"""Operators 11 to 13 against plain versions: all segments, all pairs of words, all periods; the queries against plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs, queries, spelling, toxicity

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def all_runs(words, least):
    """Every period, every maximal stretch that keeps it, if no smaller period fits."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, own = j - i + q, words[i : j + q]
            if j > i and length >= max(least, 2 * q) and not any(own[p:] == own[: length - p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=45) | st.lists(st.sampled_from("abcd"), max_size=60), st.integers(0, 40), st.integers(1, 9), st.sampled_from([2, 3, 4, 7, 12]))
def test_runs_are_those_of_all_periods(words, a, p, least):
    words = [w.encode() if i < a else words[a + (i - a) % p].encode() for i, w in enumerate(words)] if a + p <= len(words) else [w.encode() for w in words]
    assert periodic_runs.runs_of(words, least) == all_runs(words, least)


def test_runs_of_long_and_of_fibonacci_texts():
    assert periodic_runs.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    x, y = [b"a"], [b"b"]
    while len(x) < 300:
        x, y = x + y, x
    assert periodic_runs.runs_of(x) == all_runs(x, 12)
    assert periodic_runs.collapsed([b"x"] + [b"a", b"b"] * 6 + [b"y"], [(1, 12, 2)]) == b"x a b y"


def plain_periodic(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = periodic_runs.runs_of([w.encode() for w in words])
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    top = min(((-k, s, q) for s, k, q in found), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_periodic_query(spark):
    got = queries.op13_periodic_runs(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(plain_periodic(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 50 and dict(queries.op13_periodic_runs(spark, SMALL).dtypes)["exponent_milli"] == "bigint"
    # runs of short real texts by all periods
    short = [r for r in docs if r.text and len(WORD.findall(r.text)) < 120][:60]
    for r in short:
        words = [w.encode() for w in WORD.findall(r.text)]
        assert periodic_runs.runs_of(words) == all_runs(words, 12)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        own = [v for v in words if one_edit(v, w)]
        best = min(own, key=lambda v: (-words[v], v)) if own else None
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(own), form[w], words[form[w]] if form[w] is not None else None]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


@pytest.mark.parametrize("block", [2048, 6, 1])
def test_variants_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 8))): int(rng.choice([2, 3, 5, 20, 50, 200, 600, 2000, 30000])) for _ in range(500)}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), block=block)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == plain_variants(words)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", max_size=7), min_size=1, max_size=40), st.text("abé", max_size=7), st.none() | st.integers(0, 5))
def test_position_index_finds_one_edit(words, query, within):
    words = sorted(words)
    found = spelling.PositionIndex(words).near(query, within)
    alike = lambda w: within is not None and len(query) >= within and w[:within] == query[:within]
    if query:
        assert {w for k, w in enumerate(words) if found >> k & 1} == {w for w in words if one_edit(w, query) and not alike(w)}


def test_variants_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "Abcdefgh ABCDEFGH Éabcdefg"), (3, "abcdefgh-abcdefgX " * 3), (3, "abcdefgh-abcdefgX " * 3), (4, "z" * 30_000 + " " + "z" * 30_000)], "doc_id long, text string")
    words = {r.word: r.n for r in spelling.count_words(rows).collect()}
    assert words == {"abcdefgh": 8, "abcdefgx": 6, "z" * 30_000: 2}
    got = {r.word: r for r in spelling.group_variants(spelling.count_words(rows.selectExpr("*", "1 AS word", "2 AS n"))).collect()}
    assert got["abcdefgh"].n_near == 1 and got["abcdefgh"].form is None and got["z" * 30_000].n_near == 0
    assert spelling.group_variants(spelling.count_words(rows.limit(0))).count() == 0
    tied = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaaac", 20), (None, 9)], "word string, n long")
    assert {r.word: r.form for r in spelling.group_variants(tied).collect()} == {"aaaaaaa": "aaaaaab", "aaaaaab": None, "aaaaaac": None}


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
def test_variants_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = queries.op12_spelling_variants(spark, TINY).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(words) and len(got) == len(words)


def best_segments(scores):
    """The best segment (the shortest of equal ones), then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return best_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in best_segments(scores[j:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([None, -2.3137, -1.1741, 0.5719, 1.1333, 3.7177, 2.9391]), max_size=22))
def test_segments_are_the_best_ones(scores):
    at = [i for i, s in enumerate(scores) if s is not None]
    got = toxicity.segments([scores[i] for i in at], at, 0.3107)
    full = [(s or 0) - 0.3107 for s in scores]
    assert [(a, b) for a, b, _ in got] == best_segments(full)
    assert all(math.isclose(s, sum(full[a:b]), abs_tol=1e-9) for a, b, s in got)


def test_extreme_value_law():
    rng = np.random.default_rng(5)
    scores, shares, drift = rng.uniform(-1, 1.5, 200), rng.dirichlet(np.ones(200)) * 0.4, 0.3
    rate = toxicity.extreme_value_rate(scores, shares, drift)
    values, p = np.append(scores, 0) - drift, np.append(shares, 1 - shares.sum())
    assert math.isclose(float((p * np.exp(rate * values)).sum()), 1, abs_tol=1e-6)
    n, best = 400, []
    for _ in range(1500):
        drawn = rng.choice(201, n, p=p / p.sum())
        at = np.flatnonzero(drawn < 200)
        best.append(max((s for _, _, s in toxicity.segments(scores[drawn[at]].tolist(), at.tolist(), drift)), default=0.0))
    best = np.array(best)
    scale = len(best) / (n * np.exp(-rate * best)).sum()
    for level in (0.2, 0.05):
        x = np.log(scale * n / -math.log(1 - level)) / rate
        assert abs((best > x).mean() - level) < 0.5 * level + 0.02


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_token_scores_are_those_of_a_plain_count(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic, clean = Counter(), Counter()
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    for r in docs.filter("text IS NOT NULL").collect():
        if label.get(r.doc_id) is not None:
            (toxic if label[r.doc_id] else clean).update({w for w in toxicity.tokens(r.text.encode()) if len(w) <= 64})
    a, b = sum(toxic.values()), sum(clean.values())
    share, want = (a + 0.5) / (a + b + 1), {}
    for w in toxic | clean:
        x, y = toxic[w] + 2.0 * share, clean[w] + 2.0 * (1 - share)
        odds = math.log(x / share) - math.log(y / (1 - share))
        size = abs(odds) - 2.5 * math.sqrt(1 / x + 1 / y)
        if size > 0:
            want[w] = math.copysign(size, odds)
    got = toxicity.train(docs, labels).scores
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_of_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op11_toxic_segments(spark, at).join(spark.read.parquet(f"{at}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").filter("held_out").toPandas()
    wrong = (got.predicted != got.toxic).mean()
    assert len(got) > 500 and wrong < 0.02 and got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.01


def test_passages_and_odd_rows(spark):
    calm, angry = "the river runs past the old mill " * 30, "you worthless stupid fool "
    rows = [(i, calm if i % 4 else calm + angry, None, None, 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    odd = [(None, None, None, None, None), (None, "", None, None, None), (1000, "  \n", None, None, None), (1001, angry + calm * 300, None, None, None), (1001, angry + calm * 300, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "'x' AS score", "'x' AS passages", "'x' AS toxic", "'x' AS n", "'x' AS term")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.toxic == "x" for r in got)
    found = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert all(bool(r.passages) == (r.doc_id % 4 == 0) == bool(r.predicted) for r in found)
    assert all([(p.start, p.length) for p in r.passages] == [(len(calm.split()), 4)] for r in found if r.passages)
    assert all((r.passages == []) and not r.predicted for r in got if r.doc_id in (None, 1000))
    assert all([(p.start, p.length) for p in r.passages] == [(0, 4)] for r in got if r.doc_id == 1001)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}


def test_runs_of_odd_rows(spark):
    loop = "over and " * 40_000
    rows = [(1, None), (2, ""), (None, "  \t\n"), (3, loop), (3, loop), (None, loop), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "'x' AS start", "'x' AS words", "'x' AS h")
    got = periodic_runs.find_runs(docs).collect()
    assert len(got) == 7 and sorted(len(r.runs) for r in got) == [0, 0, 0, 0, 1, 1, 1] and {r.collapsed for r in got} == {"", "over and", "a b c"}
    assert all(tuple(r.runs[0]) == (0, 80_000, 2) for r in got if r.runs)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    kept = {(r.doc_id, r.text) for r in queries.repeating(docs).collect()}
    assert (None, loop) in kept and (1, None) in kept and (2, "") in kept


def test_rare_toxic_tokens_rank_texts_without_passages(spark):
    """A token of two toxic texts is too rare for a passage, but held-out texts with it rank over plain ones."""
    words = [f"w{i}" for i in range(40)]
    kept = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    learnt, fresh = [i for i in range(400) if kept(i)], [i for i in range(400) if not kept(i)]
    common = lambda i: " ".join(words[(i * 7 + k * k) % 40] for k in range(30))
    toxic = set(learnt[:40]) | set(fresh[:30])
    rare = {i: f" rare{at // 2}" for at, i in enumerate(sorted(set(learnt[:40])))} | {i: f" rare{at % 20}" for at, i in enumerate(fresh[:30])}
    docs = spark.createDataFrame([(i, common(i) + rare.get(i, ""), "en", "s", 0) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert not any(got[i].passages for i in fresh)
    assert min(got[i].score for i in fresh[:30]) > max(got[i].score for i in fresh[30:])
