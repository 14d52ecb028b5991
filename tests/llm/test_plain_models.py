"""The fitted parts of operators 2, 5, 6 and 7 against plain versions written from their definitions."""

import html
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, outliers, quality_gam, text_stats, url_filter

TINY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
TAGS = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>")


def read(spark, name):
    return spark.read.parquet(f"{TINY}/{name}.parquet")


def plain_host(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.lower(), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_posteriors_of_languages(spark):
    """Every page's posterior, with its own share left out of the counts that judge it."""
    docs, pages = read(spark, "documents").select("doc_id", "text", "lang"), read(spark, "pages")
    grams = lambda t: (lambda j: [j[i : i + 3] for i in range(len(j) - 2)])(" " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " ")
    slot = lambda g: (((ord(g[0]) * 0x9E3779B1 + ord(g[1])) % 2**64 * 0x85EBCA77 + ord(g[2])) % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> 49
    counts = defaultdict(Counter)
    for r in docs.collect():
        if r.text is not None and r.lang is not None:
            counts[r.lang].update(slot(g) for g in grams(r.text))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + language_id.SLOTS / 2 for x in langs}

    rows, by = [], {key: defaultdict(lambda: dict.fromkeys(langs, 0.0)) for key in ("suffix", "domain", "host", "declared")}
    everything = dict.fromkeys(langs, 0.0)
    for p in pages.collect():
        host, _ = plain_host(p.url)
        said = re.search(r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", p.html or "")
        labels = host.split(".")
        keys = {"suffix": labels[-1], "domain": ".".join(labels[-2:]), "host": host, "declared": said.group(1).lower() if said else None}
        own = grams(html.unescape(TAGS.sub(" ", p.html or "")))
        text = {x: sum(math.log((counts[x][slot(g)] + 0.5) / total[x]) for g in own) / len(own) * min(len(own), 60) if own else 0.0 for x in langs}
        odds = {x: math.exp(text[x] - max(text.values())) for x in langs}
        share = {x: odds[x] / sum(odds.values()) for x in langs}
        rows.append((p.page_id, keys, text, share))
        for x in langs:
            everything[x] += share[x]
            for key, value in keys.items():
                by[key][value][x] += share[x]
    base = {x: (everything[x] + 1) / (sum(everything.values()) + len(langs)) for x in langs}
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert len(got) == len(rows)
    for page_id, keys, text, share in rows:
        prior = base
        for key in ("suffix", "domain", "host"):
            held = {x: by[key][keys[key]][x] - share[x] for x in langs}
            prior = {x: (held[x] + 4 * prior[x]) / (sum(held.values()) + 4) for x in langs}
        logs = {x: text[x] + math.log(prior[x]) for x in langs}
        if keys["declared"] is not None:
            held = {x: by["declared"][keys["declared"]][x] - share[x] for x in langs}
            for x in langs:
                logs[x] += math.log((held[x] + 2 * base[x]) / (sum(held.values()) + 2)) - math.log(base[x])
        best = max(langs, key=lambda x: (logs[x], [-ord(c) for c in x]))
        assert got[page_id].lang == best
        assert got[page_id].confidence == pytest.approx(1 / sum(math.exp(logs[x] - logs[best]) for x in langs), abs=1e-3)


def plain_features(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return [0.0] * len(text_stats.QUALITY_FEATURES)
    data, n = text.encode(), len(words)
    kept = [b for b in data if b not in (32, 9, 10, 11, 12, 13)]
    upper, lower = sum(65 <= b <= 90 for b in kept), sum(97 <= b <= 122 for b in kept)
    digits, wide = sum(48 <= b <= 57 for b in kept), sum(b >= 128 for b in kept)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    again = {k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    share = lambda chars: sum(text.count(c) for c in chars) / n
    return [
        math.log1p(n), len(kept) / n, upper / max(1, upper + lower), digits / len(kept), (len(kept) - upper - lower - digits - wide) / len(kept), share("!"), share("|"), share("#*$%&|<>"), share("."),
        sum("A" <= w[0] <= "Z" for w in words) / n, len(set(words)) / n, max(Counter(words).values()) / n, len(again) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), n / max(1, len(lines)), (upper + lower) / len(kept), wide / len(kept),
    ]


def test_quality_scores_are_sums_of_table_entries(spark):
    """Plain features, the training rows of the fold rule, and each score added up entry by entry."""
    docs = {r.doc_id: r.text or "" for r in read(spark, "documents").collect()}
    labels = [(r.doc_id, r.quality) for r in read(spark, "labels").collect() if r.quality is not None and r.doc_id is not None]
    trained = sorted((i, y) for i, y in labels if i in docs and zlib.crc32(str(i).encode()) % 5)
    model = quality_gam.fit(np.array([plain_features(docs[i]) for i, _ in trained]), np.array([float(y) for _, y in trained]))
    place = lambda edges, x: sum(e <= x for e in edges)
    got = {r.doc_id: r.score for r in quality_gam.classify(read(spark, "documents").select("doc_id", "text"), read(spark, "labels")).collect()}
    assert got.keys() == docs.keys() and len(model.pairs) == quality_gam.PAIRS
    for i, text in docs.items():
        x = plain_features(text)
        total = model.intercept + sum(t[place(e, x[j])] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[place(model.pair_edges[a], x[a]), place(model.pair_edges[b], x[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-6), i


def test_trees_take_the_best_cut():
    """A tree of two leaves against every cut of its bins."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h = rng.standard_normal(12), rng.random(12) + 2
        worth = lambda cuts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in zip(cuts[:-1], cuts[1:]))
        best = max(([0, c, 12] for c in range(1, 12)), key=worth)
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(best[:-1], best[1:])])
        assert quality_gam._tree(g, h, 2) == pytest.approx(want)


def plain_estimate(x):
    """Concentration steps on the rows of ``x`` (whole 1/256ths) with means and covariances of the rows themselves."""
    x, n = np.asarray(x) / outliers.SCALE, len(x)
    quartile = lambda q: np.sort(x, axis=0)[math.ceil(q * n) - 1]
    center, scatter = quartile(0.5), np.diag(np.maximum((quartile(0.75) - quartile(0.25)) / 1.349, outliers.FLOORS) ** 2)
    lowest, steps = math.inf, 0
    while True:
        distance = ((x - center) @ np.linalg.inv(scatter) * (x - center)).sum(axis=1)
        bins = np.floor(16 * np.log2(np.maximum(distance, 0) + 0.01))
        held = x[bins <= np.sort(bins)[math.ceil(outliers.COVERAGE * n) - 1]]
        new = np.cov(held.T, bias=True) * outliers.consistency(len(held) / n, outliers.D) + np.diag(np.square(outliers.FLOORS))
        if np.linalg.slogdet(new)[1] >= lowest - 1e-9:
            return center, np.linalg.inv(scatter), lowest
        center, scatter, lowest, steps = held.mean(axis=0), new, np.linalg.slogdet(new)[1], steps + 1


def test_estimates_of_contaminated_groups(spark):
    """Each group as a plain loop finds it, near the clean rows' own mean, and as tight as the best of many random starts."""
    rng, groups = np.random.default_rng(6), {}
    for name, odd in (("a", 0), ("b", 60), ("c", 100)):
        mixing = rng.standard_normal((outliers.D, outliers.D)) * 0.3
        clean = rng.standard_normal((500 - odd, outliers.D)) @ mixing + 2
        groups[name] = clean, np.rint(np.concatenate([clean, rng.standard_normal((odd, outliers.D)) * 0.05 + 9]) * outliers.SCALE).astype(int)
    rows = [(g, *map(int, v)) for g, (_, own) in groups.items() for v in own]
    columns = ", ".join(f"x{i} long" for i in range(outliers.D))
    got = {r.g: r for r in outliers.estimate(spark.createDataFrame(rows, f"g string, {columns}").repartition(3), "plain-estimate").collect()}
    for g, (clean, own) in groups.items():
        center, inverse, lowest = plain_estimate(own)
        assert got[g].center == pytest.approx(center, abs=1e-8) and got[g].inverse == pytest.approx(inverse.ravel(), rel=1e-5, abs=1e-6)
        spread = clean.std(axis=0)
        assert (np.abs(center - clean.mean(axis=0)) < 0.25 * spread).all()
        assert lowest <= random_starts(own / outliers.SCALE, rng) + 0.1


def random_starts(x, rng, starts=100):
    """Lowest determinant of subsets of ``COVERAGE`` of the rows from random starts, on the same scale."""
    h, best = math.ceil(outliers.COVERAGE * len(x)), math.inf
    for _ in range(starts):
        held = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(15):
            scatter = np.cov(held.T, bias=True) + np.eye(x.shape[1]) * 1e-6
            d = ((x - held.mean(axis=0)) @ np.linalg.inv(scatter) * (x - held.mean(axis=0))).sum(axis=1)
            held = x[np.argsort(d)[:h]]
        scatter = np.cov(held.T, bias=True) * outliers.consistency(h / len(x), outliers.D) + np.diag(np.square(outliers.FLOORS))
        best = min(best, np.linalg.slogdet(scatter)[1])
    return best


def test_segmentation_against_all_splits():
    rng = np.random.default_rng(9)
    for _ in range(60):
        counts = {"".join(rng.choice(list("abc"), rng.integers(1, 5))): int(rng.integers(1, 90)) for _ in range(12)}
        total, label = sum(counts.values()) + 5, "".join(rng.choice(list("abcd"), rng.integers(1, 9)))
        worth = lambda words: sum(math.log(counts[w] / total) if w in counts else -math.log(total) - 2.5 * len(w) for w in words)
        splits = [[label[a:b] for a, b in zip((0, *cuts), (*cuts, len(label)))] for k in range(len(label)) for cuts in combinations(range(1, len(label)), k)]
        found = url_filter.segment(label, counts, total)
        assert "".join(found) == label and worth(found) == pytest.approx(max(map(worth, splits)))


def test_verdicts_of_the_model(spark):
    """Every page without a rule gets the verdict of a naive Bayes model written out page by page."""
    more = [(-1 - i, f"http://{host}/{lang}/x", None) for i, (host, lang) in enumerate([("news.news.example.com", "en"), ("shop-shop.org", "fr"), ("b.c.d.net", "es"), ("news.shop.org", "en")])]
    pages = read(spark, "pages").select("page_id", "url", "html").union(spark.createDataFrame(more, "page_id long, url string, html string"))
    rows = pages.collect()
    words = Counter(w for r in rows if r.html for w in re.findall(r"[^\W\d_]+", html.unescape(TAGS.sub(" ", r.html)).lower()) if len(w) <= 63)
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    tokens, seen = {}, {"allow": Counter(), "block": Counter()}
    rule_verdicts = Counter()
    for r in rows:
        host, path = plain_host(r.url)
        own = {"h:" + w for label in re.split(r"[.\-]", host) if label for w in url_filter.segment(label, words, sum(words.values()))}
        parts = re.findall(r"[^\W_]+", path.lower())
        tokens[r.page_id] = own | {"p:" + ("0" if p.isnumeric() else p) for p in parts}
        if got[r.page_id].rule is not None:
            seen[got[r.page_id].verdict].update(tokens[r.page_id])
            rule_verdicts[got[r.page_id].verdict] += 1
    vocabulary = set().union(*tokens.values())
    known = {k: sum(c.values()) + len(vocabulary) for k, c in seen.items()}
    weight = lambda t: round(1e6 * (math.log((seen["block"][t] + 1) / known["block"]) - math.log((seen["allow"][t] + 1) / known["allow"])))
    prior = round(1e6 * (math.log(rule_verdicts["block"] + 1) - math.log(rule_verdicts["allow"] + 1)))
    judged = 0
    for r in rows:
        score = prior + sum(map(weight, tokens[r.page_id]))
        assert got[r.page_id].score == pytest.approx(score / 1e6, abs=1e-4)
        if got[r.page_id].rule is None and abs(score) > 100:
            assert got[r.page_id].verdict == ("block" if score > 0 else "allow")
            judged += 1
    assert judged or all(got[r.page_id].rule for r in rows)


def test_training_rows_of_a_language_with_few_doc_ids(spark):
    """The model is that of the smallest hashes of each language, whether or not enough of them are below the cut."""
    rows = [(i % 3, "aa", f"word{i % 3} abc") for i in range(300)] + [(1000 + i, "bb", f"text{i} xyz") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for most in (5, 20, 250):
        picked = docs.selectExpr("doc_id", "lang", "text", "row_number() over (partition by lang order by xxhash64(doc_id), doc_id) AS nth").filter(f"nth <= {most}")
        texts = docs.join(picked.select("doc_id", "lang").distinct(), ["doc_id", "lang"], "left_semi").collect()
        languages, logs = language_id.fit_text_model(docs, most)
        assert languages == ["aa", "bb"]
        for k, lang in enumerate(languages):
            want = np.full(language_id.SLOTS, 0.5)
            for r in texts:
                if r.lang == lang:
                    want += np.bincount(language_id.slots(r.text), minlength=language_id.SLOTS)
            assert np.allclose(logs[k], np.log(want / want.sum()))


def test_two_hundred_languages(spark):
    """200 languages and 10,000 pages: the posteriors of a plain version for some pages, and the right language for nearly all."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    stock = [["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(30)] for _ in range(200)]
    say = lambda k, n: " ".join(rng.choice(stock[k], n))
    docs = spark.createDataFrame([(5 * k + i, say(k, 60), f"l{k:03d}") for k in range(200) for i in range(5)], "doc_id long, text string, lang string")
    rows = [(i, f"http://h{i % 997}.s{i % 200}/x", f"<html lang=l{i % 200:03d}><p>{say(i % 200, 12)}</p></html>", f"l{i % 200:03d}") for i in range(10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(8)
    got = language_id.identify(pages.drop("want"), docs).join(pages.select("page_id", "want"), "page_id").collect()
    assert len(got) == 10_000 and sum(r.lang == r.want for r in got) > 9_900 and all(0 < r.confidence <= 1 for r in got)
    few = language_id.identify(pages.limit(50), docs, max_languages=7).select("lang").distinct().collect()
    assert {r.lang for r in few} <= {f"l{k:03d}" for k in range(7)}


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a"), (3, "same words here", "c")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://x.y/", "<html>same words</html>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    assert [r.lang for r in language_id.identify(pages, docs).collect()] == ["a", "a", "a"]
