"""Each training-data operator against a plain version of itself, an exact round trip or held-out accuracy."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, golay_simhash, hash_forest, language_id, line_dedup, mixing, outliers, packing, quality_gam, queries, suffix_dedup, text_stats, url_filter

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def read(spark, name, at=SMALL):
    return spark.read.parquet(f"{at}/{name}.parquet")


def groups_of(n, linked):
    """The smallest position reachable from each of ``n``."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents",):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    got, want = queries.queries()[name](spark, SMALL).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].round(6).astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_water_filling_clamps_and_reshares(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), (None, 50, None)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(sources, 0.5, 2).collect()}
    # 580 words: a stops at 20, b at 200, c takes the rest
    assert got == pytest.approx({"a": 20.0, "b": 200.0, "c": 360.0, None: 0.0})


def test_mix_comes_near_its_targets(spark):
    sized = mixing.sized(read(spark, "documents"))
    mixed = mixing.mix(sized, mixing.cyclic_weights(sized), share=1.5)
    rows, again = mixed.toPandas(), mixing.mix(sized, mixing.cyclic_weights(sized), share=1.5).toPandas()
    order = ["doc_id", "size"]
    assert rows.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert len(rows) == sized.count() and (rows.taken <= 2 * rows["size"]).all()
    for _, own in rows.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_languages_of_held_out_documents(spark):
    docs = read(spark, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 100")
    trained, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    pages = rest.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/x").alias("url"), F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"))
    found = language_id.identify(pages, trained).join(rest.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("want")), "page_id")
    assert found.agg(F.avg((F.col("lang") == F.col("want")).cast("double"))).first()[0] > 0.95


def test_declared_language_and_host_decide_empty_pages(spark):
    docs = spark.createDataFrame([(1, "the river and the hill " * 20, "en"), (2, "der fluss und der berg " * 20, "de")], "doc_id long, text string, lang string")
    rows = [(i, f"http://www.ort.de/{i}", '<html lang="de"><p>der berg und der fluss</p></html>') for i in range(6)]
    rows += [(10, "http://www.ort.de/x", ""), (11, None, None)] + [(20 + i, f"http://b.com/{i}", "<html lang='en'>the hill and the river</html>") for i in range(5)]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[10].lang == "de" and got[0].lang == "de" and got[20].lang == "en" and 0 < got[11].confidence <= 1


def test_nearest_recall_and_exact_scores(spark):
    rows = read(spark, "embeddings").toPandas()
    clean = [(int(i), np.array(v, float)) for i, v in zip(rows.vec_id, rows.embedding) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, points = np.array([i for i, _ in clean]), np.array([v for _, v in clean])
    got = defaultdict(list)
    for r in hash_forest.nearest(read(spark, "embeddings"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    at = {i: k for k, i in enumerate(ids)}
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = (points * points[at[q]]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert len(got[q]) == len(best) and all(s == pytest.approx(score[at[v]], abs=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and q not in [v for v, _ in got[q]]
        hits, total = hits + len({ids[i] for i in best} & {v for v, _ in got[q]}), total + len(best)
    assert hits / total >= 0.9


def test_forest_ascends_to_the_longest_prefixes():
    rng = np.random.default_rng(3)
    points = rng.standard_normal((2000, 16))
    points /= np.sqrt((points * points).sum(axis=1))[:, None]
    forest = hash_forest.Forest(points, trees=16)
    found = list(forest.search(points[:5], offer=0.05, least=50))
    assert all(i in f and 10 <= len(f) < 1500 for i, f in enumerate(found))


def test_repeated_passages_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    long, short = words(70), words(40)
    texts = [words(120) + long + words(30), words(20) + long, words(200) + short, short + words(90), words(300), words(60), words(60)]
    texts += [texts[5], long + words(10) + long, []]
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    want = defaultdict(set)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            grams = {tuple(b[k : k + 50]) for k in range(len(b) - 49)} if i != j else set()
            for k in range(len(a) - 49):
                if tuple(a[k : k + 50]) in grams:
                    want[i] |= set(range(k, k + 50))
    for i in range(len(texts)):
        assert {x for s in got[i].spans for x in range(s.start, s.stop)} == want[i], i


def test_quality_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SMALL
    scored = queries.op5_quality_gam(spark, at).join(read(spark, "labels", at), "doc_id").filter("quality IS NOT NULL").toPandas()
    crc = [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]
    assert crc == scored.held_out.tolist() and ((scored.score >= 0.3).astype(int) == scored.predicted).all()
    own = scored[scored.held_out]
    share = max(own.quality.mean(), 1 - own.quality.mean())
    good, bad = own[own.quality == 1].score.to_numpy(), own[own.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2 > 0.8
    assert (own.predicted == own.quality).mean() >= share - 0.02


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pairs


def plain_rules(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup, _ = dup + (line in seen), seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            inside |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_rules_against_plain_ones(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    for r in queries.op6_robust_outliers(spark, SMALL).collect():
        n, *rest = plain_rules(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.base_failed and r.kept)


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rng = np.random.default_rng(2)
    clean = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(100, 300))), "en", "s") for i in range(300)]
    odd = [(1000 + i, " ".join("#$%&|<>*" * 3 + str(rng.integers(1e9)) for _ in range(150)), "en", "s") for i in range(20)]
    got = {r.doc_id: r.kept for r in outliers.reject_outliers(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(300)) >= 299


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_url_rules_against_plain_ones(spark):
    rows = [(i, r.url, r.html) for i, r in enumerate(read(spark, "pages").collect())]
    odd = [None, "", "no scheme", "http://", "http://NET/es/x", "http://a.net/fr/?q", "http://anet/es/", "x://y://example.com/en/", "http://www.example.com/en/a#b", "http://example.com/en/", "http://b.example.com\n/en/", "http://com?/x"]
    rows += [(len(rows) + i, u, None) for i, u in enumerate(odd)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows:
        host, path, rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_segmentation():
    counts = {"blue": 50, "river": 40, "news": 30, "new": 20, "s": 1}
    assert url_filter.segment("bluerivernews", counts, 200) == ["blue", "river", "news"] and url_filter.segment("", counts, 200) == []


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text or "" for r in read(spark, "documents").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_retrieval_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for i, text in docs.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0


def test_packing_prefers_related_documents():
    docs = [np.full(512, 10 + i % 2, np.uint16) for i in range(16)]
    pieces = packing.pack_shard(docs, np.ones(64, np.float32), 512.0)
    first = {d % 2 for d, _, _, s, _ in pieces if s == 0}
    assert len(first) == 1


def test_terms_of_a_document():
    ids = np.random.default_rng(0).integers(0, 60000, 5000).astype(np.uint16)
    for got, want in zip(packing.terms_of(ids), np.unique(ids, return_counts=True)):
        assert (got == want).all()


def plain_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_all_pairs(spark):
    docs = read(spark, "documents").orderBy("doc_id").collect()
    fps = np.array([plain_fingerprint(r.text) for r in docs], np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4) if i < j]
    root = groups_of(len(docs), near)
    want = {(r.doc_id, f"{int(fp):016x}", docs[root[i]].doc_id) for i, (r, fp) in enumerate(zip(docs, fps))}
    assert {tuple(r) for r in queries.op9_golay_simhash(spark, SMALL).collect()} == want


def test_golay_keys_meet_for_up_to_four_errors():
    rng = np.random.default_rng(9)
    for errors in range(1, 5):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, errors, replace=False).astype(np.uint64)) for _ in a])
        met = [defaultdict(set), defaultdict(set)]
        for side, fps in enumerate((a, a ^ flips)):
            for key, who in zip(*(x.tolist() for x in golay_simhash.fuzzy_keys(fps))):
                met[side][who].add(key)
        assert all(met[0][i] & met[1][i] for i in range(300))


def test_near_copies_of_a_dense_group(spark):
    """Copies of one text with some words changed: exactly the groups of all pairs at 0.8."""
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in rng.integers(0, 5000, 150)], []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(0, 5000)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    got = {r.doc_id for r in golay_simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == exact_heads(rows)


def plain_lines(rows, min_docs):
    keys = lambda t: [re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n")]
    held = Counter(k for _, t in rows for k in set(keys(t)) if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not k or held[k] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_both_ways(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").select("doc_id", "text").collect()]
    rows += [(100_000 + i, f"\x0b Common LINE\x0c\n\nown {i}\n{chr(0x85)}common line") for i in range(9)] + [(200_000, "common line\r\ncommon line"), (200_001, None), (200_002, "")]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), plain_lines(rows, 10)
    for bound in (2_000_000, 0):
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1 << 16 if bound else 8)
        got = line_dedup.drop_common_lines(docs, 10, 1, max_broadcast_keys=bound).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got)) == want
    assert any(n for _, _, n, _ in want)


def test_line_digest(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents", TINY).select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(rows, 10)}
    assert {tuple(r) for r in queries.op10_line_dedup(spark, TINY).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want


def test_perfect_hash_holds_every_key_and_no_other():
    rng = np.random.default_rng(4)
    keys, prints = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    index = line_dedup.PerfectHash(keys[:10_000], prints[:10_000], np.arange(1, 10_001))
    assert (index.counts_of(keys[:10_000], prints[:10_000]) == np.arange(1, 10_001)).all() and not index.counts_of(keys[10_000:], prints[10_000:]).any()


def test_repeat_words_against_plain_ones():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 5, 40, 400):
        text = " ".join(str(x) for x in rng.integers(0, 6, n))
        assert text_stats.rule_stats(text.encode())[4] == plain_rules(text)[4]


def exact_heads(rows, similarity=0.8):
    """The least doc_id of each group that all links of shingle sets at ``similarity`` form."""
    sets, linked = [golay_simhash.shingle_set(r[1].encode(), 5) for r in rows], []
    for i in range(len(rows)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if same >= similarity * (len(sets[i]) + len(sets[j]) - same):
                linked.append((j, i))
    return {rows[i][0] for i in set(groups_of(len(rows), linked))}


def test_every_link_of_a_family_counts(spark, monkeypatch):
    """Families of edited copies around 0.8, where decoys just below it are as near as true copies; with blocks of few rows too."""
    rng, rows = np.random.default_rng(23), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in rng.integers(0, 5000, 200)]
        for _ in range(150):
            words = list(base)
            for at in rng.choice(200, rng.integers(3, 8), replace=False):
                words[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(words), "en", "a", 1))
    want = exact_heads(rows)
    assert 20 < len(want) < len(rows) - 20
    assert {r.doc_id for r in golay_simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == want
    monkeypatch.setattr(golay_simhash, "KEY_ROWS", 40)
    monkeypatch.setattr(golay_simhash, "GROUP_ROWS", 30)
    assert {r.doc_id for r in golay_simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_repeated_lines_do_not_make_texts_alike(spark):
    """One line a hundred times fixes fingerprints of texts that share nothing else; they all stay."""
    rng, line = np.random.default_rng(3), " ".join(f"l{i}" for i in range(20))
    rows = [(i, " ".join([line] * 100 + [f"x{w}" for w in rng.integers(0, 10**9, 400)]), "en", "a", 1) for i in range(40)]
    fps = [golay_simhash.fingerprint(r[1].encode(), 5) for r in rows]
    assert any((fps[i] ^ fps[j]).bit_count() <= 4 for i in range(40) for j in range(i))
    assert {r.doc_id for r in golay_simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == set(range(40))


def test_repetition_does_not_keep_copies_apart(spark):
    """A line once or forty times before the same tail: shingle sets are alike, repeat-weighted fingerprints aren't."""
    rng, rows = np.random.default_rng(4), []
    for i in range(20):
        line, tail = ([f"{kind}{w}" for w in rng.integers(0, 10**9, n)] for kind, n in (("l", 20), ("t", 300)))
        rows += [(2 * i + k, " ".join(line * times + tail), "en", "a", 1) for k, times in enumerate((1, 40))]
    fps = [golay_simhash.fingerprint(r[1].encode(), 5) for r in rows]
    assert any((fps[2 * i] ^ fps[2 * i + 1]).bit_count() > 20 for i in range(20))
    assert {r.doc_id for r in golay_simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == {2 * i for i in range(20)}


def test_each_statistic_alone_rejects_moderate_outliers(spark):
    """Texts at their group's centre but for one statistic; of clean texts hardly one is lost."""
    rng = np.random.default_rng(8)
    word = lambda least, most: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(least, most)))
    words = lambda n, least=3, most=9: [word(least, most) for _ in range(n)]
    lines = lambda own: "\n".join(" ".join(own[i : i + 10]) for i in range(0, len(own), 10))
    clean = [lines(words(rng.integers(150, 251))) for _ in range(400)]
    odd = {"long": [lines(words(1500)) for _ in range(3)], "wide": [lines(words(200, 7, 13)) for _ in range(3)], "symbols": [lines([w + "#" if k % 5 == 0 else w for k, w in enumerate(words(200))]) for _ in range(3)]}
    odd["repeats"] = [lines((own := words(100)) + words(1) + own[:45] + words(54)) for _ in range(3)]
    odd["lines"] = [lines(words(180)) + "\n" + "\n".join(["a b"] * 10) for _ in range(3)]
    texts = [("clean", t) for t in clean] + [(kind, t) for kind, own in odd.items() for t in own]
    rows = [(i, t, "en", "s") for i, (_, t) in enumerate(texts)]
    got = outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = Counter(texts[r.doc_id][0] for r in got if r.kept)
    assert not any(r.base_failed for r in got) and set(kept) == {"clean"} and kept["clean"] >= 392


def shared_words(texts, width=50):
    """For each text the word positions in windows of ``width`` words that another, different text holds too."""
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t) - width + 1):
            held[tuple(t[k : k + width])].add(tuple(t))
    return [{p for k in range(len(t) - width + 1) if len(held[tuple(t[k : k + width])]) > 1 for p in range(k, k + width)} for t in texts]


@pytest.mark.parametrize("hot, most", [(4096, 10**6), (40, 10**6), (40, 10)])
def test_no_passage_is_missed_among_common_heads_and_tails(spark, monkeypatch, hot, most):
    """Pairs whose passage ends (or begins, or both) in words that hundreds of other texts hold; with hot minimisers too."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST", most)
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    texts = []
    for own, head, tail in ((16, 0, 36), (16, 36, 0), (12, 20, 20)):
        first, last = words(head), words(tail)
        for _ in range(60):
            passage = first + words(own) + last
            texts += [words(rng.integers(0, 60)) + passage + words(rng.integers(0, 60)) for _ in range(2)]
        texts += [words(40) + first + words(rng.integers(0, 30)) + last + words(40) for _ in range(300)]
    # partners with one side in common at every length: the longest right side never has the longest left one
    middle = words(60)
    texts += [words(30) + middle[30 - k : 30 + k + d] + words(30) for k in range(5, 30) for d in (0, 3, 11, 20)]
    want = shared_words(texts)
    assert sum(map(bool, want)) > 370
    rows = suffix_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        assert {x for s in r.spans for x in range(s.start, s.stop)} == want[r.doc_id], r.doc_id


def test_long_runs_of_one_line(spark):
    """A line two thousand times in a text and in another one: spans don't depend on where batches end."""
    line, rng = [f"l{i}" for i in range(12)], np.random.default_rng(2)
    texts = [line * 2000, [f"x{i}" for i in rng.integers(0, 10**7, 30)] + line * 300, [f"y{i}" for i in range(99)]]
    want = shared_words(texts)
    for r in suffix_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        assert {x for s in r.spans for x in range(s.start, s.stop)} == want[r.doc_id]


def test_bitmaps_rule_out_only_what_cannot_be_similar():
    """Sets of very different sizes around 0.8: no similar pair is ruled out, and few that are far from it stay."""
    rng = np.random.default_rng(31)
    sets, far = [], 0
    for n in (3, 40, 600, 1100, 5000, 30000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            keep = base[rng.random(n) >= share]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, n - len(keep), dtype=np.uint64)])))
    bits, sizes = golay_simhash.Bitmaps([golay_simhash._parities(s) for s in sets]), np.array([len(s) for s in sets])
    i, j = map(np.array, zip(*[(a, b) for a in range(len(sets)) for b in range(a)]))
    may = bits.may_be_similar(sizes, i, j, 0.8)
    for a, b, ok in zip(i, j, may):
        same = len(np.intersect1d(sets[a], sets[b]))
        like = same / (len(sets[a]) + len(sets[b]) - same)
        assert ok or like < 0.8
        far += ok and like < 0.5 and min(sizes[a], sizes[b]) > 100
    assert far == 0


def test_related_documents_meet_in_a_shard(spark):
    """Of many shards: a document's best neighbour over all documents, by its 12 heaviest BM25 terms, is far oftener in its own shard than by chance."""
    docs = read(spark, "documents").filter("length(text) > 200").select("doc_id", "text")
    tokens = packing.tokenize(docs, queries.tokenizer_path()).collect()
    ids = [packing.unpack(r.ids, r.n) for r in tokens]
    counts = np.zeros(50_000)
    for own in ids:
        counts[packing.terms_of(own)[0]] += 1
    mean, idf = np.mean([len(x) for x in ids]), np.log1p((len(ids) - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    index, best = packing.ShardIndex(ids, idf, mean, query_terms=12), {}
    for i in range(len(ids)):
        near = [j for j in index.neighbours(i) if j != i]
        if near:
            best[tokens[i].doc_id] = tokens[near[0]].doc_id
    common.release(spark, "deal_test")
    table = common.table(packing.tokenize(docs, queries.tokenizer_path()), "deal_test/tokens")
    dealt, _, _ = packing.deal(table, sum(map(len, ids)) // 20, "deal_test")
    shard = {r.doc_id: r.shard for r in dealt.select("doc_id", "shard").collect()}
    met = np.mean([shard[a] == shard[b] for a, b in best.items()])
    assert len(set(shard.values())) >= 10 and met > 0.3, met
    print("best neighbours in the same shard:", round(float(met), 3), "of", len(best))


def test_probes_of_a_text_of_many_rows(spark, monkeypatch):
    """A text that most rows repeat is dealt to several tasks, and each row still gets its lines dropped."""
    monkeypatch.setattr(line_dedup, "MOST_COPIES", 7)
    rows = [(i, "shared line\nown of all\n" if i % 3 else f"shared line\nown {i}", "x") for i in range(120)] + [(None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, turn string").repartition(9)
    got, want = (line_dedup.drop_common_lines(docs, min_docs=100, **k) for k in ({"max_broadcast_keys": 0}, {}))
    order = lambda df: sorted(map(str, df.select("doc_id", "text", "turn", "n_lines", "n_dropped").collect()))
    assert order(got) == order(want) and got.count() == 122 and got.agg(F.sum("n_dropped")).first()[0] == 120


def test_a_score_of_nothing_allows(spark):
    """Without a training URL the score is 0, which allows; very long labels and paths are judged like others."""
    rows = [(1, "http://com.example/"), (2, "http://a.com/w"), (3, "http://b.net/es/w"), (4, "http://zzz.org/" + "q" * 300), (5, "://"), (5, "://"), (None, None)]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages.filter("page_id IS NULL OR page_id NOT IN (2, 3)")).collect()}
    assert got[1].score == 0 and {r.verdict for r in got.values()} == {"allow"}
    both = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert both[2].verdict == "allow" and both[3].verdict == "block" and both[4].verdict == ("block" if both[4].score > 0 else "allow")


@pytest.mark.parametrize("n", [300, 2_000])
def test_retrieved_neighbours_against_whole_queries(spark, n):
    """A seed asks with its heaviest terms only: the best neighbour by all of its terms is among the first ten for over nine tenths, at either size."""
    docs = read(spark, "documents", "/root/testdata/sf0.1").filter("length(text) BETWEEN 200 AND 20000").select("doc_id", "text").orderBy("doc_id").limit(n)
    ids = [packing.unpack(r.ids, r.n) for r in packing.tokenize(docs, queries.tokenizer_path()).collect()]
    counts = np.zeros(50_000)
    for own in ids:
        counts[packing.terms_of(own)[0]] += 1
    mean, idf = np.mean([len(x) for x in ids]), np.log1p((len(ids) - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    index, weights = packing.ShardIndex(ids, idf, mean), np.zeros((len(ids), 50_000), np.float32)
    for i, own in enumerate(ids):
        term, tf = packing.terms_of(own)
        weights[i, term] = packing.bm25(tf, idf[term], len(own), mean)
    asked = range(0, len(ids), max(1, len(ids) // 200))
    scores = (weights[list(asked)] > 0).astype(np.float32) @ weights.T
    scores[np.arange(len(asked)), list(asked)] = -1
    found = [scores[k].argmax() in [j for j in index.neighbours(i) if j != i][:10] for k, i in enumerate(asked)]
    assert np.mean(found) > 0.9, np.mean(found)
