"""The corpus pipeline: each stage does its operator's work on what the one before kept."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm import common, golay_simhash, quality_gam  # noqa: E402

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(stage(spark, docs, SMALL), "pipeline_test")
        out.append((name, docs))
    return dict(out)


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "pack"]


def test_columns_and_decisions(spark, stages):
    for name, docs in list(stages.items())[:-1]:
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = quality_gam.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert stages["quality"].count() == scored.filter("predicted = 1").count()
    assert stages["line_dedup"].count() == stages["quality"].count()


def test_one_document_of_each_group_stays(stages):
    """Exactly the smallest doc_id of each group that all links at 0.8 form."""
    before = stages["line_dedup"].orderBy("doc_id").collect()
    sets = [golay_simhash.shingle_set((r.text or "").encode(), 5) for r in before]
    links = []
    for i in range(len(before)):
        for j in range(i):
            if len(sets[i]) * 5 < len(sets[j]) * 4 or len(sets[j]) * 5 < len(sets[i]) * 4:
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                links.append((j, i))
    kept = {r.doc_id for r in stages["near_duplicates"].collect()}
    assert kept == {before[i].doc_id for i in set(_least(len(before), links))} and len(kept) < len(before)


def _least(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_mix_and_pack(stages):
    mixed = {r.doc_id: r.n for r in stages["mix"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(mixed) <= {r.doc_id for r in stages["near_duplicates"].collect()} and max(mixed.values()) <= 2
    first = {r.doc_id: r.n for r in stages["pack"].filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert first == mixed


def test_a_run_leaves_only_its_result(spark):
    path = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/tidemark"
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (only,) = set(os.listdir(path)) - before
    assert only.startswith("out_pack") and got.count() > 0


ROWS = [
    (1, "Some words\nand a line", "en", "a", 20), (1, "Some words\nand a line", "en", "a", 20), (1, "Some words\nand a line", "en", "a", 20), (1, "other words of that id", "en", "a", 3), (2, None, None, None, None),
    (3, "", "de", "b", 0), (None, "no id", "en", None, 5), (None, None, None, None, None), (4, " \t\n\x0b ", "fr", "a", 5), (5, "a very long text of many words\n" * 20_000, "en", "b", 9), (7, "é ü 漢字 \U0001f600 one two three four five", "zz", "c", 9),
]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_through_every_stage(spark, name):
    """Nulls, repeated rows and ids, empty and long texts, extra columns with names of the operators' own, and no rows at all."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(ROWS, DOCS)
    wide = docs.withColumns({c: F.lit("x") for c in ("gone", "_gone", "copies", "whole", "row_key", "nth", "n_lines", "hits", "text_key", "score", "predicted", "ids", "n", "sid", "fp")})
    got = stage(spark, docs, SMALL)
    rows, again = (sorted(map(str, x.drop("sequence_id", "offset").collect())) for x in (got, stage(spark, wide, SMALL)))
    assert len(rows) == len(again) and stage(spark, docs.limit(0), SMALL).count() == 0
    if name == "mix":
        # per distinct row at most twice the times that it is there
        times = {}
        for r in got.collect():
            times[(r.doc_id, r.text)] = times.get((r.doc_id, r.text), 0) + 1
        assert all(n <= 2 * sum(r[:2] == k for r in ROWS) for k, n in times.items()) and times[(1, "Some words\nand a line")] <= 6
    if name == "near_duplicates":
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert len(kept) == len(set(kept)) and {1, 5, 7} <= {i for i, _ in kept} and {"other words of that id", "no id"} <= {t for _, t in kept}
    if name == "line_dedup":
        assert len(rows) == len(ROWS)
    if name == "pack":
        assert sum(r.start == 0 for r in got.collect()) == len(ROWS)


def test_texts_without_or_with_shared_ids_stay(spark):
    rows = [(None, "A text of its own"), (None, "B another one"), (None, "C and a third"), (1, "D with an id"), (1, "E said twice"), (2, "E said twice")]
    docs = lambda rows: spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs(rows), SMALL)
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, docs(rows[:5]).select("doc_id", "text").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_odd_ids_against_all_pairs(spark, seed):
    """Null and repeated ids, repeated rows and near copies: exactly one row of each group, whatever the partitions."""
    rng, word = np.random.default_rng(seed), lambda k: f"w{k}"
    base = [[word(k) for k in rng.integers(0, 500, 60)] for _ in range(25)]
    rows = []
    for _ in range(120):
        words = list(base[rng.integers(0, 25)])
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, 60)] = word(rng.integers(0, 500))
        rows.append((None if rng.random() < 0.3 else int(rng.integers(0, 60)), " ".join(words), str(rng.integers(0, 2)), None, 0))
    rows += rows[:15]
    sets = [golay_simhash.shingle_set(r[1].encode(), 5) for r in rows]
    same = lambda a, b: len(np.intersect1d(a, b, assume_unique=True))
    pairs = [(j, i) for i in range(len(rows)) for j in range(i) if (k := same(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - k)]
    groups = {}
    for i, g in enumerate(_least(len(rows), pairs)):
        groups.setdefault(g, []).append(rows[i])
    got = [corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(n), SMALL).collect() for n in (1, 7)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == len(groups)
    kept = {r.text: r for r in got[0]}
    for members in groups.values():
        (text,) = {r[1] for r in members} & set(kept)
        assert kept[text].doc_id == min((r[0] for r in members if r[0] is not None), default=None)
        assert kept[text].lang == min(r[2] for r in members if r[0] == kept[text].doc_id and r[1] == text)
