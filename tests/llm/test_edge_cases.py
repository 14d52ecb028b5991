"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, through every operator."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import golay_simhash, hash_forest, language_id, line_dedup, mixing, outliers, packing, quality_gam, queries, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a very long text of many words\n" * 40_000
ROWS = [
    (1, "Some words\nand a line", "en", "a", 20), (1, "Some words\nand a line", "en", "a", 20), (2, None, None, None, None), (3, "", "de", "b", 0),
    (None, "no id", "en", None, 5), (None, None, None, None, None), (4, " \t\n\x0b ", "fr", "a", 5), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (7, "é ü 漢字 \U0001f600 one two three four five", "zz", "c", 9),
]
CLASH = ("whole", "extra", "cut", "before", "words", "doc", "range", "hits", "text_key", "_gone", "gone", "key", "shard", "sid", "hash", "taken", "target", "source_size", "copies", "held_out", "score", "predicted", "n_words", "kept", "fp", "component_id", "n_lines", "n_dropped", "ids", "n", "tid", "g", "bin", "_hash", "_range")
LABELS = "doc_id long, quality int, toxic int"


def extra(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def operators(labels):
    sized = lambda d: d.withColumn("size", mixing.word_count("text"))
    return {
        "mix": lambda d: mixing.mix(sized(d), mixing.cyclic_weights(d), share=1.5),
        "suffixes": suffix_dedup.repeated_passages,
        "quality": lambda d: quality_gam.classify(d, labels),
        "outliers": outliers.reject_outliers,
        "simhash": golay_simhash.near_duplicates,
        "lines": line_dedup.drop_common_lines,
        "probes": lambda d: line_dedup.drop_common_lines(d, min_docs=2, max_broadcast_keys=0),
    }


@pytest.mark.parametrize("name", ["mix", "suffixes", "quality", "outliers", "simhash", "lines", "probes"])
def test_every_row_has_a_result(spark, name):
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (4, None, 0)], LABELS)
    for df in (docs, extra(docs)):
        got = operators(labels)[name](df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert operators(labels.limit(0))[name](docs.limit(0)).count() == 0


def test_packing_of_odd_rows(spark):
    docs = extra(spark.createDataFrame(ROWS, DOCS))
    got = packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(r.start == 0 for r in got) == len(ROWS) and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_dropped_near_duplicates_of_odd_rows(spark):
    wide = golay_simhash.drop_near_duplicates(extra(spark.createDataFrame(ROWS, DOCS)))
    got = golay_simhash.drop_near_duplicates(spark.createDataFrame(ROWS, DOCS).select("doc_id", "text"))
    assert sorted(str(r.doc_id) for r in wide.collect()) == sorted(str(r.doc_id) for r in got.collect()) and set(CLASH) <= set(wide.columns)
    assert {r.doc_id for r in got.collect()} >= {1, 2, 5, 7} and got.filter("doc_id in (3, 4, 6)").count() == 0
    assert golay_simhash.drop_near_duplicates(spark.createDataFrame([], DOCS).select("doc_id", "text")).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [2.0, 1.0]), (None, [1.0, 1.0]), (20, [0.0, -1.0]), (40, None), (60, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "d", "q", "shard", "rank", "score")})
    got = hash_forest.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(9, 2.0), (1, 1.0), (2, 1.0), (20, 0.0)]
    assert {r.query_id for r in got} == {0, 20}
    assert hash_forest.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://a.com/x", "<p>x"), (2, "", ""), (3, "http://a.com/x", "<p>" + LONG), (4, "http://" + "word" * 20_000 + "/x", "<p>word")], "page_id long, url string, html string")
    docs = spark.createDataFrame(ROWS, DOCS)
    wide = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "lang", "declared", "share", "token")})
    for df in (pages, wide):
        assert url_filter.filter_urls(df).count() == 6 and language_id.identify(df, docs).count() == 6
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and language_id.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}
