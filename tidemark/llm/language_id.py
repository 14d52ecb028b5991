"""Language ID (operator 2): Bayesian evidence fusion for web pages.

The posterior of a page's language adds up logarithms of

* the likelihood of its visible text under a model of character trigrams for
  each language, learned from labelled documents,
* how often each language goes with the declared ``lang`` of the markup and
  with the address suffix, and
* the prior of its host, smoothed towards its registered domain, that towards
  its suffix, and that towards all pages.

The counts of declarations, suffixes and hosts are grouped aggregates of the
text model's posteriors over all pages, in whole millionths so that sums are
exact. A page's own posterior is taken out of the counts that judge it.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, new_tag, table
from tidemark.llm.url_filter import host_and_path

#: Fitted on this many documents of each language at most, those of the smallest hashes of their doc_id.
MAX_TRAINING_ROWS = 1_000
#: The model has so many languages at most, those of most labelled documents (ties by name): ``SLOTS`` numbers of 8 bytes each.
MAX_LANGUAGES = 1_000
SLOTS, MIN_SCALE = 1 << 15, 1e6
#: Pseudo-pages with which each level of the host prior leans on the next.
HOST_LEAN, DECLARED_LEAN = 4.0, 2.0
#: A text counts as this many independent trigrams at most.
MOST_EVIDENCE = 60
_TAGS = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>")
_RUNS = re.compile(r"[^\W\d_]+")


def visible(page: str | None) -> str:
    return html.unescape(_TAGS.sub(" ", page)) if page else ""


def slots(text: str) -> np.ndarray:
    """Hash slots of the character trigrams of a text's lower-cased letter runs, with a blank at either end."""
    joined = " " + " ".join(_RUNS.findall(text.lower())) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def fit_text_model(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithm of each slot's probability by language (add-half smoothing).

    The driver gets one row for each language: the slots that its texts fill
    and their counts, 12 bytes for each of ``SLOTS`` at most.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    named = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not named:
        return [], np.zeros((0, SLOTS))
    # only rows whose hash is below a cut, about four times as many as wanted, meet in the task of their language
    cuts = [(r["lang"], r["count"], -(2**63) + min(2**64 - 1, 4 * max_rows * 2**64 // r["count"])) for r in named]
    cuts = known.sparkSession.createDataFrame(cuts, "lang string, total long, cut long")
    placed = known.join(F.broadcast(cuts), "lang").withColumn("place", F.xxhash64("doc_id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    first = lambda rows: rows.withColumn("nth", nth).filter(F.col("nth") <= max_rows)
    picked = first(placed.filter("place <= cut"))
    # a language whose rows share few doc_ids can have too few below its cut: then all rows are ordered
    got = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    if any(got.get(r["lang"], 0) < min(max_rows, r["count"]) for r in named):
        picked = first(placed)
    picked = picked.select("doc_id", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
            own += np.bincount(slots(text), minlength=SLOTS)
        rows = [(lang, int(i), int(own[i])) for lang, own in sums.items() for i in np.flatnonzero(own)]
        lang, at, n = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["lang", "slot", "n"])

    rows = docs.filter("text IS NOT NULL").join(F.broadcast(picked.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = map_batches(rows, count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    vectors = counts.groupBy("lang").agg(F.collect_list(F.col("slot").cast("int")).alias("slots"), F.collect_list("n").alias("counts")).toArrow()
    vectors = vectors.sort_by("lang")
    languages = vectors.column("lang").to_pylist()
    logs = np.full((len(languages), SLOTS), 0.5)
    for k in range(len(languages)):
        logs[k, vectors.column("slots")[k].values.to_numpy()] += vectors.column("counts")[k].values.to_numpy()
        logs[k] = np.log(logs[k] / logs[k].sum())
    return languages, logs


def identify(pages: DataFrame, docs: DataFrame, most_evidence: int = MOST_EVIDENCE, max_languages: int = MAX_LANGUAGES, tag: str | None = None) -> DataFrame:
    """(page_id, lang, confidence, declared, suffix, host) for every row of ``pages`` (page_id, url, html).

    ``declared`` is the first part of the markup's ``lang`` in lower case, null
    if there is none; ``suffix`` the last label of the host, '' without one. A
    null or empty page, or one without letters, has no text evidence and is
    judged by the rest. Ties go to the language first by code point. Without
    labelled documents ``lang`` and ``confidence`` are null. Neighbouring
    trigrams aren't independent, so a text counts as ``most_evidence`` of them
    at most, each with the mean of all. Of more than ``max_languages``
    labelled languages those of fewest documents aren't known to the model.

    Counts of a host, domain, suffix or declaration are held as the languages
    that it has and their shares, so a page carries as many numbers as there
    are languages at most, and its posterior is worked out on whole batches.
    """
    tag = tag or new_tag("language_id")
    languages, logs = fit_text_model(docs, max_languages=max_languages)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    url = pages.select("page_id", host_and_path("url")[0].alias("host"), F.nullif(declared, F.lit("")).alias("declared"), "html")
    labels = F.split("host", r"\.")
    url = url.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    if not languages:
        return url.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), "declared", "suffix", "host")
    # a slot's logarithms of all languages lie together
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    k = len(languages)
    at = url.columns.index("html")
    kept = [c for c in url.columns if c != "html"]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = np.zeros((batch.num_rows, k))
        for i, page in enumerate(batch.column(at).to_pylist()):
            own = slots(visible(page))
            if len(own):
                text[i] = shared.value[own].mean(axis=0) * min(len(own), most_evidence)
        odds = np.exp(text - text.max(axis=1, keepdims=True))
        share = np.floor(odds / odds.sum(axis=1, keepdims=True) * MIN_SCALE + 0.5).astype(np.int64)
        row, lang = np.nonzero(share)
        stops = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        sparse = pa.ListArray.from_arrays(pa.array(stops), pa.StructArray.from_arrays([pa.array(lang.astype(np.int32)), pa.array(share[row, lang])], ["lang", "n"]))
        dense = pa.ListArray.from_arrays(pa.array(np.arange(0, text.size + 1, k, dtype=np.int32)), pa.array(text.ravel()))
        return pa.record_batch([*(batch.column(c) for c in kept), dense, sparse], [*kept, "text_log", "share"])

    counted = "array<struct<lang: int, n: bigint>>"
    schema = ", ".join([*(f"{c} {t}" for c, t in url.dtypes if c != "html"), f"text_log array<double>, share {counted}"])
    read = table(map_batches(url, judge, schema), tag)
    whole = {r.lang: r.n for r in read.select(F.explode("share").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")).collect()}
    base = np.array([whole.get(i, 0) / MIN_SCALE + 1.0 for i in range(k)]) / (sum(whole.values()) / MIN_SCALE + k)

    out, levels = read, ("suffix", "domain", "host", "declared")
    for key in levels:
        each = read.select(F.col(key).alias("_key"), F.explode("share").alias("x")).groupBy("_key", "x.lang").agg(F.sum("x.n").alias("n"))
        counts = each.groupBy("_key").agg(F.collect_list(F.struct("lang", "n")).alias(f"n_{key}"))
        out = out.join(counts, out[key].eqNullSafe(counts["_key"]), "left").drop("_key")

    def dense_counts(column: pa.Array, rows: int) -> np.ndarray:
        """Pages of a sparse column of counts, one row for each page."""
        full, parts = np.zeros((rows, k)), column.flatten()
        page = np.repeat(np.arange(rows), column.value_lengths().fill_null(0).to_numpy())
        full[page, parts.field("lang").to_numpy()] = parts.field("n").to_numpy()
        return full

    results = ["page_id", "declared", "suffix", "host"]

    def fuse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, get = batch.num_rows, lambda c: batch.column(batch.schema.names.index(c))
        text, share = get("text_log").flatten().to_numpy().reshape(rows, k), dense_counts(get("share"), rows)
        # a page's own posterior is taken out of the counts that judge it
        rest = {key: (dense_counts(get(f"n_{key}"), rows) - share) / MIN_SCALE for key in levels}
        lean = lambda own, towards, weight: (own + weight * towards) / (own.sum(axis=1, keepdims=True) + weight)
        prior = np.broadcast_to(base, (rows, k))
        for key in ("suffix", "domain", "host"):
            prior = lean(rest[key], prior, HOST_LEAN)
        said = np.log(lean(rest["declared"], base, DECLARED_LEAN)) - np.log(base)
        said[~get("declared").is_valid().to_numpy(zero_copy_only=False)] = 0.0
        logs = text + np.log(prior) + said
        best = logs.argmax(axis=1)
        confidence = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        named = pa.array([languages[i] for i in best], pa.string())
        return pa.record_batch([*(get(c) for c in results), named, pa.array(confidence)], [*results, "lang", "confidence"])

    kinds = dict(out.dtypes)
    found = map_batches(out, fuse, ", ".join([*(f"{c} {kinds[c]}" for c in results), "lang string, confidence double"]))
    return found.select("page_id", "lang", "confidence", "declared", "suffix", "host")
