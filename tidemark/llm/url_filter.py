"""URL filters (operator 7): host and path rules, then word segmentation and naive Bayes for the rest.

Host labels are split into words by a unigram Viterbi search whose word counts
come from the text of all pages; a multinomial naive Bayes model of the words
of hosts and paths, learned from the URLs that a rule decides, judges the
others. Only distinct host labels are segmented, each with the counts of its
own substrings that are words, so no dictionary is broadcast.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, map_batches, new_tag, slices, table

#: Fixed values of the rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Longest word of a host label: a label of the domain name system has no more characters than that.
MAX_WORD = 63
MAX_BROADCAST = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAGS = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), _PARTS, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path joined, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most likely split of a label by unigram counts; unseen strings pay by their length. Ties: the longer last word."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - MAX_WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            gain = math.log(n / total) if n else -math.log(total) - 2.5 * len(word)
            if best[start] + gain > best[end]:
                best[end], back[end] = best[start] + gain, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of up to ``MAX_WORD`` letters in the visible text of all pages."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for page in batch.column(0).to_pylist():
            if page:
                found.update(w for w in _WORD.findall(html.unescape(_TAGS.sub(" ", page)).lower()) if len(w) <= MAX_WORD)
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return map_batches(pages.select("html"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words): each distinct ``label`` split by the counts of those of its substrings that ``words`` has.

    Substrings are cut one after the other, so a very long label costs
    ``MAX_WORD`` for each of its characters and is never held as one array of them.
    """
    total = words.agg(F.sum("n")).first()[0] or 1
    labels = labels.distinct()

    def substrings(batches):
        for batch in (piece for x in batches for piece in slices(x)):
            own, parts = [], []
            for label in batch.column(0).to_pylist():
                for end in range(1, len(label) + 1):
                    new = [label[start:end] for start in range(max(0, end - MAX_WORD), end)]
                    own += [label] * len(new) if len(label) <= 4 * MAX_WORD else [_stand_in(label)] * len(new)
                    parts += new
                    if len(parts) > 20_000:
                        yield pa.record_batch([pa.array(own, pa.string()), pa.array(parts, pa.string())], ["key", "word"])
                        own, parts = [], []
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(parts, pa.string())], ["key", "word"])

    def split(frames):
        for frame in frames:
            yield pd.DataFrame({"label": frame.label, "words": [segment(x, dict(c) if c is not None else {}, total) for x, c in zip(frame.label, frame.counts)]})

    parts = labels.mapInArrow(substrings, "key string, word string").join(words, "word").distinct()
    own = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    key = F.when(F.length("label") <= 4 * MAX_WORD, F.col("label")).otherwise(F.concat(F.lit("\n"), F.md5("label")))
    return labels.withColumn("key", key).join(own, "key", "left").select("label", "counts").mapInPandas(split, "label string, words array<string>")


def _stand_in(label: str) -> str:
    """What names a very long label beside each of its substrings; no label holds a line feed before its digest."""
    return "\n" + hashlib.md5(label.encode()).hexdigest()


def filter_urls(pages: DataFrame, rules=RULES, smoothing: float = 1.0, tag: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins. URLs without one get naive Bayes' verdict,
    learned from the distinct host words and path words of those with one:
    block if that is likelier, else allow (without any training URL: allow).
    A null URL, or one without ``://``, has empty host and path. Null page_ids
    and repeated rows stay; a null html adds no words. Weights are summed as
    whole millionths, so reruns agree.
    """
    tag = tag or new_tag("url_filter")
    host, path = host_and_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = table(urls.withColumn("rule", rule).withColumn("_verdict", verdict), tag)
    words = table(page_words(pages), tag)
    label = F.filter(F.split("host", r"[.\-]"), lambda x: x != "")
    hosts = urls.select("host").distinct().withColumn("labels", label)
    split = table(segment_labels(hosts.select(F.explode("labels").alias("label")), words), tag)
    by_host = hosts.select("host", F.explode("labels").alias("label")).join(split, "label").select("host", F.explode("words").alias("token"))
    by_host = table(by_host.select("host", F.concat(F.lit("h:"), "token").alias("token")).distinct(), tag)
    pieces = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pieces = F.transform(F.array_distinct(F.transform(pieces, lambda x: F.regexp_replace(x, r"^\p{N}+$", "0"))), lambda x: F.concat(F.lit("p:"), x))
    paths = urls.groupBy("path").agg(F.count_if(F.col("_verdict") == "allow").alias("allow"), F.count_if(F.col("_verdict") == "block").alias("block")).select("path", "allow", "block", F.explode(pieces).alias("token"))
    seen = urls.groupBy("host").agg(F.count_if(F.col("_verdict") == "allow").alias("allow"), F.count_if(F.col("_verdict") == "block").alias("block"))
    counted = by_host.join(seen, "host").select("token", "allow", "block").union(paths.select("token", "allow", "block"))
    counts = table(counted.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), tag)
    sums = counts.agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.count("*").alias("v")).first()
    prior = urls.agg(F.count_if(F.col("_verdict") == "allow").alias("a"), F.count_if(F.col("_verdict") == "block").alias("b")).first()
    a, b, v = sums["a"] or 0, sums["b"] or 0, smoothing * max(1, sums["v"])
    weight = F.log((F.col("block") + smoothing) / (b + v)) - F.log((F.col("allow") + smoothing) / (a + v))
    # what is broadcast has a digest of fixed size in place of a token, host or path of any length: 48 bytes a row
    digest = lambda c: F.unhex(F.md5(c))
    small = lambda df: F.broadcast(df) if bounded(df, MAX_BROADCAST) else df
    weights = small(table(counts.select(digest("token").alias("key"), F.round(weight * 1e6).cast("long").alias("w")), tag))
    weighed = lambda rows, name: rows.withColumn("key", digest("token")).join(weights, "key").groupBy(digest(name).alias(f"{name}_key")).agg(F.sum("w").alias(f"{name}_w"))
    # a row for each host and each path: broadcast while they are few, so that the pages of one host needn't meet in one task;
    # beyond that a host of very many pages is split by adaptive execution, as it is the left side of a left join
    host_w = small(table(weighed(by_host, "host"), tag))
    path_w = small(table(weighed(urls.select("path").distinct().select("path", F.explode(pieces).alias("token")), "path"), tag))
    start = round(1e6 * (math.log((prior["b"] + smoothing)) - math.log(prior["a"] + smoothing))) if prior["a"] + prior["b"] else 0
    out = urls.withColumns({"host_key": digest("host"), "path_key": digest("path")}).join(host_w, "host_key", "left").join(path_w, "path_key", "left")
    score = F.coalesce("host_w", F.lit(0)) + F.coalesce("path_w", F.lit(0)) + start
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), (score / 1e6).alias("score"))
