"""Suffix-array dedup (operator 4): sparse suffix arrays at content-selected minimiser positions.

A text keeps only the suffixes that start at its minimisers: word positions
whose ``GRAM``-word hash is the least of ``WINDOW`` neighbouring ones. Any
passage of ``GRAM + WINDOW - 1`` words holds one, at the same place in every
text. So

1. minimiser hashes are counted, and those that two different texts share
   keep their suffixes (the others can't start a match);
2. the suffixes, with what stands on their left, are dealt out by their
   minimiser and sorted: each minimiser's suffixes are one run of the array;
3. neighbours are compared and matches extended to the left and right. A
   partner may share fewer words on the right than the nearest neighbour, but
   more on the left; so for every length that the right side can have, those
   that share it are also put in order of their left sides, where the nearest
   one of another text has the longest match. No passage is missed thereby;
4. matches of enough words become spans, and overlapping spans of a text are
   merged, which extends them as far as the passage goes.

A minimiser with more than ``HOT`` suffixes doesn't go to one task: the hashes
of its windows of ``min_words`` words are counted instead, and those that two
texts share are spans as well. They are broadcast up to ``MAX_BROADCAST`` of
them; beyond that the windows meet them in a join.

Equal texts are one from the start; a text that two documents have is a
repeated passage as a whole. Words are compared by 32-bit hashes beyond the
64-bit hash of the minimiser itself.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, map_batches, new_tag, table, texts
from tidemark.llm.golay_simhash import _runs

GRAM, WINDOW = 10, 32
#: Most suffixes of a minimiser that are sorted in one task, and rows of the array that are compared at once.
HOT, ROWS = 4096, 20_000
#: Shared windows of hot minimisers that are broadcast, 8 bytes each.
MAX_BROADCAST = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimisers of a text of at least ``GRAM + WINDOW - 1`` words."""
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, wide = np.zeros(n, np.uint64), words.astype(np.uint64)
    for k in range(GRAM):
        grams = grams * _BASE + wide[k : k + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least = _sliding(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == grams
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _spaced(words: np.ndarray, at: np.ndarray, width: int, step: int) -> np.ndarray:
    """The hashes of the ``width`` words from each position on, forward or backward; 0 beyond the text."""
    padded = np.concatenate([np.zeros(width, np.uint32), np.maximum(words, 1), np.zeros(width, np.uint32)])
    return padded[(at + width)[:, None] + step * np.arange(width)[None, :]]


def _windows(words: np.ndarray, anchors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``width`` words that begin up to ``WINDOW - 1`` words before an anchor."""
    mark = np.zeros(len(words) + WINDOW, np.int64)
    np.add.at(mark, np.maximum(anchors - WINDOW + 1, 0), 1)
    np.add.at(mark, anchors + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark)[: max(0, len(words) - width + 1)] > 0)
    hashes, wide = np.zeros(len(starts), np.uint64), words.astype(np.uint64)
    for k in range(width):
        hashes = (hashes + wide[starts + k] + np.uint64(1)) * _BASE
        hashes ^= hashes >> np.uint64(31)
    return starts, hashes


def repeated_passages(docs: DataFrame, min_words: int = 50, tag: str | None = None) -> DataFrame:
    """(doc_id, n_words, repeated_words, spans) for every row of ``docs``.

    ``spans`` are the merged word ranges [start, stop) of all passages of at
    least ``min_words`` words (41 or more) that another text holds too, in
    order; words are runs of characters other than ASCII white space. A text
    that several doc_ids have is one span if it has ``min_words`` words. Rows
    with equal doc_id and text are one document, null doc_ids count as one id;
    null and empty texts have no words. Other columns are ignored.
    """
    if min_words < GRAM + WINDOW - 1:
        raise ValueError(f"passages need {GRAM + WINDOW - 1} words or more")
    tag = tag or new_tag("suffixes")
    docs = docs.select("doc_id", "text")

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, grams, at, sizes, ends = [], [], [], [], []
        for text in texts(batch.column(1)):
            words = word_hashes(text)
            own, h = minimisers(words) if len(words) >= min_words else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            ids.append(xxhash.xxh3_64_intdigest(text))
            at.append(own.astype(np.int32))
            grams.append(h)
            sizes.append(len(words))
            ends.append(len(own))
        stops = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate(x))) for x in ([g.view(np.int64) for g in grams], at)]
        return pa.record_batch([batch.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *lists], ["doc_id", "tid", "n_words", "grams", "at"])

    kind = dict(docs.dtypes)["doc_id"]
    read = table(map_batches(docs, anchors, f"doc_id {kind}, tid long, n_words long, grams array<long>, at array<int>"), tag)
    each = read.select("tid", F.explode(F.arrays_zip("grams", "at")).alias("x")).select("tid", F.col("x.grams").alias("gram"), F.col("x.at").alias("at"))
    shared = each.groupBy("gram").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("n")).filter("a <> b").select("gram", (F.col("n") > HOT).alias("hot"))
    shared = table(shared, tag)  # a table by itself, so that a join on a very common hash can be split
    kept = each.join(shared, "gram").groupBy("tid").agg(F.collect_set(F.struct("at", "gram", "hot")).alias("kept"))
    keys = read.groupBy("tid").agg(F.min_by("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("doc_id"))
    wanted = kept.join(keys, "tid").select("tid", "kept", "doc_id")

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([xxhash.xxh3_64_intdigest(t) for t in texts(batch.column(1))], np.uint64)
        return pa.record_batch([*batch.columns, pa.array(own.view(np.int64))], ["doc_id", "text", "tid"])

    def suffixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[tuple] = []
        for tid, text, own in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
            own = sorted((x["at"], x["gram"]) for x in own if not x["hot"])
            at = np.array([x for x, _ in own], np.int64)
            words = word_hashes(text) if own else np.zeros(0, np.uint32)
            right, left = (x.astype(">u4") for x in (_spaced(words, at, min_words, 1), _spaced(words, at - 1, WINDOW, -1)))
            parts.append((np.full(len(at), tid), at, np.array([x for _, x in own], np.int64), [x.tobytes() for x in right], [x.tobytes() for x in left]))
        tid, at, gram, right, left = zip(*parts)
        flat = lambda x: pa.array([v for one in x for v in one], pa.binary())
        return pa.record_batch([pa.array(np.concatenate(gram)), pa.array(np.concatenate(tid).astype(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), flat(right), flat(left)], ["gram", "tid", "at", "suffix", "before"])

    texts_ = map_batches(docs, named, f"doc_id {kind}, text string, tid long")
    joined = texts_.alias("d").join(wanted.alias("w"), (F.col("d.tid") == F.col("w.tid")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.tid", "d.text", "w.kept")
    rows = map_batches(joined, suffixes, "gram long, tid long, at int, suffix binary, before binary")
    array_ = rows.repartition("gram").sortWithinPartitions("gram", "suffix", "tid", "at")
    spans = array_.mapInArrow(lambda batches: _runs(batches, ROWS, partial(_found, min_words=min_words)), "tid long, start long, stop long")
    if not shared.filter("hot").isEmpty():
        hot = joined.filter(F.exists("kept", lambda x: x["hot"])).withColumn("kept", F.array_sort(F.transform(F.filter("kept", lambda x: x["hot"]), lambda x: x["at"])))
        spans = spans.union(_hot_spans(hot, min_words, tag))
    merged = table(spans, tag).groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own in batch.column(1).to_pylist():
            done: list[list[int]] = []
            for x in own:
                if done and x["start"] <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], x["stop"])
                else:
                    done.append([x["start"], x["stop"]])
            out.append([{"start": a, "stop": b} for a, b in done])
        return pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["tid", "spans"])

    kind_of = "array<struct<start:bigint,stop:bigint>>"
    merged = map_batches(merged, merge, f"tid long, spans {kind_of}")
    ids = F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    per_text = read.groupBy("tid").agg((ids > 1).alias("copied")).join(merged, "tid", "left")
    whole = F.expr("array(named_struct('start', 0L, 'stop', n_words))")
    out = read.select("doc_id", "tid", "n_words").join(per_text, "tid")
    out = out.withColumn("spans", F.when(F.col("copied") & (F.col("n_words") >= min_words), whole).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {kind_of})"))))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("repeated_words"), "spans")


def _hot_spans(joined: DataFrame, min_words: int, tag: str) -> DataFrame:
    """(tid, start, stop) of the shared windows around the hot minimisers (positions ``kept``) of texts."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [_windows(word_hashes(text), np.array(at, np.int64), min_words) for text, at in zip(texts(batch.column(1)), batch.column(2).to_pylist())]
        stops = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in own])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate(x))) for x in ([x for x, _ in own], [h.view(np.int64) for _, h in own])]
        return pa.record_batch([batch.column(0), *lists], ["tid", "starts", "hashes"])

    rows = table(map_batches(joined, windows, "tid long, starts array<long>, hashes array<long>"), tag)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The distinct windows of a batch, with the least and greatest text that holds each."""
        hashes = batch.column(2).flatten().to_numpy()
        tid = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(2).offsets.to_numpy()))
        order = np.lexsort((tid, hashes))
        hashes, tid = hashes[order], tid[order]
        edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        last = np.concatenate([edge[1:], [len(hashes)]])[: len(edge)] - 1
        return pa.record_batch([pa.array(hashes[edge]), pa.array(tid[edge]), pa.array(tid[last])], ["hash", "a", "b"])

    each = map_batches(rows, count, "hash long, a long, b long").groupBy("hash").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    common = table(each.filter("a <> b").select("hash"), tag)
    if not bounded(common, MAX_BROADCAST):
        pairs = rows.select("tid", F.explode(F.arrays_zip("starts", "hashes")).alias("x")).select("tid", F.col("x.starts").alias("start"), F.col("x.hashes").alias("hash"))
        return pairs.join(common, "hash", "left_semi").select("tid", "start", F.col("start") + min_words)
    known = rows.sparkSession.sparkContext.broadcast(np.sort(common.toPandas()["hash"].to_numpy(dtype=np.int64)))

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, hashes = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        tid = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        hit = known.value[np.minimum(np.searchsorted(known.value, hashes), max(0, len(known.value) - 1))] == hashes if len(known.value) else np.zeros(len(hashes), bool)
        tid, starts = tid[hit], starts[hit]
        # one span for each run of windows that overlap or touch
        edge = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (starts[1:] > starts[:-1] + min_words)])) if len(tid) else np.zeros(0, np.int64)
        last = np.concatenate([edge[1:], [len(tid)]])[: len(edge)] - 1
        return pa.record_batch([pa.array(tid[edge]), pa.array(starts[edge]), pa.array(starts[last] + min_words)], ["tid", "start", "stop"])

    return map_batches(rows, mark, "tid long, start long, stop long")


def _other_text(tid: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions: each row with the nearest one of another text before and after it in its group."""
    n = len(tid)
    edge = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (group[1:] != group[:-1]), [True]]))
    run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    every, before, after = np.arange(n), edge[run] - 1, edge[run + 1]
    up = every[(before >= 0) & (group[before] == group)]
    down = every[(after < n) & (group[np.minimum(after, n - 1)] == group)]
    return np.concatenate([before[up], down]), np.concatenate([up, after[down]])


def _found(rows: pa.Table, min_words: int) -> pa.RecordBatch:
    """Spans of the matches of a sorted piece of the array, whole runs of a minimiser.

    Rows that share at least k words on the right stand together. For each k
    that a match can have there, they are ordered by their left sides, and
    each is held against the nearest one of another text.
    """
    gram, tid, at = (rows.column(c).to_numpy() for c in ("gram", "tid", "at"))
    at, n = at.astype(np.int64), len(gram)
    flat = lambda c, width: np.frombuffer(b"".join(rows.column(c).to_pylist()), ">u4").reshape(n, width).astype(np.uint32)
    right, left = flat("suffix", min_words), flat("before", WINDOW)
    reach = lambda x, i, j: ((x[i] != x[j]) | (x[i] == 0)).argmax(axis=1) + x.shape[1] * ((x[i] == x[j]) & (x[i] != 0)).all(axis=1)
    common = np.zeros(n, np.int64)  # words shared on the right with the row before
    if n > 1:
        common[1:] = np.where(gram[1:] == gram[:-1], reach(right, np.arange(1, n), np.arange(n - 1)), -1)
    common[:1] = -1
    text = np.ascontiguousarray(left.astype(">u4")).view(f"V{4 * WINDOW}").reshape(-1)
    rank = np.unique(text, return_inverse=True)[1].reshape(-1)
    # all spans of a suffix hold its position, so together they are one
    start, stop, before = at.copy(), at.copy(), np.zeros(n, np.int64)
    for k in range(min_words - WINDOW, min_words + 1):
        part = np.cumsum(common < k)
        own = np.arange(n)
        if k > min_words - WINDOW:
            split = np.zeros(n + 1, bool)
            split[before[common == k - 1]] = True
            own = np.flatnonzero(split[before])  # only rows that stood together with others than now
        before = part
        if not len(own):
            continue
        order = own[np.lexsort((tid[own], rank[own], part[own]))]
        i, j = _other_text(tid[order], part[order])
        i, j = order[i], order[j]
        r, l = reach(right, i, j), reach(left, i, j)  # noqa: E741
        good = (r >= GRAM) & (r + l >= min_words)
        for x in (i, j):
            np.minimum.at(start, x[good], at[x[good]] - l[good])
            np.maximum.at(stop, x[good], at[x[good]] + r[good])
    met = np.flatnonzero(stop > start)
    return pa.record_batch([pa.array(x[met]) for x in (tid, start, stop)], ["tid", "start", "stop"])
