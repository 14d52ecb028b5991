"""Line dedup (operator 10): drop lines that many documents share.

Method: a sharded minimal perfect hash over the distinct line hashes that
reach the threshold, indexing compact fingerprint and count arrays. Documents
probe these arrays; their lines are never joined.

1. One pass over the texts emits, for each Arrow batch, the distinct line
   hashes with the number of documents of the batch that hold them. Only
   (hash, hash, count) rows are shuffled and summed.
2. The hashes found in ``min_docs`` documents are dealt by their top bits into
   shards of bounded size; each shard becomes a perfect hash (levels of bit
   arrays with ranks) with a 64-bit fingerprint and a count per slot.
3. The shards are broadcast if they have at most ``max_broadcast_keys`` keys in
   all (about 14 bytes each, so the size is proven before). Otherwise the
   probes, one for each distinct line of a text, are shuffled to the shard that
   holds their range and probe its arrays there; a shard that very many texts
   ask is copied, and each copy answers a share of them.

Two 64-bit halves of XXH3-128 identify a line: one picks the slot, the other is
the fingerprint.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, free_name, hand_back, map_batches, new_tag, slices, table, texts

SHARD_KEYS = 1 << 16
LEVELS = 24
#: Probes that one copy of a shard answers.
PROBES = 1 << 20
MAX_BROADCAST_SHARDS = 200_000
#: Rows of one text that meet its found lines in one task.
MOST_COPIES = 4_096


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: white space stripped at both ends, A-Z lower-cased."""
    lines = text.split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of each key's XXH3-128."""
    joined = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(joined, dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash over 64-bit keys with a fingerprint and a count for each.

    Keys that collide on a level move to the next; a key's slot is the rank of
    its bit. Keys left after the last level (two lines with one key, say) are
    kept in a dictionary.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.words, self.ranks, self.sizes, order, rest = [], [], [], [], np.arange(len(keys))
        base = 0
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, 2 * len(rest))
            at = _slots(keys[rest], level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]])
            self.words.append(words)
            self.ranks.append(ranks.astype(np.int64))
            self.sizes.append(size)
            order.append(rest[alone][np.argsort(at[alone], kind="stable")])
            base += int(alone.sum())
            rest = rest[~alone]
        placed = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        self.prints, self.counts = prints[placed], np.minimum(counts[placed], 0xFFFFFFFF).astype(np.uint32)
        self.rest = {(int(keys[i]), int(prints[i])): int(counts[i]) for i in rest}

    def counts_of(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count stored for each key, 0 for keys that aren't in the index."""
        out = np.zeros(len(keys), dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks, size) in enumerate(zip(self.words, self.ranks, self.sizes)):
            if not len(open_):
                break
            at = _slots(keys[open_], level, size).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot = (ranks[at >> 6] + below)[hit]
            own = open_[hit]
            same = self.prints[slot] == prints[own]
            out[own[same]] = self.counts[slot[same]]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get((int(keys[i]), int(prints[i])), 0)
        if self.rest:
            for i in np.flatnonzero(out == 0):
                out[i] = self.rest.get((int(keys[i]), int(prints[i])), 0)
        return out


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(h, f, n) of the lines found in at least ``min_docs`` documents (rows), whatever their number within one."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[bytes] = []
        for text in texts(batch.column(0)):
            keys = {k for k in line_keys(text)[1] if k}
            found += keys if min_chars <= 1 else [k for k in keys if len(k.decode()) >= min_chars]
        halves, n = np.unique(digests(found), axis=0, return_counts=True) if found else (np.zeros((0, 2), np.uint64), np.zeros(0))
        return pa.record_batch([pa.array(halves[:, 0].view(np.int64)), pa.array(halves[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], ["h", "f", "n"])

    each = map_batches(docs.select("text"), count, "h long, f long, n long")
    return each.groupBy("h", "f").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)


def line_index(frequent: DataFrame, shard_bits: int) -> DataFrame:
    """One row for each shard: its number and its pickled ``PerfectHash``."""

    def build(key, rows):
        own = PerfectHash(rows.h.to_numpy().view(np.uint64), rows.f.to_numpy().view(np.uint64), rows.n.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "arrays": [pickle.dumps(own)]})

    shard = F.shiftrightunsigned("h", 64 - shard_bits) if shard_bits else F.lit(0).cast("long")
    return frequent.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, arrays binary")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, max_broadcast_keys: int = 2_000_000, tag: str | None = None) -> DataFrame:
    """``docs`` with the lines of frequent keys removed from ``text``, plus ``n_lines`` and ``n_dropped``.

    A key is the line stripped of ASCII white space at both ends with A-Z
    lower-cased; keys of ``min_chars`` code points or more found in ``min_docs``
    documents or more go, in every document. Each row is a document, rows with
    equal or null ``doc_id`` included. A null or empty text is one empty line
    and comes back empty; empty keys always stay. Input columns called
    ``n_lines`` or ``n_dropped`` are replaced; all others are kept as they are.
    """
    spark = docs.sparkSession
    tag = tag or new_tag("line_dedup")
    docs = docs.drop("n_lines", "n_dropped")
    frequent = table(frequent_lines(docs, min_docs, min_chars), tag)
    n = frequent.count()
    shard_bits = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))
    index = line_index(frequent, shard_bits)
    if n > max_broadcast_keys:
        return _drop_by_probes(docs, table(index, tag), shard_bits, tag)
    return _rewrite(docs, spark.sparkContext.broadcast({r.shard: r.arrays for r in index.collect()}), shard_bits)


def _shard_of(halves: np.ndarray, shard_bits: int) -> np.ndarray:
    """The number of the shard that holds each line's range: the top bits of the first half."""
    return (halves[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(halves), np.int64)


def _rewrite(docs: DataFrame, shards, shard_bits: int) -> DataFrame:
    at = docs.columns.index("text")
    schema = f"{_ddl(docs)}, n_lines long, n_dropped long"

    def run(batches):
        index = {k: pickle.loads(v) for k, v in shards.value.items()}
        for batch in (piece for x in batches for piece in slices(x)):
            kept, total, dropped, lines, keys = [], [], [], [], []
            for text in texts(batch.column(at)):
                own, own_keys = line_keys(text)
                lines.append(own)
                keys += own_keys
            halves = digests(keys)
            drop = np.zeros(len(keys), dtype=bool)
            shard = _shard_of(halves, shard_bits)
            for s, arrays in index.items():
                own = np.flatnonzero(shard == s)
                drop[own] = arrays.counts_of(halves[own, 0], halves[own, 1]) > 0
            start = 0
            for own in lines:
                gone = drop[start : start + len(own)]
                start += len(own)
                n = int(gone.sum())
                kept.append(b"\n".join(own if not n else [x for x, g in zip(own, gone.tolist()) if not g]).decode())
                total.append(len(own))
                dropped.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(kept, pa.string())
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names, "n_lines", "n_dropped"])
        hand_back()

    return docs.mapInArrow(run, schema)


def _drop_by_probes(docs: DataFrame, index: DataFrame, shard_bits: int, tag: str, most_probes: int = PROBES) -> DataFrame:
    """For an index too large to broadcast: the line hashes of each distinct text go to the shards that may hold them.

    Only 16-byte hashes are shuffled; a text gets back those found, both halves
    of each. A shard is copied so often that a copy answers about
    ``most_probes`` probes, so a line that a third of all texts hold is dealt
    out. A text of more than ``MOST_COPIES`` rows meets its answer in several
    tasks: its rows go there by the partition that they come from.
    """
    at = docs.columns.index("text")
    key, hits, turn = (free_name(c, docs.columns) for c in ("text_key", "hits", "turn"))
    text_hash = F.xxhash64("text")
    often = table(docs.groupBy(text_hash.alias("text_hash")).count().filter(F.col("count") > MOST_COPIES).select("text_hash", F.ceil(F.col("count") / F.lit(MOST_COPIES)).cast("int").alias("turns")), tag)
    often = F.broadcast(often) if bounded(often, MAX_BROADCAST_SHARDS) else often

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes, found = [], [], []
        for text, text_hash in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            keys = list({k for k in line_keys(text)[1] if k})
            found += keys
            ids += [xxhash.xxh3_128_digest(text)] * len(keys)
            hashes += [text_hash] * len(keys)
        halves = digests(found)
        return pa.record_batch([pa.array(ids, pa.binary()), pa.array(hashes, pa.int64()), pa.array(halves[:, 0].view(np.int64)), pa.array(halves[:, 1].view(np.int64)), pa.array(_shard_of(halves, shard_bits))], ["text_key", "text_hash", "h", "f", "shard"])

    def answer(shards: pa.Table, probes: pa.Table) -> pa.Table:
        if shards.num_rows and probes.num_rows:
            own = pickle.loads(shards.column("arrays")[0].as_py())
            h, f = (probes.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
            probes = probes.take(pa.array(np.flatnonzero(own.counts_of(h, f))))
        return (probes if shards.num_rows else probes.slice(0, 0)).select(["text_key", "text_hash", "h", "f"])

    def identify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [xxhash.xxh3_128_digest(t) for t in texts(batch.column(at))]
        return pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, key])

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, dropped = [], [], []
        for text, found in zip(texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
            lines, keys = line_keys(text)
            gone = {(x["h"], x["f"]) for x in found or ()}
            own = [x for x, pair in zip(lines, map(tuple, digests(keys).view(np.int64).tolist())) if pair not in gone]
            kept.append(b"\n".join(own).decode())
            total.append(len(lines))
            dropped.append(len(lines) - len(own))
        columns = list(batch.columns)[:-1]
        columns[at] = pa.array(kept, pa.string())
        return pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    probes = table(map_batches(docs.select("text", text_hash.alias("text_hash")), probe, "text_key binary, text_hash long, h long, f long, shard long").distinct(), tag)
    # a row for each shard of the index, that is one for SHARD_KEYS of its keys
    copies = table(probes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(most_probes)).cast("int").alias("copies")), tag)
    copies = F.broadcast(copies) if bounded(copies, MAX_BROADCAST_SHARDS) else copies
    dealt = probes.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("text_key"), F.col("copies")).cast("int")).drop("copies")
    shards = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "arrays")
    found = shards.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInArrow(answer, "text_key binary, text_hash long, h long, f long")
    found = found.groupBy("text_hash", F.col("text_key").alias(key)).agg(F.collect_set(F.struct("h", "f")).alias(hits))
    turns = F.coalesce(F.col("turns"), F.lit(1))
    found = found.join(often, "text_hash", "left").select(key, hits, F.explode(F.sequence(F.lit(0), turns - 1)).alias(turn))
    # the input's columns travel as one struct beside the hash, so that none of them can clash
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text_hash.alias("text_hash"), F.spark_partition_id().alias("part"))
    told = told.join(often, "text_hash", "left").select("doc.*", F.pmod("part", turns).cast("int").alias(turn))
    marked = map_batches(told, identify, f"{_ddl(docs)}, `{turn}` int, `{key}` binary").join(found, [key, turn], "left")
    marked = marked.select(*[F.col(f"`{c}`") for c in docs.columns], hits)
    return map_batches(marked, rewrite, f"{_ddl(docs)}, n_lines long, n_dropped long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
