"""Packing (operator 8): lexical retrieval packing with a sharded BM25 inverted index.

1. Every text is tokenized once; ids go to a scratch table as 16- or 32-bit
   integers. Document frequencies and the mean length are counted over all
   documents (one row for each id of the vocabulary and task, then summed).
2. Each document is keyed by its heaviest BM25 term that another document has
   too, and dealt to shards by that key, so documents of one rare subject meet
   in one shard whatever the size of the corpus. A key of more ids than a shard
   should have is split into several shards.
3. Each shard builds its inverted index of BM25 weights. A seed document asks
   for its unused neighbours by its heaviest terms; they fill the seed's window
   best first, and a document that doesn't fit is cut there and starts the
   next window as its seed. So windows are full but for a shard's last one,
   which is cut into powers of two: these aren't padded.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, hand_back, map_batches, new_tag, release, slices, table
from tidemark.llm.tokens import tokenizer_at

WINDOW, END_ID = 4096, 2
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: A seed asks with so many of its heaviest terms: nearly all best neighbours by whole queries come first, at half the work.
QUERY_TERMS = 128
#: Neighbours that one request returns; a window that uses them up asks again for the rest.
NEIGHBOURS = 256
#: Texts are tokenized so many at once (or one): the more there are, the oftener a word is found again.
BATCH_BYTES, BATCH_ROWS = 6 << 20, 2000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n): each text's ids and ``end_id``, as little-endian 32-bit integers; null is as empty."""

    def run(batches):
        tokenizer = tokenizer_at(path)
        for batch in (piece for x in batches for piece in slices(x, BATCH_BYTES, BATCH_ROWS)):
            found, sizes = [], []
            for own in tokenizer.encode_batch(batch.column(1)):
                ids = np.append(own, np.uint32(end_id)).astype("<u2" if tokenizer.narrow else "<u4")
                found.append(ids.tobytes())
                sizes.append(len(ids))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "ids", "n"])
        hand_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n long")


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(id, df): documents that hold each id; every task sends one row for each id it has seen."""

    def run(batches):
        seen = np.zeros(0, dtype=np.int64)
        for batch in (piece for x in batches for piece in slices(x)):
            _, term, _ = terms_of_all([unpack(data.as_buffer(), n) for data, n in zip(batch.column(0), batch.column(1).to_pylist())])
            own = np.bincount(term, minlength=len(seen))
            own[: len(seen)] += seen
            seen = own
        ids = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())], ["id", "df"])

    return tokens.select("ids", "n").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))


def unpack(data, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document in order, and how often each occurs."""
    return terms_of_all([ids])[1:]


def terms_of_all(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of documents by document, in order: place of the document, id, how often it occurs. One sort for all documents."""
    kind = np.result_type(*docs)
    bits = 8 * kind.itemsize
    wide = np.uint32 if bits == 16 and len(docs) <= 1 << 16 else np.uint64
    both = np.repeat(np.arange(len(docs), dtype=wide) << wide(bits), np.fromiter(map(len, docs), np.int64, len(docs)))
    both |= np.concatenate(docs).astype(wide)
    both.sort()
    edge = np.concatenate([[0], np.flatnonzero(both[1:] != both[:-1]) + 1])
    tf, both = np.diff(edge, append=len(both)), both[edge]
    return (both >> wide(bits)).astype(np.int32), both.astype(kind), tf


def bm25(tf: np.ndarray, idf: np.ndarray, n: int | np.ndarray, mean_length: float) -> np.ndarray:
    """Weights of documents' terms of frequencies ``tf``; ``n`` is the length of a term's document."""
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean_length))).astype(np.float32)


def heaviest_shared(docs: list[np.ndarray], idf: np.ndarray, shared: np.ndarray, mean_length: float) -> np.ndarray:
    """The heaviest term of each document that others have too, ties to the smaller id; -1 if there is none."""
    owner, term, tf = terms_of_all(docs)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    weight = np.where(shared[term], bm25(tf, idf[term], sizes[owner], mean_length), -1.0)
    best = np.maximum.reduceat(weight, np.searchsorted(owner, np.arange(len(docs))))
    at = np.flatnonzero(weight == best[owner])
    first = at[np.searchsorted(owner[at], np.arange(len(docs)))]
    return np.where(best > 0, term[first].astype(np.int64), -1)


class ShardIndex:
    """Inverted index of BM25 weights over one shard's documents.

    Documents whose ``unused`` is set to false are no neighbours any more; their
    entries are dropped whenever a quarter of the documents listed is used.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int = QUERY_TERMS):
        owner, term, tf = terms_of_all(docs)
        weight = bm25(tf, idf[term], np.fromiter(map(len, docs), np.int64, len(docs))[owner], mean_length)
        edges = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        self.queries = []
        for a, b in zip(edges[:-1], edges[1:]):
            top = term[a:b] if b - a <= query_terms else term[a:b][np.argpartition(-weight[a:b], query_terms)[:query_terms]]
            self.queries.append(top.astype(np.int64))
        order = np.argsort(term, kind="stable")
        self.owners, self.weights = owner[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused, self.listed = np.ones(len(docs), dtype=bool), len(docs)

    def _drop_used(self, left: int) -> None:
        keep = self.unused[self.owners]
        self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
        self.owners, self.weights, self.listed = self.owners[keep], self.weights[keep], left

    def neighbours(self, seed: int) -> np.ndarray:
        """The ``NEIGHBOURS`` best unused documents that share a heavy term with the seed, best first; ties by position."""
        left = np.count_nonzero(self.unused)
        if left < 0.75 * self.listed:
            self._drop_used(left)
        asked = self.queries[seed]
        hit = list(map(slice, self.first[asked].tolist(), self.first[asked + 1].tolist()))
        owners, weights = np.concatenate([self.owners[x] for x in hit]), np.concatenate([self.weights[x] for x in hit])
        scores = np.bincount(owners, weights, len(self.unused))
        found = np.flatnonzero((scores > 0) & self.unused)
        if len(found) > NEIGHBOURS:
            found = found[scores[found] >= np.partition(scores[found], len(found) - NEIGHBOURS)[len(found) - NEIGHBOURS]]
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW, query_terms: int = QUERY_TERMS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every id once."""
    index, pieces = ShardIndex(docs, idf, mean_length, query_terms), []
    sequence = at = next_seed = seed = 0
    queue: list[int] = []
    for _ in range(len(docs)):
        while queue and not index.unused[queue[-1]]:
            queue.pop()
        if not queue and at:  # the seed's neighbours are used up: those beyond the first ones
            queue = index.neighbours(seed)[::-1].tolist()
        if queue:
            doc = queue.pop()
        else:
            while not index.unused[next_seed]:
                next_seed += 1
            doc = seed = next_seed
        index.unused[doc] = False
        fresh, start, left = at == 0, 0, len(docs[doc])
        while left:
            n = min(left, window - at)
            pieces.append((doc, start, n, sequence, at))
            start, left, at = start + n, left - n, at + n
            if at == window:
                sequence, at, fresh = sequence + 1, 0, True
        if at and fresh:
            seed, queue = doc, []
    return _powers(pieces, sequence, at)


def _powers(pieces: list[tuple[int, int, int, int, int]], last: int, rest: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the unfilled last sequence of ``rest`` ids into sequences of powers of two."""
    out = [p for p in pieces if p[3] < last]
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    sequence, at = last, 0
    for doc, start, n, _, _ in (p for p in pieces if p[3] == last):
        while n:
            m = min(n, sizes[0] - at)
            out.append((doc, start, m, sequence, at))
            start, n, at = start + m, n - m, at + m
            if at == sizes[0]:
                sizes, sequence, at = sizes[1:], sequence + 1, 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, query_terms: int = QUERY_TERMS, tag: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document of its own, whatever its doc_id; its ids
    and the end id lie in exactly one piece each. Null and empty texts are the
    end id alone. A document longer than the window spans several sequences.
    ``window`` is a power of two; a seed's neighbours are asked for by
    ``query_terms`` of its heaviest terms. Other columns are ignored; an empty table
    gives no pieces. Documents without a term that others share are dealt by row.
    """
    tag = tag or new_tag("packing")
    tokens = table(tokenize(docs, tokenizer_path), f"{tag}/tokens")
    dealt, shared, mean_length = deal(tokens, shard_tokens, tag)

    def run(rows: pa.Table) -> pa.Table:
        shard, ids, n = rows.column("shard")[0].as_py(), rows.column("ids"), rows.column("n").to_pylist()
        own = [unpack(data.as_buffer(), size) for data, size in zip(ids, n)]
        names, order = rows.column("doc_id").to_pylist(), range(len(own))
        order = sorted(order, key=lambda i: (names[i] is None, names[i] or 0, n[i], own[i].tobytes() if len(set(names)) < len(names) else b""))
        own, names = [own[i] for i in order], [names[i] for i in order]
        found = pack_shard(own, shared.value, mean_length, window, query_terms)
        crc = [zlib.crc32(own[d][a : a + k].astype("<u4").tobytes()) for d, a, k, _, _ in found]
        d, a, k, s, o = (np.array(x, dtype=np.int64) for x in zip(*found))
        size = np.array([len(x) for x in own], dtype=np.int64)[d]
        return pa.table({"doc_id": pa.array([names[i] for i in d], pa.int64()), "start": a, "length": k, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": size, "sequence_id": s + (np.int64(shard) << 32), "offset": o})

    return dealt.groupBy("shard").applyInArrow(run, PIECES)


def deal(tokens: DataFrame, shard_tokens: int, tag: str):
    """``tokens`` with ``shard``; the broadcast inverse document frequencies; the mean length.

    Keys are hashed to as many shards as the ids need. Those of more ids than a
    quarter of a shard get shards of their own, as many as they fill: at most
    four for each shard's worth of ids, so their table is small. ``tokens`` is
    a scratch table (``tag``/tokens) that a keyed one takes the place of.
    """
    total = tokens.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    shards, mean_length = max(1, math.ceil((total["n"] or 0) / shard_tokens)), (total["n"] or 1) / max(1, total["docs"])
    df = document_frequencies(tokens).toPandas()  # a row for each id of the vocabulary at most
    counts = np.zeros(int(df["id"].max()) + 1 if len(df) else 1)
    counts[df["id"].to_numpy(dtype=np.int64)] = df["df"]
    idf = tokens.sparkSession.sparkContext.broadcast(np.log1p((total["docs"] - counts + 0.5) / (counts + 0.5)).astype(np.float32))
    if shards == 1:
        return tokens.withColumn("shard", F.lit(0).cast("long")), idf, mean_length
    common = tokens.sparkSession.sparkContext.broadcast(counts >= 2)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = [unpack(data.as_buffer(), n) for data, n in zip(batch.column(1), batch.column(2).to_pylist())]
        key = heaviest_shared(docs, idf.value, common.value, mean_length)
        return pa.record_batch([*batch.columns, pa.array(key, pa.int64())], ["doc_id", "ids", "n", "key"])

    keyed = table(map_batches(tokens, mark, "doc_id long, ids binary, n long, key long"), tag)
    release(tokens.sparkSession, f"{tag}/tokens")
    own = keyed.filter("key >= 0").groupBy("key").agg(F.ceil(F.sum("n") / F.lit(shard_tokens)).cast("int").alias("split"), F.sum("n").alias("size"))
    large = table(own.filter(F.col("size") > shard_tokens // 4).select("key", "split"), tag)
    large = F.broadcast(large) if bounded(large, 4 * shards) else large
    # equal rows are told apart by their place in the table, so that a text that a third of all rows repeat is dealt out too
    place = F.xxhash64("doc_id", "ids", F.monotonically_increasing_id())
    keyed = keyed.withColumn("place", place).join(large, "key", "left")
    alone = F.pmod(F.xxhash64("key", F.pmod("place", F.col("split"))), F.lit(2**30)) + shards
    shard = F.when(F.col("key") < 0, F.pmod("place", F.lit(shards))).when(F.col("split").isNotNull(), alone).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    return keyed.select("doc_id", "ids", "n", shard.cast("long").alias("shard")), idf, mean_length
