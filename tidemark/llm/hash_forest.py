"""Approximate nearest neighbours (operator 3): a hash-prefix forest (LSH forest) for inner products.

Every tree is a sorted array of long hash strings, the signs of random
projections. A query descends each tree to its longest matching prefix by
binary search; then all trees ascend together, one bit at a time, until the
points below the reached prefixes are enough, and these are scored exactly.
Inner products are turned into angles by one more component that fills every
vector up to the largest norm.

Rows are dealt into shards of bounded size by a hash of their id, and the
queries go to all shards in blocks, so a task holds one shard and one block
whatever the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_tag, table

TREES, BITS = 48, 32
SHARD_ROWS, QUERY_BLOCK = 16_384, 4_096
#: Ascend until the trees together offer this many points for each of the shard (a point counts once for each tree).
OFFER = 1.0


class Forest:
    """Sorted hash strings of the points of one shard."""

    def __init__(self, points: np.ndarray, trees: int = TREES, seed: int = 11):
        self.points = points
        norms = np.sqrt((points * points).sum(axis=1))
        self.norm = norms.max() if len(norms) else 1.0
        self.planes = np.random.default_rng([seed, points.shape[1]]).standard_normal((points.shape[1] + 1, trees * BITS)).astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - (norms / self.norm) ** 2))
        codes = self._codes(np.concatenate([points / self.norm, rest[:, None]], axis=1))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def _codes(self, vectors: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(vectors), 4096):
            signs = (vectors[at : at + 4096].astype(np.float32) @ self.planes) > 0
            out.append(np.packbits(signs.reshape(len(signs), -1, BITS), axis=2).view(">u4")[:, :, 0].astype(np.int64))
        return np.concatenate(out).T.copy() if out else np.zeros((self.planes.shape[1] // BITS, 0), np.int64)

    def search(self, queries: np.ndarray, offer: float = OFFER, least: int = 200):
        """For each query the positions of its candidates."""
        n, want = len(self.points), max(offer * len(self.points), least)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        codes = self._codes(np.concatenate([queries / lengths[:, None], np.zeros((len(queries), 1))], axis=1))
        low = np.zeros((len(self.codes), len(queries)), np.int64)
        high = np.zeros_like(low)
        open_ = np.arange(len(queries))
        for level in range(BITS, -1, -1):
            mask = (1 << (BITS - level)) - 1
            for t, own in enumerate(self.codes):
                low[t, open_] = np.searchsorted(own, codes[t, open_] & ~mask)
                high[t, open_] = np.searchsorted(own, codes[t, open_] | mask, side="right")
            open_ = open_[(high[:, open_] - low[:, open_]).sum(axis=0) < want]
            if not len(open_):
                break
        for q in range(len(queries)):
            mark = np.zeros(n, dtype=bool)
            for own, a, b in zip(self.order, low[:, q].tolist(), high[:, q].tolist()):
                mark[own[a:b]] = True
            yield np.flatnonzero(mark)


def best(points: np.ndarray, ids: np.ndarray, found: np.ndarray, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best candidates, ties to the smaller id. Equal vectors get equal scores."""
    found = found[ids[found] != own_id]
    rough = points[found] @ query
    if len(found) > k:
        found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
    exact = (points[found] * query).sum(axis=1)
    order = np.lexsort((ids[found], -exact))[:k]
    return ids[found][order], exact[order]


def nearest(rows: DataFrame, is_query, k: int = 20, id_: str = "vec_id", vector: str = "embedding", tag: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k`` nearest other rows found.

    Nearness is the largest inner product in double precision; ties go to the
    smaller id. Null, empty and zero vectors, those with null or non-finite
    components, and rows without an id take no part. Vectors of different
    lengths aren't compared. Rows that repeat a query's id count as its own.
    Fewer than ``k`` rows are returned only if there are fewer. All copies of a
    vector share every hash string and so are found together.
    """
    tag = tag or new_tag("forest")
    v = F.col(f"`{vector}`").cast("array<double>")
    clean = rows.select(F.col(f"`{id_}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).filter("id IS NOT NULL AND size(v) > 0")
    clean = clean.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0.0))
    clean = table(clean.withColumn("d", F.size("v")), tag)
    sizes = clean.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    shards, blocks = max(1, math.ceil(sizes["n"] / SHARD_ROWS)), max(1, math.ceil(sizes["m"] / QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = clean.select("d", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"), "id", "v")
    queries = clean.filter("q").select("d", each(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else flat.reshape(0, 1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = arrays(left)
        query_ids, query = arrays(right)
        out_q, out_v, out_s = [], [], []
        if len(ids) and len(query_ids):
            forest = Forest(own)
            for i, found in enumerate(forest.search(query, least=10 * k)):
                if (ids[found] != query_ids[i]).sum() < k:
                    found = np.arange(len(ids))
                near, score = best(own, ids, found, query[i], query_ids[i], k)
                out_q += [query_ids[i]] * len(near)
                out_v += near.tolist()
                out_s += score.tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = points.groupBy("d", "shard", "block").cogroup(queries.groupBy("d", "shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
