"""SimHash near-dedup (operator 9) with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits, each
padded to a word of the perfect binary Golay code (23, 12, 7). A word's *near*
keys are the indices of all codewords within distance 4 of it: the one it
decodes to and, where that is at distance 3, five more. Two words at distance 2
or less share a near key (the codeword nearest to a word between them). Words
at distance 1 differ in parity, so it's enough that words of odd weight give
all near keys and words of even weight give the decoded one (*tight* keys).

Two fingerprints that differ in at most 4 bits always share one of these keys:

* a segment without errors and a near key of another one (some segment has no
  errors; the other two have 4 at most, so one of them has 2 at most), or
* the tight keys of two segments (no segment is free of errors, so two of the
  three have exactly one).

That makes about 62 keys for a fingerprint. Equal fingerprints are one class
from the start, so copies cost nothing. Keys are shuffled and sorted; each
group of a key is verified exactly and gives a spanning forest of its links,
never all pairs. Components of the links follow by grouped minima and joins.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, free_name, hand_back, map_batches, new_tag, slices, table, texts
from tidemark.llm.components import connected_components

WIDTHS = (22, 21, 21)
GENERATOR = 0b101011100011
MAX_ERRORS = 4


def _parity(info: int) -> int:
    rest = info << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return rest


class Golay:
    """Syndrome tables of the (23, 12) Golay code."""

    def __init__(self):
        self.parity = np.array([_parity(i) for i in range(4096)], dtype=np.int64)
        syndrome = lambda v: self.parity[v >> 11] ^ (v & 0x7FF)
        #: Per syndrome: the error of weight 3 or less, then the five of weight 4 if that has weight 3.
        self.errors = np.full((2048, 6), -1, dtype=np.int64)
        filled = np.zeros(2048, dtype=np.int64)
        for weight in range(5):
            for ones in combinations(range(23), weight):
                v = sum(1 << i for i in ones)
                s = int(syndrome(np.int64(v)))
                if weight < 4 or filled[s] and int(self.errors[s, 0]).bit_count() == 3:
                    self.errors[s, filled[s]] = v
                    filled[s] += 1
        self.filled = filled

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) codeword indices within distance 4 of each word, the decoded one first, and how many count."""
        s = self.parity[words >> 11] ^ (words & 0x7FF)
        return (words[:, None] ^ self.errors[s]) >> 11, self.filled[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """SimHash of a text's word shingles by XXH64 with seed 42; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - words_per_shingle + 1
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 16384):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 16384], stops[at : at + 16384])], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """``docs`` with ``text`` replaced by the signed 64-bit fingerprint ``fp``."""
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), "fp long"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words_per_shingle) for t in texts(batch.column(at))], dtype=np.uint64)
        return pa.record_batch([*(x for i, x in enumerate(batch.columns) if i != at), pa.array(fp.view(np.int64))], [*rest, "fp"])

    return map_batches(docs, run, schema)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the unsigned fingerprints, and for each key the position of its fingerprint."""
    code, parts, shift = golay(), [], 0
    for width in WIDTHS:
        bits = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        near, n = code.near(bits << (23 - width))
        parts.append((bits, near, n, np.where(np.bitwise_count(bits) & 1, n, 1)))
        shift += width
    keys, owners = [], []
    slot = np.arange(6)
    for i in range(3):
        for j in range(3):
            if i != j:
                who, k = np.nonzero(slot[None, :] < parts[j][2][:, None])
                keys.append(((i * 3 + j) << 36) | (parts[i][0][who] << 12) | parts[j][1][who, k])
                owners.append(who)
    for i, j in combinations(range(3), 2):
        live = (slot[None, :, None] < parts[i][3][:, None, None]) & (slot[None, None, :] < parts[j][3][:, None, None])
        who, k, m = np.nonzero(live)
        keys.append(((9 + i + j) << 36) | (parts[i][1][who, k] << 12) | parts[j][1][who, m])
        owners.append(who)
    return np.concatenate(keys), np.concatenate(owners)


def forest(members: np.ndarray, max_errors: int = MAX_ERRORS) -> list[tuple[int, int]]:
    """Positions of the ends of links that connect all of ``members`` that are linked at all: a spanning forest.

    Visits what is near and drops it from the rest, so a dense group costs
    about one comparison for each member, and memory is one array.
    """
    links, rest = [], np.arange(len(members))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(members[rest] ^ members[x]) <= max_errors
            if near.any():
                links += [(x, y) for y in rest[near]]
                queue += rest[near].tolist()
                rest = rest[~near]
    return links


def _links_of_sorted(keys: np.ndarray, fps: np.ndarray, max_errors: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within the groups of equal keys; keys are sorted."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    a, b = [], []
    for step in (1, 2):
        i = np.concatenate([edge[(size > step) & (size <= 3)] + k for k in range(3 - step)])
        i = i[(i + step < len(keys))]
        i = i[keys[i] == keys[i + step]]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= max_errors]
        a.append(fps[i])
        b.append(fps[i + step])
    for at, n in zip(edge[size > 3].tolist(), size[size > 3].tolist()):
        own = np.unique(fps[at : at + n])
        if len(own) > 1 and (found := forest(own, max_errors)):
            i, j = np.array(found).T
            a.append(own[i])
            b.append(own[j])
    return a, b


def links(classes: DataFrame, max_errors: int = MAX_ERRORS) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``classes`` (column fp, distinct) within ``max_errors`` bits.

    Rows of one key arrive sorted and are handled group by group; only the
    group at a batch's end is carried on, as 16 bytes for each member.
    """

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy().view(np.uint64)
        keys, who = fuzzy_keys(fps)
        return pa.record_batch([pa.array(keys), pa.array(fps[who].view(np.int64))], ["key", "fp"])

    def meet(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def flush(k, f):
            a, b = _links_of_sorted(k, f, max_errors)
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1).view(np.int64), axis=0)
            return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole > 50_000:
                yield flush(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield flush(keys, fps)

    keyed = map_batches(classes.select("fp"), spread, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, max_errors: int = MAX_ERRORS, tag: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z); shingles are ``words_per_shingle`` words joined
    by a space, repeats included; a text with fewer words is one shingle, one
    without words (null and empty texts too) has fingerprint zero and is linked
    like any other. A bit is 1 if over half of the shingles' XXH64 have it.
    Fingerprints link at ``max_errors`` (4 at most) differing bits;
    ``component_id`` is the smallest non-null doc_id reachable, null if there
    is none. Repeated rows and doc_ids stay; other columns are ignored.
    """
    if max_errors > MAX_ERRORS:
        raise ValueError("the keys find links of up to 4 bits")
    tag = tag or new_tag("simhash")
    own = table(fingerprints(docs.select("doc_id", "text"), words_per_shingle), tag)
    classes = table(own.groupBy("fp").agg(F.min("doc_id").alias("least")), tag)
    roots = table(connected_components(links(classes, max_errors), tag), tag)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


MAX_BROADCAST_IDS = 500_000
#: Counters of the shingle sketch and of one of its rows, and the most rows that meet in one piece of a key or of a candidate group.
SKETCH, SKETCH_ROW, KEY_ROWS, GROUP_ROWS = 1 << 20, 1 << 14, 4096, 256
#: Least and most bits of a parity bitmap; between them it has as many as its set has members, or up to twice that.
BITMAP_BITS = (512, 16384)


def shingle_set(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    n = len(words) - words_per_shingle + 1
    shingles = [b" ".join(words[i : i + words_per_shingle]) for i in range(n)] if n > 0 else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles)))


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Bitmap whose bits are the parities of the set's members in each slot: two bitmaps differ in no more bits than their sets in members."""
    n = min(max(BITMAP_BITS[0], 1 << max(0, len(shingles) - 1).bit_length()), BITMAP_BITS[1])
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Bitmaps:
    """Parity bitmaps of several sets. Of two lengths, the longer one is folded: its slots modulo the shorter one's."""

    def __init__(self, bitmaps: list):
        self.flat = np.frombuffer(b"".join(bitmaps), np.uint64)
        self.width = np.array([memoryview(x).nbytes // 8 for x in bitmaps], np.int64)
        self.at = np.cumsum(self.width) - self.width

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint64)
        for times in np.unique(self.width[rows] // width).tolist():
            own = np.flatnonzero(self.width[rows] == times * width)
            cells = self.flat[self.at[rows[own]][:, None] + np.arange(times * width)]
            out[own] = np.bitwise_xor.reduce(cells.reshape(-1, times, width), axis=1)
        return out

    def may_be_similar(self, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """False only for pairs that can't be similar enough, by their sizes and the bits in which their bitmaps differ."""
        n, m = sizes[i], sizes[j]
        good = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
        most = (1 - similarity) / (1 + similarity) * (n + m) + 1e-9
        least = np.minimum(self.width[i], self.width[j])
        for width in np.unique(least[good]).tolist():
            own = np.flatnonzero(good & (least == width))
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                apart = np.bitwise_count(self._folded(i[some], width) ^ self._folded(j[some], width)).sum(axis=1, dtype=np.int64)
                good[some] = apart <= most[some]
        return good


def _prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The set's first members, rarest first by the sketch: two sets similar enough always share one of them."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]))
    return shingles[order[: n - math.ceil(similarity * n - 1e-9) + 1]] if n else shingles


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _candidate_links(keys: np.ndarray, sids: np.ndarray, sizes: np.ndarray, bits: Bitmaps, similarity: float) -> np.ndarray:
    """(a, b) links that connect, within each run of equal keys, all members whose sets may be similar enough."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    inside, found = np.repeat(size, size), []
    for step in range(1, min(8, int(size.max()))):
        i = np.flatnonzero((keys[:-step] == keys[step:]) & (inside[:-step] <= 8))
        i = i[bits.may_be_similar(sizes, i, i + step, similarity)]
        found.append(np.stack([sids[i], sids[i + step]], axis=1))
    for at, n in zip(edge[size > 8].tolist(), size[size > 8].tolist()):
        rest = np.arange(at, at + n)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = bits.may_be_similar(sizes, np.full(len(rest), x), rest, similarity)
                if near.any():
                    found.append(np.stack([np.full(int(near.sum()), sids[x]), sids[rest[near]]], axis=1))
                    queue += rest[near].tolist()
                    rest = rest[~near]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _verified_links(sids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of all pairs whose shingle sets are similar enough."""
    n, links_ = len(sids), []
    root, sizes = list(range(n)), np.array([len(s) for s in sets])
    bits = Bitmaps([_parities(s) for s in sets])

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(1, n):
        for j in np.flatnonzero(bits.may_be_similar(sizes, np.full(i, i), np.arange(i), similarity)).tolist():
            a, b = top(i), top(j)
            if a != b and _similar(sets[i], sets[j], similarity):
                root[max(a, b)] = min(a, b)
                links_.append((sids[j], sids[i]))
    return links_


def _pieces(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``rows`` with a column ``piece``: a key of more than ``most`` rows is dealt into blocks, and each two blocks (and each one) meet in a piece."""
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("_blocks")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    piece = F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return other.withColumn("piece", piece).drop("_blocks", "_own", "_other")


def _runs(batches, most: int, work):
    """``work`` of every so many rows of batches sorted by the first column, whole runs of it at a time."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows > most and batch.column(0)[batch.num_rows - 1].as_py() != held[0].column(0)[0].as_py():
            whole = pa.Table.from_batches(held).combine_chunks()
            first = whole.column(0).to_numpy()
            cut = int(np.flatnonzero(first != first[-1])[-1]) + 1
            yield work(whole.slice(0, cut).combine_chunks())
            held = whole.slice(cut).combine_chunks().to_batches()
            rows = whole.num_rows - cut
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _binary(values) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, tag: str | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the smallest doc_id (none last).

    Two documents are near duplicates if the sets of their shingles of
    ``words_per_shingle`` words have a Jaccard similarity of ``similarity`` or
    more; groups are the components of these links, and all of them are found:

    1. texts of equal sets are one class; a sketch counts shingles over all;
    2. fingerprints within four bits, found by their Golay keys, are
       candidates: most copies with small edits;
    3. 64 bits can't tell 0.8 from less (such texts differ in about ten bits),
       so the rest is found exactly: a class meets others under the shingles
       of its prefix, the rarest ones by the sketch, of which two similar sets
       share one whatever its order is; each key gives a spanning forest of
       its candidates, never all pairs;
    4. candidates that sizes and parity bitmaps rule out go; within each
       component of the others all pairs are held against whole sets, unless
       they are connected already.

    Keys and components of very many classes are dealt into blocks that meet
    two by two. Texts without words are all copies of each other. A document
    is told by doc_id and text (its 64-bit hash), so texts that share a doc_id
    or have none are documents of their own, and stay unless they are near
    duplicates. Of a group's rows that share the smallest doc_id that of the
    smallest text hash stays, and of rows that repeat it the first by all
    columns. Other columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    tag = tag or new_tag("simhash")
    # from here on every list of columns starts with these, so others can't clash
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    every, docs = docs, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash.alias("h"))
    ids, at, hashes = 0, 1, 2

    names = ["doc_id", "h", "sid", "fp", "part", "counts"]

    def read(batches):
        counts = np.zeros(SKETCH, np.int32)
        for batch in (piece for x in batches for piece in slices(x)):
            found = [shingle_set(t, words_per_shingle) for t in texts(batch.column(at))]
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.int32)
            own = np.array([_set_id(s) for s in found], np.uint64).view(np.int64)
            fps = np.array([fingerprint(t, words_per_shingle) for t in texts(batch.column(at))], np.uint64).view(np.int64)
            n = len(found)
            yield pa.record_batch([batch.column(ids), batch.column(hashes), pa.array(own), pa.array(fps), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        parts = [k for k in range(SKETCH // SKETCH_ROW) if counts[k * SKETCH_ROW : (k + 1) * SKETCH_ROW].any()]
        m = len(parts)
        yield pa.record_batch([*[pa.nulls(m, pa.int64())] * 4, pa.array(parts, pa.int32()), _binary(counts[k * SKETCH_ROW : (k + 1) * SKETCH_ROW] for k in parts)], names)
        hand_back()

    def summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROW, np.int64)
        for v in rows.column("counts"):
            total += np.frombuffer(v.as_buffer(), np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": _binary([np.minimum(total, 2**31 - 1).astype(np.int32)])})

    both = table(docs.mapInArrow(read, "doc_id long, h long, sid long, fp long, part int, counts binary"), tag)
    own = both.filter("part IS NULL").select("doc_id", "h", "sid", "fp")
    repeated = not bounded(own.groupBy("doc_id", "h").count().filter("count > 1"), 0)
    counts = np.zeros(SKETCH, np.int32)
    for row in both.filter("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(summed, "part int, counts binary").collect():
        counts[row.part * SKETCH_ROW : (row.part + 1) * SKETCH_ROW] = np.frombuffer(row.counts, np.int32)
    shared = spark.sparkContext.broadcast(counts)
    # the first document of a class; without a doc_id it comes last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = table(own.groupBy("sid").agg(least.alias("least"), F.min("fp").alias("fp")), tag)

    def of_classes(some: DataFrame) -> DataFrame:
        """The text and sid of the first document of each of ``some`` classes (sid, least), and what else they hold."""
        some = some.select(F.col("least.doc_id").alias("id"), F.col("least.h").alias("first"), *(c for c in some.columns if c != "least"))
        some = F.broadcast(some) if bounded(some, MAX_BROADCAST_IDS) else some
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("first"))).drop("doc_id", "h", "id", "first")

    def once(rows: DataFrame) -> DataFrame:
        """A class of which several rows repeat the first document comes up several times; one is enough."""
        return rows.dropDuplicates(["sid"]) if repeated else rows

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(sid, s) for sid, t in zip(batch.column(1).to_pylist(), texts(batch.column(0))) if _set_id(s := shingle_set(t, words_per_shingle)) == sid % 2**64 and len(s)]
        keys = [_prefix(s, shared.value, similarity) for _, s in rows]
        stops = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
        flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
        return pa.record_batch([pa.array([sid for sid, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int32()), _binary(_parities(s) for _, s in rows), pa.ListArray.from_arrays(stops, pa.array(flat))], ["sid", "n", "bits", "keys"])

    marked = table(once(map_batches(of_classes(classes.select("sid", "least")), mark, "sid long, n int, bits binary, keys array<long>")), tag)

    def repeated_keys(rows: pa.Table) -> pa.RecordBatch:
        keys, sids = (rows.column(i).to_numpy() for i in range(2))
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([edge, [len(keys)]]))
        size = np.repeat(size, size)
        more = size > 1
        return pa.record_batch([pa.array(keys[more]), pa.array(sids[more]), pa.array(size[more])], ["key", "sid", "size"])

    keyed = marked.select(F.explode("keys").alias("key"), "sid").repartition("key").sortWithinPartitions("key")
    keyed = table(keyed.mapInArrow(lambda batches: _runs(batches, 50_000, repeated_keys), "key long, sid long, size long"), tag)

    def meet(rows: pa.Table) -> pa.RecordBatch:
        piece, sids, n = (rows.column(i).to_numpy() for i in range(3))
        bits = Bitmaps(rows.column(3).to_pylist())
        found = _candidate_links(piece, sids, n.astype(np.int64), bits, similarity)
        return pa.record_batch([pa.array(found[:, 0].copy(), pa.int64()), pa.array(found[:, 1].copy(), pa.int64())], ["a", "b"])

    met = _pieces(keyed.join(marked.select("sid", "n", "bits"), "sid"), "key", "size", KEY_ROWS).select("piece", "sid", "n", "bits")
    met = met.repartition("piece").sortWithinPartitions("piece")
    candidates = met.mapInArrow(lambda batches: _runs(batches, 20_000, meet), "a long, b long").filter("a <> b")
    candidates = candidates.union(_fingerprint_candidates(classes, marked, similarity, tag)).distinct()
    groups = table(connected_components(candidates, tag), tag).select(F.col("node").alias("sid"), F.col("root").alias("near"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s) for i, (sid, t) in enumerate(zip(batch.column(1).to_pylist(), texts(batch.column(0)))) if _set_id(s := shingle_set(t, words_per_shingle)) == sid % 2**64]
        kept = batch.take(pa.array([i for i, _ in rows], pa.int64()))
        return pa.record_batch([kept.column(1), kept.column(2), kept.column(3), _binary(s for _, s in rows)], ["sid", "near", "size", "shingles"])

    def verify(rows: pa.Table) -> pa.RecordBatch:
        piece, sids = rows.column(0).to_numpy(), rows.column(1).to_pylist()
        values = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column(2)]
        edge = [*np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])).tolist(), len(piece)]
        found = [x for a, b in zip(edge, edge[1:]) for x in _verified_links(sids[a:b], values[a:b], similarity)]
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    sizes = groups.groupBy("near").agg(F.count("*").alias("size"))
    members = table(groups.join(sizes, "near").join(classes, "sid").select("least", "sid", "near", "size"), tag)
    members = once(map_batches(of_classes(members), sets, "sid long, near long, size long, shingles binary"))
    members = _pieces(members, "near", "size", GROUP_ROWS).select("piece", "sid", "shingles")
    members = members.repartition("piece").sortWithinPartitions("piece")
    linked = members.mapInArrow(lambda batches: _runs(batches, 1_000, verify), "a long, b long")
    tops = connected_components(linked, tag).select(F.col("node").alias("sid"), F.col("root").alias("top"))
    heads = classes.join(tops, "sid", "left").groupBy(F.coalesce("top", "sid").alias("top")).agg(F.min("least").alias("head")).select("head.doc_id", "head.h")
    first = heads.select(F.col("doc_id").alias("id"), F.col("h").alias("first"))
    dropped = own.select("doc_id", "h").distinct().join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("first")), "left_anti")
    id_, hash_ = (free_name(c, every.columns) for c in ("gone", "gone_text"))
    dropped = table(dropped.select(F.col("doc_id").alias(id_), F.col("h").alias(hash_)), tag)
    gone = F.broadcast(dropped) if bounded(dropped, MAX_BROADCAST_IDS) else dropped
    kept = every.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_)), "left_anti")
    if not repeated:
        return kept
    row = F.min(F.struct(*(F.col(f"`{c}`") for c in every.columns))).alias("row")
    return kept.groupBy(F.col("doc_id").alias("id"), text_hash.alias("h")).agg(row).select("row.*")


def _fingerprint_candidates(classes: DataFrame, marked: DataFrame, similarity: float, tag: str) -> DataFrame:
    """(a, b): classes whose fingerprints are within four bits, without those that sizes and bitmaps rule out.

    ``classes`` has (sid, fp); of several classes with one fingerprint the
    smallest stands for it, and the others are held against that one.
    """
    prints = table(classes.groupBy("fp").agg(F.min("sid").alias("b")), tag)
    near = links(prints).join(prints.select(F.col("fp").alias("a"), F.col("b").alias("sa")), "a").join(prints.select(F.col("fp").alias("b"), F.col("b").alias("sb")), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    same = classes.join(prints, "fp").select(F.col("sid").alias("a"), "b").filter("a <> b")
    side = lambda x, n, bits: marked.select(F.col("sid").alias(x), F.col("n").alias(n), F.col("bits").alias(bits))
    pairs = near.union(same).join(side("a", "n", "bits"), "a").join(side("b", "m", "others"), "b").select("a", "b", "n", "m", "bits", "others")

    def possible(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        bits, one = Bitmaps(batch.column(4).to_pylist() + batch.column(5).to_pylist()), np.arange(len(n))
        return pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(bits.may_be_similar(np.concatenate([n, m]), one, one + len(n), similarity)))

    return map_batches(pairs, possible, "a long, b long")
