"""Quality classifier (operator 5): a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees: round after round, each feature in turn gets
a small tree on its quantile bins, fitted to the gradient of the log loss, so
every feature ends up with one lookup table. Pairs of features are then ranked
by how much a table of 4 x 4 coarse bins explains of what is left, and the best
get boosted tables of their own. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, texts
from tidemark.llm.text_stats import QUALITY_FEATURES, quality_stats, with_quality_stats

#: The model is fitted on this many labelled rows at most, those of the smallest hashes of their doc_id.
MAX_TRAINING_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 64, 8, 150, 60, 6, 0.15, 3
THRESHOLD = 0.3


@dataclass
class AdditiveModel:
    """Intercept, and for each feature its bin edges and table; for each pair its coarse edges and table."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``, by vectorised bin additions."""
        sums = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            sums += values[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            sums += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float = 5.0) -> np.ndarray:
    """Step values of a tree with up to ``leaves`` leaves on ordered bins, best split first (Newton leaf values)."""
    spans = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for span in spans:
            a, b = span
            cuts = np.arange(a + 1, b)
            if len(cuts):
                wins = gain(a, cuts) + (g[b] - g[cuts]) ** 2 / (h[b] - h[cuts] + 1.0) - gain(a, b)
                wins[(h[cuts] - h[a] < least / 4) | (h[b] - h[cuts] < least / 4)] = 0
                if wins.max() > best[0]:
                    best = (wins.max(), span, int(cuts[wins.argmax()]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on features ``x`` and labels ``y`` (0 or 1). Without rows every score is 0.5; with one label only, near it."""
    n, d = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    edges = [_quantile_edges(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = float(np.log(prior / (1 - prior)))
    model = AdditiveModel(intercept, edges, tables, [], [_quantile_edges(x[:, j], PAIR_BINS) for j in range(d)], [])
    if n == 0 or y.min() == y.max():
        return model
    sums = np.full(n, intercept)
    probability = lambda: 1 / (1 + np.exp(-sums))
    for _ in range(ROUNDS):
        for j in range(d):
            p = probability()
            step = RATE * _tree(np.bincount(bins[j], y - p, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j])), LEAVES)
            tables[j] += step
            sums += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    p, worth = probability(), []
    for i, j in combinations(range(d), 2):
        cell = coarse[i] // 2 * 8 + coarse[j] // 2
        worth.append(((np.bincount(cell, y - p, 64) ** 2 / (np.bincount(cell, p * (1 - p), 64) + 1.0)).sum(), i, j))
    for _, i, j in sorted(worth, reverse=True)[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            p, cell = probability(), coarse[i] * values.shape[1] + coarse[j]
            g = np.bincount(cell, y - p, values.size).reshape(values.shape)
            h = np.bincount(cell, p * (1 - p), values.size).reshape(values.shape)
            step = RATE * _tree_of_pair(g, h)
            values += step
            sums += step[coarse[i], coarse[j]]
    return model


def _tree_of_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Best cut of either feature, then the best cut of the other one on each side: four leaves at most."""
    best = (-1.0, None)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out = np.concatenate([np.repeat(_tree(part_g.sum(axis=0), part_h.sum(axis=0), 2)[None], len(part_g), axis=0) for part_g, part_h in ((a[:cut], b[:cut]), (a[cut:], b[cut:]))])
            gain = float((out * a).sum())
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best[1] if best[1] is not None else np.zeros_like(g)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True where crc32 of the doc_id as text leaves no remainder; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on the rows of ``docs`` that ``labels`` marks and that aren't held out.

    ``max_rows`` label rows at most are used, those of the smallest hashes of
    their doc_id, and of the documents that they mark as many at most in the
    same order: that bounds the broadcast (16 bytes each) and the features
    sent to the driver (150 bytes each). Null labels and ids don't count; a
    doc_id labelled twice counts twice.
    """
    marked = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("_label")).filter("_label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(max_rows)
    rows = with_quality_stats(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id"))
    frame = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *QUALITY_FEATURES, "_label").limit(max_rows).toPandas()
    frame = frame.sort_values(["doc_id", *QUALITY_FEATURES, "_label"])
    return fit(frame[list(QUALITY_FEATURES)].to_numpy(dtype=float).reshape(-1, len(QUALITY_FEATURES)), (frame["_label"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.3 on).

    Only the text is an input of a score. Null and empty texts and repeated
    rows get scores like any other; without labelled rows all scores are 0.5.
    Columns named like the results are replaced.
    """
    return _scored(docs.drop("held_out", "score", "predicted"), train(docs, labels))


def _scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "score double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([quality_stats(t) for t in texts(batch.column(at))])
        return pa.record_batch([*batch.columns, pa.array(shared.value.score(x))], [*batch.schema.names, "score"])

    out = map_batches(docs, run, schema)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
