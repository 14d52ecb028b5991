"""Statistics of whole texts, one pass each: for the quality classifier and the outlier rules."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import WHITE, map_batches, texts

SYMBOLS = b"#*$%&|<>"
RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
QUALITY_FEATURES = ("log_words", "mean_word", "upper", "digit", "punctuation", "bangs", "bars", "symbols", "stops", "capital_words", "distinct_words", "top_word", "repeat_words", "dup_lines", "line_words", "letters", "wide")
_WHITE = WHITE.encode()
_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def count_of(data: bytes, chars: bytes) -> int:
    """How many bytes of ``data`` are in ``chars``."""
    return len(data) - len(data.translate(None, chars))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that the text holds twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    window = own[:n].copy()
    for k in range(1, width):
        window = window * len(ids) + own[k : k + n] if len(ids) ** width < 2**62 else np.unique(np.stack([window, own[k : k + n]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(width):
        inside[k : k + n] |= again
    return int(inside.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def rule_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(text.decode()) - count_of(text, _WHITE)
    return len(words), chars, count_of(text, SYMBOLS), dup_lines(text), repeat_words(words)


def quality_stats(text: bytes) -> tuple[float, ...]:
    """Shares and means that don't grow with a text's length, but for ``log_words``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(QUALITY_FEATURES)
    chars = len(text) - count_of(text, _WHITE)
    letters, upper = count_of(text, _LETTERS), count_of(text, _UPPER)
    digits, wide = count_of(text, _DIGITS), len(text) - len(text.translate(None, bytes(range(128, 256))))
    counts = Counter(words)
    filled = [x for x in text.split(b"\n") if x.strip()]
    return (
        float(np.log1p(n)), chars / n, upper / max(1, letters), digits / chars, (chars - letters - digits - wide) / chars,
        text.count(b"!") / n, text.count(b"|") / n, count_of(text, SYMBOLS) / n, text.count(b".") / n, sum(65 <= w[0] <= 90 for w in words) / n,
        len(counts) / n, max(counts.values()) / n, repeat_words(words) / n, (len(filled) - len(set(filled))) / max(1, len(filled)), n / max(1, len(filled)), letters / chars, wide / chars,
    )


def with_rule_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``RULE_COLUMNS`` (null text: no words)."""
    return _instead(docs, rule_stats, RULE_COLUMNS, pa.int64(), "long")


def with_quality_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``QUALITY_FEATURES`` (null text: as empty)."""
    return _instead(docs, quality_stats, QUALITY_FEATURES, pa.float64(), "double")


def _instead(docs: DataFrame, fn, names: tuple[str, ...], kind: pa.DataType, ddl: str) -> DataFrame:
    docs = docs.drop(*names)
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), *(f"`{c}` {ddl}" for c in names)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fn(t) for t in texts(batch.column(at))])
        return pa.record_batch([*(x for i, x in enumerate(batch.columns) if i != at), *(pa.array(c, kind) for c in found.T)], [*rest, *names])

    return map_batches(docs, run, schema)
