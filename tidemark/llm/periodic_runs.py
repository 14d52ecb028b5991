"""Periodic run detection (operator 13): a suffix automaton whose link tree is accessed word by word.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends. Appended word by word, a text's newest
prefix is a state of its suffix automaton; the states on the way to the root
are its suffixes, and each remembers where it ended last. Preferred paths of
a link-cut tree hold stretches of the way that ended at one place. An access
from the newest state reads them off and recolours the way with the new end:
a stretch whose longest suffix has h words and ended d words before shows that
words d apart agree over h + d words, and if d <= h, that is a square and part
of the run with period d that starts h + d - 1 words before. Its end is the
last word at which the same start and period come up.

Runs of at least ``min_length`` words repeat windows of ``min_length // 2``
words that cover them wholly, so only stretches of a text that such repeated
windows cover (found by hashes, which can only add some) go to the automaton,
and ways to the root end at suffixes shorter than a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, texts

MIN_LENGTH = 12


def repeated_stretches(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches (first, end) of positions covered by windows of ``width`` ids that the text holds twice or more.

    Windows are compared by a 64-bit hash; a clash only makes a stretch longer.
    """
    n = len(ids) - width + 1
    if n < 2:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = window * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    cut = np.flatnonzero(np.diff(at) > width)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return list(zip(first.tolist(), (last + width).tolist()))


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link) of every state, and the state of each prefix; state 0 is the root."""
    length, link, follow, prefix = [0], [-1], [{}], []
    last = 0
    for c in word:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                link[q] = link[now] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        last = now
        prefix.append(now)
    return length, link, prefix


def squares_to_runs(word: list[int], min_length: int = MIN_LENGTH) -> dict[tuple[int, int], int]:
    """{(start, period): last word} of the runs of ``word`` with at least max(min_length, 2 * period) words.

    ``above`` is a state's parent in its splay tree or, for the root of one,
    the state that its preferred path hangs from; ``ended`` holds the last end
    of a path at the root of its splay tree.
    """
    length, link, prefix = suffix_automaton(word)
    least = min_length // 2
    n = len(length)
    # 0 stands for none: ways to the root end at suffixes shorter than a window
    above = [p if p > 0 and length[p] >= least else 0 for p in link]
    left, right, ended = [0] * n, [0] * n, [0] * n
    runs: dict[tuple[int, int], int] = {}

    def rotate(x: int, p: int) -> None:
        g = above[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            above[b] = p
        above[p] = x
        above[x] = g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    for end, state in enumerate(prefix, 1):
        if length[state] < least:
            continue
        x, below = state, 0
        while x:
            p = above[x]
            while p and (left[p] == x or right[p] == x):
                g = above[p]
                if g and (left[g] == p or right[g] == p):
                    if (left[g] == p) == (left[p] == x):
                        ended[x] = ended[g]
                        rotate(p, g)
                    else:
                        ended[x] = ended[g]
                        rotate(x, p)
                        p = above[x]
                else:
                    ended[x] = ended[p]
                rotate(x, p)
                p = above[x]
            before = ended[x]
            if before:
                d, h = end - before, length[x]
                if d <= h and h + d >= min_length:
                    runs[end - h - d, d] = end - 1
            r = right[x]
            if r:
                ended[r] = before
            right[x] = below
            below, x = x, above[x]
        ended[below] = end
    return runs


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(min_length, 2 * period) words, by start and period."""
    if len(words) < min_length:
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(words) - len(seen) < min_length // 2:
        return []
    found = []
    for first, end in repeated_stretches(ids, min_length // 2):
        if end - first >= min_length:
            found += [(first + s, last - s + 1, q) for (s, q), last in squares_to_runs(ids[first:end].tolist(), min_length).items()]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([w for w, dropped in zip(words, gone.tolist()) if not dropped])


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the text without repeats.

    Words are numbered from 0. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Each row is worked on by itself, whatever
    its ids are; columns named like the results are replaced. A text's
    automaton is held in memory while it is worked on: about 1 KB for each word
    that its repeated windows cover.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    docs = docs.drop("runs", "collapsed")
    at, names = docs.columns.index(text), docs.columns
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, rest = [], []
        for t in texts(batch.column(at)):
            words = t.split()
            own = runs_of(words, min_length)
            lists.append([{"start": s, "length": k, "period": q} for s, k, q in own])
            rest.append(collapsed(words, own).decode())
        return pa.record_batch([*batch.columns, pa.array(lists, run), pa.array(rest, pa.string())], [*names, "runs", "collapsed"])

    return map_batches(docs, find, schema)
