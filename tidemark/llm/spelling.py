"""Spelling variants (operator 12): words one edit apart, by a bit-sliced position index over the vocabulary.

For every (position, letter) a bitset marks the vocabulary's words with that
letter there. A query word goes through its letters once: one bitset holds the
words that agree so far without an error, three more those with one replaced,
one added or one left-out code point, each advanced for all words at once by
an AND with the bitset of the same, the next or the previous position.

The index is held by key. Two words one edit apart, the shorter one of l code
points, share their first or their last l // 2, so each word is filed under
both for its own length and the one below. Keys with more than ``block`` words
are filed anew by what their words don't share yet, again by first or last
half, until a rest of one code point is left. A pair is taken where its words
first agree from the left, so it comes up exactly once and no pairs are ever
shuffled: a key gives each of its words a count and its best neighbour.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, map_batches, new_tag, table, texts

#: What words are made of once A-Z is lower-cased: basic and Latin-1 letters (with the two operators between them).
LETTERS = "a-z\u00c0-\u00ff"
LEAST_CHARS, LEAST_COUNT, RATIO, BLOCK = 7, 2, 10, 2048
#: Hashes of hot keys are broadcast up to this many (8 bytes each).
MAX_HOT = 1_000_000


def count_words(docs: DataFrame, edit: Callable[[str, str], str] | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs of all texts with A-Z lower-cased, of so many code points and occurrences at least.

    ``edit(doc_id as text, run)`` may shorten a document's run before it is
    counted. Null texts have no words; a null doc_id is the text ''. Rows are
    counted as often as they come.
    """
    run = re.compile(f"[{LETTERS}]{{{least_chars},}}")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for doc, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            found = run.findall(t.lower().decode())
            if edit is None:
                total.update(found)
                continue
            for w, n in Counter(found).items():
                changed = edit(doc, w)
                if len(changed) >= least_chars:
                    total[changed] += n
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets over ``words``, one for each (position, letter) and one for each length; bit k stands for the k-th word."""

    def __init__(self, words: list[str]):
        self.everyone = (1 << len(words)) - 1
        self.slices: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 1)]
        self.of_length: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for at, letter in enumerate(word):
                own = self.slices[at]
                own[letter] = own.get(letter, 0) | bit

    def near(self, word: str, apart_within: int | None = None) -> int:
        """The bitset of words that one replaced, added or left-out code point tells from ``word``.

        With ``apart_within`` only those whose first so many code points aren't all the word's own.
        """
        slices, most = self.slices, len(self.slices)
        exact, replaced, longer, shorter, alike = self.everyone, 0, 0, 0, 0
        for at, letter in enumerate(word):
            if at == apart_within:
                alike = exact
            same = slices[at].get(letter, 0) if at < most else 0
            # one code point more: the other word's letters come a position later; one less: a position earlier
            longer = (longer | exact) & (slices[at + 1].get(letter, 0) if at + 1 < most else 0)
            shorter = shorter & (slices[at - 1].get(letter, 0) if 0 < at <= most else 0) | exact
            replaced = replaced & same | exact & ~same
            exact &= same
            if not (exact or replaced or longer or shorter):
                return 0
        n = len(word)
        if n == apart_within:
            alike = exact
        sizes = self.of_length
        found = replaced & sizes.get(n, 0) | (longer | exact) & sizes.get(n + 1, 0) | shorter & sizes.get(n - 1, 0)
        return found & ~alike


def best_neighbours(words: list[str], counts: list[int], length: int, left: int = 0, right: int = 0, apart_within: int | None = None) -> dict[str, tuple[int, int, str]]:
    """{word: (near words, largest count, its word)} among words of ``length`` and ``length + 1`` code points.

    All agree in their first ``left`` and last ``right`` code points, so only
    what lies between is indexed. Two words of ``length + 1`` are no pair here.
    """
    rest = [w[left : len(w) - right] for w in words]
    index, short = PositionIndex(rest), length - left - right
    base, out = index.of_length.get(short, 0), {}
    for word, own in zip(words, rest):
        found = index.near(own, None if apart_within is None else apart_within - left)
        if len(own) > short:
            found &= base
        n, best, form = found.bit_count(), 0, ""
        while found:
            low = found & -found
            found ^= low
            k = low.bit_length() - 1
            if counts[k] > best or counts[k] == best and words[k] < form:
                best, form = counts[k], words[k]
        if n:
            out[word] = (n, best, form)
    return out


def _filed(rows: DataFrame) -> DataFrame:
    """Rows under both halves of what their key leaves open: ``left`` and ``right`` are what the words of a key share.

    Under the right half only pairs count that differ within the left one, which are those not found there.
    """
    half = F.expr("(length - length(left) - length(right)) div 2").alias("half")
    rows = rows.select("*", half)
    a = F.length("left") + F.col("half")
    first = F.struct(F.concat("path", F.lit("l")).alias("path"), F.expr("substring(word, 1, length(left) + half)").alias("left"), F.col("right").alias("right"), F.col("apart_within").alias("apart_within"))
    last = F.struct(F.concat("path", F.lit("r")).alias("path"), F.col("left").alias("left"), F.expr("right(word, int(length(right) + half))").alias("right"), F.least("apart_within", a.cast("int")).alias("apart_within"))
    filed = rows.select("word", "n", "length", F.explode(F.array(first, last)).alias("to")).select("word", "n", "length", "to.*")
    # what must differ within the part that all words of the key share has no pairs
    return filed.filter("apart_within IS NULL OR apart_within > length(left)")


def _neighbours_by_key(filed: DataFrame) -> DataFrame:
    keys = ["length", "path", "left", "right", "apart_within"]
    sets = filed.groupBy(*keys).agg(F.collect_list(F.struct("word", "n")).alias("members")).filter(F.size("members") > 1)
    sets = sets.select("length", F.length("left").alias("left"), F.length("right").alias("right"), "apart_within", F.col("members.word").alias("words"), F.col("members.n").alias("counts"))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[str, int, int, str]] = []
        for row in batch.to_pylist():
            found = best_neighbours(row["words"], row["counts"], row["length"], row["left"], row["right"], row["apart_within"])
            out += [(w, *x) for w, x in found.items()]
        columns = list(zip(*out)) or [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

    return map_batches(sets, find, "word string, n_near long, form_n long, form string")


def neighbours(words: DataFrame, block: int = BLOCK, tag: str | None = None) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have a near word; ``form`` is the most frequent one.

    Ties go to the first in code-point order. A key of at most ``block`` words
    is one index. Larger ones are filed anew until one code point is left open;
    such a last index holds words of one or two open code points, which the
    alphabet bounds (90 letters: 8,190 words), whatever the vocabulary's size.
    """
    tag = tag or new_tag("spelling")
    spread = words.select("word", "n", F.length("word").alias("chars")).withColumn("length", F.explode(F.array(F.col("chars") - 1, F.col("chars")))).filter("length > 0")
    rows = spread.select("word", "n", "length", F.lit("").alias("path"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit(None).cast("int").alias("apart_within"))
    parts = []
    while True:
        key = F.xxhash64("length", "path", "left", "right", "apart_within")
        filed = table(_filed(rows).withColumn("key", key), tag)
        hot = table(filed.filter("length - length(left) - length(right) > 1").groupBy("key").count().filter(F.col("count") > block).select("key"), tag)
        if bounded(hot, 0):
            parts.append(_neighbours_by_key(filed.drop("key")))
            break
        few = F.broadcast(hot) if bounded(hot, MAX_HOT) else hot
        parts.append(_neighbours_by_key(filed.join(few, "key", "left_anti").drop("key")))
        rows = filed.join(few, "key", "left_semi").drop("key")
    found = reduce(DataFrame.union, parts)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def group_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK, tag: str | None = None) -> DataFrame:
    """``words`` (word, n; each word once) with n_near, form, form_n and root.

    A word's form is its most frequent near word, if that is at least
    ``ratio`` times as frequent; its root is where forms lead. Counts grow by
    ``ratio`` from form to form, so ways are as long as the largest count's
    logarithm at most, and the joins double the steps. Null words are left out;
    an empty table gives an empty one.
    """
    tag = tag or new_tag("spelling")
    words = table(words.select("word", "n").filter("word IS NOT NULL"), tag)
    near = neighbours(words, block, tag)
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n") >= ratio * F.col("n"), F.struct("form", "form_n")).alias("to"))
    rows = table(rows.select("word", "n", "n_near", "to.form", "to.form_n"), tag)
    most = rows.agg(F.max("form_n")).first()[0] or 1
    ways, steps, longest = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), 1, 1
    while ratio**longest <= most:
        longest += 1
    while steps < longest:
        ways, steps = table(ways, tag), 2 * steps
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return rows.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
