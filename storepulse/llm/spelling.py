"""Spelling variants: words one code point apart, grouped under the commonest form.

**Words.**  Tasks count the letter runs of each document once, spoil every 199th by its checksum,
and add the counts up before the shuffle, so a very common word is a few rows.

**Near words.**  Of two words that differ by one inserted, deleted or replaced code point, the
shorter one (length ``m``) has a window ``[low, high)`` of positions that holds the first
difference, and outside it both are the same.  So words are keyed by ``m`` (a word takes part as
the shorter one and as one code point longer), a window and what lies outside of it.  A word
starts with two windows, its halves; a group of more than ``GROUP`` words, or of more than ``FEW``
very long ones, halves its windows again, until it is small or its windows are single positions,
where a group is the words that differ in that position alone, at most one for each letter of the
alphabet.  No group is cut and no pair is
left out: a pair is accepted in the one window that holds its first difference.

**Scan.**  Within a group the windows are sorted and scanned once for all of them as queries: the
three cells of an edit matrix's row that lie within one edit of the diagonal are kept for every
depth, rows are reused up to the common prefix with the word before, and a query whose row exceeds
one edit at some depth is left out of the whole range of words that share that prefix.

**Forms.**  A word's form is its commonest near word, if that is five times as common; roots follow
the forms by doubling jumps, with the tables of each step in the shared folder.

A null text has no words.  A null identifier counts as an empty one in the checksum.  Rows that
repeat an identifier each count.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, slices, written

#: A run's checksum that this divides spoils the run; least code points and occurrences of a word.
SPOILT, LENGTH, OCCURRENCES = 199, 6, 5
#: A form is at least this many times as common as its word.
TIMES = 5
#: Most words of a group whose windows can still be halved, and most code points in the windows of one of over ``FEW`` words.
GROUP, POINTS, FEW = 1024, 1 << 21, 64
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, 1 << 22):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():    # bytes lower A-Z alone
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % SPOILT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                    if len(held) >= HELD:
                        yield passed_on()
        if held:
            yield passed_on()
    return run


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word`` and ``n`` of the words that are long and common enough."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return (map_batches(texts, _counted(length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= occurrences))


# ------------------------------------------------------------------ groups

def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of what lies outside their window.  Equal keys of unlike rows only cost a comparison."""
    outside = F.concat_ws("\u0000", F.expr("substring(word, 1, low)"), F.expr("right(word, m - high)"))
    return rows.withColumn("key", F.xxhash64("m", "low", "high", outside))


def _halved(low: Column, high: Column) -> Column:
    """The halves of a window, a single position as it is."""
    middle = F.floor((low + high) / 2).cast("int")
    whole = F.struct(low.alias("low"), high.alias("high"))
    return F.when(high - low <= 1, F.array(whole)).otherwise(
        F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


def _split(rows: DataFrame) -> DataFrame:
    """Rows with each of the two halves of their windows, keyed anew."""
    return _keyed(rows.select("word", "n", "m", F.inline(_halved(F.col("low"), F.col("high")))))


def groups(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """``word``, ``n``, ``m``, ``low``, ``high``, ``key``: words that share a key are compared.  Groups of one word are left out."""
    whole = vocabulary.withColumn("_length", F.char_length("word")).select(
        "word", "n", F.explode(F.array(F.col("_length"), F.col("_length") - 1)).alias("m"))
    open_rows, done = _split(whole.select("word", "n", "m", F.lit(0).alias("low"), F.col("m").alias("high"))), []
    while True:
        window = F.col("high") - F.col("low")
        sizes = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum(window).alias("_size"), F.max(window).alias("_window"))
        large = (F.col("_n") > most) | ((F.col("_n") > FEW) & (F.col("_size") > POINTS))
        sizes = sizes.where("_n > 1").select("key", (large & (F.col("_window") > 1)).alias("large"))
        sized = written(open_rows.join(sizes, "key"), "word_groups")
        done.append(sized.where("not large").drop("large"))
        if not sized.where("large").limit(1).count():
            break
        open_rows = _split(sized.where("large"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------ scan of a group

def _first_difference(a: str, b: str) -> int:
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    return at


def near_words(sorted_words: list[str], m: int) -> Iterator[tuple[int, int]]:
    """(i, j): word ``i`` of length ``m`` and word ``j`` of length ``m`` or one more are one edit apart.

    The words are sorted.  Pairs of equal length come with ``i < j``."""
    lengths = np.array([len(w) for w in sorted_words])
    # queries: code points with room at the end that matches nothing
    queries = np.zeros((len(sorted_words), m + 4), dtype=np.int32)
    for row, w in zip(queries, sorted_words):
        row[:len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    # rows of the edit matrix by depth: (queries still within one edit, cells left of, on and right of the diagonal)
    start = np.array([[9], [0], [1]], dtype=np.int8)
    rows = [(np.arange(len(sorted_words)), np.repeat(start, len(sorted_words), axis=1))]
    before = ""
    for j, word in enumerate(sorted_words):
        del rows[_first_difference(before, word) + 1:]      # what the word before shares with this one is known
        before = word
        for depth in range(len(rows) - 1, len(word)):
            alive, (left, middle, right) = rows[depth]
            if not len(alive):
                break                                       # the range of words with this prefix is skipped
            c = ord(word[depth])
            text = queries[alive]
            nine = np.int8(9)
            new_left = np.minimum(left + (text[:, depth - 1] != c) if depth else nine, middle + 1)
            new_middle = np.minimum(np.minimum(middle + (text[:, depth] != c), right + 1), new_left + 1)
            new_right = np.minimum(right + (text[:, depth + 1] != c), new_middle + 1)
            within = np.minimum(np.minimum(new_left, new_middle), new_right) <= 1
            rows.append((alive[within], np.stack([new_left, new_middle, new_right])[:, within]))
        if len(rows) <= len(word):
            continue
        alive, cells = rows[len(word)]
        beyond = lengths[alive] - len(word)                 # the last cell of a query lies so far from the diagonal
        fits = np.abs(beyond) <= 1
        alive, apart = alive[fits], cells[beyond[fits] + 1, np.flatnonzero(fits)]
        for i in alive[apart == 1]:
            if lengths[i] == m and (lengths[j] > m or i < j):
                yield int(i), j


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and word to pairs of near words, both ways, with the other one's count."""
    out: list[tuple] = []
    group: list[tuple] = []

    def compare() -> None:
        if len(group) < 2:
            return
        # unlike rows may share a key by chance
        for m, low, high in {g[2:] for g in group}:
            here = [g for g in group if g[2:] == (m, low, high)]
            windows = sorted((w[low:len(w) - (m - high)], at) for at, (w, *_) in enumerate(here))
            for i, j in near_words([w for w, _ in windows], high - low):
                (x, one), (y, other) = windows[i], windows[j]
                one, other, at = here[one], here[other], _first_difference(x, y)
                if (low + at < high or high == m) and one[0][:low] == other[0][:low] and one[0][high:] == other[0][len(other[0]) - (m - high):]:
                    out.append((one[0], other[0], other[1]))
                    out.append((other[0], one[0], one[1]))

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))],
                                           names=["word", "near", "near_n"])
        out.clear()
        return batch

    key = None
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "low", "high"))):
            if k != key:
                compare()
                group.clear()
                key = k
                if len(out) >= 50_000:
                    yield passed_on()
            group.append(tuple(row))
    compare()
    if out:
        yield passed_on()


def near_pairs(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """``word``, ``near``, ``near_n``: every pair of near words, both ways, once."""
    rows = groups(vocabulary, most).select("key", "word", "n", "m", "low", "high")
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), _compared, "word string, near string, near_n long")


# ------------------------------------------------------------------ forms and roots

def _roots(table: DataFrame) -> DataFrame:
    """``word`` and ``root``: the last word on the way from form to form.  Jumps double until none moves."""
    jumps = written(table.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(jumps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                  F.col("_next").isNotNull().alias("moved")), "jumps")
        jumps = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return jumps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES,
             times: int = TIMES, most: int = GROUP) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    if length < 2:
        raise ValueError("words need two code points at least")
    vocabulary = written(words(docs, id_col, text_col, length, occurrences), "vocabulary")
    # the largest count, then the first in code-point order, which is that of UTF-8 bytes
    near = near_pairs(vocabulary, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    common = -F.col("best.n") >= F.col("n") * times
    table = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")), "forms")
    return table.join(_roots(table), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
