"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds its distinct word shingles as 64-bit tokens.  Documents are put in
size bands.  For a band, the token universe is cut by hash into as many segments as a
linked pair of that band can have differing tokens, plus one: some segment is then the
same in both sets.  The signature of a segment is the sum of its tokens' scrambles, so
documents that share a signature are candidates.

Allocation by cost: segments come in twos.  A segment with at most one token is shared by
many unrelated sets, so its signature would be costly.  A pair of segments that holds such
a one is indexed together instead, with the whole subset and its one-deletion
neighbourhood (the subset without each token).  Of two segments that differ in at most one
token in all, one is the same in both sets: if it is not costly, its own signature is
shared; if it is, both sets index the pair together, and the neighbourhoods meet.  No
linked pair is missed.

Candidates are first compared by sketches: the parities of the tokens that fall in each of some
bins.  Tokens that two sets have in common cancel, so the number of bins that differ is at most
that of tokens that differ; a pair beyond what a link allows is left out.  The others are verified
exactly on their token sets.  Equal sets count once, under their smallest identifier.  Of the documents with one signature each is first compared with the
smallest (in two steps, within a task and then across tasks, so that a signature that very
many share is small before the shuffle); the links found give components.  Only documents
that share a signature and are still in different components are looked at further:

* where at most ``COMMON`` documents share it, a task compares their sketches with each other;
  signatures that the same documents share count once;
* otherwise its cost is too high, as above: these documents index its pair of segments
  together with the one-deletion neighbourhood, and again up to ``COMMON`` are compared so;
* where more agree even on that, or the signature is that of a pair from the start, they are
  compared with the one among them that shares most (the hub).  Most are near copies of one
  text.  Two of these differ by what their differences from the hub do not have in common,
  so a link of a document that the hub does not reach needs about half of the other's
  difference; each document is indexed by the rarest tokens of its difference that must then
  hold a common one (a prefix filter).  A document that has more of its own than a link
  allows (pairs of segments with hardly a token bring unrelated texts together) is indexed
  by the rarest of its own tokens, of which a link needs all but that many.

A null or empty text has no tokens and is linked with nothing.  Rows that repeat an
identifier are one node.  Rows with a null identifier have a null component.  Only the
identifier and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import discarded, map_batches, mix64, slices, text_or_empty, utf8_buffer, written
from storepulse.llm.components import connected_components
from storepulse.llm.words import words_of

#: Ratio of the sizes at the ends of a band.
BAND = 1.4
#: Documents that may share a signature before its segments are indexed in pairs.
COMMON = 256
#: Pairs of sketches that a task compares at a time (those of one document with its group at least).
PAIRS_AT_ONCE = 1 << 17
#: Slices of all signatures, and the documents that differ from which on there are several.
SLICES, SLICED_FROM = 2, 20_000
#: Signatures that a task sorts at a time.
SORTED_AT_ONCE = 1 << 20
#: Bytes of text that a task turns into tokens at a time (one text at least).
TEXT_AT_ONCE = 4 << 20
#: Bins of a sketch: a power of two, at least the tokens of the set, between these.
FEWEST_BINS, MOST_BINS = 64, 1 << 16

_ONE = np.uint64(1)


def token_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of every text, one after the other, and where each text's begin.

    A text of fewer than ``width`` words has its whole sequence as one token.
    """
    words = words_of(data, starts, fold=True)
    count = np.diff(words.first)
    n = len(words.code)
    tokens = np.full(n, width, dtype=np.uint64)
    for k in range(width - 1, -1, -1):
        tokens[:n - k] = mix64(tokens[:n - k] + words.code[k:])
    own = np.maximum(0, count - width + 1)
    place = np.arange(n) - np.repeat(words.first[:-1], count)
    whole = place < np.repeat(own, count)
    for i in np.flatnonzero((count > 0) & (count < width)):
        code = np.array([count[i]], dtype=np.uint64)
        for c in words.code[words.first[i]:words.first[i + 1]][::-1]:
            code = mix64(code + c)
        tokens[words.first[i]] = code[0]
        whole[words.first[i]] = True
        own[i] = 1
    tokens = tokens[whole]
    first = np.concatenate([[0], np.cumsum(own)])
    for a, b in zip(first, first[1:]):
        tokens[a:b].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[first[:-1][first[:-1] < len(tokens)]] = True
    held = np.concatenate([[0], np.cumsum(new)])
    return tokens[new], held[first]


class Scheme:
    """Bands and the number of segments of each, for links of ``part`` / ``whole`` or more."""

    def __init__(self, part: int, whole: int, longest: int = 1 << 40):
        self.part, self.whole = part, whole
        low = [1]
        while low[-1] <= longest:
            low.append(max(low[-1] + 1, int(low[-1] * BAND)))
        self.low = np.array(low)
        self.segments = np.array([self._segments(a, b - 1) for a, b in zip(low, low[1:])])

    def _segments(self, low: int, top: int) -> int:
        """One more than the tokens in which a linked pair can differ whose smaller set is in the band."""
        largest = top + top * self.whole // self.part
        # the bound grows with the sum of the sizes, but for a sawtooth of fewer than three steps
        sums = range(max(2 * low, largest - 3 * (self.part + self.whole)), largest + 1)
        differ = max(s - 2 * -(-self.part * s // (self.part + self.whole)) for s in sums)
        return 1 if differ <= 0 else differ + 1 + (differ + 1) % 2

    def bands(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band in which a set of this size can be the smaller or the larger of a pair."""
        least = -(-size * self.part // self.whole)
        return (np.searchsorted(self.low, least, side="right") - 1, np.searchsorted(self.low, size, side="right") - 1)


def signatures(tokens: np.ndarray, first: np.ndarray, scheme: Scheme,
               common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of all segments in all bands of each text; those of pairs of segments are odd.

    With ``common``, a sorted list of signatures that too many share, only those of the pairs
    of segments that hold one of them."""
    size = np.diff(first)
    lowest, highest = scheme.bands(np.maximum(size, 1))
    out, of = [], []
    scrambled = mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for step in range(int((highest - lowest).max(initial=0)) + 1):
        band = lowest + step
        segments = np.where((size > 0) & (band <= highest), scheme.segments[np.minimum(band, highest)], 1)
        texts = np.flatnonzero(segments > 1)
        if not len(texts):
            continue
        m = segments[texts]
        text = np.repeat(np.arange(len(texts)), size[texts])
        at = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])
        offset = np.cumsum(m) - m
        # tokens are sorted within a text, and a segment is a range of the universe
        segment = offset[text] + ((tokens[at] >> np.uint64(32)) * m[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(segment, minlength=int(m.sum()))
        total = np.zeros(len(held), dtype=np.uint64)
        heads = np.flatnonzero(np.diff(segment, prepend=-1))
        total[segment[heads]] = np.add.reduceat(scrambled[at], heads)
        number = np.arange(len(held)) - np.repeat(offset, m)
        salt = mix64(np.repeat(band[texts], m).astype(np.uint64) << np.uint64(40) | number.astype(np.uint64) << _ONE)
        owner = np.repeat(texts, m)
        code = mix64(total + salt) & ~_ONE
        if common is None:
            cheap = held > 1
            out.append(code[cheap])
            of.append(owner[cheap])
        else:
            at_most = np.minimum(np.searchsorted(common, code), len(common) - 1)
            cheap = common[at_most] != code
        # twos with a costly segment; every text has an even number of segments
        costly = np.flatnonzero(~cheap[0::2] | ~cheap[1::2])
        if len(costly):
            both = total[0::2][costly] + total[1::2][costly]
            mark = salt[0::2][costly] ^ _ONE
            out.append(mix64(both + mark) | _ONE)
            of.append(owner[0::2][costly])
            which = np.full(len(held) // 2, -1)
            which[costly] = np.arange(len(costly))
            inside = which[segment // 2]
            token = np.flatnonzero(inside >= 0)
            inside = inside[token]
            out.append(mix64(both[inside] - scrambled[at[token]] + mark[inside]) | _ONE)
            of.append(owner[0::2][costly][inside])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def sketches(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the tokens in each bin of every text's sketch, as bytes, and where each text's begin."""
    size = np.diff(first)
    bins = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), FEWEST_BINS, MOST_BINS)
    begin = np.concatenate([[0], np.cumsum(bins)])
    bin_of = np.repeat(begin[:-1], size) + (tokens & np.repeat(bins - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bin_of, minlength=begin[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), begin // 8


def least_difference(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each pair of sketches a number of tokens by which their sets differ at least."""
    least = np.zeros(len(x), dtype=np.int64)
    lengths = np.array([[len(a), len(b)] for a, b in zip(x, y)]).reshape(-1, 2)
    for shape in np.unique(lengths, axis=0):
        rows = np.flatnonzero((lengths == shape).all(axis=1))
        sides = [np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(len(rows), -1) for side in (x, y)]
        words = min(side.shape[1] for side in sides)
        # bins are low bits of a token, so halves of a longer sketch fall on each other
        sides = [np.bitwise_xor.reduce(side.reshape(len(rows), -1, words), axis=1) for side in sides]
        least[rows] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return least


def _indexed(rows: DataFrame, width: int) -> DataFrame:
    """Each row's identifier, set size, set digest (two numbers) and sketch."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXT_AT_ONCE):
            tokens, first = token_sets(*utf8_buffer(batch.column("text")), width)
            parities, begin = sketches(tokens, first)
            drawn = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(begin), pa.py_buffer(parities)])
            sums = []
            for salt in (0x1234567, 0x7654321):
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append((running[first[1:]] - running[first[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first), pa.int64()), *(pa.array(s, pa.int64()) for s in sums), drawn.cast(pa.binary())],
                names=["id", "size", "sum1", "sum2", "sketch"])

    return map_batches(rows, run, f"id {kind}, size long, sum1 long, sum2 long, sketch binary")


def _packed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, packed): the named documents' texts, compressed before the shuffle."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, TEXT_AT_ONCE):
            packed = [squeeze(t.as_buffer()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])

    # both sides grow with the data, so the join is a shuffled one at every size
    return map_batches(rows.where("id is not null"), pack, "id long, packed binary").join(nodes.hint("merge"), "id", "left_semi")


def _tokens_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Identifiers, tokens and where each text's begin, of packed texts, a few at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        packed = batch.column("packed").to_pylist()
        ends = np.cumsum([zstandard.frame_content_size(p) for p in packed])
        at = 0
        while at < len(packed):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
            texts = pa.array([unpack(p) for p in packed[at:end]], pa.large_binary())
            yield batch.column("id").slice(at, end - at), *token_sets(*utf8_buffer(texts), width)
            at = end


def _members(packed: DataFrame, scheme: Scheme, width: int, shares: int = 1, own: int = 0) -> DataFrame:
    """(signature, lead, id): documents that share a signature, as a tree over the smallest of them.

    Of several ``shares`` of all signatures, those of one.
    Each task links the ones that it sorts at a time to their smallest; those are linked to the
    smallest of all after the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, held = [], [], 0

        def sorted_out() -> pa.RecordBatch:
            code, owner = np.concatenate(codes), np.concatenate(ids)
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            head = np.flatnonzero(np.diff(code, prepend=~code[:1]))
            lead = owner[np.repeat(head, np.diff(np.append(head, len(code))))]
            keep = owner != lead
            keep[head] = True
            codes.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (code, lead, owner)],
                                              names=["signature", "lead", "id"])

        for owners, tokens, first in _tokens_of(batches, width):
            code, of = signatures(tokens, first, scheme)
            if shares > 1:
                here = (code.view(np.uint64) >> np.uint64(33)) % np.uint64(shares) == own
                code, of = code[here], of[here]
            codes.append(code.view(np.int64))
            ids.append(owners.to_numpy(zero_copy_only=False)[of])
            held += len(code)
            if held >= SORTED_AT_ONCE:
                yield sorted_out()
                held = 0
        if held:
            yield sorted_out()

    rows = map_batches(packed, run, "signature long, lead long, id long")
    least = F.min("lead").over(Window.partitionBy("signature").orderBy("lead").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    linked = rows.withColumn("least", least)
    return (linked.select("signature", F.when(F.col("lead") == F.col("id"), F.col("least")).otherwise(F.col("lead")).alias("lead"), "id")
            .where("lead <> id").distinct())


def _token_sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of the named documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, tokens, first in _tokens_of(batches, width):
            sets = [tokens[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([owners, pa.array(sets, pa.binary())], names=["id", "tokens"])

    return map_batches(_packed(rows, nodes), run, "id long, tokens binary")


def _possible(x: list[bytes], y: list[bytes], a: np.ndarray, b: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Whether sets of these sketches and sizes may be similar enough."""
    keep = np.minimum(a, b) * whole >= np.maximum(a, b) * part
    some = np.flatnonzero(keep)
    least = least_difference([x[i] for i in some], [y[i] for i in some])
    keep[some] = least * (whole + part) <= (a[some] + b[some]) * (whole - part)
    return keep


def _near(pairs: DataFrame, index: DataFrame, part: int, whole: int) -> DataFrame:
    """Those of the pairs (lead, id) that may be linked by their sizes and sketches."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("x", "y"))
            sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "size2"))
            yield batch.select(["lead", "id"]).filter(pa.array(_possible(*sides, *sizes, part, whole)))

    own = index.select("id", "size", F.col("sketch").alias("x"))
    lead = index.select(F.col("id").alias("lead"), F.col("size").alias("size2"), F.col("sketch").alias("y"))
    both = pairs.join(own, "id").join(lead, "lead").select("lead", "id", "size", "size2", "x", "y")
    return map_batches(both, compare, "lead long, id long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("id").union(pairs.select("lead")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Those of the pairs (lead, id) whose sets are similar enough, as links (a, b)."""
    pairs = written(pairs, "near_pairs")
    sets = written(_token_sets(rows, _ends(pairs), width), "token_sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * whole < len(large) * part:
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(whole * common >= part * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("id")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_own = pairs.join(sets.withColumnRenamed("tokens", "x"), "id")
    both = with_own.join(sets.select(F.col("id").alias("lead"), F.col("tokens").alias("y")), "lead")
    return map_batches(both.select("lead", "id", "x", "y"), compare, "a long, b long")


def _in_pairs(common: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(signature, id, component) of the pairs of segments that hold one of the document's common signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (tokens, codes) in enumerate(zip(batch.column("tokens").to_pylist(), batch.column("codes").to_pylist())):
                tokens = np.frombuffer(tokens, np.uint64)
                code, _ = signatures(tokens, np.array([0, len(tokens)]), scheme, np.sort(np.array(codes, np.int64).view(np.uint64)))
                of = pa.array(np.full(len(code), i))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64), pa.int64()), batch.column("id").take(of), batch.column("component").take(of)],
                                                 names=["signature", "id", "component"])

    by_document = common.groupBy("id", "component").agg(F.collect_list("signature").alias("codes"))
    return map_batches(by_document.join(sets, "id").select("id", "component", "codes", "tokens"), run,
                       "signature long, id long, component long")


def _pairs_across(rows: DataFrame, index: DataFrame, part: int, whole: int) -> DataFrame:
    """(lead, id) of rows that share a signature in different components and may be linked.

    At most ``COMMON`` rows share a signature here.  They meet in one task, which compares their sketches."""
    held = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"),
                                         F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("xor"))
    # signatures that the same documents share: one of them
    kept = held.groupBy("members", "sum", "xor").agg(F.min("signature").alias("signature")).select("signature")
    drawn = rows.join(kept, "signature", "left_semi").join(index.select("id", "size", "sketch"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            code = rest.column("signature").to_numpy(zero_copy_only=False)
            whole_groups = int(np.searchsorted(code, code[-1])) if len(code) else 0      # the last may go on in the next batch
            yield from groups(rest.slice(0, whole_groups))
            rest = rest.slice(whole_groups)
        if rest is not None:
            yield from groups(rest)

    def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        code, node, component, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("signature", "id", "component", "size"))
        sketch = batch.column("sketch").to_pylist()
        following = np.searchsorted(code, code, side="right") - np.arange(len(code)) - 1
        total = np.cumsum(following)
        at = 0
        while at < len(code):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            count = following[at:end]
            x = np.repeat(np.arange(at, end), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            across = (component[x] != component[y]) & (node[x] != node[y])
            x, y = x[across], y[across]
            keep = _possible([sketch[i] for i in x], [sketch[i] for i in y], size[x], size[y], part, whole)
            x, y = node[x[keep]], node[y[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["lead", "id"])
            at = end

    in_order = drawn.select("signature", "id", "component", "size", "sketch").repartition("signature").sortWithinPartitions("signature")
    return map_batches(in_order, compare, "lead long, id long").distinct()


def _open(rows: DataFrame) -> DataFrame:
    """Signatures shared by documents of several components, and by how many documents."""
    return (rows.groupBy("signature").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n"))
            .where("c1 < c2").select("signature", "n"))


def _from_hubs(rows: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """(hub, id, size, linked, far, tokens): how each document of a common signature differs from its hub.

    ``far`` documents have more tokens that the hub lacks than a link allows; of them only these are given."""
    degree = rows.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = rows.join(degree, "id").groupBy("signature").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("best"))
    pairs = (rows.join(hubs.select("signature", (-F.col("best.minus")).alias("hub")), "signature")
             .where("hub <> id").select("hub", "id").distinct())

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, linked, far, edits = [], [], [], []
            for x, h in zip(batch.column("x").to_pylist(), batch.column("h").to_pylist()):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                edit = np.setxor1d(x, h, assume_unique=True)
                size.append(len(x))
                common = (len(x) + len(h) - len(edit)) // 2
                linked.append(whole * common >= part * (common + len(edit)))
                far.append(whole * (len(x) - common) > (whole - part) * len(x))
                edits.append((np.setdiff1d(x, h, assume_unique=True) if far[-1] else edit).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("hub"), batch.column("id"), pa.array(size, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.array(far, pa.bool_()), pa.array(edits, pa.list_(pa.int64()))],
                names=["hub", "id", "size", "linked", "far", "tokens"])

    both = (pairs.join(sets.withColumnRenamed("tokens", "x"), "id")
            .join(sets.select(F.col("id").alias("hub"), F.col("tokens").alias("h")), "hub"))
    return map_batches(both.select("hub", "id", "x", "h"), differ,
                       "hub long, id long, size long, linked boolean, far boolean, tokens array<long>")


def _pairs_beside_hubs(edits: DataFrame, part: int, whole: int) -> DataFrame:
    """(lead, id) of documents with the same hub that can be linked though the hub does not reach one of them.

    Sets of sizes a and b are linked when they differ in at most (whole - part) / (whole + part) of
    a + b.  With e the size of a document's difference from the hub, and another that the hub does
    not reach, the two differences must have at least ``need`` tokens in common.

    A link of a far document needs part / whole of its tokens, so all but (whole - part) / whole of
    its size of those that the hub lacks; the other document's difference holds them too."""
    least, most = F.lit(whole - part), F.lit(whole + part)
    e = F.size("tokens")
    need = F.ceil((e + 1 - F.ceil(e * least / most)) / 2)
    token = edits.select("hub", "id", "size", "linked", "far", e.alias("e"), need.alias("need"), F.explode("tokens").alias("token"))
    often = token.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    # a token that one document alone holds joins nothing; such tokens come first in the order
    of_document = Window.partitionBy("hub", "id")
    at = F.col("e") - F.count(F.lit(1)).over(of_document) + F.row_number().over(of_document.orderBy("held", "token"))
    held = token.join(often, ["hub", "token"]).withColumn("at", at)
    x = held.where("not far and at <= e - need + 1").alias("x")
    s = held.where("not far and not linked").alias("s")
    # what the two can still have in common, from this token on, must be enough for their sizes
    enough = ((F.col("x.e") + F.col("s.e") - 2 * (F.col("x.e") - F.col("x.at") + 1)) * most
              <= (F.col("x.size") + F.col("s.size")) * least)
    same = (F.col("x.hub") == F.col("s.hub")) & (F.col("x.token") == F.col("s.token")) & (F.col("x.id") != F.col("s.id"))
    pair = [F.least("x.id", "s.id").alias("lead"), F.greatest("x.id", "s.id").alias("id")]
    near = x.join(s, same & enough).select(*pair)
    spare = lambda side: F.floor(F.col(f"{side}size") * least / whole)  # noqa: E731  tokens of its own that a link may lack
    own = held.where(~F.col("far") | (F.col("at") <= spare("") + 1))
    sizes = F.least("x.size", "s.size") * whole >= F.greatest("x.size", "s.size") * part
    # from the first token in common on, both must still hold as many as the link of a far document needs
    left = F.least(F.col("x.e") - F.col("x.at"), F.col("s.e") - F.col("s.at")) + 1
    holds = (left >= F.col("x.e") - spare("x.")) & (~F.col("s.far") | (left >= F.col("s.e") - spare("s.")))
    far = own.where("far").alias("x").join(own.alias("s"), same & sizes & holds).select(*pair)
    return near.union(far).distinct()


def _links_across(members: DataFrame, found: DataFrame, checked: DataFrame, rows: DataFrame, index: DataFrame,
                  scheme: Scheme, width: int) -> DataFrame:
    """Links between documents that share a signature, and where it is common the one of a pair of
    segments, but are in different components; ``checked`` pairs are left out."""
    part, whole = scheme.part, scheme.whole
    both = members.select("signature", "id").union(members.select("signature", F.col("lead").alias("id"))).distinct()
    labelled = both.join(found.withColumnRenamed("node", "id"), "id", "left").select("signature", "id", F.coalesce("component", "id").alias("component"))
    open_rows = written(labelled.join(_open(labelled), "signature"), "open_signatures")
    common = open_rows.where(F.col("n") > COMMON)
    sets = written(_token_sets(rows, common.select("id").distinct(), width), "common_sets")
    of_one, of_pair = common.where("signature & 1 = 0"), common.where("signature & 1 = 1")
    paired = _in_pairs(of_one, sets, scheme).union(of_pair.select("signature", "id", "component"))
    paired = written(paired.distinct(), "paired_segments")
    paired = written(paired.join(_open(paired), "signature"), "open_pairs")
    edits = written(_from_hubs(paired.where(F.col("n") > COMMON), sets, part, whole), "differences")
    apart = (_pairs_across(open_rows.where(F.col("n") <= COMMON), index, part, whole)
             .union(_pairs_across(paired.where(F.col("n") <= COMMON), index, part, whole))
             .union(_near(_pairs_beside_hubs(edits, part, whole), index, part, whole)))
    links = _verified(apart.distinct().join(checked, ["lead", "id"], "left_anti"), rows, width, part, whole)
    return links.union(edits.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                       part: int = 90, whole: int = 100) -> DataFrame:
    """Identifier, ``n_shingles`` and ``component_id`` (smallest identifier reachable by links) of each row.

    Two rows are linked when their sets' intersection is at least ``part`` / ``whole`` of the union.
    """
    scheme = Scheme(part, whole)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    index = written(_indexed(rows, width), "index")
    held = index.where("size > 0")
    classes = held.groupBy("size", "sum1", "sum2").agg(F.min("id").alias("first"))
    classes = written(classes.where("first is not null"), "classes")

    single = _packed(rows, classes.select(F.col("first").alias("id")))
    # signatures are shuffled slice by slice, so that the disk holds one slice of them at a time
    shares = SLICES if classes.count() > SLICED_FROM else 1
    if shares > 1:
        single = written(single, "packed")
    members = reduce(DataFrame.union, [written(_members(single, scheme, width, shares, own), "members") for own in range(shares)])
    if shares > 1:
        discarded(single)
    pairs = written(members.select("lead", "id").distinct(), "pairs")
    links = written(_verified(_near(pairs, held, part, whole), rows, width, part, whole), "links")
    found = connected_components(links)
    more = written(_links_across(members, found, pairs, rows, held, scheme, width), "more_links")
    found = connected_components(links.union(more)) if more.head(1) else found
    named = (classes.join(found.withColumnRenamed("node", "first"), "first", "left")
             .select("size", "sum1", "sum2", F.coalesce("component", "first").alias("component")))
    return (index.select("id", "size", "sum1", "sum2").join(named, ["size", "sum1", "sum2"], "left")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id")))
