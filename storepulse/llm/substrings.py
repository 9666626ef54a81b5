"""Removal of repeated substrings with per-shard suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in the same
or another document, is removed.

1. *Shards by anchor.*  A window of ``LENGTH`` bytes has an anchor: its ``GRAM``-byte string
   with the smallest hash, leftmost on ties.  Equal windows have equal anchors, so windows
   can only repeat within the shard of their anchor.  Consecutive windows with the same
   anchor form one segment.  An anchor that occurs once is done with.
2. *Equal segments* are counted by two 64-bit fingerprints; where one occurs again, all of
   its bytes are covered.  One copy of each goes on.
3. *Suffix arrays.*  The different segments of a shard are sorted by Larsson-Sadakane
   refinement (prefix doubling that re-sorts unresolved groups only) in numpy, and Kasai's
   algorithm, run over all segments in step, gives common prefixes.  Neighbours that share
   ``LENGTH`` bytes repeat.
4. *Cross-shard merging.*  An anchor with more than ``SHARD_SEGMENTS`` different segments is
   split into shards of that size.  Each cuts its sorted windows by binary search into as
   many ranges as there are shards; a range's slices are then merged by binary search in
   one place, so that no task holds more than about a shard.

Offsets are bytes of the UTF-8 text.  Null, empty and short texts lose nothing.  Rows that
are equal in identifier and text repeat each other.  Only the identifier and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, mix64, slices, text_or_empty, utf8_buffer, written

LENGTH = 400
GRAM = 64
#: Different segments of an anchor that one suffix array takes.
SHARD_SEGMENTS = 512
#: Bytes whose suffixes are sorted at a time.
ARRAY_BYTES = 1 << 19
#: Bytes of text that anchors are sought in at a time.
PIECE = 1 << 19

_CODES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
_CODES2 = mix64(np.arange(256, dtype=np.uint64) + np.uint64(99991))
_P1, _P2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Tables:
    """Powers and inverse powers of both bases, grown as needed."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, ...]:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.all = tuple(_powers(b, self.size) for b in (_P1, pow(_P1, -1, 1 << 64), _P2, pow(_P2, -1, 1 << 64)))
        return self.all


_tables = _Tables()


class Prefixes:
    """Fingerprints of any substring of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        p1, self._i1, p2, self._i2 = _tables.upto(len(data) + 1)
        zero = np.zeros(1, np.uint64)
        self._s1 = np.concatenate([zero, np.cumsum(_CODES[data] * p1[:len(data)], dtype=np.uint64)])
        self._s2 = np.concatenate([zero, np.cumsum(_CODES2[data] * p2[:len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (mix64((self._s1[end] - self._s1[start]) * self._i1[start]).view(np.int64),
                mix64((self._s2[end] - self._s2[start]) * self._i2[start]).view(np.int64))


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each position."""
    h, reach = _CODES[data], 1
    while reach < width:
        h = h[:-reach] * np.uint64(pow(_P1, reach, 1 << 64)) + h[reach:]
        reach *= 2
    return mix64(h)


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position."""
    least, reach = values, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:len(least) - (width - reach)], least[width - reach:]) if width > reach else least


def anchored_segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The segments of the texts: anchor, fingerprints, size, text, start in the text, copies
    that follow each other, and the end of the last of them."""
    sizes = np.diff(starts)
    empty = {k: np.empty(0, np.int64) for k in ("anchor", "print1", "print2", "size", "text", "start", "reach", "copies")}
    count = np.maximum(0, sizes - length + 1)  # windows of each text
    if not count.sum():
        return empty
    hashes = _gram_hashes(data, gram)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    place = np.arange(len(hashes), dtype=np.uint64)
    least = _least_ahead((hashes >> bits << bits) | place, length - gram + 1)
    text = np.repeat(np.arange(len(sizes)), count)
    window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + starts[text]
    at = least[window] & ((np.uint64(1) << bits) - np.uint64(1))
    head = np.ones(len(at), dtype=bool)
    head[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(head)
    begin, end = window[head], window[np.append(head[1:], len(window)) - 1] + length
    print1, print2 = Prefixes(data).of(begin, end)
    text = text[head]
    # copies in a row (a text with a short period) count as one
    again = np.zeros(len(head), dtype=bool)
    again[1:] = (print1[1:] == print1[:-1]) & (print2[1:] == print2[:-1]) & (text[1:] == text[:-1]) & \
        (end[1:] - begin[1:] == end[:-1] - begin[:-1]) & (begin[1:] <= end[:-1])
    first = np.flatnonzero(~again)
    last = np.append(first[1:], len(head)) - 1
    of = text[first]
    return {"anchor": hashes[at[head][first].astype(np.int64)].view(np.int64), "print1": print1[first], "print2": print2[first],
            "size": (end - begin)[first], "text": of, "start": begin[first] - starts[of], "reach": end[last] - starts[of],
            "copies": last - first + 1}


_SEGMENT = "anchor long, print1 long, print2 long, size int, doc long, mark long, start long, reach long, copies long"
#: Stands for a null identifier.
_NO_ID = -(1 << 63)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"),
                     text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """The texts compressed, to be shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 4 << 20):
            packed = [squeeze(t.as_buffer()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(packed, pa.binary())],
                                             names=["doc", "mark", "packed"])

    return map_batches(rows, run, "doc long, mark long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, batch.column("packed").to_pylist())


def segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments; ``doc`` and ``mark`` (a hash of the text) name the row."""
    def out(batch: pa.RecordBatch, found: dict[str, np.ndarray], shift: int = 0) -> pa.RecordBatch:
        of = pa.array(found["text"], pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(pa.array(found[k], pa.int64()) for k in ("anchor", "print1", "print2")), pa.array(found["size"].astype(np.int32), pa.int32()),
             batch.column("doc").take(of), batch.column("mark").take(of),
             *(pa.array(found[k] + s, pa.int64()) for k, s in (("start", shift), ("reach", shift), ("copies", 0)))],
            names=["anchor", "print1", "print2", "size", "doc", "mark", "start", "reach", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PIECE):
            data, starts = utf8_buffer(batch.column("text"))
            if batch.num_rows == 1:  # a long text is taken in pieces that overlap by a window
                for begin in range(0, max(1, len(data) - length + 1), PIECE):
                    piece = data[begin:begin + PIECE + length - 1]
                    yield out(batch, anchored_segments(piece, np.array([0, len(piece)]), length, gram), begin)
            else:
                yield out(batch, anchored_segments(data, starts, length, gram))

    return map_batches(rows, run, _SEGMENT)


def _words_ahead(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes, each of which ends with its segment.

    ``ends[i]`` is the end of the segment of position ``i``.  Equal suffixes are ordered by
    position.
    """
    n = len(data)
    place = np.arange(n)
    left = ends - place
    words = _words_ahead(data)
    short = left < 8
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))
    # shorter suffixes first among those that are alike up to their end
    order = np.lexsort((np.minimum(left, 8), words))
    rank = np.empty(n, dtype=np.int64)
    sorted_words, sorted_left = words[order], np.minimum(left, 8)[order]
    head = np.ones(n, dtype=bool)
    head[1:] = (sorted_words[1:] != sorted_words[:-1]) | (sorted_left[1:] != sorted_left[:-1])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    single = head & np.append(head[1:], True)
    open_at = np.flatnonzero(~single)  # places in the order that are not settled
    while len(open_at):
        suffix = order[open_at]
        ahead = suffix + depth
        inside = ahead < ends[suffix]
        if not inside.any():
            break
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[suffix]
        by = np.argsort(group * (n + 1) + second + 1, kind="stable")
        suffix, second, group = suffix[by], second[by], group[by]
        order[open_at] = suffix
        head = np.ones(len(by), dtype=bool)
        head[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(head, open_at, 0))
        single = head & np.append(head[1:], True)
        # suffixes that ended within this depth are alike for good
        open_at = open_at[~single & ((second >= 0))]
        depth *= 2
    # equal suffixes by position
    tied = np.lexsort((place, rank))
    rank[tied] = place
    return tied, rank


def common_prefixes(data: np.ndarray, begins: np.ndarray, ends_of: np.ndarray, order: np.ndarray, rank: np.ndarray,
                    limit: int) -> np.ndarray:
    """Kasai: for each suffix the bytes, up to ``limit``, that it shares with its predecessor
    in the order.  All segments advance together, one position at a time."""
    n = len(data)
    ends = np.repeat(ends_of, ends_of - begins)
    words = _words_ahead(data)
    shared = np.zeros(n, dtype=np.int64)
    lengths = ends_of - begins
    by_size = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[by_size], lengths[by_size]
    h = np.zeros(len(begins), dtype=np.int64)
    alive = len(begins)
    for t in range(int(lengths.max(initial=0))):
        while alive and lengths[alive - 1] <= t:
            alive -= 1
        here = begins[:alive] + t
        at = rank[here]
        other = order[np.maximum(at - 1, 0)]
        most = np.minimum(np.minimum(ends[here] - here, ends[other] - other), limit)
        most[at == 0] = 0
        now = np.minimum(np.maximum(h[:alive] - 1, 0), most)
        going = np.flatnonzero(now < most)
        while len(going):
            differ = words[np.minimum(here[going] + now[going], n - 1)] ^ words[np.minimum(other[going] + now[going], n - 1)]
            same = differ == 0
            lead = np.full(len(going), 8)
            some = differ[~same]
            # leading zero bytes of the difference
            lead[~same] = 7 - (np.searchsorted(_BYTE_LIMITS, some, side="right") - 1)
            now[going] = np.minimum(now[going] + lead, most[going])
            going = going[same & (now[going] < most[going])]
        shared[here] = now
        h[:alive] = now
    return shared


_BYTE_LIMITS = np.array([0] + [1 << (8 * k) for k in range(1, 8)], dtype=np.uint64)


def _needed(classes: DataFrame) -> DataFrame:
    """The segments that suffix arrays must compare, by row: different ones of an anchor of
    which one at least occurs once."""
    shards = (classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"))
              .where("n > 1 and least = 1").select("anchor", F.ceil(F.col("n") / SHARD_SEGMENTS).alias("parts")))
    part = F.pmod(F.xxhash64("print1", "print2"), F.col("parts")).alias("part")
    return (classes.join(shards, "anchor")
            .groupBy("doc", "mark")
            .agg(F.collect_list(F.struct("anchor", "parts", part, "start", "size", (F.col("copies") == 1).alias("single"))).alias("wanted")))


def _fetched(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """The needed segments with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, wanted) in enumerate(zip(_unpacked(batch), batch.column("wanted").to_pylist())):
                of = pa.array([i] * len(wanted), pa.int64())
                cut = [text[w["start"]:w["start"] + w["size"]] for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([w[k] for w in wanted], pa.int64()) for k in ("anchor", "parts", "part", "start")),
                     pa.array([w["single"] for w in wanted], pa.bool_()), batch.column("doc").take(of), batch.column("mark").take(of),
                     pa.array(cut, pa.binary())],
                    names=["anchor", "parts", "part", "start", "single", "doc", "mark", "bytes"])

    return map_batches(_packed(rows).join(needed, ["doc", "mark"]), run,
                       "anchor long, parts long, part long, start long, single boolean, doc long, mark long, bytes binary")


def _compared(fetched: DataFrame, length: int) -> DataFrame:
    """Spans (doc, mark, start, end) that repeat within a shard; and for an anchor of several
    shards, slices (anchor, range, slice) of its sorted windows."""
    fields = ["doc", "mark", "start", "end", "anchor", "range", "slice"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, parts, part, start, single, doc, mark, cut = zip(*rows)
        anchor, parts, start, doc, mark = (np.array(x, dtype=np.int64) for x in (anchor, parts, start, doc, mark))
        data = np.frombuffer(b"".join(cut), np.uint8)
        size = np.array([len(c) for c in cut])
        ends = np.cumsum(size)
        begins = ends - size
        order, rank = suffix_array(data, np.repeat(ends, size))
        shared = common_prefixes(data, begins, ends, order, rank, length)
        like_before = shared[order] >= length
        repeats = np.empty(len(data), dtype=bool)
        repeats[order] = like_before | np.append(like_before[1:], False)
        of = np.repeat(np.arange(len(size)), size)
        # runs of repeating windows in segments that occur once
        hit = np.flatnonzero(repeats & np.array(single)[of])
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])
            head = np.flatnonzero(new)
            last = hit[np.append(head[1:], len(hit)) - 1]
            head = hit[head]
            seg = of[head]
            shift = start[seg] - begins[seg]
            none = pa.nulls(len(head), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (doc[seg], mark[seg], head + shift, last + shift + length)), none, none,
                 pa.nulls(len(head), pa.binary())], names=fields)
        split = parts[of] > 1
        if split.any():
            # a window for each class of equal ones, by fingerprint
            window = order[~like_before & split[order] & (ends[of[order]] - order >= length)]
            print1, print2 = Prefixes(data).of(window, window + length)
            open_ = ~repeats[window] & np.array(single)[of[window]]
            seg = of[window]
            table = np.stack([print1, print2, doc[seg], mark[seg], window - begins[seg] + start[seg], open_], axis=1)
            for a in np.unique(anchor[seg]):
                mine = table[anchor[seg] == a]
                mine = mine[np.lexsort((mine[:, 1], mine[:, 0]))]
                ranges = int(parts[anchor == a][0])
                # range limits over the values of a fingerprint; cut by binary search
                limits = np.array([-(1 << 63) + ((1 << 64) * k) // ranges for k in range(1, ranges)], dtype=np.int64)
                cuts = np.concatenate([[0], np.searchsorted(mine[:, 0], limits), [len(mine)]])
                some = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array([a] * len(some), pa.int64()), pa.array(some, pa.int64()),
                     pa.array([mine[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary())], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "parts", "part", "start", "single", "doc", "mark", "bytes"))):
                # whole shards only
                if held >= ARRAY_BYTES and (row[0], row[2]) != last:
                    yield from compared(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
                last = (row[0], row[2])
        if rows:
            yield from compared(rows)

    schema = ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in zip(fields, types))
    return map_batches(fetched.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), run, schema)


def _merged(slices_: DataFrame, length: int) -> DataFrame:
    """Spans of windows that repeat across the shards of an anchor."""
    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.int64).reshape(-1, 6) for b in table.column("slice").to_pylist()]
        while len(parts) > 1:  # two by two; each row's place in the other slice is found by binary search
            parts = [np.insert(x, np.searchsorted(x[:, 0], y[:, 0]), y, axis=0) for x, y in zip(parts[0::2], parts[1::2])] + \
                parts[len(parts) & ~1:]
        like_next = parts[0][1:, 0] == parts[0][:-1, 0]
        met = parts[0][np.append(like_next, False) | np.insert(like_next, 0, False)]
        met = met[np.lexsort((met[:, 1], met[:, 0]))]
        like_next = (met[1:, :2] == met[:-1, :2]).all(axis=1)
        again = np.append(like_next, False) | np.insert(like_next, 0, False) if len(met) else np.empty(0, bool)
        hit = met[again & (met[:, 5] > 0)]
        return pa.table({"doc": pa.array(hit[:, 2]), "mark": pa.array(hit[:, 3]), "start": pa.array(hit[:, 4]),
                         "end": pa.array(hit[:, 4] + length)})

    return slices_.groupBy("anchor", "range").applyInArrow(merge, "doc long, mark long, start long, end long")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, mark, start, end) of byte spans whose every byte lies in a repeated string of ``length``
    bytes.  Spans may overlap."""
    found = written(segments(rows, length, gram), "segments")
    often = found.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    found = written(found.join(often, "anchor", "left_semi"), "shared_anchors")
    same = ["anchor", "print1", "print2", "size"]
    classes = written(found.groupBy(*same).agg(F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("doc", "mark", "start"))),
                      "classes")
    whole = (found.join(classes.where("copies > 1").select(*same), same, "left_semi")
             .select("doc", "mark", "start", F.col("reach").alias("end")))
    compared = written(_compared(_fetched(rows, _needed(classes)), length), "compared")
    within = compared.where("slice is null").select("doc", "mark", "start", "end")
    across = _merged(compared.where("slice is not null").select("anchor", "range", "slice"), length)
    return whole.union(within).union(across)


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in spans."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   digest: bool = False) -> DataFrame:
    """Every row's identifier, ``n_bytes``, ``n_removed``, ``n_spans``, and the bytes that stay: ``kept``,
    or with ``digest`` their SHA-256 in ``kept_sha256``."""
    rows = _rows(df, id_col, text_col)
    spans = repeated_spans(rows, length, gram).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, runs, kept = [], [], [], []
            for text, found in zip(_unpacked(batch), batch.column("spans").to_pylist()):
                found = union_of(found or [])
                bounds = [0, *(x for span in found for x in span), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(bounds[0::2], bounds[1::2]))
                total.append(len(text))
                removed.append(len(text) - len(rest))
                runs.append(len(found))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(x, pa.int64()) for x in (total, removed, runs)),
                 pa.array(kept, pa.string() if digest else pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digest else "kept"
    out = map_batches(_packed(rows).join(spans, ["doc", "mark"], "left").select("doc", "packed", "spans"), run,
                      f"doc long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
    return out.select(F.nullif("doc", F.lit(_NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", last)
