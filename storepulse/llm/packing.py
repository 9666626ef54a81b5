"""Packing token sequences into fixed windows by best-fit decreasing.

A document's ids and an end id are cut into full windows and a rest.  Full windows are
sequences of their own.  The rests are packed best-fit decreasing: longest first, each
into the open window with least room that still holds it.  Which rest goes where depends
on the lengths alone, and there are fewer lengths than the window has places, so the
packing is worked out on the histogram of lengths: windows that hold the same lengths
form one run of consecutive numbers, a segment tree over the remaining room finds the
tightest run, and equal lengths are placed in bulk.  The result is that of placing the
pieces one by one, while the driver holds a few entries for each length however many
documents there are.  A piece finds its window by its rank among pieces of its length.

A null or empty text is the end id alone.  Repeated rows are packed once each.  Only the
identifier and the text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storepulse.llm.common import map_batches, slices, text_or_empty, utf8_buffer, written
from storepulse.llm.words import distinct_words, same_bytes, spans, words_of

WINDOW = 2048
#: Identifier buckets in which pieces are ranked, so that no task ranks all pieces of a length.
BUCKETS = 4096
#: Bytes of words and ids kept in a worker, and of pre-tokens and ids; beyond it a store forgets.
CACHE_BYTES = 48 << 20
#: What an entry of a store takes besides its bytes, about.
ENTRY_BYTES = 150
#: Pre-tokens that are encoded in one text.
JOINED = 512
# The tokenizer's own pattern for letters of ASCII and Latin-1, and the words it is certain for.
# A line end is a piece of its own.
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|\n|[^a-zà-öø-ÿß0-9\n]+")
_CERTAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_CERTAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ\n]+")
#: Stands for a line end among ids; no vocabulary is that large.
_NO_ID = 0xFFFFFFFF
_LINE_END = np.array([_NO_ID], dtype="<u4").tobytes()


class Store:
    """Ids by pre-token, in two generations.  When the young one holds half of ``limit`` bytes it becomes the old one,
    whose entries go; what is found in the old one is young again.  What is put in at once stays together."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self._young, self._old, self._bytes, self._old_bytes = limit, {}, {}, 0, 0

    @property
    def held(self) -> int:
        return self._bytes + self._old_bytes

    def make_room(self) -> None:
        if self._bytes > self.limit // 2:
            self._old, self._old_bytes, self._young, self._bytes = self._young, self._bytes, {}, 0

    def put(self, entries: dict[str | bytes, bytes]) -> None:
        self._young.update(entries)
        self._bytes += sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY_BYTES * len(entries)

    def find(self, keys: list) -> list[bytes | None]:
        """The ids of each of the keys, which are distinct; None of unknown ones."""
        found = list(map(self._young.get, keys))
        if self._old:
            missing = [k for k, ids in enumerate(found) if ids is None]
            again = {}
            for k, ids in zip(missing, map(self._old.get, [keys[k] for k in missing])):
                if ids is not None:
                    found[k] = again[keys[k]] = ids
            self.put(again)
        return found


class Entries(NamedTuple):
    """Words in the order of their fingerprints, with their ids."""

    code: np.ndarray  # fingerprint, of which there is one word
    start: np.ndarray  # first byte of each word in ``text``
    length: np.ndarray  # bytes
    first: np.ndarray  # first id in ``ids``
    count: np.ndarray  # ids
    text: np.ndarray
    ids: np.ndarray

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in self)

    def at(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where each word of ``data`` is, -1 if it is not there.  Fingerprints find it, bytes decide."""
        if not len(self.code):
            return np.full(len(code), -1)
        place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        check = np.flatnonzero((self.code[place] == code) & (self.length[place] == length))
        check = check[same_bytes(data, start[check], self.text, self.start[place[check]], length[check])]
        out = np.full(len(code), -1)
        out[check] = place[check]
        return out

    def ids_of(self, place: np.ndarray) -> np.ndarray:
        return self.ids[spans(self.first[place], self.count[place])]

    def plus(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray, count: np.ndarray, ids: np.ndarray) -> Entries:
        """These and words of ``data``; of words with one fingerprint the first stays."""
        both, which = np.unique(np.concatenate([self.code, code]), return_index=True)
        new = np.sort(which[which >= len(self.code)]) - len(self.code)
        first = (np.cumsum(count) - count)[new]
        start, length, count = start[new], length[new], count[new]
        # the new ones lie behind the others, as they do in ``which``
        which = np.where(which < len(self.code), which, len(self.code) + np.searchsorted(new, which - len(self.code)))
        return Entries(both, np.concatenate([self.start, len(self.text) + np.cumsum(length) - length])[which],
                       np.concatenate([self.length, length])[which],
                       np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])[which],
                       np.concatenate([self.count, count])[which],
                       np.concatenate([self.text, data[spans(start, length)]]), np.concatenate([self.ids, ids[spans(first, count)]]))


_NO_ENTRIES = Entries(np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint8), np.empty(0, "<u4"))


class WordStore:
    """Ids by word, in two generations as in ``Store``."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self._young, self._old = limit, _NO_ENTRIES, _NO_ENTRIES

    @property
    def held(self) -> int:
        return self._young.held + self._old.held

    def make_room(self) -> None:
        if self._young.held > self.limit // 2:
            self._old, self._young = self._young, _NO_ENTRIES

    def put(self, *words: np.ndarray) -> None:
        self._young = self._young.plus(*words)

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray):
        """(ids of known words, how many each word has, where its own begin, which words are unknown)."""
        count, begin, unknown, flat = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.arange(len(code)), []
        for held in (self._young, self._old):
            place = held.at(data, start[unknown], length[unknown], code[unknown])
            hit, place = unknown[place >= 0], place[place >= 0]
            unknown = np.setdiff1d(unknown, hit, assume_unique=True)
            count[hit] = held.count[place]
            begin[hit] = sum(map(len, flat)) + np.cumsum(count[hit]) - count[hit]
            flat.append(held.ids_of(place))
            if held is self._old and len(hit):
                self.put(data, start[hit], length[hit], code[hit], count[hit], flat[-1])
        return np.concatenate(flat), count, begin, unknown


PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long")


class WordEncoder:
    """Ids of texts by a byte-pair tokenizer that drops white space.

    A slice of texts is cut into words, each distinct word is looked up once by its bytes, and the
    ids are gathered in order.  New words are cut into the tokenizer's pre-tokens where that is
    certain (ASCII and Latin letters, digits, punctuation), and many pre-tokens are encoded
    in one text: the last id of each stands for a token with the end-of-word mark.
    Other words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self._tool = Tokenizer.from_file(path)
        self._tool.encode_special_tokens = True
        mark = self._tool.model.end_of_word_suffix
        vocabulary = self._tool.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        self._words, self._pieces = WordStore(), Store()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self._tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_pieces(self, new: list[str]) -> dict[str, bytes]:
        added = {}
        chunks = [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        for chunk, ids in zip(chunks, self._plain([" ".join(c) for c in chunks])):
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                each = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
            else:
                each = [x.tobytes() for x in self._plain(chunk)]
            added.update(zip(chunk, each))
        self._pieces.put(added)
        return added

    def _encode_certain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_encode_words`` of words that ``_CERTAIN`` holds for: all are cut at once, with a line end after each."""
        cut = _PRE_TOKEN.findall(b"\n".join([*words, b""]).decode().lower())
        self._pieces.make_room()
        distinct = list(set(cut) - {"\n"})
        known = dict(zip(distinct, self._pieces.find(distinct)))
        known.update(self._add_pieces([p for p, ids in known.items() if ids is None]))
        known["\n"] = _LINE_END
        ids = b"".join([known[p] for p in cut])
        ids = np.frombuffer(ids, "<u4")
        lines = ids == _NO_ID
        return np.diff(np.flatnonzero(lines), prepend=-1) - 1, ids[~lines]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        if _CERTAIN_LINES.fullmatch(b"\n".join(words).decode()):
            return self._encode_certain(words)
        certain = np.array([_CERTAIN.fullmatch(w.decode()) is not None for w in words])
        own_count, own = self._encode_certain([w for w, sure in zip(words, certain) if sure])
        other = self._plain([w.decode() for w, sure in zip(words, certain) if not sure])
        order = np.argsort(~certain, kind="stable")      # certain words first
        held = np.concatenate([own_count, [len(x) for x in other]]).astype(np.int64)
        count, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[order], begin[order] = held, np.cumsum(held) - held
        return count, np.concatenate([own, *other])[spans(begin, count)]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin)."""
        words = words_of(data, starts)
        first, which = distinct_words(data, words)
        start, length, code = words.start[first], (words.end - words.start)[first], words.code[first]
        self._words.make_room()
        flat, size, begin, new = self._words.find(data, start, length, code)
        if len(new):
            raw = data.tobytes()
            added, ids = self._encode_words([raw[a:b] for a, b in zip(start[new].tolist(), (start + length)[new].tolist())])
            self._words.put(data, start[new], length[new], code[new], added, ids)
            size[new], begin[new] = added, len(flat) + np.cumsum(added) - added
            flat = np.concatenate([flat, ids])
        each = size[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], each)]
        return ids, ends[words.first]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(df: DataFrame, path: str, end_id: int, window: int = WINDOW,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: full windows in order, then the rest."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in slices(batches, 2 << 20):
            of, start, length, crc, tokens = [], [], [], [], []
            ids, bounds = tool.encode(*utf8_buffer(batch.column("text")))
            raw, bounds = ids.tobytes(), bounds.tolist()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                own = raw[4 * a:4 * b] + end
                n = b - a + 1
                for at in range(0, n, window):
                    part = own[4 * at:4 * (at + window)]
                    of.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(rows, run, schema)


class RoomTree:
    """Segment tree over remaining room 0..window; a leaf is set while a window with that room is open."""

    def __init__(self, window: int):
        self._half = 1 << window.bit_length()
        self._any = np.zeros(2 * self._half, dtype=bool)

    def put(self, room: int, there: bool) -> None:
        at = room + self._half
        self._any[at] = there
        while at > 1:
            at //= 2
            self._any[at] = self._any[2 * at] or self._any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open window has."""
        at = need + self._half
        if self._any[at]:
            return need
        while at > 1 and not (at % 2 == 0 and self._any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self._half:
            at = 2 * at if self._any[2 * at] else 2 * at + 1
        return at - self._half


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go.

    Entries are (length, first rank, count, first window, pieces in each window, offset):
    the piece of rank ``first + j`` goes to window ``first window + j // each`` at
    ``offset + (j % each) * length``.
    """
    tree, runs = RoomTree(window), [[] for _ in range(window + 1)]  # runs[room]: (first window, windows)
    placed, windows = [], 0

    def open_run(room: int, first: int, count: int) -> None:
        if count:
            runs[room].append((first, count))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                first, count = windows, -(-left // each)
                windows += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
            each = room // length
            full, some = divmod(min(left, count * each), each)
            if full:
                placed.append((length, rank, full * each, first, each, window - room))
                open_run(room - each * length, first, full)
            if some:
                placed.append((length, rank + full * each, some, first + full, some, window - room))
                open_run(room - some * length, first + full, 1)
            used = full + (some > 0)
            open_run(room, first + used, count - used)
            rank += full * each + some
            left -= full * each + some
    return placed


def pack(cut: DataFrame, window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """``cut`` (of ``pieces``) with ``sequence_id`` and ``offset``.  Rests come first, then full windows."""
    spark = cut.sparkSession
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    # one row for each length and bucket: at most window * buckets
    counts = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    full = histogram.pop(window, 0)
    placed = best_fit_decreasing(histogram, window)
    rests = max((first + -(-n // each) for _, _, n, first, each, _ in placed), default=0)
    if full:
        placed.append((window, 0, full, rests, 1, 0))
    table = spark.createDataFrame(
        placed, "length long, _first long, _count long, _window long, _each long, _offset long")
    in_bucket = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (bucketed.withColumn("_row", F.row_number().over(in_bucket) - 1)
              .join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_row")))
    j = F.col("_rank") - F.col("_first")
    # a few entries for each length, at most about three times the window
    return (ranked.join(F.broadcast(table), "length").where((j >= 0) & (j < F.col("_count")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("_window") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"),
                    (F.col("_offset") + F.pmod(j, F.col("_each")) * F.col("length")).alias("offset")))


def pack_documents(df: DataFrame, path: str, end_id: int = 1, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack; the pieces are written once, as the packing reads them twice."""
    out = pack(written(pieces(df, path, end_id, window, id_col, text_col), "pieces"), window)
    return out.withColumnRenamed("doc_id", id_col)
