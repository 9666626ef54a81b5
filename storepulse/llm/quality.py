"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each, covering the whole text).
Every passage is described by measures of its characters and words and encoded by a small
layer; gated attention weighs the encodings, and a logistic layer scores the weighted sum.
Encoder, attention and scorer are learned together from document labels alone.

The model is fitted on the driver on a bounded sample of labelled rows: at most
``TRAINING_ROWS`` documents, in the order of a hash of the identifier, and no more of them
than hold ``TRAINING_BYTES`` bytes.  Scoring reads every row and whole texts.

Null and empty texts are one empty passage and get a score like any other.  Rows of the
label table with a null label are not used; of several labels for one document the lowest
counts.  Where the sample lacks one of the classes every score is the share of label 1
(0.5 without any labelled row).  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, slices, text_or_empty, utf8_buffer
from storepulse.llm.words import words_of

PASSAGE_WORDS = 48
TRAINING_ROWS = 8000
TRAINING_BYTES = 48 << 20
#: Bytes of texts that are measured at a time; the arrays of their bytes take about 30 times as much.
SLICE_BYTES = 1 << 20
THRESHOLD = 0.3
WIDTH = 16
ATTENTION = 8
EPOCHS = 60
BATCH = 256

# Character classes that passages are measured by.
_CLASSES = [" ", "\n\r\t\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
            ".", ",;:'\"", "!?", "|", "%&$#*@^~+=<>\\/_", "()[]{}-"]
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)  # the rest: bytes beyond ASCII and controls
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _chars]] = _k
_KINDS = len(_CLASSES) + 1
MEASURES = _KINDS + 7


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each passage (rows), and for each text its first passage (one more entry at the end)."""
    words = words_of(data, starts)
    count = np.maximum(1, -(-np.diff(words.first) // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    out = np.zeros((n, MEASURES), dtype=np.float64)
    if not len(words.start):
        return out, first
    at = first[words.text] + (np.arange(len(words.start)) - words.first[words.text]) // PASSAGE_WORDS
    # a passage takes the bytes from its first word to the next passage or the end of the text
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    passage_of_text = np.zeros(len(data), dtype=np.int64)
    bounds = np.append(words.start[heads], len(data))
    passage_of_text[bounds[0]:] = np.repeat(at[heads], np.diff(bounds))
    kinds = np.bincount(passage_of_text * _KINDS + _CLASS_OF[data], minlength=n * _KINDS).reshape(n, _KINDS)
    size = np.maximum(1, kinds.sum(axis=1))
    share = kinds / size[:, None]
    out[:, :_KINDS] = np.sqrt(share)
    held = np.bincount(at, minlength=n)
    some = np.maximum(1, held)
    again = (np.diff(words.code, prepend=np.uint64(0)) == 0) & (np.diff(at, prepend=-1) == 0)
    key = np.sort(at.astype(np.uint64) << np.uint64(36) | words.code >> np.uint64(28))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> np.uint64(36)).astype(np.int64), minlength=n)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(at, weights=length, minlength=n) / some
    out[:, _KINDS] = held / PASSAGE_WORDS
    out[:, _KINDS + 1] = distinct / some
    out[:, _KINDS + 2] = np.bincount(at, weights=again, minlength=n) / some
    out[:, _KINDS + 3] = mean / 10
    out[:, _KINDS + 4] = np.log1p(np.maximum(0, np.bincount(at, weights=length**2, minlength=n) / some - mean**2)) / 4
    out[:, _KINDS + 5] = share[:, 3] / np.maximum(share[:, 2] + share[:, 3], 1e-9)
    out[:, _KINDS + 6] = np.log1p(np.repeat(np.diff(words.first), count)) / 8
    return out, first


class Model(NamedTuple):
    """Weights by name; ``mean`` and ``scale`` standardise the measures."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: Model, x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ m.encode + m.encode_bias)
    t, s = np.tanh(h @ m.tanh_gate), _sigmoid(h @ m.sigmoid_gate)
    e = (t * s) @ m.attend
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return h, t, s, a, bag, z, _sigmoid(z @ m.score + m.score_bias[0])


def score_bags(m: Model, measures: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each document, attention of each passage)."""
    if len(first) < 2:
        return np.empty(0), np.empty(0)
    out = _forward(m, (measures - m.mean) / m.scale, first)
    return out[-1], out[3]


def _gradients(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    h, t, s, a, bag, z, p = _forward(m, x, first)
    out = (p - y) / len(y)
    by_bag = out[:, None] * m.score
    dh = a[:, None] * by_bag[bag]
    along = (h * by_bag[bag]).sum(axis=1)
    de = a * (along - np.add.reduceat(a * along, first[:-1])[bag])
    dt = (de[:, None] * m.attend) * s * (1 - t**2)
    ds = (de[:, None] * m.attend) * t * s * (1 - s)
    dh += dt @ m.tanh_gate.T + ds @ m.sigmoid_gate.T
    du = dh * (1 - h**2)
    return {"encode": x.T @ du, "encode_bias": du.sum(axis=0), "tanh_gate": h.T @ dt, "sigmoid_gate": h.T @ ds,
            "attend": (t * s).T @ de, "score": z.T @ out, "score_bias": np.array([out.sum()])}


def fit(measures: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss, with a little weight decay."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    scale = measures.std(axis=0)
    m = Model(measures.mean(axis=0), np.where(scale > 1e-6, scale, 1.0), start(MEASURES, WIDTH), np.zeros(WIDTH),
              start(WIDTH, ATTENTION), start(WIDTH, ATTENTION), start(ATTENTION), start(WIDTH), np.zeros(1))
    x = (measures - m.mean) / m.scale
    learned = Model._fields[2:]
    first_moment = {k: np.zeros_like(getattr(m, k)) for k in learned}
    second_moment = {k: np.zeros_like(getattr(m, k)) for k in learned}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            chosen = order[begin:begin + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            bounds = np.concatenate([[0], np.cumsum(first[chosen + 1] - first[chosen])])
            step += 1
            for k, g in _gradients(m, x[rows], bounds, y[chosen]).items():
                g = g + 1e-4 * getattr(m, k)
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                move = (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                getattr(m, k)[...] -= 0.01 * move
    return m


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model | float:
    """The model, or the constant score where the sample lacks a class."""
    order = F.xxhash64(F.col("id").cast("string"), F.lit("training"))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .where("id is not null and label is not null")
             .where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
             .orderBy(order, "id").limit(TRAINING_ROWS))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # at most TRAINING_ROWS rows of an identifier and a label; of rows that share one, a single text
    def one_each(ids: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    sample = one_each(known.select("id")).join(F.broadcast(known), "id")
    sizes = sample.select("id", "label", F.octet_length("text").alias("bytes"), order.alias("at")).collect()
    sizes.sort(key=lambda r: (r["at"], r["id"], r["bytes"]))
    chosen, filled = {}, 0
    for r in sizes:
        if filled + r["bytes"] <= TRAINING_BYTES:
            filled += r["bytes"]
            chosen[r["id"]] = r["label"]
    y = [float(v > 0) for v in chosen.values()]
    if len(set(y)) < 2:
        return y[0] if y else 0.5

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            x, first = passages(*utf8_buffer(batch.column("text")))
            bags = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bags, pa.binary())], names=["id", "bag"])

    kind = rows.schema["id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame([(k,) for k in chosen], f"id {kind}")
    bags = map_batches(one_each(picked), measured, f"id {kind}, bag binary").collect()
    bags.sort(key=lambda r: (r["id"], r["bag"]))
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, MEASURES) for r in bags]
    first = np.concatenate([[0], np.cumsum([len(b) for b in x])])
    return fit(np.concatenate(x).astype(np.float64), first, np.array([float(chosen[r["id"]] > 0) for r in bags]))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and score of every document."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            if isinstance(model, float):
                found = np.full(batch.num_rows, model)
            else:
                found, _ = score_bags(model, *passages(*utf8_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every document."""
    model = train(docs, labels, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(
        id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES, text_col):
            if isinstance(model, float):
                found = np.full(batch.num_rows, model)
            else:
                found, _ = score_bags(model, *passages(*utf8_buffer(batch.column(text_col))))
            yield batch.filter(pa.array(found >= threshold))

    return map_batches(docs, run, docs.schema)
