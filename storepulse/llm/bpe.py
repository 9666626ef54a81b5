"""Byte-level BPE through a sentencepiece model written from a rank file.

``model_bytes`` serialises a sentencepiece BPE model straight from a vocabulary of byte
strings: each byte becomes one character, each token one piece with its negative rank as
score, with identity normalisation.  Its merges (best score first, leftmost on ties) are
then those of the rank file.  A text is split by the tokenizer's pattern, every distinct
pre-token is encoded once for a while, and ids are joined in order.  Decoding maps ids to
their byte strings.

A null or empty text has no tokens.  Repeated rows are encoded alike; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, slices, text_or_empty

#: Distinct pre-tokens kept in a worker, and the bytes of these and their ids; beyond either the store starts anew.
CACHE = 400_000
CACHE_BYTES = 64 << 20
#: First code point of the characters that stand for bytes.
BYTE_BASE = 0x100

_AS_CHARS = {b: BYTE_BASE + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_AS_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protocol-buffer field: length-delimited, varint or 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, str):
        value = value.encode()
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; the id of a piece is its place in rank order plus 1."""
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, as_piece(token)) + _field(2, float(-rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0)
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # -1: no begin, end or padding piece
    plain = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, plain)


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self._tokens = {rank: token for token, rank in ordered}
        self._id_of_piece = np.array([0] + [rank for _, rank in ordered], dtype="<u4")
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self._split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._held = 0

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, known = self._split(text), self._known
        parts = list(map(known.get, words))
        if None in parts:
            new = list({w for w, part in zip(words, parts) if part is None})
            if len(known) + len(new) > CACHE or self._held > CACHE_BYTES:
                known.clear()
                self._held = 0
                new = list(set(words))
            pieces = self._model.encode([as_piece(w.encode()) for w in new], num_threads=1)
            ids = [self._id_of_piece[p].tobytes() for p in pieces]
            known.update(zip(new, ids))
            self._held += sum(map(len, new)) + sum(map(len, ids))
            parts = map(known.__getitem__, words)
        return b"".join(parts)

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self._tokens
        return b"".join([tokens[i] for i in ids])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; built once for each file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           digest: bool = False) -> DataFrame:
    """Ids of each text (``ids``), or with ``digest`` their number and the SHA-256 of the
    ids and of the bytes that they decode to.

    ``path`` names a rank file present on every executor.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, 4 << 20):
            out: list = []
            for text in batch.column("text").to_pylist():
                raw = tool.encode(text)
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                out.append((len(ids), hashlib.sha256(raw).hexdigest(),
                            hashlib.sha256(tool.decode(ids)).hexdigest()) if digest else ids)
            if digest:
                n, sha, back = zip(*out)
                columns = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns, names = [pa.array(out, pa.list_(pa.int64()))], ["id", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Identifier and ``decoded``, the bytes that the ids stand for; null ids decode to no bytes."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            decoded = [tool.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decoded, pa.binary())], names=["id", "decoded"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, decoded binary"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)
