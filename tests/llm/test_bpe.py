import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm.helpers import awkward, documents
from storepulse.llm.bpe import Codec, decode, encode, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_equal_tiktoken_on_odd_strings(reference):
    codec, rng = Codec(PATH, PATTERN), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "'s", "'S", "1", "²", "_", "\x1c", "\x85", "\xa0", "　", "😀", "<|endoftext|>",
             "\x00", "ß", "İ", "the", "tion", "▁", "Ā", "▁"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_a_full_store_starts_anew(reference, monkeypatch):
    monkeypatch.setattr("storepulse.llm.bpe.CACHE", 5)
    codec = Codec(PATH, PATTERN)
    for text in ("one two three four", "five six seven one", "one two three four five six seven eight nine"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_digests_and_round_trip(spark, reference):
    rows = awkward()
    df = documents(spark, rows)
    found = encode(df, PATH, PATTERN, digest=True).collect()
    expect = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in found), key=str) == sorted(expect, key=str)
    back = decode(encode(df, PATH, PATTERN), PATH, PATTERN)
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in back.collect()), key=str) == \
        sorted(((i, (t or "").encode()) for i, t in rows), key=str)


def test_empty_table(spark):
    assert encode(documents(spark, []), PATH, PATTERN).count() == 0


def test_store_is_bound_by_bytes(monkeypatch):
    monkeypatch.setattr("storepulse.llm.bpe.CACHE_BYTES", 2000)
    tool = Codec(PATH, public_tokenizers.PATTERN)
    for i in range(30):
        text = " ".join("x" * (200 + 30 * i + k) for k in range(3))
        assert tool.decode(np.frombuffer(tool.encode(text), "<u4").tolist()).decode() == text
        assert tool._held < 2000 + 20_000
