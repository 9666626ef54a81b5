import random
from collections import Counter

import numpy as np
import pytest
from llm.helpers import awkward, documents, sentence
from storepulse.llm import substrings
from storepulse.llm.substrings import common_prefixes, remove_repeats, suffix_array


def brute(rows, length):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        covered = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                covered[k] += 1
                covered[k + length] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df, **options).collect()),
                  key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    passages = [sentence(rng, 30) for _ in range(3)]
    rows = []
    for i in range(30):
        words = sentence(rng, rng.randint(0, 60))
        if i % 2:
            words += " " + rng.choice(passages) + " " + sentence(rng, rng.randint(0, 20))
        if i % 7 == 0:
            words += rng.choice(passages)[:rng.randint(1, 100)] * 3
        rows.append((1000 + i, words))
    return rows


def test_equals_brute_force(spark):
    rows = corpus() + [r for r in awkward() if len(r[1] or "") < 5000]
    assert found(documents(spark, rows), length=60, gram=16) == brute(rows, 60)


def test_long_texts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1000)
    rng = random.Random(8)
    passage = sentence(rng, 100)
    rows = [(1, sentence(rng, 900) + passage), (2, passage + sentence(rng, 700)), (3, "ab" * 4000), (4, "z" * 3000), (5, sentence(rng, 300))]
    assert found(documents(spark, rows), length=120, gram=32) == brute(rows, 120)


@pytest.mark.parametrize("segments", [1, 3])
def test_anchor_with_many_segments_is_split_and_merged(spark, monkeypatch, segments):
    # many documents share a passage and differ around it
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", segments)
    rng = random.Random(9)
    passage = sentence(rng, 12)[:70]
    rows = [(i, sentence(rng, 15) + passage + sentence(rng, 15)) for i in range(25)]
    assert found(documents(spark, rows), length=60, gram=16) == brute(rows, 60)


def test_default_length(spark):
    rng = random.Random(10)
    passage = sentence(rng, 120)
    rows = [(1, "a" + passage), (2, passage + "b"), (3, passage[:399]), (4, sentence(rng, 200))]
    assert found(documents(spark, rows)) == brute(rows, 400)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = rng.integers(97, 97 + rng.integers(1, 4), 400).astype(np.uint8)
        parts = [base[a:a + rng.integers(1, 150)] for a in rng.integers(0, 250, rng.integers(1, 7))]
        data, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        begins = ends - [len(p) for p in parts]
        end_of = np.repeat(ends, ends - begins)
        order, rank = suffix_array(data, end_of)
        suffix = [bytes(data[i:end_of[i]]) for i in range(len(data))]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i))
        limit = int(rng.integers(1, 90))
        shared = common_prefixes(data, begins, ends, order, rank, limit)
        for a, b in zip(order, order[1:]):
            same = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
            assert shared[b] == min(same, limit)


def test_empty_table(spark):
    assert found(documents(spark, [])) == []
