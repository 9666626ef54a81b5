import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from llm.helpers import awkward, documents
from storepulse.llm.packing import WordEncoder, best_fit_decreasing, pack_documents
from storepulse.llm.common import utf8_buffer
from tokenizers import Tokenizer
import pyarrow as pa

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    return [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "é", "É", "ñ", "日", "'s", "'S", "'ll", "1", "²", "_", "\x1c", "\x85", "\xa0", "　", "😀",
             "<|endoftext|>", "\x00", "ß", "İ", "Σ", "ΑΣ", "the", "tion", "é", "µ", "º", "don't", "×", "&&&", "***", "x,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, bounds = WordEncoder(PATH).encode(*utf8_buffer(pa.array(texts)))
    for text, a, b, expect in zip(texts, bounds, bounds[1:], reference(texts)):
        assert ids[a:b].tolist() == expect, text


def one_by_one(lengths, window):
    """Room left in each window after plain best-fit decreasing."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(window - length)
    return Counter(rooms)


def test_bulk_placement_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(120):
        window = rng.choice([8, 20, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 150))]
        used = defaultdict(list)
        for length, first, count, at, each, offset in best_fit_decreasing(Counter(lengths), window):
            for j in range(count):
                used[at + j // each].append((offset + j % each * length, length))
        for places in used.values():
            places.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
        assert sorted(n for p in used.values() for _, n in p) == sorted(lengths)
        assert Counter(window - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, window)


def check(found, rows, window):
    expect = Counter()
    for (i, _), ids in zip(rows, reference([t or "" for _, t in rows])):
        ids = [*ids, 1]
        for at in range(0, len(ids), window):
            piece = np.array(ids[at:at + window], "<u4")
            expect[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == expect
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= window
    assert Counter(window - sum(n for _, n in p) for p in places.values()) == one_by_one([r["length"] for r in found], window)


def test_packing(spark):
    rows = awkward()
    check(pack_documents(documents(spark, rows), PATH).collect(), rows, 2048)
    check(pack_documents(documents(spark, rows), PATH, window=64).collect(), rows, 64)


def test_many_equal_lengths(spark):
    rows = [(i, "the same words") for i in range(300)]
    check(pack_documents(documents(spark, rows), PATH, window=16).collect(), rows, 16)


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), PATH).count() == 0


def thue_morse(n):
    """A string over a and b and its complement, which polynomials modulo 2**64 take for the same."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    texts = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    for force in (False, True):
        if force:  # all fingerprints collide
            from storepulse.llm import packing
            real = packing.words_of
            monkeypatch.setattr(packing, "words_of", lambda *a, **k: real(*a, **k)._replace(code=np.zeros(len(real(*a, **k).code), np.uint64)))
            texts = ["one two", "two three one", "", "thr three", *texts, "onf one"]
        ids, bounds = WordEncoder(PATH).encode(*utf8_buffer(pa.array(texts)))
        for a, b, expect in zip(bounds, bounds[1:], reference(texts)):
            assert ids[a:b].tolist() == expect


def test_store_is_bound_by_bytes():
    rng = random.Random(8)
    tool = WordEncoder(PATH)
    tool._words.limit = tool._pieces.limit = 20_000
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdé9-") for _ in range(rng.choice([3, 400]))) for _ in range(10))]
        ids, _ = tool.encode(*utf8_buffer(pa.array(texts)))
        assert ids.tolist() == reference(texts)[0]
        assert max(tool._words.held, tool._pieces.held) < 20_000 + 100_000  # and what one call puts in


def test_words_in_use_stay_while_others_go():
    tool = WordEncoder(PATH)
    tool._words.limit = tool._pieces.limit = 20_000
    asked, real = [], tool._encode_words
    tool._encode_words = lambda words: asked.extend(words) or real(words)
    for i in range(60):
        rare = [f"rare{i}x{j}" for j in range(40)]
        text = " ".join(["constant", "Été,", *rare, "中文", "constant"])
        ids, _ = tool.encode(*utf8_buffer(pa.array([text])))
        assert ids.tolist() == reference([text])[0]
    assert len(asked) > 60 * 40 and asked.count(b"constant") == asked.count("中文".encode()) == 1


def test_word_store_tells_words_of_one_fingerprint_apart():
    from storepulse.llm.packing import WordStore
    data = np.frombuffer(b"onetwosixeleven" + b"y" * 40 + b"z" * 40, np.uint8)
    start, length = np.array([0, 3, 6, 9, 15, 55]), np.array([3, 3, 3, 6, 40, 40])
    code = np.array([7, 7, 5, 9, 11, 11], np.uint64)
    store = WordStore()
    count = np.arange(1, 7)
    ids = np.arange(count.sum(), dtype="<u4")
    store.put(data, start, length, code, count, ids)
    flat, size, begin, unknown = store.find(data, start, length, code)
    assert unknown.tolist() == [1, 5]                    # the first word of each fingerprint is held
    for k in (0, 2, 3, 4):
        assert flat[begin[k]:begin[k] + size[k]].tolist() == ids[count[:k].sum():count[:k + 1].sum()].tolist()
