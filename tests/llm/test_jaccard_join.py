import random

import numpy as np
import pyarrow as pa
from llm.helpers import awkward, documents, sentence
from storepulse.llm.common import utf8_buffer
from storepulse.llm.jaccard_join import Scheme, jaccard_components, least_difference, signatures, sketches, token_sets


def shingles(text):
    words = text.encode().lower().split()
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(rows, part=90, whole=100):
    sets = [(i, shingles(t or "")) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and None not in (i, j) and whole * len(s & t) >= part * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def near_copies(seed, n=25):
    """A text of some length and copies with a few words changed."""
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = sentence(rng, rng.choice([3, 9, 12, 25, 60, 200, 900])).split()
        words = [w + str(rng.randint(0, 99)) for w in words]
        for c in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 9))
            rows.append((1000 * seed + 20 * g + c, " ".join(copy)))
    return rows


def test_equals_brute_force(spark):
    rows = awkward() + near_copies(3)
    found = jaccard_components(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute(rows)


def test_common_signatures(spark, monkeypatch):
    # many variants of one text: most signatures are shared by more than COMMON of them
    monkeypatch.setattr("storepulse.llm.jaccard_join.COMMON", 2)
    rng = random.Random(7)
    rows = []
    for base in range(2):
        words = [f"w{rng.random()}" for _ in range(90)]
        for k in range(50):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 3)}"
            rows.append((1000 * base + k, " ".join(copy)))
    found = jaccard_components(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute(rows)


def test_links_only_through_a_hub(spark):
    rng = random.Random(5)
    words = [f"w{rng.random()}" for _ in range(120)]
    rows = [(900, " ".join(words))]
    for k in range(14):  # each is near the hub, two of them are not near each other
        copy = list(words)
        for at in range(2):
            copy[8 * k + 4 * at] = f"new{k}{at}"
        rows.append((k, " ".join(copy)))
    found = jaccard_components(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    scheme = Scheme(90, 100)
    for size in list(range(1, 60)) + [100, 333, 1000]:
        for _ in range(12):
            common = rng.integers(1, 1 << 62, size).astype(np.uint64)
            drop = int(rng.integers(0, size // 8 + 1))
            add = int(rng.integers(0, size // 8 + 1))
            x = np.unique(common)
            y = np.unique(np.concatenate([common[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(y) == 0 or np.array_equal(x, y) or 100 * shared < 90 * (len(x) + len(y) - shared):
                continue
            code, of = signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), scheme)
            assert set(code[of == 0].tolist()) & set(code[of == 1].tolist()), (size, drop, add)


def test_tokens_fold_ascii_only_and_ignore_white_space():
    texts = ["A  b\tC d", "a b c D", "É a b", "é a b", "x y", "X\ny", None, ""]
    tokens, first = token_sets(*utf8_buffer(pa.array(texts)), 3)
    sets = [set(tokens[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert sets[2] != sets[3]
    assert sets[4] == sets[5] and len(sets[4]) == 1
    assert sets[6] == sets[7] == set()


def test_common_signatures_of_pairs_of_segments(spark):
    # nine shingles in two segments of which one holds at most one, and variants linked only through their base
    rng = random.Random(11)
    rows = []
    while len(rows) < 8 * 25:
        words = " ".join(f"w{rng.randrange(10**9)}" for _ in range(11))
        tokens, _ = token_sets(*utf8_buffer(pa.array([words])), 3)
        if int((tokens >> np.uint64(63)).sum()) not in (0, 1, 8, 9):
            continue
        base = 10 * len(rows)
        rows += [(base + k, f"{words} v{rng.randrange(10**9)}") for k in range(24)] + [(base + 50, words)]
    found = jaccard_components(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute(rows)


def test_documents_far_from_the_hub(spark, monkeypatch):
    # few tokens a segment, so pairs of segments with hardly a token are shared by unrelated texts
    monkeypatch.setattr("storepulse.llm.jaccard_join.COMMON", 1)
    rng = random.Random(12)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(20, 60))]
        for k in range(8):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(3)}"
            rows.append((100 * base + k, " ".join(copy[rng.randint(0, 2):len(copy) - rng.randint(0, 2)])))
    found = jaccard_components(documents(spark, rows), part=60)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute(rows, 60)


def test_empty_table(spark):
    assert jaccard_components(documents(spark, [])).count() == 0


def test_long_words_that_a_polynomial_takes_for_the_same_are_not_linked(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    rows = [(10 * k + j, "".join(letters[b] for b in bits[:n])) for k, n in enumerate((1024, 2048, 4096)) for j, letters in enumerate(("ab", "ba", "AB"))]
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(documents(spark, rows)).collect()}
    assert found == {i: i - 2 if i % 10 == 2 else i for i, _ in rows}


def test_sketches_never_pass_the_true_difference():
    rng = np.random.default_rng(5)
    for n, m, shared in [(3, 4, 3), (100, 120, 90), (1000, 700, 650), (5000, 5000, 0), (200000, 150000, 149000)]:
        common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k - shared, dtype=np.uint64)])) for k in (n, m))
        drawn = [sketches(t, np.array([0, len(t)]))[0].tobytes() for t in (x, y)]
        true = len(np.setxor1d(x, y))
        assert least_difference(drawn[:1], drawn[1:])[0] <= true
        assert least_difference(drawn[:1], drawn[:1])[0] == 0
    assert least_difference([], []).tolist() == []


def test_five_words_and_groups_beyond_the_limit(spark, monkeypatch):
    rows = near_copies(11, 12)
    found = [sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(documents(spark, rows), width=5, part=80).collect())]
    monkeypatch.setattr("storepulse.llm.jaccard_join.COMMON", 1)
    found.append(sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(documents(spark, rows), width=5, part=80).collect()))
    assert found[0] == found[1]


def test_signatures_in_slices_find_the_same_components(spark, monkeypatch):
    from storepulse.llm import jaccard_join as J
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i % 7:40 + i % 7]) + (f" own{i}" if i % 3 else "") for i in range(40)] + ["", None, "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, made, real = sorted(map(tuple, J.jaccard_components(df).collect())), [], J._members
    monkeypatch.setattr(J, "SLICED_FROM", 0)
    monkeypatch.setattr(J, "_members", lambda *a: made.append(real(*a)) or made[-1])
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == want and len(made) == J.SLICES
