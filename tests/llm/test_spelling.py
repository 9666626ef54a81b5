"""Spelling variants against plain forms of each step."""

import random
import zlib
from collections import Counter
import re

import pytest

from llm.helpers import awkward, documents
from storepulse.llm.spelling import groups, near_pairs, near_words, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def found(spark, rows, **options):
    out = variants(documents(spark, rows), **options).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(map(tuple, out.collect()), key=str)


def misspelt(seed, size=60, letters="abcdé"):
    """Texts of a few stems and words an edit or two away from them, some much commoner than others."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(12)]

    def edited(w):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:at] + rng.choice(letters) + w[at + (kind > 0):] if kind < 2 else w[:at] + w[at + 1:]
    pool = []
    for s in stems:
        once = [edited(s) for _ in range(6)]
        pool += [s] * 40 + once * 3 + [edited(w) for w in once]
    return [(i, " ".join(rng.choice(pool).title() if rng.random() < .2 else rng.choice(pool) for _ in range(80))) for i in range(size)]


@pytest.mark.parametrize("seed,most", [(1, 1024), (2, 3)])
def test_equals_brute_force(spark, seed, most):
    rows = misspelt(seed)
    expect = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in expect) and any(r[4] > 3 for r in expect)
    assert found(spark, rows, most=most) == expect


def test_awkward_rows(spark):
    rows = awkward() * 3 + [(None, "stands heed naïve " * 4), (900, "ÀÉÏ×÷ÀÉ " * 6 + "àéï×÷àé " * 9)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_wordless(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (3, "a b c 1 2 3")]) == []


def test_a_very_long_run(spark):
    rows = [(i, "z" * 50_000 + " " + "z" * 50_001) for i in range(6)] + [(9, "short words")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_scan_finds_the_pairs(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 7)
    pool = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([m, m + 1]))) for _ in range(120)})
    expect = {(i, j) for i, a in enumerate(pool) for j, b in enumerate(pool)
              if len(a) == m and one_edit(a, b) and (len(b) > m or i < j)}
    got = list(near_words(pool, m))
    assert len(got) == len(set(got)) and set(got) == expect


def test_a_hot_prefix_is_split_until_groups_are_small(spark):
    """A third of the vocabulary shares its first half; no group keeps more than a position's words."""
    rng = random.Random(3)
    vocabulary = {"interna" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1500)} | \
        {"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 14))) for _ in range(1500)}
    df = spark.createDataFrame([(w, 5) for w in vocabulary], "word string, n long")
    sizes = groups(df, most=400).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 60
    got = [tuple(r) for r in near_pairs(df, most=400).select("word", "near").collect()]
    by_gap = {}
    for w in vocabulary:
        for i in range(len(w)):
            by_gap.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    expect = {(a, b) for group in by_gap.values() for a in group for b in group if a != b}
    expect |= {p for w in vocabulary for i in range(len(w)) if (v := w[:i] + w[i + 1:]) in vocabulary for p in ((w, v), (v, w))}
    assert len(got) == len(set(got)) and set(got) == expect
