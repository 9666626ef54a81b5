import hashlib
import re
from collections import defaultdict

from llm.helpers import awkward, documents
from storepulse.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), (i is not None, i), i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for k, (_, _, i) in enumerate(members):
            out.append((i, members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = awkward()
    for partitions in (1, 4, 13):
        assert result(exact_dedup(documents(spark, rows), partitions=partitions)) == brute(rows)


def test_huge_group_is_spread(spark):
    # one text fills most ranges, so its rows lie in several partitions
    rows = [(i, "the same text" + " " * (i % 3)) for i in range(400)] + [(1000 + i, f"other {i}") for i in range(40)]
    for partitions in (2, 8, 30):
        assert result(exact_dedup(documents(spark, rows), partitions=partitions)) == brute(rows)


def test_rows_that_stay_keep_all_columns(spark):
    df = documents(spark, awkward())
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r[3] for r in brute(awkward()))


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
    assert drop_copies(documents(spark, [])).count() == 0


def test_native(spark):
    plan = exact_dedup(documents(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
