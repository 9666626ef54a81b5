import zlib

import numpy as np
from llm.helpers import awkward, documents
from storepulse.llm.sharding import first_map, grown, load_version, rebalanced, save_version, shard_by_bytes


def test_sizes_checksums_places_and_balance(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is None or r[0] < 300] + [(1000 + i, "y" * (i % 97)) for i in range(600)]
    found = shard_by_bytes(documents(spark, rows), shards=5, slots=256).collect()
    expect = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expect
    totals = []
    for shard in range(5):
        mine = [r for r in found if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        totals.append(sum(r["size"] for r in mine))
    assert max(totals) - min(totals) <= 16
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_map_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    save_version(spark, path, 1, first_map(3, 64))
    df = documents(spark, [(i, "t" * (i % 50)) for i in range(300)])
    one = {r["doc_id"]: r["shard"] for r in shard_by_bytes(df, 3, map_path=path, slots=64).collect()}
    assert (load_version(spark, path, 1) == first_map(3, 64)).all()
    # the same bytes again: no further version, the same places
    assert {r["doc_id"]: r["shard"] for r in shard_by_bytes(df, 3, map_path=path, slots=64).collect()} == one
    assert spark.read.parquet(path).select("version").distinct().count() == 2


def test_rebalancing_moves_few_slots_and_growth_only_into_the_new_shard():
    rng = np.random.default_rng(3)
    load = rng.integers(900, 1100, 1024)
    old = first_map(8, 1024)
    new = rebalanced(old, load, 8)
    total = np.bincount(new, weights=load)
    assert total.max() - total.min() <= 2 and (old != new).mean() < 0.2
    more = grown(new, load, 8)
    assert set(more[more != new]) == {8}
    assert abs(load[more == 8].sum() - load.sum() / 9) < 1100


def test_empty_table(spark):
    assert shard_by_bytes(documents(spark, []), shards=4, slots=64).count() == 0
