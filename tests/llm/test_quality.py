import random
import zlib

import numpy as np
import pyarrow as pa
from llm.helpers import awkward, documents, sentence
from pyspark.sql import types as T

from storepulse.llm.common import utf8_buffer
from storepulse.llm.quality import MEASURES, Model, _forward, _gradients, accepted, classify, fit, passages, score, score_bags, train

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])


def labelled(n=400, seed=1):
    """Bad documents hold one spoilt passage among good ones."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(60, 250)).split()
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(words) - 40)  # a whole passage, wherever it lies
            words[at:at + 40] = [w + rng.choice(["&&&", "%%%"]) for w in words[at:at + 40]]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, "clash"))
    return rows, labels


def test_held_out_accuracy_and_contract(spark):
    rows, labels = labelled()
    rows += [(9000, None), (9001, ""), (None, "no identifier"), (9002, "x " * 30000), (9002, "x " * 30000)]
    labels += [(None, 1, ""), (3, None, ""), (777777, 1, "")]
    out = classify(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    truth = {i: q for i, q, _ in labels if q is not None}
    hits = []
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            hits.append(r["predicted"] == truth[r["doc_id"]])
    assert len(hits) > 50 and np.mean(hits) > 0.95


def test_held_out_labels_are_not_learned(spark):
    rows, labels = labelled(160)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in labels]
    df = documents(spark, rows)
    one = train(df, spark.createDataFrame(labels, LABELS))
    other = train(df, spark.createDataFrame([(i, 1 - q if h else q, t) for (i, q, t), h in zip(labels, held)], LABELS))
    assert all(np.array_equal(a, b) for a, b in zip(one, other))


def test_a_text_that_does_not_fit_is_passed_over(spark, monkeypatch):
    rows, labels = labelled(120)
    monkeypatch.setattr("storepulse.llm.quality.TRAINING_BYTES", sum(len(t.encode()) for _, t in rows))
    # one huge text among the first in the order of hashes
    first = spark.sql("select id from range(120) where crc32(cast(id as string)) % 5 <> 0 order by xxhash64(cast(id as string), 'training')").first()[0]
    rows = [(i, t * 150 if i == first else t) for i, t in rows]
    assert isinstance(train(documents(spark, rows), spark.createDataFrame(labels, LABELS)), Model)


def test_one_class_or_no_label(spark):
    df = documents(spark, [(i, "words here") for i in range(20)])
    assert train(df, spark.createDataFrame([], LABELS)) == 0.5
    assert train(df, spark.createDataFrame([(i, 1, "") for i in range(20)], LABELS)) == 1.0
    assert {r["score"] for r in score(df, 0.5).collect()} == {0.5}


def test_accepted_rows_keep_all_columns(spark):
    rows, labels = labelled(200)
    df = documents(spark, rows + [(None, None)])
    model = train(df, spark.createDataFrame(labels, LABELS))
    good = accepted(df, model)
    assert good.columns == df.columns
    kept = {r["doc_id"] for r in good.collect()}
    scores = {r["doc_id"]: r["score"] for r in score(df, model).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}


def test_passages_cover_whole_texts():
    texts = ["a b " * 100, "", None, "one", "w " * 48]
    measures, first = passages(*utf8_buffer(pa.array(texts)))
    assert np.diff(first).tolist() == [5, 1, 1, 1, 1] and measures.shape[1] == MEASURES
    assert not measures[first[1]].any() and not measures[first[2]].any()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    measures, first = rng.normal(size=(12, MEASURES)), np.array([0, 3, 4, 9, 12])
    y = np.array([1.0, 0, 1, 0])
    m = fit(measures, first, y)
    x = (measures - m.mean) / m.scale

    def loss(model: Model):
        p = _forward(model, x, first)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in _gradients(m, x, first, y).items():
        w = getattr(m, name)
        at = tuple(rng.integers(0, s) for s in w.shape)
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (loss(m._replace(**{name: up})) - loss(m._replace(**{name: down}))) / 2e-5
        assert abs(slope - g[at]) < 1e-5, name
    _, attention = score_bags(m, measures, first)
    assert np.allclose(np.add.reduceat(attention, first[:-1]), 1)


def test_empty_tables(spark):
    assert classify(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_measures_take_little_memory_at_a_time(monkeypatch):
    import tracemalloc
    import numpy as np
    import pyarrow as pa
    from storepulse.llm import quality
    rng = np.random.default_rng(5)
    x, first = rng.normal(size=(40, quality.MEASURES)), np.arange(0, 41, 4)
    model = quality.fit(x, first, np.array([0.0, 1.0] * 5))
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(["some words of a text " * 200] * 2000)})   # 8 MB
    caught = {}
    monkeypatch.setattr(quality, "map_batches", lambda df, run, schema: caught.update(run=run))

    class Docs:
        schema = None

    quality.accepted(Docs, model)
    tracemalloc.start()
    rows = sum(b.num_rows for b in caught["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows in (0, 2000) and peak < 80 << 20


def test_workers_give_freed_memory_back(monkeypatch):
    from storepulse.llm import common
    calls, caught = [], []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(common, "on_workers_path", lambda spark: None)

    class Rows:
        sparkSession = None

        def mapInArrow(self, run, schema):
            caught.append(run)

    common.map_batches(Rows(), lambda batches: (2 * b for b in batches), "x long")
    assert list(caught[0](iter([1, 2]))) == [2, 4] and calls == [1]
