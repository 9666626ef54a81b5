"""Small documents that hold the awkward cases, with extra columns named like the operators' own."""

import random

from pyspark.sql import types as T

CLASHING = ["kept", "_id", "_key", "slot", "shard", "signature", "score", "rank", "spans", "text_sha256", "part", "id"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *(T.StructField(c, T.StringType()) for c in CLASHING)])


def documents(spark, rows):
    """A table of (doc_id, text) with clashing columns, over a few partitions."""
    data = [(i, t, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.repartition(3) if rows else df


WORDS = "the of and to in erathaha onthe tion ingly heed éan ñeque straße naïve don't it's 3rd x9 stands, over. (maybe)".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def awkward(seed=1):
    """Nulls, empty and blank texts, copies, repeated rows, a null identifier, and a long text."""
    rng = random.Random(seed)
    base = sentence(rng, 150)
    rows = [(i, sentence(rng, rng.randint(1, 200))) for i in range(20)]
    rows += [(100, base), (101, base), (102, base.replace(" ", "  ")), (103, " " + base), (104, base + " tail")]
    rows += [(200, None), (201, ""), (202, " \t\n\r\x0b\x0c"), (203, "one"), (204, "one two"), (205, "ONE  two")]
    rows += [(300, "aa " * 9000), (301, "z" * 30000), (None, "no identifier"), (5, rows[5][1]), (5, rows[5][1])]
    return rows
