"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search in it.

**Nodes.**  Equal vectors are one node, named by their smallest identifier, which keeps the
``k + 1`` smallest identifiers of its copies (no answer can hold more of them), so a vector
that a third of all rows share costs one node.  A node carries an 8-bit code of its direction;
codes steer the building and the search, original vectors give the scores.

**Graph.**  A first graph comes from blocks of at most about ``FIRST`` nodes that random
hyperplanes (twice) and a hash (once) put together.  Each round of NN-descent then joins every
node's neighbours with each other: ``joined(v)`` holds the ``degree`` neighbours of ``v`` and up
to ``degree`` nodes that have ``v`` as a neighbour; of any two members of which one is new there,
each is proposed to the other where it beats that one's worst neighbour.  Rounds end when fewer
than ``settled`` of all entries change.  Rounds are joins by block: a block of rows fetches each node that it names once.
Requests, codes and proposals travel between a block and a part (``PART`` nodes by a hash) as one
row for all its nodes.
Sampling is part of the method: of the reverse neighbours ``degree`` take part in a round, others
in another one or by other paths; a block proposes to a node as many as its list can hold.

**Search.**  A query starts at its own node if its vector is indexed, else at the best of
``ENTRIES`` fixed nodes.  Each round expands the ``EXPANDED`` best open nodes among its ``beam``
best, until none of them is open.  The beam is then scored on the original vectors.

Every row is indexed.  Recall against brute force is tested (0.9 or more).  Tables between rounds
are written to the shared folder, and the one before is deleted, so a lost executor costs one
round at most.  A vector that is null, empty or zero, or holds a null or a non-finite component
takes no part, neither does one with a null identifier.  Vectors of different lengths are compared
as if padded with zeros.  Rows that repeat identifier and vector count once; a query never meets
its own identifier.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, mix64, on_workers_path, scratch_path

#: Nodes that are compared with each other for the first graph.
FIRST = 1024
#: Nodes and queries of a block.  What a block names is fetched once, so large blocks move little; a block of
#: nodes names 2 * degree each at most, 100 MB of codes of 64 components at the degree of 48.
BLOCK, QUERY_BLOCK = 16384, 2048
#: Nodes of a part; what all blocks send to a part in a round is held by one task.
PART = 2048
#: Fixed entry nodes of a search; nodes expanded in a round.
ENTRIES, EXPANDED = 64, 16
#: Rows of a block that are joined at a time.
AT_ONCE = 64

_GRAPH = "part long, node long, block long, code binary, ids array<long>, scores array<float>, fresh array<boolean>"
#: What is found for nodes of a part: ``counts`` of ``ids`` and ``scores`` belong to each.
_FOUND = "part long, nodes array<long>, counts array<int>, ids array<long>, scores array<float>"


class _Tables:
    """Tables in the shared folder; a name written again replaces what it held."""

    def __init__(self, spark):
        self.spark, self.path, self.at, self.count = spark, scratch_path(spark, "graph"), {}, 0

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path, old = f"{self.path}/{name}-{self.count}", self.at.get(name)
        df.write.parquet(path)
        if old:
            self._delete(old)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


# ------------------------------------------------------------------ vectors

def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Identifier and vector, as doubles, of the rows that take part."""
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return df.where(F.col(id_col).isNotNull() & fit).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("vector"))


def padded(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix; short lists are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The code of each vector: its components as parts of the largest, in 127ths."""
    for batch in batches:
        x = padded(batch.column("vector"))
        code = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
        lengths = batch.column("vector").value_lengths().to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c[:n].tobytes() for c, n in zip(code, lengths)], pa.binary())],
                                         names=[*batch.schema.names, "code"])


def _codes(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes as a matrix, shorter ones padded with zeros, and their lengths as vectors."""
    codes = codes.to_pylist()
    width = max((len(c) for c in codes), default=0)
    if all(len(c) == width for c in codes):
        x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), width)
    else:
        x = np.zeros((len(codes), width), np.int8)
        for row, c in zip(x, codes):
            row[:len(c)] = np.frombuffer(c, np.int8)
    return x, np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x, dtype=np.int64), 1)).astype(np.float32)


def directions(codes: pa.Array) -> np.ndarray:
    """Unit vectors of codes; shorter ones are padded with zeros."""
    x, length = _codes(codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes)
    return x / length[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, the same for the same two vectors wherever they lie."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    # a power of two takes no precision and keeps squares in range
    a, b = (x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: ``node``, ``members`` (its k + 1 smallest identifiers), ``vector``, ``code``."""
    # windows keep k + 1 rows of a vector in each task before the shuffle
    first = Window.partitionBy("vector").orderBy("id")
    kept = rows.distinct().withColumn("_row", F.row_number().over(first)).where(F.col("_row") <= k + 1)
    nodes = kept.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    nodes = nodes.select(F.col("members")[0].alias("node"), "members", "vector")
    # rows that give one identifier to several vectors are several nodes
    twice = Window.partitionBy("node").orderBy("vector")
    nodes = nodes.withColumn("_copy", F.row_number().over(twice) - 1)
    name = F.when(F.col("_copy") == 0, F.col("node")).otherwise(F.xxhash64("node", "vector"))
    nodes = nodes.select(name.alias("node"), "members", "vector")
    return map_batches(nodes, encode, "node long, members array<long>, vector array<double>, code binary")


# ------------------------------------------------------------------ lists of neighbours

def _lists(values: np.ndarray, counts: np.ndarray, dtype) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values, dtype))


def best_of(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, old: np.ndarray, most: int):
    """Owners in order and, for each, its ``most`` best distinct ids, best first: (owners, counts, ids, scores, old)."""
    order = np.lexsort((~old, ids, owner))
    owner, ids, scores, old = owner[order], ids[order], scores[order], old[order]
    once = np.ones(len(owner), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores, old = owner[once], ids[once], scores[once], old[once]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, old = owner[order], ids[order], scores[order], old[order]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(owner)))
    keep = np.arange(len(owner)) - np.repeat(starts, sizes) < most
    return owner[starts], np.minimum(sizes, most), ids[keep], scores[keep], old[keep]


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node."""
    return (mix64(nodes.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _parted(parts: int):
    """Prepends ``part``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(batch.column("node").to_numpy(), parts), pa.int64())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])
    return run


def _dealt(node: np.ndarray, values: dict[str, tuple[np.ndarray, object]], parts: int) -> pa.Table:
    """Entries, of which those of a node follow each other, as a row for each part: its ``nodes``, the ``counts`` of
    their entries, and the values."""
    heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
    sizes, nodes = np.diff(np.append(heads, len(node))), node[heads]
    part = part_of(nodes, parts)
    entries = np.argsort(np.repeat(part, sizes), kind="stable")
    order = np.argsort(part, kind="stable")
    at, held = np.unique(part, return_counts=True)
    total = np.add.reduceat(sizes[order], np.cumsum(held) - held) if len(held) else held
    return pa.table({"part": pa.array(at, pa.int64()), "nodes": _lists(nodes[order], held, pa.int64()),
                     "counts": _lists(sizes[order].astype(np.int32), held, pa.int32()),
                     **{name: _lists(x[entries], total, kind) for name, (x, kind) in values.items()}})


def _found(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, parts: int) -> pa.Table:
    return _dealt(node, {"ids": (ids, pa.int64()), "scores": (scores, pa.float32())}, parts)


def _owners(table: pa.Table) -> np.ndarray:
    """The node of each entry of the rows of a part."""
    return np.repeat(_flat(table, "nodes"), _flat(table, "counts"))


def merger(degree: int):
    """A part of the graph and what was found for it: each node's best neighbours."""
    def run(graph: pa.Table, found: pa.Table) -> pa.Table:
        graph = graph.sort_by("node")
        named = graph.column("node").to_numpy()
        lengths = graph.column("ids").combine_chunks().value_lengths().to_numpy()
        owner = np.concatenate([np.repeat(named, lengths), _owners(found)])
        ids, scores = (np.concatenate([_flat(graph, c), _flat(found, c)]) for c in ("ids", "scores"))
        old = np.arange(len(owner)) < lengths.sum()
        apart = owner != ids
        owners, counts, ids, scores, old = best_of(owner[apart], ids[apart], scores[apart], old[apart], degree)
        held = np.zeros(len(named), np.int64)
        held[np.searchsorted(named, owners)] = counts
        return pa.table({**{c: graph.column(c) for c in ("part", "node", "block", "code")}, "ids": _lists(ids, held, pa.int64()),
                         "scores": _lists(scores, held, pa.float32()), "fresh": _lists(~old, held, pa.bool_())})
    return run


def _merged(base: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """The graph's rows (or new nodes with empty lists) after what was found for them."""
    base = base.select("part", "node", "block", "code", "ids", "scores")
    return base.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(merger(degree), _GRAPH)


# ------------------------------------------------------------------ the first graph

def _sides(seed: int, bits: int):
    """Appends ``cell``: on which sides of ``bits`` random hyperplanes a code lies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = directions(batch.column("code"))
            planes = np.random.default_rng([seed, 11]).standard_normal((4096, bits)) if x.shape[1] <= 4096 else \
                np.random.default_rng([seed, 11]).standard_normal((x.shape[1], bits))
            cell = (x @ planes[:x.shape[1]] > 0) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(cell, pa.int64())],
                                             names=["node", "code", "cell"])
    return run


def _blocked(nodes: DataFrame, seed: int, count: int, block: int) -> DataFrame:
    """``node``, ``code`` and ``block``: by hyperplanes, and by a hash where too many nodes share a cell."""
    bits = max(0, min(40, (count // block).bit_length()))
    cells = map_batches(nodes.select("node", "code"), _sides(seed, bits), "node long, code binary, cell long")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_parts"))
    return cells.join(sizes, "cell").select("node", "code", F.xxhash64("cell", part).cast("long").alias("block"))


def _inside(degree: int, parts: int):
    """The best neighbours of each node of a block among the others of it."""
    def run(table: pa.Table) -> pa.Table:
        nodes, x = table.column("node").to_numpy(), directions(table.column("code"))
        most = min(degree, len(nodes) - 1)
        ids, scores = [], []
        for begin in range(0, len(nodes), 512):
            s = x[begin:begin + 512] @ x.T
            s[np.arange(len(s)), begin + np.arange(len(s))] = -np.inf
            at = np.argpartition(-s, most - 1, axis=1)[:, :most] if most else np.empty((len(s), 0), np.int64)
            ids.append(nodes[at])
            scores.append(np.take_along_axis(s, at, axis=1))
        return _found(np.repeat(nodes, most), np.concatenate(ids).ravel(), np.concatenate(scores).ravel(), parts)
    return run


# ------------------------------------------------------------------ a round of NN-descent

def _priority(node: np.ndarray, member: np.ndarray, fresh: np.ndarray, seed: int) -> np.ndarray:
    """New entries before old ones, else by a hash."""
    mixed = mix64(mix64(node.astype(np.uint64) + np.uint64(seed)) ^ member.astype(np.uint64)) >> np.uint64(2)
    return mixed.astype(np.int64) + np.where(fresh, 0, 1 << 62)


def _turned(most: int, seed: int, parts: int):
    """For the nodes that rows of the graph name the rows that name them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = table.column("ids").combine_chunks().value_lengths().to_numpy()
            node, member, fresh = np.repeat(table.column("node").to_numpy(), lengths), _flat(table, "ids"), _flat(table, "fresh")
            order = np.lexsort((_priority(node, member, fresh, seed), member))
            node, member, fresh = node[order], member[order], fresh[order]
            starts = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]])) if len(member) else np.empty(0, np.int64)
            keep = np.arange(len(member)) - np.repeat(starts, np.diff(np.append(starts, len(member)))) < most
            yield from _dealt(member[keep], {"ids": (node[keep], pa.int64()), "fresh": (fresh[keep], pa.bool_())}, parts).to_batches()
    return run


def _gathered(most: int, seed: int):
    """A part of the graph: the neighbours of its nodes and up to ``most`` of the nodes that name each."""
    def run(graph: pa.Table, turned: pa.Table) -> pa.Table:
        graph = graph.sort_by("node")
        nodes = graph.column("node").to_numpy()
        lengths = graph.column("ids").combine_chunks().value_lengths().to_numpy()
        node = np.concatenate([np.repeat(nodes, lengths), _owners(turned)])
        member, fresh = (np.concatenate([_flat(graph, c), _flat(turned, c)]) for c in ("ids", "fresh"))
        back = np.arange(len(node)) >= lengths.sum()
        order = np.lexsort((np.where(back, _priority(member, node, fresh, seed), -1), node))
        node, member, fresh, back = node[order], member[order], fresh[order], back[order]
        at = np.searchsorted(nodes, node)
        before = np.concatenate([[0], np.cumsum(back)])
        first = np.searchsorted(node, nodes)
        keep = ~back | (before[:-1] - before[first[at]] < most)
        counts = np.bincount(at[keep], minlength=len(nodes))
        return pa.table({"node": graph.column("node"), "block": graph.column("block"), "members": _lists(member[keep], counts, pa.int64()),
                         "fresh": _lists(fresh[keep], counts, pa.bool_())})
    return run


def _around(graph: DataFrame, most: int, seed: int, parts: int) -> DataFrame:
    """``node``, ``block``, ``members``, ``fresh``: the neighbours of each node and up to ``most`` nodes that have it as one."""
    turned = map_batches(graph.select("node", "ids", "fresh"), _turned(most, seed, parts),
                         "part long, nodes array<long>, counts array<int>, ids array<long>, fresh array<boolean>")
    return graph.select("part", "node", "block", "ids", "fresh").groupBy("part").cogroup(turned.groupBy("part")).applyInArrow(
        _gathered(most, seed), "node long, block long, members array<long>, fresh array<boolean>")


def _listed(parts: int):
    """A block's rows as one, without ``part``, and for each part the nodes of it that they name."""
    def run(table: pa.Table) -> pa.Table:
        members = _flat(table, "members")
        asked = _dealt(np.unique(members), {}, parts)
        counts = table.column("members").combine_chunks().value_lengths().to_numpy()
        first = lambda values, kind: _lists(values, np.array([len(values)] + [0] * asked.num_rows), kind)
        return pa.table({"block": pa.array(np.full(asked.num_rows + 1, table.column("block")[0].as_py()), pa.int64()),
                         "part": pa.array([None, *asked.column("part").to_pylist()], pa.int64()),
                         "named": _lists(_flat(asked, "nodes"), np.array([0, *asked.column("nodes").combine_chunks().value_lengths().to_pylist()]),
                                         pa.int64()),
                         "counts": first(counts, pa.int32()), "members": first(members, pa.int64()), "fresh": first(_flat(table, "fresh"), pa.bool_())})
    return run


_LISTED = "block long, part long, named array<long>, counts array<int>, members array<long>, fresh array<boolean>"


def _answered(graph: pa.Table, asked: pa.Table) -> pa.Table:
    """A part's codes and worst scores, for each block those of the nodes that it named."""
    graph = graph.sort_by("node")
    nodes = graph.column("node").to_numpy()
    at = pa.array(np.searchsorted(nodes, _flat(asked, "named")))
    counts = asked.column("named").combine_chunks().value_lengths().to_numpy()
    codes, worst = (graph.column(c).combine_chunks().take(at) for c in ("code", "worst"))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.table({"at": asked.column("block"), "nodes": _lists(_flat(asked, "named"), counts, pa.int64()),
                     "codes": pa.ListArray.from_arrays(offsets, codes), "worst": pa.ListArray.from_arrays(offsets, worst)})


def _joined(proposed: int, parts: int):
    """A block's rows (``members``, ``fresh``) and the nodes that they name: proposals to each of these."""
    def run(rows: pa.Table, named: pa.Table) -> pa.Table:
        nodes = _flat(named, "nodes")
        order = np.argsort(nodes)
        nodes = nodes[order]
        x, length = _codes(named.column("codes").combine_chunks().flatten().take(pa.array(order)))
        worst = _flat(named, "worst")[order].astype(np.float32)
        lengths = _flat(rows, "counts")
        width = int(lengths.max(initial=0))
        there = np.arange(width) < lengths[:, None]
        at, fresh = np.zeros(there.shape, np.int64), np.zeros(there.shape, bool)
        at[there], fresh[there] = np.searchsorted(nodes, _flat(rows, "members")), _flat(rows, "fresh")
        owner, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        waiting = []

        def fold():
            nonlocal owner, ids, scores, waiting
            if waiting:
                owner, ids, scores = (np.concatenate([now, *new]) for now, new in zip((owner, ids, scores), zip(*waiting)))
                owners, counts, ids, scores, _ = best_of(owner, ids, scores, np.zeros(len(owner), bool), proposed)
                owner, waiting = np.repeat(owners, counts), []
                full = owners[counts == proposed]                # only what beats these can still be proposed
                worst[full] = np.maximum(worst[full], scores[np.cumsum(counts)[counts == proposed] - 1])

        held = 0
        for begin in range(0, len(at), AT_ONCE):
            i, new, ok = at[begin:begin + AT_ONCE], fresh[begin:begin + AT_ONCE], there[begin:begin + AT_ONCE]
            member = x[i] / length[i][:, :, None]
            score = member @ member.transpose(0, 2, 1)
            better = (score > worst[i][:, :, None]) & (new[:, :, None] | new[:, None, :]) & ok[:, :, None] & ok[:, None, :]
            row, one, other = np.nonzero(better)
            a, b = i[row, one], i[row, other]
            apart = a != b
            waiting.append((a[apart], b[apart], score[row, one, other][apart]))
            held += int(apart.sum())
            if held > 1_000_000:
                fold()
                held = 0
        fold()
        return _found(nodes[owner], nodes[ids], scores, parts)
    return run


def _proposals(graph: DataFrame, degree: int, seed: int, parts: int, tables: _Tables) -> DataFrame:
    """What one round finds: neighbours of neighbours are joined, block by block.  A row for each block and part at most."""
    around = _around(graph, degree, seed, parts).where(F.exists("fresh", lambda f: f))
    listed = tables.write("rows", around.groupBy("block").applyInArrow(_listed(parts), _LISTED))
    short = F.when(F.size("scores") < degree, F.lit(-2.0)).otherwise(F.element_at("scores", -1)).cast("float")
    asked = listed.where("part is not null").select("part", "block", "named")
    named = graph.select("part", "node", "code", short.alias("worst")).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(
        _answered, "at long, nodes array<long>, codes array<binary>, worst array<float>")
    rows = listed.where("part is null").select("block", "counts", "members", "fresh")
    return rows.groupBy("block").cogroup(named.groupBy("at")).applyInArrow(_joined(degree, parts), _FOUND)


class NeighbourGraph:
    """The nodes and the neighbour graph of all vectors of a table, in the shared folder."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, degree: int = 48,
                 settled: float = 0.02, rounds: int = 12, block: int = BLOCK):
        on_workers_path(df.sparkSession)
        self.k, self.degree, self.tables = k, degree, _Tables(df.sparkSession)
        self.nodes = self.tables.write("nodes", nodes_of(usable(df, id_col, vector_col), k))
        self.count = self.nodes.count()
        self.parts = max(1, -(-self.count // PART))
        home = map_batches(_blocked(self.nodes, 0, self.count, block), _parted(self.parts), "part long, node long, code binary, block long")
        home = self.tables.write("home", home)
        first = [_blocked(self.nodes, seed, self.count, min(block, FIRST)) for seed in (1, 2)]
        parts = max(1, -(-self.count // min(block, FIRST)))
        first += [self.nodes.select("node", "code", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts)).cast("long").alias("block"))]
        found = [b.groupBy("block").applyInArrow(_inside(degree, self.parts), _FOUND) for b in first]
        empty = home.select("part", "node", "block", "code", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"))
        graph = _merged(empty, found[0].unionByName(found[1]).unionByName(found[2]), degree)
        self.changes: list[int] = []
        for seed in range(rounds):
            graph = self.tables.write("graph", graph)
            fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
            self.changes.append(fresh)
            if fresh <= settled * degree * self.count:
                break
            graph = _merged(graph, _proposals(graph, degree, seed, self.parts, self.tables), degree)
        self.graph = self.tables.write("graph", graph) if len(self.changes) == rounds and rounds else graph

    # -------------------------------------------------------------- search

    def search(self, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 64) -> DataFrame:
        """``query_id``, ``rank`` (from 1), the found identifier and ``score`` (cosine) of the k best found."""
        asked = usable(queries, id_col, vector_col).distinct()
        own = self.nodes.select("vector", F.col("node").alias("own"))
        asked = asked.join(own, "vector", "left")
        asked = self.tables.write("asked", map_batches(asked, encode, "vector array<double>, id long, own long, code binary"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        entries = [(r.node, bytes(r.code)) for r in
                   self.nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").select("node", "code").limit(ENTRIES).collect()]
        state = asked.select(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("long").alias("block"), F.col("id").alias("query"),
                             "vector", "code", "own")
        state = self.tables.write("state", map_batches(state, _started(entries, beam), _STATE))
        around = self.tables.write("around", _around(self.graph, self.degree, 0, self.parts).select("node", F.col("members").alias("around")))
        codes = self.nodes.select("node", "code")
        while state.where(F.size("open") > 0).limit(1).count():
            # the open nodes' neighbours, then these neighbours' codes, each once for a block
            reached = state.select(F.col("block").alias("at"), F.explode("open").alias("node")).distinct().join(around, "node")
            named = reached.select("at", F.explode("around").alias("node")).distinct().join(codes, "node")
            right = reached.select("at", "node", "around", F.lit(None).cast("binary").alias("code")).unionByName(
                named.select("at", "node", F.lit(None).cast("array<long>").alias("around"), "code"))
            state = self.tables.write("state", state.groupBy("block").cogroup(right.groupBy("at")).applyInArrow(_expanded(beam), _STATE))
        return self._scored(state).withColumnRenamed("id", id_col)

    def _scored(self, state: DataFrame) -> DataFrame:
        """The beams on original vectors: the k best identifiers of every query."""
        named = state.select(F.col("block").alias("at"), F.explode("ids").alias("node")).distinct().join(self.nodes.select("node", "members", "vector"), "node")
        k = self.k

        def run(rows: pa.Table, named: pa.Table) -> pa.Table:
            order = np.argsort(named.column("node").to_numpy())
            nodes, x = named.column("node").to_numpy()[order], padded(named.column("vector"))[order]
            members = named.column("members").combine_chunks().take(pa.array(order))
            starts, ids = members.offsets.to_numpy(), members.values.to_numpy()
            out = []
            for query, vector, near in zip(*(rows.column(c).to_pylist() for c in ("query", "vector", "ids"))):
                at = np.searchsorted(nodes, np.array(near, np.int64))
                score = cosine(np.repeat(np.array([vector]), len(at), axis=0), x[at]) if len(at) else np.empty(0)
                sizes = starts[at + 1] - starts[at]
                found = np.concatenate([ids[starts[a]:starts[a + 1]] for a in at] or [np.empty(0, np.int64)])
                score = np.repeat(score, sizes)
                score, found = score[found != query], found[found != query]
                best = np.lexsort((found, -score))[:k]
                out += [(query, r + 1, int(found[b]), float(score[b])) for r, b in enumerate(best)]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.table({"query_id": pa.array(columns[0], pa.int64()), "rank": pa.array(columns[1], pa.int32()),
                             "id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

        return state.groupBy("block").cogroup(named.groupBy("at")).applyInArrow(run, "query_id long, rank int, id long, score double")


_STATE = "block long, query long, vector array<double>, code binary, ids array<long>, scores array<float>, done array<boolean>, open array<long>"


def _states(rows: pa.Table, owner, ids, scores, done, beam: int) -> pa.Table:
    """Rows with the beam of each (owners are row numbers) and the nodes that it opens next."""
    owners, counts, ids, scores, done = best_of(owner, ids, scores, done, beam)
    held = np.zeros(rows.num_rows, np.int64)
    held[owners] = counts
    row = np.repeat(np.arange(len(held)), held)
    shut = np.cumsum(~done)
    before = np.concatenate([[0], shut])[np.concatenate([[0], np.cumsum(held)])[:-1]]
    opened = ~done & (shut - np.repeat(before, held) <= EXPANDED)
    columns = [rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
               for c in ("block", "query", "vector", "code")]
    return pa.table({**dict(zip(("block", "query", "vector", "code"), columns)), "ids": _lists(ids, held, pa.int64()),
                     "scores": _lists(scores, held, pa.float32()), "done": _lists(done, held, pa.bool_()),
                     "open": _lists(ids[opened], np.bincount(row[opened], minlength=len(held)), pa.int64())})


def _started(entries: list[tuple[int, bytes]], beam: int):
    """First beams: a query's own node, if its vector is indexed, else the fixed entry nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.array([n for n, _ in entries], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, x = directions(batch.column("code")), directions(pa.array([c for _, c in entries], pa.binary()))
            width = max(q.shape[1], x.shape[1])
            q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
            score = q @ x.T
            own = batch.column("own").to_pandas()
            has, lost = np.flatnonzero(own.notna()), np.flatnonzero(own.isna())
            owner = np.concatenate([np.repeat(lost, len(nodes)), has])
            ids = np.concatenate([np.tile(nodes, len(lost)), own.iloc[has].to_numpy().astype(np.int64)])
            scores = np.concatenate([score[lost].ravel(), np.full(len(has), 2)]).astype(np.float32)
            table = _states(pa.Table.from_batches([batch]).rename_columns(batch.schema.names), owner, ids, scores,
                            np.zeros(len(owner), bool), beam)
            yield from table.combine_chunks().to_batches()
    return run


def _expanded(beam: int):
    """A block of queries, the neighbours of its open nodes and their codes: the next beams."""
    def run(rows: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.filter(right.column("code").is_null())
        coded = right.filter(right.column("around").is_null())
        order = np.argsort(coded.column("node").to_numpy())
        nodes, x = coded.column("node").to_numpy()[order], directions(coded.column("code"))[order]
        q = directions(rows.column("code"))
        width = max(q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
        around = dict(zip(lists.column("node").to_pylist(), lists.column("around").combine_chunks()))
        owner, ids, scores, done = [], [], [], []
        opened = rows.column("open").to_pylist()
        for r, (was, score, shut) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("ids", "scores", "done")))):
            now = set(opened[r])
            near = np.unique(np.concatenate([around[n].values.to_numpy() for n in opened[r]])) if now else np.empty(0, np.int64)
            owner += [np.full(len(was) + len(near), r)]
            ids += [np.array(was, np.int64), near]
            scores += [np.array(score, np.float32), x[np.searchsorted(nodes, near)] @ q[r]]
            done += [np.array([s or n in now for n, s in zip(was, shut)], bool), np.zeros(len(near), bool)]
        # of a node that is there twice the closed one stays
        return _states(rows, *(np.concatenate(v) if v else np.empty(0, t) for v, t in
                               ((owner, np.int64), (ids, np.int64), (scores, np.float32), (done, bool))), beam)
    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            degree: int = 48, beam: int = 64) -> DataFrame:
    """The ``k`` nearest found of ``df`` for every query, by cosine; ties to the smaller identifier."""
    return NeighbourGraph(df, id_col, vector_col, k, degree).search(queries, id_col, vector_col, beam)
