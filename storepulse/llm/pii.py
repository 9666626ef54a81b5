"""Personal data by a skip-chain conditional random field.

*Base spans* (email, ip, card, phone) are found by fixed patterns over the whole text, in
time linear in its length.  The field then adds spans that the patterns miss: its nodes
are the tokens that hold a digit or an ``@``, with a label each (none or one of the
kinds).  Neighbouring nodes share a chain potential; distant nodes with repeated or similar
content (the same characters, or the same digits) share a skip potential.  Loopy
sum-product message passing gives each node's label; tokens inside base spans are observed.
So a number that is written out once as a phone number and later without its prefix gets
the same label in both places.  An added span is a node, or for phone numbers a run of
nodes, whose label has a certainty of at least ``CERTAIN`` and which is linked, directly or
over other nodes of that label, to a base span of that kind.

Node weights and the strength of both potentials are learned by pseudo-likelihood, with
base spans as labels, on a bounded sample: at most ``TRAINING_ROWS`` documents with a digit
or an ``@``, in the order of a hash of the identifier.  Finding spans reads every row.

Null and empty texts have no spans.  Repeated rows give repeated results.  Only the
identifier and the text are read.  Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
TRAINING_ROWS = 2000
CERTAIN = 0.5
ROUNDS = 12
#: Digits that a token needs for its digits alone to link it to others.
LINK_DIGITS = 7

# The patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_NODE = re.compile(r"[^\s]*[0-9@][^\s]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    start: int
    kind: int  # place in KINDS
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    if not _MARKED.search(text):
        return []
    found = [Span(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(Span(m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


FEATURES = 14


def _features(token: str, digits: str) -> list[float]:
    n = len(digits)
    return [1.0, "@" in token, token.startswith("+"), "(" in token, "-" in token, token.count(".") >= 3, "." in token,
            0 < n < 4, 4 <= n < 7, 7 <= n < 9, 9 <= n < 12, 12 <= n < 20, 12 <= n < 20 and luhn(digits), n == len(token)]


class Graph(NamedTuple):
    """Nodes and edges of many documents."""

    features: np.ndarray
    text: np.ndarray  # the document of a node
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  # of the base span that a node lies in, else 0
    observed: np.ndarray
    chain: np.ndarray  # edges as rows (node, node)
    skip: np.ndarray


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    """The field over texts and their base spans.

    Every node with the same content is linked to the one before it, so a content that
    occurs n times adds n - 1 edges.
    """
    features, of, start, end, label, observed, chain, skip = [], [], [], [], [], [], [], []
    for i, (text, found) in enumerate(zip(texts, spans)):
        last: dict[str, int] = {}
        at = 0
        by_start = sorted(found)
        longest = 0
        previous = -2
        for m in _NODE.finditer(text):
            a, b = m.span()
            node = len(of)
            while at < len(by_start) and by_start[at].start < b:
                longest = max(longest, by_start[at].end)
                at += 1
            kind = 0
            if longest > a:
                over = [s for s in by_start[max(0, at - 8):at] if s.start < b and s.end > a]
                kind = over[0].kind + 1 if over else 0
            digits = _NOT_DIGIT.sub("", m[0])
            features.append(_features(m[0], digits))
            of.append(i)
            start.append(a)
            end.append(b)
            label.append(kind)
            observed.append(kind > 0)
            if previous >= 0 and of[previous] == i and not text[end[previous]:a].strip(" "):
                chain.append((previous, node))
            links = {m[0].strip(".,;:!?()").lower()}
            if len(digits) >= LINK_DIGITS:
                links.add("#" + digits)
                links.add("#" + digits[-LINK_DIGITS:])
            for key in sorted(links):
                if key in last:
                    skip.append((last[key], node))
                last[key] = node
            previous = node
    def edges(pairs):
        return np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)
    return Graph(np.array(features, dtype=np.float64).reshape(-1, FEATURES), np.array(of, np.int64), np.array(start, np.int64),
                 np.array(end, np.int64), np.array(label, np.int64), np.array(observed, bool), edges(chain), edges(skip))


class Weights(NamedTuple):
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: float  # agreement of linked nodes


def train(g: Graph, steps: int = 300) -> Weights:
    """Pseudo-likelihood: each node's label given those of its neighbours, by gradient ascent."""
    node, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 0.5
    if not len(g.label):
        return Weights(node, chain, 1.0)
    one = np.eye(LABELS)[g.label]
    left, right, linked = (np.zeros((len(g.label), LABELS)) for _ in range(3))
    np.add.at(left, g.chain[:, 1], one[g.chain[:, 0]])
    np.add.at(right, g.chain[:, 0], one[g.chain[:, 1]])
    for a, b in ((0, 1), (1, 0)):
        np.add.at(linked, g.skip[:, a], one[g.skip[:, b]])
    linked = np.minimum(linked, 2)
    n = len(g.label)
    for _ in range(steps):
        z = g.features @ node + left @ chain + right @ chain.T + skip * linked
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (one - p) / n
        node += 2.0 * (g.features.T @ d - 1e-3 * node)
        chain += 2.0 * (left.T @ d + d.T @ right - 1e-3 * chain)
        skip += 2.0 * (float((linked * d).sum()) - 1e-3 * (skip - 1.0))
    return Weights(node, chain, max(0.0, skip))


def marginals(g: Graph, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy message passing; observed nodes keep their label."""
    z = g.features @ w.node
    z[g.observed] = np.where(np.eye(LABELS)[g.label[g.observed]] > 0, 0.0, -30.0)
    agree = w.skip * np.eye(LABELS)
    source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
    target = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
    c, s = len(g.chain), len(g.skip)
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)])
    potential = np.concatenate([np.broadcast_to(x, (k, LABELS, LABELS)) for x, k in
                                ((w.chain, c), (w.chain.T, c), (agree, s), (agree, s))])
    message = np.zeros((len(source), LABELS))
    belief = z.copy()
    for _ in range(rounds if len(source) else 0):
        out = (belief[source] - message[back])[:, :, None] + potential
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
        belief = z.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(g: Graph, w: Weights, texts: list[str], spans: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field finds besides the base ones."""
    out: list[list[Span]] = [[] for _ in texts]
    if not len(g.skip) or not g.observed.any():
        return out
    p = marginals(g, w)
    label = np.where(p.max(axis=1) >= CERTAIN, p.argmax(axis=1), 0)
    label[g.observed] = g.label[g.observed]
    # linked to a base span of the same label, over nodes of that label
    reached = g.observed.copy()
    same = label[g.skip[:, 0]] == label[g.skip[:, 1]]
    ends = g.skip[same]
    while True:
        grown = np.zeros_like(reached)
        grown[ends[reached[ends[:, 0]], 1]] = True
        grown[ends[reached[ends[:, 1]], 0]] = True
        grown &= ~reached
        if not grown.any():
            break
        reached |= grown
    next_to = {int(b): int(a) for a, b in g.chain}
    runs: list[list[int]] = []  # only phone numbers span tokens
    phone = KINDS.index("phone") + 1
    for node in np.flatnonzero((label > 0) & ~g.observed):
        if label[node] == phone and runs and next_to.get(int(node)) == runs[-1][-1] and label[runs[-1][-1]] == phone:
            runs[-1].append(int(node))
        else:
            runs.append([int(node)])
    for run in runs:
        if reached[run].any():
            i, kind = int(g.text[run[0]]), int(label[run[0]]) - 1
            a, b = int(g.start[run[0]]), int(g.end[run[-1]])
            piece = texts[i][a:b]
            a, b = a + len(piece) - len(piece.lstrip(".,;:!?")), b - (len(piece) - len(piece.rstrip(".,;:!?")))
            if not any(s.kind == kind and s.start < b and s.end > a for s in spans[i]):
                out[i].append(Span(a, kind, b))
    return out


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights from the sample.  What reaches the driver is the sample's nodes, without their texts."""
    text = text_or_empty(text_col)
    rows = df.where(text.rlike("[0-9@]")).select(F.xxhash64(F.col(id_col).cast("string"), F.lit("training")).alias("at"),
                                                 F.xxhash64(text).alias("mark"), text.alias("text"))
    # hashes are chosen first, at most TRAINING_ROWS of them, and then their texts
    chosen = rows.select("at", "mark").distinct().orderBy("at", "mark").limit(TRAINING_ROWS)
    sample = rows.join(F.broadcast(chosen), ["at", "mark"]).dropDuplicates(["at", "mark"]).select("at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist()):
                g = graph([text], [base_spans(text)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (g.features, g.label, g.chain, g.skip))],
                    names=["at", "features", "label", "chain", "skip"])

    parts, before = [], 0
    found = map_batches(sample, run, "at long, features binary, label binary, chain binary, skip binary").collect()
    # in a fixed order, so that the weights do not depend on how the rows lie
    for r in sorted(found, key=lambda r: (r["at"], bytes(r["features"]))):
        x, y = np.frombuffer(r["features"]).reshape(-1, FEATURES), np.frombuffer(r["label"], np.int64)
        parts.append((x, y, *(np.frombuffer(r[k], np.int64).reshape(-1, 2) + before for k in ("chain", "skip"))))
        before += len(y)
    if not parts:
        return train(graph([], []))
    x, y, chain, skip = (np.concatenate(p) for p in zip(*parts))
    empty = np.zeros(len(y), np.int64)
    return train(Graph(x, empty, empty, empty, y, y > 0, chain, skip))


def find(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's identifier, number of spans of each kind, digest of the base spans, and all spans."""
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            base, more = spans_of(texts, weights)
            counts = [[sum(s.kind == k for s in both) for both in map(list.__add__, base, more)] for k in range(len(KINDS))]
            digests = [hashlib.sha256(written_out(b).encode()).hexdigest() for b in base]
            spans = [written_out(b + m) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def spans_of(texts: list[str], weights: Weights) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base and added spans of each text; a field is built only where one has a base span."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    chosen = [i for i, found in enumerate(base) if found]
    if chosen:
        some, spans = [texts[i] for i in chosen], [base[i] for i in chosen]
        for i, found in zip(chosen, added_spans(graph(some, spans), weights, some, spans)):
            more[i] = found
    return base, more


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find(df, fit(df, id_col, text_col), id_col, text_col)


def redact(df: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """``df`` with every span of the text replaced by its kind in angle brackets; overlapping
    spans are replaced together, under the kind of the first.  Rows without a span, and null
    texts, are left as they are.  Column names and order stay."""
    columns = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20, text_col):
            texts = batch.column(text_col).to_pylist()
            base, more = spans_of([t or "" for t in texts], weights)
            clean = []
            for text, found in zip(texts, map(list.__add__, base, more)):
                parts, done = [], 0
                for s in sorted(found):
                    if s.start >= done:
                        parts += [text[done:s.start], f"<{KINDS[s.kind].upper()}>"]
                    done = max(done, s.end)
                clean.append("".join([*parts, text[done:]]) if found else text)
            at = columns.index(text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(clean, batch.column(at).type), *batch.columns[at + 1:]],
                                             names=batch.schema.names)

    return map_batches(df, run, df.schema)
