"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: its nodes are paths of block elements
(tag and class), and each holds the presentation styles (sequences of child blocks) and
the contents seen there with the number of pages that have them.  A node's importance
is entropy-based, as follows.

* Content: 1 minus the mean of ``log(pages with this content) / log(pages with the node)``
  over its distinct contents.  Contents are whole blocks, and for blocks of at most
  ``SHORT_WORDS`` words also their words.  A menu repeats itself, an article does not.
* Presentation: the entropy of its styles over the pages, to the base of their number.

A node's importance is mostly that of its contents, and a node without text takes that of its styles.
Pages with identical bodies count once.  A host with few pages says little, so its tree is
blended with the tree of all hosts merged.  What an element says of itself (landmarks such
as ``nav`` and class names such as ``ad``) scales the importance of its branch; words in longer
names (``entry-header``) do so where few pages have it, and less the more there are.  Branches
below ``THRESHOLD`` are removed from each page; the blocks that stay are the main text.

Contents are counted by grouping, so a host with any share of the pages is spread over
tasks.  Pages of a host with the same set of paths have one layout; each layout's paths are
looked up in the tree once, and what reaches a task for a page is the set of its own paths
that are removed.

Null and empty pages have an empty text.  A page without a usable host belongs to the host
''.  Repeated rows give repeated results.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, slices, written

THRESHOLD = 0.5
SHORT_WORDS = 24
#: Pages at which a host's own tree weighs as much as that of all hosts.
HOST_PAGES = 200
#: Share of the styles in a node's importance.
STYLE_SHARE = 0.1
#: What the importance of a branch that names itself as something else is multiplied by.  For a word in a
#: longer name ``HOST_PAGES`` pages of all hosts leave half of what it takes away, and so on.
NOISE_FACTOR = 0.3

# Elements of HTML by their role.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head script style noscript template textarea select button svg math iframe object audio video "
                    "canvas title".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_LANDMARKS = frozenset("nav header footer aside form menu dialog".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section main body div nav aside header footer form blockquote".split())
#: Wrappers of whole pages or articles, whose names say nothing of what is in them.
_WRAPPERS = frozenset("html body main article".split())
_NOISE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
                         "consent footer header menu nav navbar navigation newsletter notice popup promo related share "
                         "sharing sidebar signup social sponsor sponsored subscribe widget".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_DIGITS = re.compile(r"\d+")


class Block(NamedTuple):
    path: str
    text: str


def _name(tag: str, attributes: str) -> str:
    named = [_DIGITS.sub("0", a or b or c).lower() for a, b, c in _CLASS.findall(attributes)] if attributes else []
    return ".".join([tag, *" ".join(named).split()])


def blocks(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """The text blocks of a page in order, and each block element's path with its child blocks' names.

    Inline elements do not count in a path.  Elements without an end tag end as HTML says,
    or with the page.
    """
    out: list[Block] = []
    styles: list[tuple[str, str]] = []
    stack: list[tuple[str, str, list[str]]] = [("", "", [])]  # tag, path, names of children
    gathered: list[str] = []
    unseen = 0  # depth of the outermost element that is not shown

    def flush() -> None:
        if gathered:
            text = " ".join(html.unescape("".join(gathered)).split())
            gathered.clear()
            if text:
                out.append(Block(stack[-1][1], text))

    def close(depth: int) -> None:
        nonlocal unseen
        flush()
        while len(stack) > depth:
            _, path, children = stack.pop()
            styles.append((path, " ".join(children)))
        if unseen > len(stack) - 1:
            unseen = 0

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not unseen:
            gathered.append(page[at:found.start() if found else end])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            continue
        if tag == "br":
            if not unseen:
                gathered.append(" ")
            continue
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                close(depth)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        ends = _CLOSED_BY.get(tag, frozenset())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends or stack[k][0] == "p":
                close(k)
                break
            if stack[k][0] in _SCOPES:
                break
        flush()
        name = _name(tag, found[3])
        stack[-1][2].append(name)
        stack.append((tag, f"{stack[-1][1]}/{name}", []))
        if not unseen and tag in _UNSEEN:
            unseen = len(stack) - 1
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
            at = stop.start() if stop else end
        elif found[3].endswith("/"):
            close(len(stack) - 1)
    close(1)
    return out, styles


NONE, HINT, PLAIN = 0, 1, 2


def markup_kind(path: str) -> int:
    """``PLAIN`` where an element of the path calls itself something other than main text, by its tag or a
    whole name; ``HINT`` where only a word of a longer name does.

    A page header inside an article is part of it.
    """
    inside, kind = False, NONE
    for step in path.split("/"):
        tag, *names = step.split(".")
        if tag in _LANDMARKS and not (inside and tag == "header"):
            return PLAIN
        if tag not in _WRAPPERS:
            for name in names:
                if name in _NOISE_NAMES and not (inside and name == "header"):
                    return PLAIN
                if name not in _NOISE_NAMES and any(word in _NOISE_NAMES for word in re.split(r"[-_]", name)):
                    kind = HINT
        inside = inside or tag in ("article", "main")
    return kind


def markup_factor(path: str) -> float:
    """What the path says of itself multiplies the importance of a branch on a single page by."""
    return NOISE_FACTOR if markup_kind(path) else 1.0


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def layout(paths) -> bytes:
    """A digest of a set of paths."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def host_of(url_col: str) -> Column:
    """The host of an address in lower case, or the empty string."""
    address = F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    return F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


CONTENT, STYLE, PAGE = 0, 1, 2
KINDS = 3


def page_features(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """For each page its host, a digest of its blocks, its paths, and its distinct features, each with a
    code that holds the place of its path and its kind."""
    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            bodies, paths, codes, features = [], [], [], []
            for page in batch.column("text").to_pylist():
                found, styles = blocks(page)
                seen = {(path, PAGE, 0) for path, _ in found} | {(path, PAGE, 0) for path, _ in styles}
                for path, text in found:
                    seen.add((path, CONTENT, _code(text)))
                    words = text.split()
                    if len(words) <= SHORT_WORDS:
                        seen.update((path, CONTENT, _code(w)) for w in words)
                seen.update((path, STYLE, _code(children)) for path, children in styles if children)
                bodies.append(_code("\n".join(f"{path}\t{text}" for path, text in found)))
                place = {path: i for i, path in enumerate({path for path, _, _ in seen})}
                paths.append(list(place))
                codes.append([place[path] * KINDS + kind for path, kind, _ in seen])
                features.append([feature for _, _, feature in seen])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(bodies, pa.int64()), pa.array(paths, pa.list_(pa.string())),
                 pa.array(codes, pa.list_(pa.int32())), pa.array(features, pa.list_(pa.int64()))],
                names=["host", "body", "paths", "codes", "features"])

    return map_batches(rows, run, "host string, body long, paths array<string>, codes array<int>, features array<long>")


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """Importance of each node from (node, kind, feature, pages)."""
    pages = F.max(F.when(F.col("kind") == PAGE, F.col("pages"))).alias("pages")
    logs = F.sum(F.when(F.col("kind") == CONTENT, F.log("pages"))).alias("logs")
    contents = F.count(F.when(F.col("kind") == CONTENT, True)).alias("contents")
    styled = F.sum(F.when(F.col("kind") == STYLE, F.col("pages"))).alias("styled")
    style_logs = F.sum(F.when(F.col("kind") == STYLE, F.col("pages") * F.log("pages"))).alias("style_logs")
    base = F.log(F.greatest("pages", F.lit(2)))
    content = 1 - F.col("logs") / F.col("contents") / base
    # entropy of the styles: log(all) - sum(n log n) / all, to the base of the pages
    style = (F.log("styled") - F.col("style_logs") / F.col("styled")) / base
    both = F.when(F.col("contents") == 0, F.coalesce(style, F.lit(1.0))).otherwise(
        (1 - STYLE_SHARE) * content + STYLE_SHARE * F.coalesce(style, content))
    return counts.groupBy(*by).agg(pages, logs, contents, styled, style_logs).select(*by, "pages", both.alias("importance"))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, seen, importance) of every node of every host's tree; ``seen`` pages of all hosts have it."""
    features = page_features(pages, url_col, html_col).dropDuplicates(["host", "body"])
    each = features.select("host", "paths", F.explode(F.arrays_zip("codes", "features")).alias("f"))
    counts = (each.select("host", F.element_at("paths", F.floor(F.col("f.codes") / KINDS).cast("int") + 1).alias("path"),
                          (F.col("f.codes") % KINDS).alias("kind"), F.col("f.features").alias("feature"))
              .groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("pages")))
    counts = written(counts, "style_tree")
    own = _importance(counts, ["host", "path"])
    merged = _importance(counts.groupBy("path", "kind", "feature").agg(F.sum("pages").alias("pages")), ["path"])
    weight = F.col("own.pages") / (F.col("own.pages") + HOST_PAGES)
    return (own.alias("own").join(merged.alias("all"), "path")
            .select("host", "path", F.col("own.pages").alias("pages"), F.col("all.pages").alias("seen"),
                    (weight * F.col("own.importance") + (1 - weight) * F.col("all.importance")).alias("importance")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD) -> DataFrame:
    """Identifier, url, ``text`` (blocks joined by an empty line) and ``n_chars`` of every page."""
    tree = style_tree(pages, url_col, html_col)
    kinds = {}

    def removed_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = []
            for path, seen, importance in zip(*(batch.column(c).to_pylist() for c in ("path", "seen", "importance"))):
                if path not in kinds:
                    kinds[path] = markup_kind(path)
                known = {NONE: 1.0, HINT: seen / (seen + HOST_PAGES), PLAIN: 0.0}[kinds[path]]
                drop.append(importance * (known + (1 - known) * NOISE_FACTOR) < threshold)
            codes = pa.array([_code(path) for path in batch.column("path").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host"), codes], names=["host", "code"]).filter(pa.array(drop, pa.bool_()))

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            numbers, codes = [], []
            for page in batch.column("text").to_pylist():
                paths = {path for path, _ in blocks(page)[0]}
                numbers.append(layout(paths))
                codes.append([_code(path) for path in paths])
            # what a batch repeats is told once
            new = list({key: i for i, key in enumerate(zip(batch.column("host").to_pylist(), numbers))}.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(numbers, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                names=["host", "layout", "codes"]).take(pa.array(new, pa.int64()))

    text = F.coalesce(F.col(html_col), F.lit(""))
    dropped = map_batches(tree.select("host", "path", "seen", "importance"), removed_paths, "host string, code long")
    own = map_batches(pages.select(host_of(url_col).alias("host"), text.alias("text")), layouts,
                      "host string, layout binary, codes array<long>").groupBy("host", "layout").agg(F.first("codes").alias("codes"))
    by_layout = written(own.select("host", "layout", F.explode("codes").alias("code")).join(dropped, ["host", "code"])
                        .groupBy("host", "layout").agg(F.collect_set("code").alias("dropped")), "dropped")

    kind = pages.schema[id_col].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 4 << 20):
            numbers, packed = [], []
            for page in batch.column("text").to_pylist():
                found = blocks(page)[0]
                paths = list(dict.fromkeys(path for path, _ in found))
                place = {path: i for i, path in enumerate(paths)}
                numbers.append(layout(paths))
                # the codes of its paths, and which of them each block has; a block's text has no line break
                head = np.array([len(paths), len(found), *(place[path] for path, _ in found)], "<u4").tobytes()
                codes = np.array([_code(path) for path in paths], "<i8").tobytes()
                packed.append(squeeze(head + codes + "\n".join(text for _, text in found).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), batch.column("host"), pa.array(numbers, pa.binary()), pa.array(packed, pa.binary())],
                names=["id", "url", "host", "layout", "packed"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), text.alias("text"))
    rows = (map_batches(rows, parsed, f"id {kind}, url string, host string, layout binary, packed binary")
            .join(by_layout, ["host", "layout"], "left").select("id", "url", "packed", "dropped"))

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 1 << 20, "packed"):
            texts = []
            for page, out in zip(batch.column("packed").to_pylist(), batch.column("dropped").to_pylist()):
                page, out = unpack(page), frozenset(out or ())
                n, held = np.frombuffer(page, "<u4", 2).tolist()
                of = np.frombuffer(page, "<u4", held, 8).tolist()
                stays = [code not in out for code in np.frombuffer(page, "<i8", n, 8 + 4 * held).tolist()]
                found = page[8 + 4 * held + 8 * n:].decode("utf-8", "surrogatepass").split("\n")
                texts.append("\n\n".join(text for k, text in zip(of, found) if stays[k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    return (map_batches(rows, main_text, f"id {kind}, url string, text string, n_chars long")
            .withColumnRenamed("id", id_col))
