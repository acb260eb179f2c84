"""Operator 2: main text of web pages by wrapper induction.

Pages of one host are built from one template. Each page's tree is reduced to a skeleton (runs of equal siblings drawn
together); the host's most frequent skeleton is its wrapper, and every other one is aligned with it by simple tree
matching. Over all pages of the host, counted without gathering them, a node whose text is constant (few distinct texts
for many pages) belongs to the template; a node whose text varies is a slot. What is extracted are the slots' texts,
less elements that HTML or their class names mark as menus, adverts, comments and the like. Where a page marks its
article (``article``, ``main``), text outside goes too. Copies and near copies of one article on several pages of a host
make no template: a constant node inside it is one only if the rest of the article varies, of which the least shingle
hash is counted. A host with too few pages has its marks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import slices, stored
from dnslens.llm.html_tree import Page

#: A template node has at least so many pages, and at most one distinct text for so many of them.
MIN_PAGES, PAGES_PER_TEXT = 8, 3
#: Inside an article, at least one article for so many of its pages: a change in a near copy moves its least hash at times.
PAGES_PER_ARTICLE = 5
#: Rows up to which the decisions for (host, skeleton) are broadcast; beyond it they are shuffled.
BROADCAST_SKELETONS = 100_000

_PARSED = (
    "page_id long, url string, host string, skeleton string, places array<int>, hashes array<long>, least array<long>, whole long, "
    "nodes array<int>, texts array<string>, inside array<boolean>, named array<int>, spans array<array<int>>"
)


@lru_cache(maxsize=4096)
def _tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [], []
    for part in skeleton.split(";"):
        parent, label = part.split(":", 1)
        labels.append(label)
        children.append([])
        if int(parent) >= 0:
            children[int(parent)].append(len(labels) - 1)
    return labels, children


def _best(weights: list[list[int]]) -> list[list[int]]:
    """The table of simple tree matching over two lists of children."""
    table = [[0] * (len(weights[0]) + 1)]
    for row in weights:
        above, line = table[-1], [0]
        for j, w in enumerate(row):
            line.append(max(above[j + 1], line[j], above[j] + w if w else 0))
        table.append(line)
    return table


@lru_cache(maxsize=65_536)
def align(skeleton: str, wrapper: str) -> tuple[int, ...]:
    """For each node of ``skeleton`` the node of ``wrapper`` matched with it, or -1.

    Simple tree matching: roots of equal label are matched, and the children of matched nodes in order so that the
    number of matched nodes is largest.
    """
    (labels, children), (other, below) = _tree(skeleton), _tree(wrapper)
    if skeleton == wrapper:
        return tuple(range(len(labels)))
    todo, order = [(0, 0)], []
    seen = {(0, 0)}
    while todo:
        a, b = todo.pop()
        order.append((a, b))
        for x in children[a]:
            for y in below[b]:
                if labels[x] == other[y] and (x, y) not in seen:
                    seen.add((x, y))
                    todo.append((x, y))
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for a, b in reversed(order):
        gain = 0
        if children[a] and below[b]:
            tables[a, b] = _best([[weight.get((x, y), 0) for y in below[b]] for x in children[a]])
            gain = tables[a, b][-1][-1]
        weight[a, b] = 1 + gain
    matched = [-1] * len(labels)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        matched[a] = b
        table = tables.get((a, b))
        if table is None:
            continue
        i, j = len(children[a]), len(below[b])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((children[a][i], below[b][j]))
    return tuple(matched)


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page: its skeleton and blocks (node, text, inside an article, number of the span named aside)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.col("html").cast("string").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(),
                 pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
        names = ["page_id", "url", "host", "skeleton", "places", "hashes", "least", "whole", "nodes", "texts", "inside", "named", "spans"]
        for batch in slices(batches, text="html"):
            made: list[list] = [[] for _ in types]
            for source in batch.column(3).to_pylist():
                for column, value in zip(made, _page(source or ""), strict=True):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names)

    return rows.mapInArrow(run, _PARSED)


def _page(source: str) -> list:
    """Skeleton, nodes with text, hash and least shingle hash (null outside articles) of each; hash of the whole; then the blocks not set aside by a tag.

    Blocks below elements that a class name marks as aside have the number of their innermost one; its span is the first
    block, from one, and the number of blocks.
    """
    page = Page(source)
    skeleton, node = page.skeleton()
    text: dict[int, list[str]] = {}
    body: set[int] = set()
    for e, t in page.blocks:
        text.setdefault(node[e], []).append(t)
        if page.body[e] and not page.aside[e]:
            body.add(node[e])
    places = sorted(text)
    hashes = [xxhash.xxh64_intdigest("\n".join(text[n])) - (1 << 63) for n in places]
    least = [_least("\n".join(text[n])) if n in body else None for n in places]
    whole = xxhash.xxh64_intdigest(repr((skeleton, hashes))) - (1 << 63)
    kept = [(e, t) for e, t in page.blocks if not page.aside[e]]
    inside = [page.body[e] for e, _ in kept]
    # The blocks below an element follow one another.
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, (e, _) in enumerate(kept, 1):
        up = page.named[e]
        while up >= 0:
            first.setdefault(up, i)
            last[up] = i
            up = page.named[page.parent[up]]
    number = {e: i for i, e in enumerate(first)}
    named = [number.get(page.named[e], -1) for e, _ in kept]
    spans = [[i, last[e] - i + 1] for e, i in first.items()]
    return [skeleton, places, hashes, least, whole, [node[e] for e, _ in kept], [t for _, t in kept], inside, named, spans]


def _least(text: str) -> int:
    """The least hash of three words in a row."""
    words = text.encode().split()
    return min(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) - (1 << 63)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, places, hashes, within = [], [], [], []
        for row in batch.to_pylist():
            match = align(row["skeleton"], row["wrapper"])
            for n, h, m in zip(row["nodes"], row["hashes"], row["least"], strict=True):
                if match[n] >= 0:
                    hosts.append(row["host"])
                    places.append(match[n])
                    hashes.append(h)
                    within.append(m is not None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), pa.array(within, pa.bool_())],
            ["host", "place", "hash", "within"],
        )


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place, article) of the constant places inside articles: the least hash of what is not constant there."""
    for batch in batches:
        hosts, places, articles = [], [], []
        for row in batch.to_pylist():
            match, constant = align(row["skeleton"], row["wrapper"]), set(row["places"])
            inside = [(match[n], m) for n, m in zip(row["nodes"], row["least"], strict=True) if m is not None]
            article = min((m for w, m in inside if w not in constant), default=None)
            for w in {w for w, _ in inside if w in constant}:
                hosts.append(row["host"])
                places.append(w)
                articles.append(article)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(places, pa.int32()), pa.array(articles, pa.int64())], ["host", "place", "article"]
        )


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template nodes of each skeleton of a host."""
    for batch in batches:
        rows = batch.to_pylist()
        nodes = []
        for row in rows:
            template = set(row["places"] or [])
            nodes.append([n for n, w in enumerate(align(row["skeleton"], row["wrapper"])) if w in template])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.list_(pa.int32()))], ["host", "skeleton", "template"]
        )


def induce(rows: DataFrame) -> DataFrame:
    """(host, skeleton, template): for each skeleton of a host the nodes that belong to the host's template."""
    seen, _ = stored(
        rows.select("host", "skeleton", "places", "hashes", "least", "whole")
        # Pages that are copies of one another count once.
        .groupBy("host", "skeleton", "whole")
        .agg(F.first("places").alias("nodes"), F.first("hashes").alias("hashes"), F.first("least").alias("least"), F.count("*").alias("n")),
        "skeletons",
    )
    kinds, _ = stored(seen.groupBy("host", "skeleton").agg(F.sum("n").alias("n")), "kinds")
    wrappers = kinds.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("wrapper"))
    matched = seen.select("host", "skeleton", "nodes", "hashes", "least").join(wrappers, "host")
    counted = (
        matched.select("host", "skeleton", "wrapper", "nodes", "hashes", "least")
        .mapInArrow(_aligned, "host string, place int, hash long, within boolean")
        .groupBy("host", "place", "hash")
        .agg(F.count("*").alias("n"), F.max("within").alias("within"))
        .groupBy("host", "place")
        .agg(F.sum("n").alias("pages"), F.count("*").alias("texts"), F.max("within").alias("within"))
    )
    constant = counted.filter((F.col("pages") >= MIN_PAGES) & (F.col("texts") * PAGES_PER_TEXT <= F.col("pages")))
    constant, _ = stored(constant, "constant")
    doubted = constant.filter("within").groupBy("host").agg(F.collect_set("place").alias("places"))
    articles = (
        matched.join(doubted, "host")
        .select("skeleton", "wrapper", "host", "nodes", "least", "places")
        .mapInArrow(_articles, "host string, place int, article long")
        .groupBy("host", "place", "article")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "place")
        .agg(F.count("article").alias("articles"))
    )
    varied = F.expr(f"articles >= {MIN_PAGES} AND texts * {PAGES_PER_TEXT} <= articles AND articles * {PAGES_PER_ARTICLE} >= pages")
    constant = constant.join(articles, ["host", "place"], "left").filter(~F.col("within") | varied)
    places = constant.groupBy("host").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return (
        kinds.join(wrappers, "host")
        .join(places, "host", "left")
        .select("host", "skeleton", "wrapper", "places")
        .mapInArrow(_decided, "host string, skeleton string, template array<int>")
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points), n_blocks, n_template.

    A null or empty html has an empty text; repeated pages each get a row; pages without a host form a host of their
    own; other columns of the input are not carried.
    """
    rows, _ = stored(parsed(pages), "parsed")
    template, _ = stored(induce(rows), "templates")
    few = template.limit(BROADCAST_SKELETONS + 1).count() <= BROADCAST_SKELETONS
    joined = rows.join(F.broadcast(template) if few else template, ["host", "skeleton"], "left")
    # What a class name marks as aside goes, but for an element that holds most of the text that varies.
    steps = {
        "fixed": "transform(nodes, n -> array_contains(coalesce(template, array()), n))",
        "mass": "transform(texts, (t, i) -> IF(fixed[i], 0L, CAST(length(t) AS long)))",
        "half": "aggregate(mass, 0L, (a, x) -> a + x) / 2",
        "goes": "transform(spans, s -> aggregate(slice(mass, s[0], s[1]), 0L, (a, x) -> a + x) < half)",
        "stays": "transform(named, n -> n < 0 OR NOT goes[n])",
        "marked": "exists(zip_with(inside, stays, (x, y) -> x AND y), x -> x)",
    }
    chosen = "filter(texts, (t, i) -> stays[i] AND NOT fixed[i] AND (inside[i] OR NOT marked))"
    # Each step is bound to a variable: as columns they would be evaluated again for every block.
    for name, step in reversed(steps.items()):
        chosen = f"element_at(transform(array({step}), {name} -> {chosen}), 1)"
    kept = F.expr(chosen)
    return joined.select(
        "page_id", "url", kept.alias("blocks"), F.size(F.coalesce("template", F.expr("cast(array() as array<int>)"))).alias("n_template")
    ).select(
        "page_id",
        "url",
        F.array_join("blocks", " ").alias("text"),
        F.length(F.array_join("blocks", " ")).cast("long").alias("n_chars"),
        F.size("blocks").alias("n_blocks"),
        "n_template",
    )


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).select("page_id", "url", "text", "n_chars")
