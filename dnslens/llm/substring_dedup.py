"""Operator 1: passages that repeat across documents, by paragraph MinHash banding.

Texts are cut into paragraphs by content (``passages``), so a passage of 50 words in the midst of other text holds
whole paragraphs that are cut alike in every document. A paragraph has ``BANDS`` = 3 MinHash values over its 5-word
shingles, each a band of one row: at a similarity of 0.8 two paragraphs meet in some band with probability 0.992, and
shingles of five words are rare enough for single rows to meet little else. Equal paragraphs count once from the start;
different ones that meet are verified by their exact Jaccard similarity, and the classes are connected components. The
first occurrence of a class stays, all others are removals.

A band in which many contents meet is dealt before it is compared: of similar sets, the first fifth and one more of
their shingles, in any common order, have one in common. The band's own shingle, which all share, comes last in it.
Where many contents share such a shingle too, they are cut into blocks, and every pair of blocks is a group of its own;
the components join what the groups link.

Nothing is gathered per band, class or document before it has been aggregated: which bands have several contents and
which contents recur are counted with partial aggregation, and only paragraphs that take part go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import bounded, give_back, slices, stored
from dnslens.llm.components import components
from dnslens.llm.passages import BANDS, band_last, paragraphs, shingle_set

SIMILARITY = 0.8
#: Repeated paragraphs count in runs of at least so many words; a shorter repeated line or phrase is left alone.
MIN_RUN = 12
#: Rows up to which a set of numbers is broadcast; beyond it it is shuffled.
BROADCAST_KEYS = 1_000_000
#: Contents in one band from which they are dealt by the shingles of which two similar ones must share one.
SPLIT_AT = 1_000

_KEYS = [f"k{b}" for b in range(BANDS)]
_OCCURRENCE = "doc_id long, text_key long, no int, start int, end int, n_words int, content long, " + ", ".join(f"{k} long" for k in _KEYS)


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells apart texts under one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every paragraph of every text: doc_id, text_key, no, start, end, n_words, content, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = paragraphs(texts)
            at = pa.array(found["text"])
            columns = [batch.column(0).take(at), batch.column(2).take(at)]
            columns += [pa.array(found[c].astype(np.int32)) for c in ("no", "start", "end", "n_words")]
            columns += [pa.array(found[c]) for c in ("content", *_KEYS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "no", "start", "end", "n_words", "content", *_KEYS])

    return _prepared(docs).select("doc_id", "text", "text_key").mapInArrow(run, _OCCURRENCE)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between similar contents of one group; the input is sorted by group."""

    def rows(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[tuple[int, np.ndarray]] = []
    group = None
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for *key, content, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != group:
                edges += tree_edges(held)
                held, group = [], key
            held.append((content, np.frombuffer(packed, "<u8")))
        yield rows(edges)
    yield rows(tree_edges(held))
    del held
    give_back()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, part, content, shingles): one part for ordinary bands, one for each leading shingle in crowded ones."""
    for batch in batches:
        rows, parts = [], []
        columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        for i, (band, crowded, packed) in enumerate(zip(*columns, strict=True)):
            shingles = np.frombuffer(packed, "<u8")
            leading = band_last(shingles, band)[: int((1 - SIMILARITY) * len(shingles) + 1e-9) + 1] if crowded else None
            mine = [0] if leading is None else leading.view(np.int64).tolist()
            rows += [i] * len(mine)
            parts += mine
        at = pa.array(rows, pa.int64())
        taken = [batch.column(0).take(at), pa.array(parts, pa.int64()), batch.column(2).take(at), batch.column(3).take(at)]
        yield pa.RecordBatch.from_arrays(taken, ["band", "part", "content", "shingles"])


def groups(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, part, low, high, content, shingles) of all that is to be compared.

    Groups have up to about twice ``SPLIT_AT`` contents: ``low`` and ``high`` are two blocks of a part that has more.
    """
    crowded = met.groupBy("band").count().filter(F.col("count") > SPLIT_AT).select("band", F.lit(True).alias("crowded"))
    crowded, _ = stored(crowded, "crowded")
    rows = met.join(bounded(crowded, BROADCAST_KEYS), "band", "left").join(sets, "content")

    def dealt(some: DataFrame) -> DataFrame:
        return some.select("band", "crowded", "content", "shingles").mapInArrow(
            _dealt, "band long, part long, content long, shingles binary"
        )

    sizes = dealt(rows.filter("crowded")).groupBy("band", "part").count().filter(F.col("count") > SPLIT_AT)
    blocks, _ = stored(sizes.select("band", "part", F.ceil(F.col("count") / SPLIT_AT).cast("long").alias("blocks")), "blocks")
    own = "pmod(xxhash64(content), blocks)"
    pairs = f"transform(sequence(0L, blocks - 1), k -> struct(least({own}, k) AS low, greatest({own}, k) AS high))"
    return (
        dealt(rows).join(bounded(blocks, BROADCAST_KEYS), ["band", "part"], "left")
        .withColumn("pair", F.explode(F.expr(f"IF(blocks IS NULL, array(struct(0L AS low, 0L AS high)), {pairs})")))
        .select("band", "part", "pair.low", "pair.high", "content", "shingles")
    )


def similar(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges that connect similar contents of a band; ``met`` has content, band, ``sets`` content, shingles."""
    keys = ["band", "part", "low", "high"]
    return groups(met, sets).repartition(*keys).sortWithinPartitions(*keys, "content").mapInArrow(_similar, "a long, b long")


def tree_edges(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of (content, shingles) whose Jaccard similarity is high enough."""
    if len(members) < 2:
        return []
    sizes = np.array([len(s) for _, s in members])
    left, edges = np.ones(len(members), bool), []

    def index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The members that are left, their shingles in order, and whose they are."""
        rest = np.flatnonzero(left)
        flat, owner = np.concatenate([members[i][1] for i in rest.tolist()]), np.repeat(np.arange(len(rest)), sizes[rest])
        order = np.argsort(flat, kind="stable")
        return rest, flat[order], owner[order]

    rest, flat, owner = index()
    waiting = len(members)
    for seed in range(len(members)):
        if not left[seed]:
            continue
        left[seed] = False
        waiting -= 1
        todo = [seed]
        while todo and waiting:
            if 2 * waiting <= len(rest):
                rest, flat, owner = index()
            one = todo.pop()
            own = members[one][1]
            lows, highs = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            meet = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lows, highs, strict=True)]), minlength=len(rest))
            near = rest[left[rest] & (meet >= SIMILARITY * (sizes[rest] + len(own) - meet) - 1e-9)]
            left[near] = False
            waiting -= len(near)
            edges += [(members[one][0], members[i][0]) for i in near.tolist()]
            todo += near.tolist()
        if not waiting:
            break
    return edges


def _shingles_of(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(content, shingles) of one occurrence of each content in ``spans``, read again from its text."""
    ids = bounded(spans.select(F.col("doc_id").alias("of")).distinct(), BROADCAST_KEYS)
    texts = _prepared(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    grouped = spans.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(
        F.collect_list(F.struct("content", "start", "end")).alias("spans")
    )
    met = texts.join(grouped, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))).select("text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            contents, sets = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for span in wanted:
                    contents.append(span["content"])
                    sets.append(shingle_set(text[span["start"] : span["end"]].encode()).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(contents, pa.int64()), pa.array(sets, pa.binary())], ["content", "shingles"])

    return met.mapInArrow(run, "content long, shingles binary").dropDuplicates(["content"])


def classes(docs: DataFrame) -> DataFrame:
    """One row for each paragraph of a class that has several occurrences.

    Columns: doc_id, text_key, no, start, end (code points), n_words, class_doc_id, class_no (the occurrence that
    stays), removed. Null and empty texts have no paragraphs; paragraphs of fewer than 8 words are left alone; a
    passage repeated within one document counts too. Rows that repeat both doc_id and text share their spans: the copy
    that stays is kept in each of them. An empty table gives an empty result; other columns are not carried.
    """
    every, _ = stored(occurrences(docs), "paragraphs")
    bands = every.select("content", F.explode(F.array(*_KEYS)).alias("band"))
    spread = bands.groupBy("band").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("band")
    spread, _ = stored(spread, "bands")
    met, _ = stored(bands.join(bounded(spread, BROADCAST_KEYS), "band").distinct(), "met")
    repeated = every.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").select("content")
    wanted, _ = stored(repeated.union(met.select("content")).distinct(), "wanted")
    some, _ = stored(every.drop(*_KEYS).join(bounded(wanted, BROADCAST_KEYS), "content", "left_semi"), "some")
    first = some.join(met.select("content").distinct(), "content", "left_semi").groupBy("content").agg(
        F.min(F.struct("doc_id", "text_key", "no", "start", "end")).alias("o")
    )
    sets = _shingles_of(docs, first.select("content", "o.doc_id", "o.text_key", "o.start", "o.end"))
    member = components(similar(met, sets)).select(F.col("node").alias("content"), "root")
    placed = some.join(member, "content", "left").withColumn("class", F.coalesce("root", "content")).drop("root")
    placed, _ = stored(placed, "placed")
    order = F.struct("doc_id", "no", "text_key")
    heads = placed.groupBy("class").agg(F.count("*").alias("n"), F.min(order).alias("head")).filter("n > 1")
    shared = placed.join(heads, "class")
    run = F.col("no") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("no"))
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "text_key", "run"))
    shared = shared.withColumn("run", run).withColumn("words", words).filter(F.col("words") >= MIN_RUN)
    return shared.select(
        "doc_id", "text_key", "no", "start", "end", "n_words",
        F.col("head.doc_id").alias("class_doc_id"), F.col("head.no").alias("class_no"),
        (~order.eqNullSafe(F.col("head"))).alias("removed"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed spans: same columns, text and n_chars (if there is one) renewed.

    Texts without a removal are returned as they are, and documents left without a word by removals are dropped.
    """
    names, key, text = docs.columns, F.xxhash64(F.coalesce("text", F.lit(""))), F.col("text")
    spans = (
        classes(docs).filter("removed").groupBy(F.col("doc_id").alias("__of"), F.col("text_key").alias("__key"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    )
    spans, _ = stored(spans, "spans")
    same = F.col("doc_id").eqNullSafe(F.col("__of")) & (key == F.col("__key"))
    # The end of the text closes the last piece that stays.
    stays = F.expr(
        "array_join(transform(sequence(0, size(__spans)), i -> substring(text, "
        "IF(i = 0, 1, __spans[greatest(i, 1) - 1].end + 1), "
        "IF(i = size(__spans), length(text), __spans[least(i, size(__spans) - 1)].start) "
        "- IF(i = 0, 0, __spans[greatest(i, 1) - 1].end))), '')"
    )
    out = docs.join(spans, same, "left").withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(stays))
    out = out.filter(F.col("__spans").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in names:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(*names)


def report(docs: DataFrame) -> DataFrame:
    """Membership of repeated paragraphs: doc_id, no, start, end, n_words, class_doc_id, class_no, removed."""
    return classes(docs).drop("text_key")
