"""Operator 7: benchmark decontamination by winnowing, in DataFrame and SQL expressions only.

A span of ``SPAN`` words holds ``SPAN - K + 1`` k-grams of ``K`` words; of each span the least k-gram hash is kept, on
both sides. So two texts that share a span share its kept hash: every shared span is found. A document's span whose
kept hash is one of the benchmark's is a hit, and is extended: its words, each as a 64-bit hash, must be those of a
benchmark span with that kept hash. Spans that lie side by side make the longer runs.

Items shorter than a span use their own length as span, with k-grams of at most ``K`` words. Documents are read and
winnowed once, in blocks of ``BLOCK`` words, whatever lengths occur. Equal spans of the benchmark are one row, so a word
repeated over and over on both sides costs its positions, not pairs of positions.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import bounded, stored

SPAN, K = 10, 5
#: Words of a document that are winnowed together; blocks overlap by a span less one word.
BLOCK = 512
#: Rows up to which the benchmark's spans, and the documents hit, are broadcast; beyond it they are shuffled.
BROADCAST_FINGERPRINTS = 1_000_000
BROADCAST_IDS = 500_000
# Word characters are ASCII letters and digits and all that is not ASCII; possessive classes of one look-up each.
SEPARATOR = r"[\p{ASCII}&&\P{Alnum}]++"
WORD = r"[\p{Alnum}[^\p{ASCII}]]++"
#: A document's row: rows that repeat both id and text share their hits.
KEY = ["doc_id", "text_key"]


def words(text: str) -> F.Column:
    """Array of the words of a text column; null has none. Only A-Z are lower-cased."""
    col = F.coalesce(F.col(text), F.lit(""))
    folded = F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(folded, SEPARATOR), "")


def kept(df: DataFrame, lengths: list[int], columns: list[str]) -> DataFrame:
    """``columns``, and for every span of ``words`` of one of the ``lengths`` its place, length, kept hash and word hashes.

    The columns are ``at``, ``n``, ``fp`` and ``h0`` to ``h9``; those at ``n`` and beyond are not part of the span.
    """
    hashes = F.expr(f"concat(transform(words, w -> xxhash64(w)), array_repeat(cast(null as bigint), {SPAN - 1}))")
    blocks = (
        df.filter(F.size("words") >= min(lengths))
        .select(*columns, F.size("words").alias("size"), hashes.alias("h"))
        .select(*columns, F.expr(f"inline(transform(sequence(0, size - 1, {BLOCK}), b -> struct(b, slice(h, b + 1, {BLOCK + SPAN - 1}))))").alias("from", "h"))
    )
    places = f"size(h) - {SPAN - 1}"
    shifted = ", ".join(f"slice(h, {j + 1}, {places})" for j in range(SPAN))
    names = [f"h{j}" for j in range(SPAN)]
    rows = blocks.select(
        *columns, "from", F.expr(f"inline(arrays_zip(sequence(0, {places} - 1), {shifted}))").alias("i", *names)
    ).withColumn("at", F.col("from") + F.col("i"))
    least = [F.when(F.col(f"h{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), _least(n).alias("fp"))) for n in lengths]
    spans = least[0] if len(least) == 1 else F.explode(F.array(*least))
    rows = rows.select(*columns, "at", *names, spans.alias("span")).filter("span IS NOT NULL")
    return rows.select(*columns, "at", "span.n", "span.fp", *names)


def _least(n: int) -> F.Column:
    """The least hash of the k-grams in a span of ``n`` words."""
    k = min(K, n)
    grams = [F.xxhash64(*[f"h{j}" for j in range(g, g + k)]) for g in range(n - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def _worded(df: DataFrame) -> DataFrame:
    """The word hashes of a span as one array ``run``, which is as long as the span."""
    run = F.slice(F.array(*[f"h{j}" for j in range(SPAN)]), F.lit(1), F.col("n"))
    return df.withColumn("run", run).drop(*[f"h{j}" for j in range(SPAN)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), spans.

    ``spans`` are the runs of hit words per item: item_id, first word, number of words; they are left out on request.
    Null or empty texts have no words and no hits; items without words are ignored; repeated documents each get a row,
    repeated items count once; an empty benchmark leaves all documents clean. Other columns of either table are not
    carried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .select("item_id", words("text").alias("words"))
        .filter(F.size("words") > 0)
        .distinct()
        .withColumn("body", F.xxhash64("words"))
    )
    items, _ = stored(items, "items")
    length = F.least(F.size("words"), F.lit(SPAN))
    lengths = sorted(r[0] for r in items.select(length).distinct().collect())
    rows = docs.select(*KEY, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    nothing = {"n_hit": "0L", "n_items": "0L", "items": "cast(array() as array<string>)"}
    if spans:
        nothing["spans"] = "cast(array() as array<struct<item_id: string, first: int, words: int>>)"
    if not lengths:
        return rows.select("doc_id", "n_words", *[F.expr(none).alias(name) for name, none in nothing.items()])
    bodies = items.dropDuplicates(["body"]).withColumn("own", length)
    marks = _worded(kept(bodies, lengths, ["body", "own"]).filter("n = own")).select("fp", "run", "body").distinct()
    marks, _ = stored(marks, "marks")
    hit = (
        kept(docs.select(*KEY, words("text").alias("words")), lengths, KEY)
        .join(bounded(marks.select("fp").distinct(), BROADCAST_FINGERPRINTS), "fp", "left_semi")
        .transform(_worded)
        .join(bounded(marks.select("fp", "run").distinct(), BROADCAST_FINGERPRINTS), ["fp", "run"], "left_semi")
        .select(*KEY, "at", "n", "fp", "run")
        .distinct()
    )
    hit, _ = stored(hit, "hits")
    found = _covered(hit).join(_named(hit, marks, items).withColumnsRenamed(_BESIDE), _same(), "left").drop(*_BESIDE.values())
    if spans:
        found = found.join(_runs(hit, marks, items).withColumnsRenamed(_BESIDE), _same(), "left").drop(*_BESIDE.values())
    found, _ = stored(found, "found")
    beside = bounded(found.withColumnsRenamed(_BESIDE), BROADCAST_IDS)
    return rows.join(beside, _same(), "left").select(
        "doc_id", "n_words", *[F.coalesce(F.col(name), F.expr(none)).alias(name) for name, none in nothing.items()]
    )


_BESIDE = {"doc_id": "hit_id", "text_key": "hit_key"}


def _same() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))


def _covered(hit: DataFrame) -> DataFrame:
    """Words of a document that lie in any of its hits: each hit adds what lies behind the furthest end before it."""
    ends = hit.groupBy(*KEY, "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    before = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    more = F.greatest(F.col("end") - F.greatest("at", reached), F.lit(0)).alias("more")
    return ends.select(*KEY, more).groupBy(*KEY).agg(F.sum("more").cast("long").alias("n_hit"))


def _named(hit: DataFrame, marks: DataFrame, items: DataFrame) -> DataFrame:
    """The items of a document: its distinct runs name texts of the benchmark, these the items that have them."""
    texts = hit.select(*KEY, "fp", "run").distinct().join(marks, ["fp", "run"]).select(*KEY, "body").distinct()
    ids = texts.join(items.select("body", "item_id"), "body").select(*KEY, "item_id").distinct()
    named = F.array_sort(F.collect_list("item_id"))
    return ids.groupBy(*KEY).agg(F.count("*").alias("n_items"), named.alias("items"))


def _runs(hit: DataFrame, marks: DataFrame, items: DataFrame) -> DataFrame:
    """The runs of a document's hits for each item: places that follow one another make one run."""
    places = hit.join(marks, ["fp", "run"]).join(items.select("body", "item_id"), "body").select(*KEY, "item_id", "at", "n").distinct()
    order = Window.partitionBy(*KEY, "item_id", "n").orderBy("at")
    runs = places.withColumn("island", F.col("at") - F.row_number().over(order)).groupBy(*KEY, "item_id", "n", "island")
    ends = runs.agg(F.min("at").alias("first"), (F.max("at") + F.col("n") - F.min("at")).alias("words"))
    return ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("item_id", "first", "words"))).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of ``decontaminate``."""
    return decontaminate(docs, benchmark, spans=False).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS p FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits)
  GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
