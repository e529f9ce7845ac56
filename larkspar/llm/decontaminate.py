"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

Texts are sets of word shingles. A document holds an item if it holds at least the given share of the item's shingles. Jaccard sketches of whole documents cannot show that, since a long document is
unlike every short item, so the items are partitioned by size instead, and each size has a sketch of its own length: an item of n shingles that must share c of them is sketched by the n - c + 1 smallest of its
shingles' min-hash values. A document that lacks all of those has fewer than c of the item's shingles, so that looking each document's shingle hashes up in the items' sketches misses nothing, whatever the document's length. The
candidates are then verified on the shingles themselves.

All of it is DataFrame code: one pass over the words of every document against the sketches, and a second over the candidate documents only. The sketches are broadcast if they are few enough, by a count; else they meet the documents' hashes in a shuffled join.

Rows: in find_leaks, rows of one id (a null one too) are one document, with the shingles of all of them; remove_leaks decides on each row. A text of fewer words than a shingle has its whole sequence as the only one; a text without words has none, and an
item without any is never found. Repeated items are found each. A very long text's words are one array, in one task, and all its shingles are looked up. An empty table, of documents or of items, gives an empty one of the same columns. Other columns are not read
by find_leaks and go through remove_leaks whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import Stash, dropped_with, fresh, numbered, words

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Rows of sketches or of item shingles, of some tens of bytes each, that may be broadcast.
BROADCAST_ROWS = 200_000


def _shingle_at(size: int) -> list[Column]:
    return [F.get("w", F.col("i") + k) for k in range(size)]


def item_shingles(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, size, shingle) of every item, distinct; size: its words, fewer for an item shorter than a shingle."""
    w = benchmark.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.lit(size), F.size("w")).alias("size"))
    each = w.select("item", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
    return each.select("item", "size", F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ").alias("shingle")).distinct()


def document_shingles(docs: DataFrame, sizes: list[int], *more: str) -> DataFrame:
    """(id, i, w, size, h): a row for each shingle of each of the sizes, ``h`` its hash."""
    parts = []
    for size in sizes:
        # Word arrays stay as they are: each shingle is hashed from its place in them, in generated code.
        each = docs.filter(F.size("w") >= size).select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.lit(size))).alias("i"))
        parts.append(each.select("id", "w", "i", F.lit(size).alias("size"), F.xxhash64(*_shingle_at(size)).alias("h"), *more))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: each document with each item of which it holds at least numerator / denominator of the shingles."""
    spark = docs.sparkSession
    shingles = item_shingles(benchmark, item_id, item_text, size)
    split = F.split("shingle", " ")
    items = Stash(shingles.select("item", "size", "shingle", F.xxhash64(*[F.get(split, F.lit(k)) for k in range(size)]).alias("h")))
    sizes = sorted(r[0] for r in items.df.select("size").distinct().collect())
    if not sizes:
        none = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).limit(0).crossJoin(benchmark.select(F.col(f"`{item_id}`").alias("item_id")).limit(0))
        return none.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("n_item", "bigint"), ("n_shared", "bigint"), ("containment", "double"))])
    # Partition by size: every item's need of shared shingles and, by it, the length of its sketch.
    need = F.ceil(F.col("n") * numerator / F.lit(float(denominator)))
    sketch = (
        items.df.groupBy("item", "size")
        .agg(F.sort_array(F.collect_set("h")).alias("hs"))
        .withColumn("n", F.size("hs"))
        .select("size", F.explode(F.slice("hs", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("h"), "item")
    )
    sketch = Stash(sketch)
    n_sketch, n_items = sketch.df.count(), items.df.count()
    folded = docs.select(F.col(f"`{doc_id}`").alias("id"), words(F.col(f"`{text}`")).alias("w"))
    candidates = document_shingles(folded, sizes).select("id", "size", "h").join(_small(sketch.df, n_sketch), ["size", "h"]).select("id", "item").distinct()
    candidates = Stash(candidates)
    ids = candidates.df.select("id").distinct()
    n_ids = ids.count()
    held = folded.join(_small(ids, n_ids), folded["id"].eqNullSafe(ids["id"]), "left_semi")
    hits = document_shingles(held, sizes).select("id", "size", "h", F.concat_ws(" ", *[F.when(F.col("size") > k, F.get("w", F.col("i") + k)) for k in range(size)]).alias("shingle"))
    shared = hits.join(_small(items.df, n_items), ["size", "h", "shingle"]).groupBy("id", "item").agg(F.size(F.collect_set("shingle")).cast("bigint").alias("n_shared"))
    pairs = shared.join(candidates.df.withColumnsRenamed({"id": "cid", "item": "citem"}), F.col("id").eqNullSafe(F.col("cid")) & F.col("item").eqNullSafe(F.col("citem")), "left_semi")
    lengths = items.df.groupBy(F.col("item").alias("litem")).agg(F.count(F.lit(1)).alias("n_item"))
    out = pairs.join(lengths, F.col("item").eqNullSafe(F.col("litem"))).filter(F.col("n_shared") * denominator >= F.col("n_item") * numerator)
    out = out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return dropped_with(out, items, sketch, candidates)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns of ``docs``, without the rows that hold an item, each by its own text: rows that share an id, or have none, do not answer for each other."""
    own = fresh(docs, "row")
    rows = numbered(docs, own)
    leaks = find_leaks(rows.df, benchmark, doc_id=own, text=text, **how).select(F.col("doc_id").alias(own)).distinct()
    return dropped_with(rows.df.join(leaks, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), rows)
