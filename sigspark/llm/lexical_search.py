"""Ranked lexical search: items against all documents, in integer scores.

The index is a DataFrame of postings (a term of a document, how often it occurs there), bucketed by term: rows are dealt by the term's
bucket and a slice of the document, so that no common term is one task's, and sorted by bucket and term, so that a filter on them skips row groups. Items'
terms are joined with postings, each match has an integer score, scores are summed by item and document, and a window ranks them.

Common terms would match nearly every document with nearly every item. They are left out of the join where they can't matter, which loses nothing: a
term's greatest contribution is known from its postings, and the terms of an item are put in order of it. The rarest of them give a floor under the
k-th score (a sum over some terms is never above the sum over all). Terms at the end of the order, whose contributions together stay below that floor, can't
bring a document up to it alone: only the others are joined with the postings. What they find is a candidate if its sum, with all that the terms
left out may add, reaches the floor; candidates get their whole score from the documents' own term lists.

Defined results: a null or empty text has no term and isn't counted in N; an item without an id or terms, or whose terms occur nowhere, has no rows; items that share an
id are one, with the terms of all; rows of documents that repeat are documents of their own, also where they share an id, and tie; null ids come after
others in ties; an empty table of documents or items gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.bytetext import string_buffers
from sigspark.llm.lineage import Tables

#: Bytes that part terms: ASCII that is neither digit nor letter.
PARTS = bytes(b for b in range(128) if not chr(b).isalnum())
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(PARTS + _UPPER.encode(), b" " * len(PARTS) + _LOWER.encode())

#: Buckets of terms, and slices of documents that a bucket is dealt into.
BUCKETS, SLICES = 64, 16
#: Matches with the rarest terms that an item's first floor comes from, about.
FIRST = 1000
#: Items' terms are broadcast up to so many rows and so many bytes of terms; beyond, they are joined.
ROWS, BYTES = 1 << 17, 1 << 24


def terms_of(text: str | Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def _counter(only: Callable[[], frozenset[bytes] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only()
        for batch in batches:
            data, at = string_buffers(batch.column(1))
            data = data.tobytes().translate(_TABLE) if len(data) else b""
            lengths, terms, times, ends = [], [], [], [0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = data[a:b].split()
                found = Counter(words)
                for term in found if wanted is None else found.keys() & wanted:
                    terms.append(term)
                    times.append(found[term])
                lengths.append(len(words))
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            strings = pa.array(terms, pa.binary()).cast(pa.string())
            lists = [pa.ListArray.from_arrays(ends, strings), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return count


@dataclass(frozen=True)
class Index:
    #: (row, doc_id, n, terms, times): each document's terms.
    documents: DataFrame
    #: (bucket, slice, term, row, doc_id, n, tf), bucketed by term.
    postings: DataFrame
    #: N and L: documents with a term, and terms of all documents with repeats.
    n_docs: int
    n_terms: int

    def damping(self) -> Column:
        """A document's m."""
        return F.expr(f"10L + ((90L * n * {self.n_docs}L) div {max(1, self.n_terms)}L)")

    def impact(self) -> Column:
        """What a term's weight is multiplied with in a document."""
        return F.expr("(1000000000L * tf) div (1000L * tf + 8L * _m)")


def _fits(df: DataFrame, column: str, rows: int = ROWS) -> bool:
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n <= rows and size <= BYTES


def build(docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> Index:
    """An index of documents; with ``only`` (a column ``term``), of no other terms than these (N and L count all)."""
    tables = tables or Tables(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n long, terms array<string>, times array<long>"
    few = only is not None and _fits(only, "term")
    if few:
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in only.collect()))
        counted = narrow.mapInArrow(_counter(lambda: wanted.value), schema)
    else:
        counted = narrow.mapInArrow(_counter(lambda: None), schema)
    documents = tables.cut(counted.withColumn("row", F.monotonically_increasing_id()))
    n_docs, n_terms = documents.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = documents.select("row", "doc_id", "n", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("times").alias("tf"))).alias("p")).select(
        F.pmod(F.xxhash64("p.term"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int").alias("slice"), "p.term", "row", "doc_id", "n", "p.tf"
    )
    if only is not None and not few:
        postings = postings.join(only.select("term", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice")), ["term", "slice"], "left_semi").select(*postings.columns)
    return Index(documents, tables.cut(postings.repartition("bucket", "slice").sortWithinPartitions("bucket", "term")), n_docs, n_terms)


def _matches(index: Index, plan: DataFrame, small: bool) -> DataFrame:
    """(item_id, row, doc_id, score): sums over the terms of the plan (item_id, term, w)."""
    terms = F.broadcast(plan) if small else plan.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    found = index.postings.withColumn("_m", index.damping()).withColumn("_impact", index.impact()).select("term", "slice", "row", "doc_id", "_impact").join(terms, ["term"] if small else ["term", "slice"])
    return found.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("_impact")).alias("score"))


def _floors(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(item_id, name): the k-th highest sum of each item that has k."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    return sums.select("item_id", "score", F.row_number().over(order).alias("_rank")).filter(F.col("_rank") <= k).filter(F.col("_rank") == k).select("item_id", F.col("score").alias(name))


def search(index: Index, item_terms: DataFrame, k: int = 10, tables: Tables | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item of ``item_terms`` (item_id, term; distinct)."""
    tables = tables or Tables(item_terms.sparkSession)
    terms = index.postings.withColumn("_m", index.damping()).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(index.impact()).alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = item_terms.join(terms.withColumn("w", weight), "term").withColumn("most", F.col("w") * F.col("most"))
    # Greatest contributions first; for each term, what it and all after it may add, and how many postings come before it.
    order = Window.partitionBy("item_id").orderBy(F.desc("most"), "term")
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    plan = tables.cut(weighted.select("item_id", "term", "w", F.sum("most").over(after).alias("rest"), F.coalesce(F.sum("df").over(before), F.lit(0)).alias("earlier")))
    small = _fits(plan, "term")

    rarest = _matches(index, plan.filter(F.col("earlier") < FIRST).select("item_id", "term", "w"), small)
    floored = tables.cut(plan.join(_floors(rarest, k, "floor"), "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0))))
    found = tables.cut(_matches(index, floored.filter("rest >= floor").select("item_id", "term", "w"), small))
    left = floored.groupBy("item_id").agg(F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("rest") < F.col("floor"), F.col("rest"))), F.lit(0)).alias("left"))
    bounds = tables.cut(left.join(_floors(found, k, "floor2"), "item_id", "left").select("item_id", "left", F.greatest("floor", "floor2").alias("floor")))
    bounds = F.broadcast(bounds) if small else bounds
    likely = tables.cut(found.join(bounds, "item_id").filter("score + left >= floor").select("item_id", "row"))

    own = plan.select("item_id", "term", "w")
    lists = likely.join(index.documents, "row").select("item_id", "row", "doc_id", index.damping().alias("_m"), F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("times").alias("tf"))).alias("p"))
    parts = lists.select("item_id", "row", "doc_id", "_m", "p.term", "p.tf").join(F.broadcast(own) if small else own, ["item_id", "term"])
    whole = parts.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * index.impact()).alias("score")).filter("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return whole.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item; the index holds the items' terms."""
    tables = Tables(docs.sparkSession)
    item_terms = tables.cut(items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(item_text_col))).alias("term")).filter("item_id is not null").distinct())
    index = build(docs, item_terms.select("term").distinct(), id_col, text_col, tables)
    return search(index, item_terms, k, tables)
