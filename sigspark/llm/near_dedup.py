"""Near-duplicates by bottom-k sketches from one hash function.

A text's set is its distinct 5-word shingles, each a 64-bit hash; its sketch is its smallest hashes under that one hash function. Texts
of equal sets are one node. A short sketch of every node (``K`` values) tells how many of them other nodes retain too; a node that
shares fewer than any linked one must has no partner, and most nodes end there. The others' longer sketches (``R`` values) are put in order of rarity,
and inverted lists of these retained values generate candidate pairs: sketches of a linked pair overlap in so many values that
they share one in both of the sketches' first parts, at places that leave room for that overlap. Common values come last in that order, which keeps
the lists short. Of these pairs, the union sketch rules out the unlikely, and the full sets decide. Links are first sought between each list's
members and its centre, the member that holds the value
earliest, which joins groups of copies in a number of pairs linear in their size; then between members of a
list that lie in different components, so that no candidate is left out.

Sketches of sets of up to R values hold them whole and lose no link (K: likewise). Of larger sets a link at
the threshold is missed only if fewer than ``_shared`` of the retained values are common, a
binomial's tail below ``MISSED``, and far below for larger similarities.

Sets are told apart by 128 bits, of which each half is summed from a hash of its own; shingles by 64 bits.

Defined results: a text that is null or has no words has an empty set and is linked with nothing; with fewer than five words the whole
sequence is the one shingle; rows that repeat a text are in one component; rows that repeat an id are judged
by their own texts; a null id is no component's smallest id unless all are null; an empty table gives an empty
table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.bytetext import blocks, lower_ascii, mix64, span_hashes, string_buffers, word_spans
from sigspark.llm.components import connected_components
from sigspark.llm.lineage import Tables

SHINGLE = 5
#: Values retained of each set; of each set that may have a partner.
K, R = 32, 1024
#: Rows read again up to which hashes of their ids (8 bytes each) are broadcast; those of more are joined.
BROADCAST = 1 << 20
#: Unless told otherwise, links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Chance that sketches of sets larger than theirs miss a link at the threshold, at most.
MISSED = 1e-7

_U = np.uint64


def _chain(h: np.ndarray, n: int, count: int, seed: int) -> np.ndarray:
    """A hash of the ``count`` words from each of the first n on, from the words' hashes."""
    whole = np.full(n, count + (seed << 32), _U)
    for j in range(count):
        whole = mix64(whole * _U(0x9E3779B97F4A7C15) ^ h[j : n + j])
    return whole


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """The sorted distinct shingle hashes of each text, and 128 bits that tell sets apart."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    words = [span_hashes(low, starts, ends, seed) for seed in (0, 1)]
    n = max(len(starts) - SHINGLE + 1, 0)
    whole = [_chain(h, n, SHINGLE, seed) for seed, h in enumerate(words)]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            hashes, at = np.unique(whole[0][a : b - SHINGLE + 1], return_index=True)
            yield hashes, _key(hashes, whole[1][a + at])
        elif b > a:
            one, other = (_chain(h[a:b], 1, int(b - a), seed) for seed, h in enumerate(words))
            yield one, _key(one, other)
        else:
            yield np.zeros(0, _U), b""


def _signed(x: np.ndarray) -> np.ndarray:
    """Longs in the same order."""
    return (x ^ _U(1 << 63)).view(np.int64)


def _key(hashes: np.ndarray, others: np.ndarray) -> bytes:
    """128 bits from two independent hashes of each shingle, in any order."""
    return np.array([mix64(hashes + _U(1)).sum(), mix64(others ^ _U(0xA0761D6478BD642F)).sum()], _U).tobytes()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    for batch in batches:
        data, at = string_buffers(batch.column(1))
        for a, b in blocks(at):
            sets, keys = zip(*_sets(data[at[a] : at[b]], at[a : b + 1] - at[a]), strict=True)
            yield batch.slice(a, b - a), list(sets), list(keys)


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(_signed(np.concatenate(values)) if values else np.zeros(0, np.int64)))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, keys in _texts(batches):
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([s[:K] for s in sets])],
            names=["doc_id", "n_shingles", "digest", "sketch"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, keys in _texts(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets)], names=["digest", "hashes"])


@cache
def _shared(percent: int, size: int = K) -> int:
    """Values that sketches of ``size`` values share at least if the sets are linked and larger: of 32, 15 at 85 percent and 12 at 80."""
    p, m, tail = percent / 100, 0, 0.0
    while m < size and (tail := tail + math.comb(size, m) * p**m * (1 - p) ** (size - m)) < MISSED:
        m += 1
    return m


def _required(n: str, percent: int, size: int = K) -> str:
    """Values of its sketch that a set of n shares with any linked partner's, at least (SQL)."""
    return f"(case when {n} * 100 <= {size} * {percent} then ({percent} * {n} + 99) div 100 else least({_shared(percent, size)}, ({percent} * {n} + 99) div 100) end)"


def _similar_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't rule out the threshold."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    union = f"slice(array_sort(array_union(sa, sb)), 1, {K})"
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("joint", F.expr(union))
        .filter(F.expr(f"{_similar_sizes('na', 'nb', percent)} and size(array_intersect(array_intersect(joint, sa), sb)) >= least({_required('na', percent)}, {_required('nb', percent)}, {_shared(percent)})"))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    return both.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _retained_lists(sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(value, node, n, at): inverted lists of the rarest values of each sketch of R values, as many as a linked pair must share one of, with their places there."""
    sketches = sets.select("node", F.size("hashes").alias("n"), F.slice("hashes", 1, R).alias("sketch"))
    values = sketches.select("node", F.explode("sketch").alias("value"))
    shared = tables.cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # Values of one sketch alone come first in the order of rarity; the places of the others follow theirs.
    common = values.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    ranked = common.join(sketches.select("node", "n"), "node")
    length = f"size(common) - {_required('n', percent, R)} + 1"
    prefix = ranked.filter(f"{length} > 0").select("node", "n", F.expr(f"least(n, {R}) - size(common)").alias("alone"), F.posexplode(F.expr(f"slice(common, 1, cast({length} as int))")).alias("i", "v"))
    return prefix.select(F.col("v.value").alias("value"), "node", "n", (F.col("alone") + F.col("i")).alias("at"))


def _room(n: str, at: str, m: str, there: str, percent: int) -> str:
    """Whether sets of n and m values whose sketches share one at the places ``at`` and ``there`` can be linked (SQL)."""
    whole = f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"
    overlap = f"case when greatest({n}, {m}) <= {R} then {whole} else least({_required(n, percent, R)}, {_required(m, percent, R)}) end"
    return f"{_similar_sizes(n, m, percent)} and least(least({n}, {R}) - {at}, least({m}, {R}) - {there}) >= {overlap}"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; links have 100 * intersection >= percent * union."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    tables = Tables(docs.sparkSession)
    cut = tables.cut
    sketched = cut(narrow.mapInArrow(_sketch_batches, f"doc_id {kind}, n_shingles long, digest binary, sketch array<long>"))
    # From here on a node is a number, fixed once written.
    grouped = sketched.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))

    retained = nodes.select("node", F.explode("sketch").alias("value"))
    # Sums are written before they are joined with what they sum: a join of two plain shuffles is one whose hot keys AQE splits.
    shared = cut(retained.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("value"))
    able = retained.join(shared, "value").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    wanted = cut(nodes.join(able, "node").filter(f"common >= {_required('n', percent)}").drop("common"))
    reps = wanted.select(F.xxhash64("rep").alias("h")).distinct()
    # Only these rows' texts are read again (and those of ids that share a hash, which match no digest). As long as they are few, texts aren't shuffled.
    reps = F.broadcast(reps) if wanted.count() <= BROADCAST else reps
    sets = cut(
        narrow.join(reps, F.xxhash64("doc_id") == F.col("h"), "left_semi")
        .mapInArrow(_set_batches, "digest binary, hashes array<long>")
        .join(wanted.select("digest", "node"), "digest")
        .select("node", "hashes")
        .dropDuplicates(["node"])
    )

    lists = cut(_retained_lists(sets, percent, tables))
    centres = cut(lists.groupBy("value").agg(F.min(F.struct("at", "node", "n")).alias("c"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("value", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.at").alias("pa")))
    stars = cut(lists.join(centres, "value").filter(f"node <> a and {_room('n', 'at', 'na', 'pa', percent)}").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    first_links = cut(_verified(_likely(stars, wanted, percent), sets, percent))
    joined = connected_components(first_links, tables)

    # What the stars left open: pairs of a list's members in different components. One of them lies outside its centre's component.
    placed = cut(lists.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = cut(placed.groupBy("value").agg(F.min(F.struct("at", "node", "root")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("value", F.col("c.root").alias("main")))
    split = cut(placed.join(main, "value"))
    apart = split.filter("root <> main").select("value", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("px"), F.col("root").alias("rx"))
    open_pairs = (
        apart.join(split.select("value", "node", "n", "at", "root"), "value")
        .filter(f"root <> rx and node <> x and {_room('n', 'at', 'nx', 'px', percent)}")
        .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more_links = cut(_verified(_likely(open_pairs, wanted, percent), sets, percent))
    tables.drop(wanted, sets, shared, lists, centres, placed, main, stars, split)
    # Components found so far are single nodes of the graph that is left.
    ends = {c: joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
    merged = more_links.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    roots = connected_components(merged.filter("a <> b"), tables)

    inner = joined.select("node", F.col("root").alias("inner_root"))
    outer = roots.select(F.col("node").alias("inner_root"), F.col("root").alias("outer_root"))
    classes = cut(
        nodes.select("node", "digest", "rep")
        .join(inner, "node", "left")
        .select("digest", "rep", F.coalesce("inner_root", "node").alias("inner_root"))
        .join(outer, "inner_root", "left")
        .select("digest", "rep", F.coalesce("outer_root", "inner_root").alias("root"))
    )
    smallest = cut(classes.groupBy("root").agg(F.min("rep").alias("component_id")))
    labels = classes.join(smallest, "root").select("digest", "component_id")
    found = sketched.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
