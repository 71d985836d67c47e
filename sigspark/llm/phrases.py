"""Phrase collocation mining: frequent phrases of each language, scored by how much more often they occur than their parts would by chance.

All runs of 1 to ``most`` words within a piece are rows of a DataFrame, counted by language. A run is a candidate if it occurs ``least`` times; then so
do all runs inside it, so that rows of runs that hold a rarer word, pair or triple of words needn't be made: they are told by a filter of fixed size (``FILTER_BITS``)
that knows every frequent one and lets through some others, which cost work and change nothing. Pairs, the most by far, are first summed by 2^32 buckets of
a hash, of which those with too few occurrences hold no candidate. Each task first sums the runs of a block of texts; counts
are summed by hash aggregation of the runs themselves, not of hashes of them. Candidates are joined with the counts of their prefixes and suffixes, scores
are whole numbers of 38-digit decimals, an anti-join with one-word extensions drops what a longer candidate explains, and a window ranks each language.

A longer candidate of n words that occurs as often as one inside it makes every run between the two occur as often, so that one-word extensions tell all.

Defined results: a null text is empty; a null language is ``und``, as is the language of that name; white space other than blanks, tabs and line ends belongs to
words; repeated rows count each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.bytetext import blocks, lower_ascii, mix64, span_hashes, string_buffers
from sigspark.llm.lineage import Tables

#: Words of the longest phrase, and occurrences that a candidate has at least.
MOST, LEAST = 5, 100
#: Phrases reported of each language.
TOP = 2000
#: Filters: of words, pairs and triples. Runs of more words are counted together.
PASSES = 3
#: Bits of the filter of frequent words or pairs: 8 MB, whatever the data.
FILTER_BITS = 1 << 26
#: Languages up to which their numbers of words are broadcast.
LANGUAGES = 100_000
#: Bytes of text whose runs a task sums at once.
BLOCK = 1 << 22

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_U = np.uint64


class Frequent:
    """A filter of fixed size that knows every hash it was made of."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        """Two places of each hash."""
        return np.stack([hashes & _U(FILTER_BITS - 1), (hashes >> _U(32)) & _U(FILTER_BITS - 1)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _run_hash(langs: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return mix64(runs ^ mix64(langs))


def _bucket_of(hashes: np.ndarray) -> np.ndarray:
    """One of 2^32 buckets."""
    return mix64(hashes) >> _U(32)


def _hash_of(column: pa.Array) -> np.ndarray:
    data, at = string_buffers(column)
    return span_hashes(data, at[:-1], at[1:])


def _joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words from each word on, from the words' hashes."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for j in range(1, n):
        out = mix64(out * _U(0x9E3779B97F4A7C15) ^ words[j : j + len(out)])
    return out


def _taken(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The strings at the given spans."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    gather = np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[gather])))


def runs_of(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, sizes: range, frequent: Frequent | None, sifted: Frequent | None = None, buckets: bool = False) -> Iterator[tuple]:
    """(language, phrase, words, occurrences) of a block's runs, for each number of words; with ``buckets``, only (bucket, occurrences) of the shortest ones.

    ``frequent``: a filter of runs of one word less than the shortest; ``sifted``: one of the shortest runs' buckets.
    """
    low = lower_ascii(data)
    apart = _BLANK[low] | _BREAK[low]
    if not len(low) or apart.all():
        return
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True  # a document's first byte
    solid = ~apart
    begins = solid & (np.concatenate([[True], apart[:-1]]) | edge[:-1])
    stops = solid & (np.concatenate([apart[1:], [True]]) | edge[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    # A word's piece: the number of breaks before it, and of documents.
    piece = np.cumsum(_BREAK[low])[starts] + doc
    names = langs.dictionary_encode()
    lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    encoded = _taken(low, starts, ends - starts).dictionary_encode()
    vocabulary, ids = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    k = sizes[0] - 1
    at = np.arange(len(starts) - k)
    if k:
        at = at[piece[at] == piece[at + k]]
        good = np.zeros(len(starts), bool)
        inner = np.flatnonzero(piece[: len(piece) - k + 1] == piece[k - 1 :])
        lang_hash, word_hash = _hash_of(names.dictionary)[lang], _hash_of(vocabulary)[ids]
        good[inner] = frequent.has(_run_hash(lang_hash[inner], _joined(word_hash, k)[inner]))
        at = at[good[at] & good[at + 1]]
        if buckets or sifted:
            own = _bucket_of(_run_hash(lang_hash[at], _joined(word_hash, k + 1)[at]))
            if buckets:
                found, count = np.unique(own, return_counts=True)
                yield found.astype(np.int64), count
                return
            at = at[sifted.has(mix64(own))]
    code = lang[at] * len(vocabulary) + ids[at]
    for n in range(2, sizes[-1] + 1):
        if n > sizes[0]:
            more = at + n - 1 < len(starts)
            more[more] = (piece[at[more]] == piece[at[more] + n - 1]) & good[at[more] + n - 1 - k]
            at, code = at[more], code[more]
        if not len(at):
            return
        # A run's number is made of that of the run without its last word, and this word.
        code = np.unique(code, return_inverse=True)[1] * len(vocabulary) + ids[at + n - 1]
        if n in sizes:
            yield _summed(code, at, n, names.dictionary, lang, vocabulary, ids)
    if sizes[0] == 1:
        yield _summed(code, at, 1, names.dictionary, lang, vocabulary, ids)


def _summed(code: np.ndarray, at: np.ndarray, n: int, names: pa.Array, lang: np.ndarray, vocabulary: pa.Array, ids: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The runs of n words from the given words on, each once."""
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    one = at[first]
    words = [pc.take(vocabulary, pa.array(ids[one + j])) for j in range(n)]
    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]
    return pc.take(names, pa.array(lang[one])), phrase, np.full(len(one), n), count


def _blocks(docs: DataFrame, schema: str, of_block: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """of_block(bytes, offsets, languages) of each block of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column(0), "und")
            data, at = string_buffers(batch.column(1))
            for a, b in blocks(at, BLOCK):
                yield from of_block(data[at[a] : at[b]], at[a : b + 1] - at[a], langs.slice(a, b - a))

    return docs.mapInArrow(work, schema)


def _known(bits: Broadcast | None) -> Frequent | None:
    return Frequent(bits.value) if bits else None


def _counted(docs: DataFrame, sizes: range, frequent: Broadcast | None = None, sifted: Broadcast | None = None) -> DataFrame:
    """(lang, n_words, phrase, f): occurrences of the runs that pass, of each number of words."""

    def runs(*block) -> Iterator[pa.RecordBatch]:  # noqa: ANN002
        for lang, phrase, words, count in runs_of(*block, sizes, _known(frequent), _known(sifted)):
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(words, pa.int32()), phrase.cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "n_words", "phrase", "f"])

    return _blocks(docs, "lang string, n_words int, phrase string, f long", runs).groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))


def _sifted(docs: DataFrame, n: int, frequent: Broadcast, least: int) -> np.ndarray:
    """A filter of the buckets of runs of n words that hold ``least`` occurrences.

    A bucket holds all occurrences of its runs, so that no frequent run is in another one. Numbers are shuffled in place of phrases, most of which occur once or twice.
    """

    def sums(*block) -> Iterator[pa.RecordBatch]:  # noqa: ANN002
        for bucket, count in runs_of(*block, range(n, n + 1), _known(frequent), buckets=True):
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(count, pa.int64())], names=["bucket", "f"])

    full = _blocks(docs, "bucket long, f long", sums).groupBy("bucket").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return _bits(full.select("bucket"), lambda batch: mix64(batch.column(0).to_numpy().astype(_U)))


def _filter_of(runs: DataFrame, n: int) -> np.ndarray:
    """The filter of runs of n words (lang, phrase)."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        words = _hash_of(pc.split_pattern(batch.column(1), " ").flatten()).reshape(-1, n)
        return _run_hash(_hash_of(batch.column(0)), _joined_columns(words))

    return _bits(runs.select("lang", "phrase"), hashes)


def _joined_columns(words: np.ndarray) -> np.ndarray:
    """As _joined, of runs in rows."""
    out = words[:, 0].copy()
    for j in range(1, words.shape[1]):
        out = mix64(out * _U(0x9E3779B97F4A7C15) ^ words[:, j])
    return out


def _bits(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A filter's bits: each task sends the bytes that it sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            if len(batch):
                at = Frequent.places(hashes(batch)).ravel()
                np.bitwise_or.at(bits, at >> _U(3), (1 << (at & _U(7))).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].astype(np.int16))], names=["at", "bits"])

    found = rows.mapInArrow(work, "at int, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return out


def frequent_runs(docs: DataFrame, most: int, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all runs of up to ``most`` words that occur ``least`` times, and (lang, n): all words of each language."""
    spark: SparkSession = docs.sparkSession
    words = tables.cut(_counted(docs, range(1, 2)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = out = tables.cut(words.filter(F.col("f") >= least))
    for n in range(1, min(most, PASSES + 1)):
        sizes = range(n + 1, n + 2) if n < PASSES else range(n + 1, most + 1)
        frequent = spark.sparkContext.broadcast(_filter_of(found, n))
        # Pairs are the most by far: sums over buckets come first.
        sifted = spark.sparkContext.broadcast(_sifted(docs, 2, frequent, least)) if n == 1 else None
        found = tables.cut(_counted(docs, sizes, frequent, sifted).filter(F.col("f") >= least))
        out = out.unionByName(found)
    return out, totals


def _part(phrase: str, first: str, count: str) -> Column:
    """``count`` words of a phrase from the word numbered ``first`` (from 0) on."""
    return F.expr(f"array_join(slice(split({phrase}, ' '), {first} + 1, {count}), ' ')")


def mine(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    tables = Tables(docs.sparkSession)
    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    runs, totals = frequent_runs(narrow, most, least, tables)
    candidates = runs.filter("n_words > 1").withColumnRenamed("f", "a")
    cut = candidates.select("lang", "n_words", "phrase", "a", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    parts = cut.withColumn("first", _part("phrase", "0", "k")).withColumn("last", _part("phrase", "k", "n_words - k"))
    counts = runs.select("lang", "phrase", "f")
    totals = F.broadcast(totals) if totals.count() <= LANGUAGES else totals
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (
        parts.join(left, ["lang", "first"])
        .join(right, ["lang", "last"])
        .join(totals, "lang")
        .withColumn("above", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"))
        .withColumn("score", F.expr("above div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
        .groupBy("lang", "n_words", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("lowest"))
    )
    longer = candidates.filter("n_words > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(_part("phrase", "0", "n_words - 1"), _part("phrase", "1", "n_words - 1"))).alias("phrase"))
    explained = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(explained, ["lang", "phrase"], "left").filter("f is null or 100 * f < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", "lowest.l", "lowest.r", "n", "lowest.score")
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
