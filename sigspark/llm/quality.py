"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

The words and word pairs of every document are hashed into ``BUCKETS`` buckets. A bucket holds n-grams with the same last
characters only (pairs: of both words; pairs of equal words have a bucket of their own), so that rare junk such as words that
carry symbols doesn't vanish among common clean n-grams, however small the corpus. Two multinomials with additive
smoothing are counted: one over the whole corpus, one over half of all trusted documents. A document's score is the mean over its n-grams (and ``NEUTRAL`` neutral ones) of log(p_trusted / p_raw); it is kept if the score reaches a
threshold that is a fixed distance below the scores of the trusted documents' other half, which isn't counted. Beside the score stand the plain counts
(``base``). All of it is Catalyst expressions; the driver holds ``BUCKETS`` weights and a few numbers that the quantiles follow from.

Defined results: a null text is empty; a document without words scores 0 and fails the base rules; without
trusted documents all weights are 0, so that only the base rules decide; rows that repeat are judged alike; an empty
table gives an empty table; other columns are carried along by ``judge`` unless they bear a name that it returns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.lineage import Tables

#: Buckets of words: 7 bits of the last character, the other bits of the hash. Buckets of pairs: 14 bits of last characters, 2 of the hashes.
WORDS, PAIRS = 1 << 17, 1 << 16
#: All buckets of n-grams: the bound of all that comes to the driver.
BUCKETS = WORDS + PAIRS
#: Trusted ids up to which they are broadcast; more are joined.
BROADCAST = 1 << 20
SMOOTHING = 1.0
#: Neutral n-grams that every document is thought to have besides: the few of a short text are weak evidence.
NEUTRAL = 20
#: The threshold lies this many times the trusted scores' spread (median to 1st percentile) below their 1st percentile.
SLACK = 3.0
#: Parts of a score's unit in which ranks are looked for first.
PARTS = 1024

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def _tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _hashes: 64 bits of each word, of which the lowest 7 are its last character's and the others a hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    return docs.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-128)).bitwiseOR(F.ascii(F.substring(w, -1, 1)).bitwiseAND(F.lit(127)))))


def _grams(hashes: str = "_hashes") -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    pair = "shiftleft(x & 127L, 9) | shiftleft(y & 127L, 2) | ((shiftright(x, 7) ^ shiftright(y, 9)) & 3L)"
    most = f"greatest(size({hashes}) - 1, 0)"
    return F.expr(
        f"concat(transform({hashes}, x -> cast(x & {WORDS - 1}L as int)), "
        f"zip_with(slice({hashes}, 1, {most}), slice({hashes}, 2, {most}), (x, y) -> cast({WORDS} + if(x = y, 0L, {pair}) as int)))"
    )


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHARACTER))
    # Windows are hashed from pairs and fours, so that each takes three hashes of two longs.
    zipped = "zip_with(slice({0}, 1, greatest(size({1}) - {2}, 0)), slice({3}, {4}, greatest(size({1}) - {2}, 0)), (x, y) -> xxhash64(x, y))"
    # Only texts with a repeated window are sorted. Each step is a projection of its own: an expression inside a lambda would be evaluated for each element.
    return (
        _tokens(docs, text_col)
        .withColumn("_lines", lines)
        .withColumn("_pairs", F.expr(zipped.format("_hashes", "_hashes", 1, "_hashes", 2)))
        .withColumn("_fours", F.expr(zipped.format("_pairs", "_hashes", 3, "_pairs", 3)))
        .withColumn("_windows", F.expr(zipped.format("_fours", "_hashes", 4, "_hashes", 5)))
        .withColumn("_sorted", F.expr("if(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (x, i) -> named_struct('x', x, 'i', i))), null)"))
        .withColumn("_at", F.expr("sort_array(transform(filter(sequence(0, size(_sorted) - 1), j -> (j > 0 and _sorted[greatest(j - 1, 0)].x = _sorted[j].x) or (j < size(_sorted) - 1 and _sorted[least(j + 1, size(_sorted) - 1)].x = _sorted[j].x)), j -> _sorted[j].i))"))
        .withColumn("n_words", F.size("_hashes").cast("long"))
        .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE[:-1]))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.expr("coalesce(aggregate(_at, named_struct('last', -5, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> a.n), 0L)"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_lines", "_pairs", "_fours", "_windows", "_sorted", "_at")
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good and not toxic, and whether they are counted.

    Half of them are counted; the others' scores, which like any document's aren't fitted to, set the threshold.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("_trusted")).filter("_trusted is not null").distinct()
    return good.withColumn("_counted", F.xxhash64("_trusted", F.lit(8)) % 2 == 0)


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of one array: log(p_trusted / p_raw) of each bucket, from counts over all documents."""
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(trusted, F.col("_id") == F.col("_trusted"), "left")
    grams = _tokens(flagged, "_text").select(F.coalesce("_counted", F.lit(False)).cast("long").alias("t"), F.explode(_grams()).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    share = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    table = share(target) - share(raw) if target.any() else np.zeros(BUCKETS)
    return docs.sparkSession.createDataFrame(pa.table({"weights": pa.array([table.astype(np.float32)], pa.list_(pa.float32()))}))


def _scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Adds llr_score. The table is the result of a scalar subquery: one array for each task.

    As _grams and _weights are used once, the optimizer puts them into the expression; as columns, they would be copied for each row.
    """
    made = docs.withColumn("_grams", _grams()).withColumn("_weights", table.scalar())
    n = "greatest(2 * size(_hashes) - 1, 0)"
    return made.withColumn("llr_score", F.expr(f"aggregate(_grams, 0D, (a, b) -> a + _weights[b]) / ({n} + {NEUTRAL})")).drop("_grams", "_weights")


def _at_ranks(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values (one column ``v``, no nulls) of the given 0-based ranks in ascending order.

    Equal values are counted; running sums go over parts of values first, at most a few ten thousand rows as scores are logarithms, then over the values of
    the parts that hold a rank.
    """
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("_part", F.floor(F.col("v") * PARTS))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part").agg(F.sum("c").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    held = lambda end: (F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col(end)))
    hit = parts.filter(F.exists(*held("_c"))).drop("_c")
    run = F.sum("c").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = counts.join(F.broadcast(hit), "_part").withColumn("_to", F.col("_before") + run).withColumn("_before", F.col("_to") - F.col("c"))
    found = near.filter(F.exists(*held("c"))).select("v", "_before", "_to").collect()  # a row per rank at most
    return [next(r.v for r in found if r._before <= k < r._to) for k in ranks]


def threshold(docs: DataFrame, trusted: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> float:
    """The score that a document must reach, from the trusted documents' scores: exact quantiles, between neighbours by linear interpolation."""
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(trusted.filter("not _counted"), F.col("_id") == F.col("_trusted"), "left_semi")
    tables = Tables(docs.sparkSession)
    scores = tables.cut(_scored(_tokens(some, "_text"), table).select(F.col("llr_score").alias("v")))
    n = scores.count()
    if not n:
        return -math.inf
    at = [(n - 1) * p for p in (0.01, 0.5)]
    ends = [math.floor(at[0]), math.ceil(at[0]), math.floor(at[1]), math.ceil(at[1])]
    got = dict(zip(ends, _at_ranks(scores, ends), strict=True))
    tables.drop()
    low, middle = (got[math.floor(x)] + (x - math.floor(x)) * (got[math.ceil(x)] - got[math.floor(x)]) for x in at)
    return low - SLACK * (middle - low)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the base counts, llr_score, base_failed and kept; the input's other columns stay."""
    trusted = trusted_ids(labels)
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST else trusted
    table = weights(docs, trusted, id_col, text_col)
    least = threshold(docs, trusted, table, id_col, text_col)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept"]
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made or c in (id_col, text_col)])
    scored = _scored(base(held, text_col), table)
    judged = scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= F.lit(least)))
    # A generator is a barrier: a filter on the verdict isn't pushed into, and evaluated again in, the projections below.
    return judged.select(*held.columns, F.inline(F.array(F.struct(*made))))
