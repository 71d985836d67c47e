"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the three-byte windows of its ASCII-lower-cased UTF-8 bytes, hashed into ``BUCKETS`` embeddings that are averaged; a
linear softmax on the mean gives the language. Embeddings and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows: the documents of each language with the smallest hashes of id and text, ``PER_LANGUAGE`` at most,
taken in the order of their rank in their language, so that every language is learned before any has a second row,
until there are ``SAMPLE`` rows or ``BYTES`` bytes of features. A fifth of the sample, but no language's only row, is set aside: a temperature is
fitted to it and the rejection bound is a low quantile of its confidence. Since the softmax is linear, the mean embedding's scores equal
the mean of per-bucket scores: for up to ``DIMENSION`` languages prediction sums one row of a BUCKETS x languages table for each
byte, for more one row of the embeddings.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; a null language
is never learned from; with nothing to learn from, every text is ``und``; rows that repeat an id and a text are learned from once and get equal predictions; an
empty table gives an empty table; columns of the input other than id and text never matter to a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.bytetext import blocks, lower_ascii, string_buffers

BUCKETS = 1 << 14
DIMENSION = 16
PER_LANGUAGE = 1000
#: Rows of the sample, and so languages that are learned, at most; bytes of features that the driver holds of it.
SAMPLE = 8000
BYTES = 1 << 26
EPOCHS = 5
RATE = 0.5
#: Share of a training target that is spread over all languages, so that scores of parts of a text add up instead of saturating.
SMOOTHING = 0.05
#: Times PER_LANGUAGE rows of a language whose order is looked at, on average.
MARGIN = 4
#: Share of the set-aside documents whose confidence lies below the rejection bound, and the factor applied to it.
REJECT_QUANTILE, REJECT_FACTOR = 0.002, 0.8


def subwords(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each position on (two positions fewer than bytes)."""
    low = lower_ascii(data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # BUCKETS x DIMENSION
    output: np.ndarray  # DIMENSION x languages
    bias: np.ndarray
    temperature: float
    reject_below: float

    def __post_init__(self) -> None:
        self.few = len(self.languages) <= DIMENSION
        self.summed = self.embedding @ self.output if self.few else self.embedding

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (documents x languages) of the texts at ``offsets`` of ``data``."""
        out = np.tile(self.bias, (len(offsets) - 1, 1))
        index = subwords(data)
        last = np.maximum(offsets[1:] - 2, offsets[:-1])  # windows over two texts don't count
        last = np.minimum(last, len(index))
        first = np.minimum(offsets[:-1], len(index))
        some = np.flatnonzero(last > first)
        if len(some):
            edges = np.stack([first[some], last[some]], axis=1).reshape(-1)
            pad = edges[-1] == len(index)
            means = np.empty((len(some), self.summed.shape[1]))
            for k in range(means.shape[1]):
                value = self.summed[:, k][index]
                sums = np.add.reduceat(np.append(value, np.float32(0)) if pad else value, edges)[::2]
                means[:, k] = sums / (last[some] - first[some])
            out[some] += means if self.few else means @ self.output
        out /= self.temperature
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 5) -> Model:
    """rows: (language, buckets, shares of the text's windows), in a fixed order."""
    languages = sorted({r[0] for r in rows})
    label = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    seen: set[str] = set()
    only = [i for i in order if not (rows[i][0] in seen or seen.add(rows[i][0]))]  # a row of each language is always fitted to
    rest = order[~np.isin(order, only)]
    aside, fit = rest[: len(rows) // 5], np.concatenate([rest[len(rows) // 5 :], np.array(only, order.dtype)])
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    output = np.zeros((DIMENSION, len(languages)), np.float32)
    output += rng.normal(0, 0.1, output.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            name, index, share = rows[i]
            mean = share @ embedding[index]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p -= SMOOTHING / len(languages)
            p[label[name]] -= 1 - SMOOTHING
            rate = RATE * (1 - done / steps)
            back = output @ p
            output -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # A shared step for the whole text: its subwords move together, each by its share times their number.
            embedding[index] -= rate * (share * len(index))[:, None] * back[None, :]
            done += 1
    z = np.array([share @ embedding[index] @ output + bias for _, index, share in (rows[i] for i in aside)]).reshape(-1, len(languages))
    truth = np.array([label[rows[i][0]] for i in aside], int)

    def loss(t: float) -> float:
        y = z / t
        y = y - y.max(axis=1, keepdims=True)
        return float(-(y[np.arange(len(y)), truth] - np.log(np.exp(y).sum(axis=1))).mean())

    temperature, bound = 1.0, 0.0
    if len(aside) and len(languages) > 1:
        temperature = min((float(t) for t in np.geomspace(1, 10, 41)), key=loss)
        y = z / temperature
        p = np.exp(y - y.max(axis=1, keepdims=True))
        bound = REJECT_FACTOR * float(np.quantile((p / p.sum(axis=1, keepdims=True)).max(axis=1), REJECT_QUANTILE))
    return Model(languages, embedding, output, bias.astype(np.float64), temperature, bound)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = string_buffers(batch.column(1))
        index, share = [], []
        for first, last in zip(at[:-1], at[1:], strict=True):
            found, n = np.unique(subwords(data[first:last]), return_counts=True)
            index.append(found.astype("<u2").tobytes())
            share.append((n / max(1, n.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["lang", "index", "share"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the given rows' texts and languages; None if none can be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null and id is not null")
    hashed = rows.select("text", F.col("lang").alias("l"), F.xxhash64("id", "text").alias("h"))
    # Features take six bytes for each bucket that a text has.
    narrow = hashed.select("l", "h", (6 * F.least(F.octet_length("text"), F.lit(BUCKETS))).cast("long").alias("cost"))
    # Hashes above a language's bound can't be among its smallest, so that few rows of a language meet in one task.
    counts = narrow.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(SAMPLE)
    bounds = counts.select(F.col("l").alias("bl"), F.expr(f"case when n <= {MARGIN * PER_LANGUAGE} then {2**63 - 1}L else cast({-(2.0**63)!r}D + {2.0**64!r}D * {MARGIN * PER_LANGUAGE} / n as bigint) end").alias("most"))
    low = narrow.join(F.broadcast(bounds), F.col("l") == F.col("bl")).filter("h <= most").groupBy("l", "h").agg(F.max("cost").alias("cost"))
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("rank") <= PER_LANGUAGE)
    first = ranked.orderBy("rank", "h", "l").limit(SAMPLE)
    chosen = first.withColumn("so_far", F.sum("cost").over(Window.orderBy("rank", "h", "l"))).filter(F.col("so_far") <= BYTES).select(F.col("l").alias("cl"), F.col("h").alias("ch"))
    same = (F.col("l") == F.col("cl")) & (F.col("h") == F.col("ch"))
    sample = hashed.join(F.broadcast(chosen), same).groupBy("l", "h").agg(F.first("text").alias("text")).select(F.col("l").alias("lang"), "text")
    # As bytes, a document's features take six bytes a bucket on the driver.
    found = [(r[0], np.frombuffer(r[1], "<u2"), np.frombuffer(r[2], "<f4")) for r in sample.mapInArrow(_features, "lang string, index binary, share binary").collect() if len(r[1])]
    found.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return train(found) if found else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """All columns of docs with the predicted language, its probability and whether it is rejected."""
    added = {lang_pred, score, rejected}
    held = [c for c in docs.columns if c not in added or c in (id_col, text_col)]
    given = docs.select(*[F.col(f"`{c}`") for c in held], F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    text_at = held.index(text_col)
    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in held) + f", `{lang_pred}` string, `{score}` double, `{rejected}` boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_buffers(batch.column(text_at))
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            names, best = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for first, last in blocks(at) if model else ():
                p = model.scores(data[at[first] : at[last]], at[first : last + 1] - at[first])
                names[first:last] = np.array(model.languages, object)[p.argmax(axis=1)]
                best[first:last] = p.max(axis=1)
            names[~letters], best[~letters] = "und", 0.0
            turned = ~letters | (best < model.reject_below) if model else np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(best), pa.array(turned)], names=[*held, lang_pred, score, rejected])

    return given.mapInArrow(work, schema)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.filter(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
