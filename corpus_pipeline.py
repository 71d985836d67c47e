"""The corpus pipeline: quality rules, language ID, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever their names and number: a stage works on
columns renamed by position, so that no name of its own can clash. An empty table passes through every stage. Rows that repeat: the
quality and language stages judge them alike, near-dedup keeps one, mixing treats them as documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm import language_id, mixing, near_dedup, packing, quality
from sigspark.llm.lineage import shared_folder
from sigspark.llm.queries import vocabulary

#: No SQL expresses the stages' trained models; tests hold each stage against a brute-force version.
ORACLE_SQL = None
#: The near-dedup stage links texts whose similarity is this many hundredths or more.
NEAR_PERCENT = 80


def _sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with columns named by position, where each name went, and the way back."""
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]
    return docs.toDF(*own), dict(zip(reversed(names), reversed(own), strict=True)), lambda df: df.select(*own).toDF(*names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, at, opened = _sealed(docs)
    judged = quality.judge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), at["doc_id"], at["text"])
    return opened(judged.filter("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    rows, at, opened = _sealed(docs)
    model = language_id.fit(language_id.learnable(rows, at["doc_id"]), at["doc_id"], at["text"], at["lang"])
    return opened(language_id.predict(rows, model, at["doc_id"], at["text"]).filter("not rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    rows, at, opened = _sealed(docs)
    # Rows are told apart by id and 128 bits of their text, in an order in which null ids come last.
    keyed = rows.withColumn("_key", F.struct(F.isnull(at["doc_id"]).alias("a"), F.col(at["doc_id"]).alias("b"), F.xxhash64(at["text"]).alias("c"), F.xxhash64(F.lit(1), at["text"]).alias("d")))
    kept = near_dedup.near_duplicates(keyed, "_key", at["text"], NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return opened(keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, at, opened = _sealed(docs)
    key = [at["doc_id"], "_size", at["source"]]
    taken = mixing.mix(rows, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"]).groupBy("doc_id", "size", "source").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows")).filter("_times > 0").toDF("_i", "_n", "_s", "_times", "_rows")
    sized = rows.withColumn("_size", mixing.n_words(at["text"]))
    same = F.col(key[0]).eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_n")) & F.col(key[2]).eqNullSafe(F.col("_s"))
    # Rows that share id, size and source share their copies out among them.
    order = Window.partitionBy(*key).orderBy(at["text"])
    copies = F.expr("_times div _rows") + (F.col("_rank") <= F.col("_times") % F.col("_rows")).cast("int")
    joined = sized.join(taken, same).withColumn("_rank", F.row_number().over(order)).withColumn("_copies", copies.cast("int"))
    return opened(joined.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is written to the shared folder."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
