"""Where a row of a text source stands: an order of all lines of many files and splits, and exact numbers and byte offsets of lines.

A split's rows come in order, and every line belongs to one split. So the file's name, the split's first byte and the row's number within its task
order all lines without a shuffle; prefix sums over splits (a row each) make exact numbers of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits up to which their first offsets are broadcast; those of more are joined.
SPLITS = 1 << 17


def place() -> Column:
    """An order of the lines of a file source: by file name, split and row. Its first use must be right on the source."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def line_spans(spark: SparkSession, path: str, **kept: Column) -> DataFrame:
    """(file, start, end, *kept): each line's bytes in its file, its line end included, and expressions over its ``value``.

    Lines of a split are summed in their order; where a split begins is the sum of the splits before it. Only lengths and what is kept are shuffled.
    Nothing can seek in compressed files: they are refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(place().alias("_at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), "value")
    size = (F.octet_length("value") + 1).cast("long")
    known = lines.select("file", "_at.block", "_at.row", "_size", size.alias("_bytes"), *[c.alias(name) for name, c in kept.items()])
    within = Window.partitionBy("file", "block").orderBy("row")
    ends = known.withColumn("_to", F.sum("_bytes").over(within))
    splits = known.groupBy("file", "block").agg(F.sum("_bytes").alias("_whole"), F.first("_size").alias("_size"))
    ahead = Window.partitionBy("file").orderBy("block")
    first = splits.select("file", "block", (F.sum("_whole").over(ahead) - F.col("_whole")).alias("_from"), (F.col("_size") - F.sum("_whole").over(ahead)).alias("_over"))
    # The last line of a file may lack its line end: one byte more is counted than is there.
    counted, low, high = first.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("_over").alias("left")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("left"), F.max("left")).first()
    if counted and not -1 <= low <= high <= 0:
        raise ValueError(f"{path} holds compressed files, which can't be read in slices")
    first = F.broadcast(first) if counted <= SPLITS else first
    end = F.least(F.col("_from") + F.col("_to"), F.col("_size"))
    return ends.join(first.drop("_over"), ["file", "block"]).select("file", (F.col("_from") + F.col("_to") - F.col("_bytes")).alias("start"), end.alias("end"), *kept)
