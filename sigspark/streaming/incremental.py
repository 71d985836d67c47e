"""Event combining over a stream: the weighted sums of a read's positions are Spark's state.

Events of a (read, position) may come in any micro-batch; the means are emitted again whenever their sums change
(update or complete mode). With a time column and a watermark the state of old groups is dropped and means are
emitted once (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.special import rint


def combine_stream(events: DataFrame, keys: tuple[str, ...] = (), time_col: str | None = None, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Means by read, position and 5-mer of a streaming (or plain) frame of events, as combine_events has them."""
    own = [*keys, "read_index", "contig", "position", "reference_kmer"]
    length = (F.col("length") if "length" in events.columns else F.col("end_idx") - F.col("start_idx")).cast("double")
    rows = events.na.drop(subset=own)
    groups = [F.col(c) for c in own]
    if time_col:
        rows = rows.withWatermark(time_col, lateness)
        groups.append(F.window(time_col, window))
    sums = rows.groupBy(*groups).agg(F.sum(F.col("event_level_mean") * length).alias("s"), F.sum(length).alias("l"))
    return sums.select(*keys, "read_index", "contig", (F.col("position") + 2).alias("position"), "reference_kmer", rint(F.try_divide("s", "l"), 1).alias("norm_mean"))
