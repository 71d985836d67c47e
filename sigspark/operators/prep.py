"""From events to sites: combine events, cap and gate reads, map transcripts to the genome, collect sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.special import rint

#: A 5-mer that touches an exon's edge.
MASK = "XXXXX"
#: Bases of a transcript in a bin, by which positions find their exon.
BIN = 256
#: A read counter admits one read more than its maximum.
CAP_EXTRA = 1


def successful_alignments(events: DataFrame) -> DataFrame:
    """Events whose reference 5-mer is the model's."""
    return events.filter(F.col("reference_kmer") == F.col("model_kmer"))


def combine_events(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One length-weighted mean per read, position and 5-mer, rounded half to even to one decimal.

    ``keys`` are further keys (a run, say). ``length`` is end_idx - start_idx unless given. Rows with a null key
    are dropped. The stored position is the centre of the 5-mer.
    """
    own = [*keys, "read_index", "contig", "position", "reference_kmer"]
    length = F.col("length") if "length" in events.columns else F.col("end_idx") - F.col("start_idx")
    rows = events.na.drop(subset=own).select(*own, length.cast("double").alias("length"), F.col("event_level_mean").cast("double").alias("level"))
    sums = rows.groupBy(*own).agg(F.sum(F.col("level") * F.col("length")).alias("s"), F.sum("length").alias("l"))
    return sums.select(
        *keys,
        "read_index",
        "contig",
        (F.col("position") + 2).alias("position"),
        "reference_kmer",
        rint(F.try_divide("s", "l"), 1).alias("norm_mean"),
    )


def combine_reads(events: DataFrame) -> DataFrame:
    """All that preparation needs of events, in one pass: (contig, read_index, position, reference_kmer, norm_mean, usable), with ``place`` if events have it.

    A row per read, position and 5-mer. Those without a successful alignment stay, not usable, as their reads count as seen; norm_mean is that of combine_events,
    place the first of a row's events. Rows without a contig or read are dropped.
    """
    own = ["contig", "read_index", "position", "reference_kmer"]
    length = (F.col("length") if "length" in events.columns else F.col("end_idx") - F.col("start_idx")).cast("double")
    good = F.coalesce(F.col("reference_kmer") == F.col("model_kmer"), F.lit(False)) & F.col("position").isNotNull()
    rows = events.na.drop(subset=["contig", "read_index"]).withColumn("_good", good).withColumn("_length", length)
    first = [F.min("place").alias("place")] if "place" in events.columns else []
    of = lambda c: F.sum(F.when(F.col("_good"), c))
    sums = rows.groupBy(*own).agg(of(F.col("event_level_mean").cast("double") * F.col("_length")).alias("s"), of(F.col("_length")).alias("l"), F.max("_good").alias("usable"), *first)
    return sums.select("contig", "read_index", (F.col("position") + 2).alias("position"), "reference_kmer", rint(F.try_divide("s", "l"), 1).alias("norm_mean"), "usable", *(["place"] if first else []))


def seen_reads(rows: DataFrame) -> DataFrame:
    """(contig, read_index, usable, place): the reads of events or of combine_reads, usable if they have two or more positions or 5-mers; place is null where rows have none.

    Whether there are two is told by the least and the greatest: a row per read is all that is shuffled.
    """
    good = F.col("usable") if "usable" in rows.columns else F.col("reference_kmer") == F.col("model_kmer")
    at = F.when(good & F.col("position").isNotNull(), F.struct("position", "reference_kmer"))
    place = F.min("place") if "place" in rows.columns else F.lit(None).cast("long")
    known = rows.na.drop(subset=["contig", "read_index"])
    return known.groupBy("contig", "read_index").agg(F.coalesce(F.min(at) < F.max(at), F.lit(False)).alias("usable"), place.alias("place"))


def strip_version(name: str | Column) -> Column:
    """An id up to its first dot."""
    return F.substring_index(name, ".", 1)


def usable_reads(combined: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Rows of reads with two or more positions."""
    own = [*keys, "read_index"]
    enough = combined.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return combined.join(enough, own, "left_semi")


def cap_reads(reads: DataFrame, keys: Sequence[str], most: int, order: Sequence[str] = ("read_index",)) -> DataFrame:
    """The first reads of each key in order (a row per read): most + 1 of them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return reads.withColumn("_rank", rank).filter(F.col("_rank") <= most + CAP_EXTRA).drop("_rank")


def read_counts(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct reads of each key."""
    return reads.groupBy(*keys).agg(F.count_distinct("read_index").alias("n_reads"))


def gated_counts(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Keys with ``least`` distinct reads or more, and how many these are: rows are counted once."""
    return read_counts(rows, keys).filter(F.col("n_reads") >= least)


def gate_reads(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of keys with ``least`` distinct reads or more."""
    good = gated_counts(rows, keys, least).select(*keys)
    return rows.join(good, list(keys), "left_semi")


def unambiguous_positions(sites: DataFrame, keys: Sequence[str] = ("idx",), on_ambiguous: str = "stop") -> DataFrame:
    """Sites without the mask and, by id, below the first position with several 5-mers or an N.

    ``on_ambiguous``: "stop" drops that position and all higher ones of the id, "drop_site" only that position.
    """
    shown = sites.filter(F.col("kmer") != MASK)
    at = shown.groupBy(*keys, "position").agg(F.count_distinct("kmer").alias("kmers"), F.max(F.col("kmer").contains("N")).alias("unknown"))
    bad = at.filter("kmers > 1 or unknown")
    if on_ambiguous == "drop_site":
        return shown.join(bad.select(*keys, "position"), [*keys, "position"], "left_anti")
    first = bad.groupBy(*keys).agg(F.min("position").alias("_first_bad"))
    return shown.join(first, list(keys), "left").filter("_first_bad is null or position < _first_bad").drop("_first_bad")


def complete_ids(sites: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """keys and complete: whether no position of the id is ambiguous."""
    at = sites.groupBy(*keys, "position").agg(
        (F.count_distinct(F.when(F.col("kmer") != MASK, F.col("kmer"))) > 1).alias("several"),
        F.coalesce(F.max((F.col("kmer") != MASK) & F.col("kmer").contains("N")), F.lit(False)).alias("unknown"),
    )
    return at.groupBy(*keys).agg((~F.max(F.col("several") | F.col("unknown"))).alias("complete"))


def event_index(events: DataFrame) -> DataFrame:
    """A row per read of a contig: its first position and its number of events."""
    return events.na.drop(subset=["contig", "read_index"]).groupBy("contig", "read_index").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_events"))


def collect_sites(rows: DataFrame, keys: Sequence[str] = ("idx", "position", "kmer")) -> DataFrame:
    """The sorted values of each site."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("norm_mean")).alias("y"))


def exon_offsets(exons: DataFrame) -> DataFrame:
    """tx_start and tx_end of each exon (tx_id, strand, g_start, g_end): exons laid end to end in the strand's direction."""
    along = F.when(F.col("strand") == "-", -F.col("g_start")).otherwise(F.col("g_start"))
    length = F.col("g_end") - F.col("g_start") + 1
    ahead = Window.partitionBy("tx_id").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(ahead), F.lit(0))
    order = F.row_number().over(Window.partitionBy("tx_id").orderBy(along))
    return exons.withColumn("exon_ord", order).withColumn("tx_start", start).withColumn("tx_end", F.col("tx_start") + length - 1)


def overlapping_exons(offsets: DataFrame) -> DataFrame:
    """Exons that overlap the exon before them in their transcript: annotations that would map a base twice."""
    before = Window.partitionBy("tx_id").orderBy("g_start", "g_end")
    return offsets.withColumn("_end", F.max("g_end").over(before.rowsBetween(Window.unboundedPreceding, -1))).filter("_end >= g_start").drop("_end")


def tx_to_genome(rows: DataFrame, offsets: DataFrame, fasta: DataFrame | None = None) -> DataFrame:
    """Rows (tx_id, position) with g_pos and, given sequences, the 5-mer around them; masked near exon edges.

    An equi-join on the transcript and a bin of positions, so that a row meets only the few exons of its bin. 5-mers are cut once for
    each position that occurs: no row carries a sequence.
    """
    first, last = (F.expr(f"{c} div {BIN}") for c in ("tx_start", "tx_end"))
    exons = offsets.select("tx_id", "strand", "g_start", "g_end", "tx_start", "tx_end", F.explode(F.sequence(first, last)).alias("_bin"))
    inside = F.col("position").between(F.col("tx_start"), F.col("tx_end"))
    step = F.col("position") - F.col("tx_start")
    binned = rows.withColumn("_bin", F.expr(f"position div {BIN}"))
    found = binned.join(exons, ["tx_id", "_bin"]).filter(inside).withColumn("g_pos", F.when(F.col("strand") == "-", F.col("g_end") - step).otherwise(F.col("g_start") + step))
    edge = (F.col("g_pos") - F.col("g_start") < 2) | (F.col("g_end") - F.col("g_pos") < 2)
    found = found.withColumn("masked", edge).drop("_bin", "strand", "g_start", "g_end", "tx_start", "tx_end")
    if fasta is None:
        return found
    kmer = F.substring(F.col("seq"), (F.col("position") - 1).cast("int"), F.lit(5))
    cut = found.filter("not masked").select("tx_id", "position").distinct().join(fasta.select("tx_id", "seq"), "tx_id").select("tx_id", "position", kmer.alias("_kmer"))
    # Rows whose transcript has no sequence go; those of masked positions need none.
    known = found.join(fasta.select("tx_id").distinct(), "tx_id", "left_semi")
    return known.join(cut, ["tx_id", "position"], "left").withColumn("kmer", F.when(F.col("masked"), MASK).otherwise(F.col("_kmer"))).drop("_kmer", "masked")


def last_transcript_wins(rows: DataFrame, order: str = "tx_ord", keys: Sequence[str] = ("gene_id", "read_index")) -> DataFrame:
    """Of a read's rows in a gene only those of its last transcript."""
    # Rows are dealt once and sorted: no table of reads beside them, and none is joined.
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.na.drop(subset=[*keys, order]).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def skip_done(rows: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose id isn't among the completed ones."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
