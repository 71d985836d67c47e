"""Data preparation: events to sites, in transcript or genome coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.special import rint
from sigspark.operators import prep


@dataclass(frozen=True)
class Prepared:
    #: (idx, position, kmer, norm_mean, read_index): one value of a read each, masked positions included.
    observed: DataFrame
    #: (idx): all ids that had reads enough to be looked at.
    ids: DataFrame
    on_ambiguous: str = "stop"

    @property
    def sites(self) -> DataFrame:
        """(idx, position, kmer, y)"""
        return prep.collect_sites(prep.unambiguous_positions(self.observed, on_ambiguous=self.on_ambiguous))

    @property
    def counts(self) -> DataFrame:
        """(idx, n_reads)"""
        return prep.read_counts(self.observed, ["idx"])

    @property
    def status(self) -> DataFrame:
        """(idx, n_reads, complete): complete unless a position's 5-mers cut the id's sites short; ids without a usable read have none to cut."""
        known = self.counts.join(prep.complete_ids(self.observed), "idx")
        return self.ids.join(known, "idx", "left").select("idx", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("complete", F.lit(True)).alias("complete"))


def transcript_sites(events: DataFrame, least: int = 1, most: int = 1000, done: DataFrame | None = None, on_ambiguous: str = "stop") -> Prepared:
    """Sites by transcript: at most ``most`` + 1 reads of each, at least ``least`` of them. Events are read for their reads, and again for those that stay."""
    reads = _transcript_reads(events, least, most, done)
    held = prep.successful_alignments(events).join(reads.filter("usable"), ["contig", "read_index"], "left_semi")
    return _by_transcript(prep.combine_events(held), reads, on_ambiguous)


def transcripts_of(combined: DataFrame, least: int = 1, most: int = 1000, done: DataFrame | None = None, on_ambiguous: str = "stop") -> Prepared:
    """The same of a table of combined events (``prep.combine_reads``): events themselves are scanned once."""
    reads = _transcript_reads(combined, least, most, done)
    return _by_transcript(combined.filter("usable").join(reads.filter("usable"), ["contig", "read_index"], "left_semi"), reads, on_ambiguous)


def _transcript_reads(rows: DataFrame, least: int, most: int, done: DataFrame | None) -> DataFrame:
    # The cap counts the reads seen, usable or not, in the order of their lines or else of their numbers.
    reads = prep.cap_reads(prep.seen_reads(rows), ["contig"], most, ["place", "read_index"])
    if done is not None:
        reads = prep.skip_done(reads.withColumn("idx", F.col("contig")), done).drop("idx")
    return prep.gate_reads(reads, ["contig"], least)


def _by_transcript(rows: DataFrame, reads: DataFrame, on_ambiguous: str) -> Prepared:
    observed = rows.select(F.col("contig").alias("idx"), "position", F.col("reference_kmer").alias("kmer"), rint(F.col("norm_mean"), 2).alias("norm_mean"), "read_index")
    return Prepared(observed, reads.select(F.col("contig").alias("idx")).distinct(), on_ambiguous)


def genome_sites(events: DataFrame, exons: DataFrame, fasta: DataFrame, least: int = 1, most: int = 1000, done: DataFrame | None = None, on_ambiguous: str = "stop") -> Prepared:
    """Sites by gene, in genome coordinates. A gene's transcripts are taken in the annotation's order if exons have a ``place``, else in that of their ids."""
    held = _gene_reads(events, exons, fasta, least, most, done)
    rows = prep.combine_events(prep.successful_alignments(events).join(held.select(*GENE), ["contig", "read_index"]), ["gene_id", "tx_id"])
    return _by_gene(rows, held, exons, fasta, on_ambiguous)


def genes_of(combined: DataFrame, exons: DataFrame, fasta: DataFrame, least: int = 1, most: int = 1000, done: DataFrame | None = None, on_ambiguous: str = "stop") -> Prepared:
    """The same of a table of combined events."""
    held = _gene_reads(combined, exons, fasta, least, most, done)
    return _by_gene(combined.filter("usable").drop("usable").join(held.select(*GENE), ["contig", "read_index"]), held, exons, fasta, on_ambiguous)


#: What a gene's read brings to its observations.
GENE = ("contig", "read_index", "gene_id", "tx_id")


def _gene_reads(rows: DataFrame, exons: DataFrame, fasta: DataFrame, least: int, most: int, done: DataFrame | None) -> DataFrame:
    """The reads that genes keep: what a read's last transcript is, and whether its gene has reads enough, is decided before observations come in."""
    order = F.min("place" if "place" in exons.columns else "tx_id")
    transcripts = exons.filter("gene_id is not null").groupBy("tx_id", "gene_id").agg(order.alias("tx_ord"))
    genes = transcripts.join(fasta.select("tx_id"), "tx_id", "left_semi")
    reads = prep.seen_reads(rows).withColumn("tx_id", prep.strip_version("contig")).join(genes, "tx_id")
    if done is not None:
        reads = prep.skip_done(reads.withColumn("idx", F.col("gene_id")), done).drop("idx")
    reads = prep.cap_reads(prep.gate_reads(reads, ["gene_id"], least), ["gene_id"], most, ["tx_ord", "place", "read_index", "contig"])
    return prep.gate_reads(prep.last_transcript_wins(reads.filter("usable")), ["gene_id"], least)


def _by_gene(rows: DataFrame, held: DataFrame, exons: DataFrame, fasta: DataFrame, on_ambiguous: str) -> Prepared:
    placed = prep.tx_to_genome(rows, prep.exon_offsets(exons), fasta).select(F.col("gene_id").alias("idx"), F.col("g_pos").alias("position"), "kmer", "norm_mean", "read_index")
    return Prepared(placed, held.select(F.col("gene_id").alias("idx")).distinct(), on_ambiguous)
