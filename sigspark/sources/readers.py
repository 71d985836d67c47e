"""Sources: event tables, annotations, sequences, site stores, reference signals, result tables, models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.operators.prep import strip_version
from sigspark.sources import commits, site_slices, writers
from sigspark.sources.lines import place

#: Columns of an event table, by position.
EVENTS = (
    "contig string, position long, reference_kmer string, read_index long, strand string, event_index long, event_level_mean double, event_stdv double, "
    "event_length double, model_kmer string, model_mean double, model_stdv double, standardized_level double, start_idx long, end_idx long"
)
SITE_MAP = "map<string,map<string,map<string,array<double>>>>"


def read_events(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """Tab-separated event table with a header; gzip is read too. ``placed``: with the order of its lines (``place``)."""
    rows = spark.read.schema(EVENTS).option("sep", "\t").option("header", True).csv(path)
    return rows.withColumn("place", place()) if placed else rows


def read_fasta(spark: SparkSession, path: str, keep_version: bool = False) -> DataFrame:
    """(tx_id, seq, gene_id): the id is the header's first token, without its version; gene_id is its ``gene:`` field or second pipe field."""
    # A record begins with > at a line's beginning only; the file's first one isn't preceded by a line.
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    token = F.split(F.split(header, r"\s+")[0], r"\|")[0]
    piped = F.split(header, r"\|")
    gene = F.coalesce(F.nullif(F.regexp_extract(header, r"gene:(\S+)", 1), F.lit("")), F.when(F.size(piped) > 1, piped[1]))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return records.select((token if keep_version else strip_version(token)).alias("tx_id"), body.alias("seq"), strip_version(gene).alias("gene_id"))


def annotation_dialect(spark: SparkSession, path: str) -> str:
    """"gff" if the first line's attributes begin with ID or Parent, else "gtf"."""
    first = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).limit(1).collect()
    fields = first[0][0].split("\t") if first else []
    return "gff" if len(fields) > 8 and fields[8].startswith(("ID", "Parent")) else "gtf"


def read_annotation(spark: SparkSession, path: str, fasta: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Exons (tx_id, gene_id, chr, strand, g_start, g_end) of a GTF or GFF3 file; versions are stripped.

    GFF3 transcripts take the gene from the sequences' headers. ``placed``: with the ``place`` of the transcript's first line, its own or an exon's.
    """
    dialect = annotation_dialect(spark, path)
    lines = spark.read.schema("chr string, source string, feature string, g_start long, g_end long, score string, strand string, frame string, attributes string")
    rows = lines.option("sep", "\t").option("comment", "#").option("quote", "").csv(path).withColumn("place", place()).filter("feature in ('exon', 'transcript', 'mRNA')")
    if dialect == "gtf":
        field = lambda name: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "?([^";]+)"?', 1), F.lit(""))
        exons = rows.withColumn("tx_id", strip_version(field("transcript_id"))).withColumn("gene_id", strip_version(field("gene_id")))
    else:
        exons = rows.withColumn("tx_id", strip_version(F.regexp_extract("attributes", r"transcript:([^;,]+)", 1))).filter("feature <> 'transcript'")
        genes = fasta.select("tx_id", "gene_id").dropDuplicates(["tx_id"]) if fasta is not None else None
        exons = exons.join(genes, "tx_id", "left") if genes is not None else exons.withColumn("gene_id", F.lit(None).cast("string"))
    first = F.min("place").over(Window.partitionBy("tx_id"))
    found = exons.filter("tx_id is not null and tx_id <> ''").withColumn("place", first).filter("feature = 'exon'") if placed else exons.filter("feature = 'exon' and tx_id is not null and tx_id <> ''")
    return found.select("tx_id", "gene_id", "chr", "strand", "g_start", "g_end", *(["place"] if placed else [])).distinct()


def read_site_store(spark: SparkSession, path: str) -> DataFrame:
    """(idx, position, kmer, y) of JSON lines {id: {position: {kmer: [values]}}}: of what was committed, where jobs commit."""
    ids = spark.read.text(commits.paths(spark, path)).select(F.explode(F.from_json("value", SITE_MAP)).alias("idx", "positions"))
    positions = ids.select("idx", F.explode("positions").alias("position", "kmers"))
    return positions.select("idx", F.col("position").cast("long").alias("position"), F.explode("kmers").alias("kmer", "y"))


def read_native(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(idx, position, kmer, y) of a native store, of all ids, the given ones, or those of a table (column ``idx``).

    Only the buckets of the wanted ids are read: of a table's ids, the buckets they fall into are asked for first, BUCKETS rows at most.
    """
    rows = spark.read.option("basePath", path).schema("idx string, position long, kmer string, y array<double>, bucket int").parquet(path)
    if isinstance(ids, DataFrame):
        wanted = ids.select("idx").distinct().withColumn("bucket", writers.bucket_of("idx"))
        present = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(present)).join(wanted.filter("idx is not null"), ["bucket", "idx"], "left_semi")
    elif ids is not None:
        rows = rows.filter(F.col("bucket").isin(*[writers.bucket_of(F.lit(i)) for i in ids]) & F.col("idx").isin(*ids)) if ids else rows.limit(0)
    return rows.select("idx", "position", "kmer", "y")


def read_store(spark: SparkSession, folder: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(idx, position, kmer, y) of a prepared folder, of all ids or some.

    The native store goes first where every committed job wrote one; then, for given ids, slices of the JSON store; then its lines.
    """
    json_paths, native, index = (commits.paths(spark, f"{folder}/{name}") for name in ("data.json", "sites", "data.index"))
    plain = lambda found, name: found == [f"{folder}/{name}"]
    if not plain(native, "sites") and len(native) == len(json_paths):
        return reduce(DataFrame.unionByName, [read_native(spark, path, ids) for path in native])
    if ids is not None and not isinstance(ids, DataFrame) and not plain(index, "data.index"):
        return site_slices.read_slices(spark, folder, ids)
    rows = read_site_store(spark, f"{folder}/data.json")
    if isinstance(ids, DataFrame):
        return rows.join(ids.select("idx").distinct(), "idx", "left_semi")
    return rows if ids is None else rows.filter(F.col("idx").isin(*ids))


def read_prep_log(spark: SparkSession, folder: str) -> DataFrame:
    """(idx, n_reads, complete) of the ids that preparation has looked at."""
    return spark.read.schema("idx string, n_reads long, complete boolean").option("header", True).csv(commits.paths(spark, f"{folder}/data.log"))


def read_readcounts(spark: SparkSession, folder: str) -> DataFrame:
    """(idx, n_reads) of the prepared ids that have a usable read."""
    return spark.read.schema("idx string, n_reads long").option("header", True).csv(commits.paths(spark, f"{folder}/data.readcount"))


def read_samples(spark: SparkSession, design: dict[str, dict[str, str]], ids: Sequence[str] | None = None) -> DataFrame:
    """(condition, run, idx, position, kmer, norm_mean) of a design {condition: {run label: folder}}, of the given ids or all."""
    parts = [
        read_store(spark, folder, ids).select(F.lit(condition).alias("condition"), F.lit(run).alias("run"), "idx", "position", "kmer", F.explode("y").alias("norm_mean"))
        for condition, runs in design.items()
        for run, folder in runs.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_kmer_reference(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, ref_mean, ref_std) of a CSV with model_kmer, model_mean, model_stdv."""
    rows = spark.read.schema("model_kmer string, model_mean double, model_stdv double").option("header", True).csv(path)
    return rows.toDF("kmer", "ref_mean", "ref_std")


def read_result_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table; all columns but id, kmer and mod_assignment are numbers."""
    raw = spark.read.option("header", True).csv(commits.paths(spark, path))
    text = {"id", "kmer", "mod_assignment"}
    return raw.select(*[F.col(f"`{c}`") if c in text else F.col(f"`{c}`").cast("long" if c == "position" else "double").alias(c) for c in raw.columns])


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Saved models."""
    return spark.read.parquet(*commits.paths(spark, path))
