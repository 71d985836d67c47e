"""Command line: prep, diff, post."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

import sigspark
from sigspark.operators import align, post, prep
from sigspark.operators.prep import skip_done
from sigspark.operators.result import result_table
from sigspark.plans import dataprep, diffmod
from sigspark.sources import config, readers, writers
from sigspark.sources.commits import Commit


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigspark")
    top.add_argument("-v", "--version", action="version", version=sigspark.__version__)
    commands = top.add_subparsers(dest="command", required=True)
    made = commands.add_parser("prep", help="events to sites")
    made.add_argument("--events", required=True)
    made.add_argument("--out", required=True)
    made.add_argument("--annotation", help="GTF or GFF3")
    made.add_argument("--fasta")
    made.add_argument("--genome", action="store_true", help="genome coordinates; needs --annotation and --fasta")
    made.add_argument("--readcount-min", type=int, default=1)
    made.add_argument("--readcount-max", type=int, default=1000)
    made.add_argument("--native", action="store_true", help="write the native store too")
    made.add_argument("--resume", action="store_true")
    diff = commands.add_parser("diff", help="sites to the result table")
    diff.add_argument("--config", required=True)
    diff.add_argument("--ids", nargs="+")
    diff.add_argument("--save-models", action="store_true")
    diff.add_argument("--refit", metavar="FOLDER", help="folder of an earlier result whose saved models to start from")
    diff.add_argument("--resume", action="store_true")
    after = commands.add_parser("post", help="majority direction of the result table")
    after.add_argument("--dir", required=True)
    return top


def run_prep(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.genome and not (args.annotation and args.fasta):
        raise SystemExit("--genome needs --annotation and --fasta")
    commit = Commit(spark, args.out, args.resume)
    done = writers.completed_ids(spark, f"{args.out}/data.log", "idx") if args.resume else None
    # The one pass over the events.
    combined = commit.staged(prep.combine_reads(readers.read_events(spark, args.events, placed=True)), "combined")
    try:
        if args.genome:
            fasta = readers.read_fasta(spark, args.fasta)
            made = dataprep.genes_of(combined, readers.read_annotation(spark, args.annotation, fasta, placed=True), fasta, args.readcount_min, args.readcount_max, done)
        else:
            made = dataprep.transcripts_of(combined, args.readcount_min, args.readcount_max, done)
        totals = writers.write_prepared(commit, made, args.native)
        commit.finish()
    finally:
        commit.close()
    print(f"{totals['ids']} ids in {args.out}, {totals['cut_short']} cut short, {totals['reads']} reads")


def run_diff(spark: SparkSession, args: argparse.Namespace) -> None:
    design = config.load(args.config)
    commit = Commit(spark, design.out, args.resume)
    done = writers.completed_ids(spark, f"{design.out}/diffmod.log", "idx") if args.resume else None
    rows = readers.read_samples(spark, design.data, args.ids)
    # Without a table of 5-mers the samples' own signal stands for it: of all ids, whichever are asked for.
    samples = rows if args.ids is None else readers.read_samples(spark, design.data)
    reference = readers.read_kmer_reference(spark, design.prior) if design.prior else commit.staged(align.own_reference(samples), "reference")
    try:
        fits = diffmod.fit(rows, reference, design.runs, design.criteria, design.method, args.ids, done, readers.read_models(spark, f"{args.refit}/models") if args.refit else None)
        if args.save_models:
            # The table is made from the models that were written, so that nothing is fitted twice.
            writers.write_models(fits, commit.path("models"))
            fits = spark.read.parquet(commit.path("models"))
        writers.write_result_table(result_table(fits, design.runs, design.method.pooling, design.method.prefilter), commit.path("diffmod.table"))
        # Every id that was looked at is finished, whether or not a site of it passed the filters.
        total = writers.write_status(rows if done is None else skip_done(rows, done), commit.path("diffmod.log"))
        commit.finish()
    finally:
        commit.close()
    print(f"{total} ids in {design.out}")


def run_post(spark: SparkSession, args: argparse.Namespace) -> None:
    try:
        table = readers.read_result_table(spark, f"{args.dir}/diffmod.table")
    except AnalysisException as error:
        raise SystemExit(f"no result table in {args.dir}") from error
    writers.write_result_table(post.filter_majority(table), f"{args.dir}/majority_direction_kmer_diffmod.table")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("sigspark").getOrCreate()
    {"prep": run_prep, "diff": run_diff, "post": run_post}[args.command](session, args)


if __name__ == "__main__":
    main()
