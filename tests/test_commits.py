"""Outputs that are committed together, slices by index, and orders of lines."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sigspark import cli
from sigspark.plans import dataprep
from sigspark.sources import commits, readers, site_slices, writers
from sigspark.sources.commits import Commit
from sigspark.sources.lines import line_spans, place
from tests.test_sources import HEADER, SEQUENCE, event, write_events


def stored(folder, name):
    """The job's files of an output that a manifest names."""
    manifest = json.loads(max((folder / "_commits").glob("0*")).read_text())
    return [p for job in manifest[name] for p in sorted((folder / name / f"run={job}").glob("part-*"))]


def lines_of(folder):
    return [json.loads(x) for p in stored(folder, "data.json") for x in p.read_text().splitlines()]


def test_line_spans_over_many_splits(spark, tmp_path):
    texts = {"a": "".join(f"línea {i} {'x' * (i % 50)}\n" for i in range(3000)), "b": "one\n\n  two", "c": "", "d": "\n" * 10}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = line_spans(spark, str(tmp_path), text=F.col("value")).collect()
        order = spark.read.text(str(tmp_path)).select(place().alias("p"), "value").orderBy("p").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(rows) == 3000 + 3 + 10
    for r in rows:
        data = open(r.file.removeprefix("file:"), "rb").read() if r.file.startswith("file:/") else None
        assert data[r.start : r.end].decode().removesuffix("\n") == r.text
    assert [r.value for r in order] == [x for t in texts.values() for x in t.removesuffix("\n").split("\n") if t]


def test_compressed_lines_have_no_spans(spark, tmp_path):
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write("abc\n" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        line_spans(spark, str(tmp_path))


def test_slices_read_only_the_wanted_lines(spark, tmp_path):
    names = [f"id{i}" for i in range(40)] + ['q"\\uote,d', "é\nx", "a b"]
    sites = spark.createDataFrame([(n, p, "ACGTA", [float(len(n)), 1.5] * (k % 7)) for k, n in enumerate(names) for p in range(k % 5 + 1)], "idx string, position long, kmer string, y array<double>").repartition(5)
    writers.write_site_store(sites, str(tmp_path))
    site_slices.write_index(spark, f"{tmp_path}/data.json", f"{tmp_path}/data.index")
    whole = sorted(map(tuple, readers.read_site_store(spark, f"{tmp_path}/data.json").collect()))
    assert sorted(map(tuple, site_slices.read_slices(spark, str(tmp_path)).collect())) == whole
    ids = ["id3", "id17", 'q"\\uote,d', "é\nx", "missing"]
    chosen = site_slices.read_slices(spark, str(tmp_path), ids)
    assert sorted(map(tuple, chosen.collect())) == [r for r in whole if r[0] in ids]
    assert sorted(map(tuple, site_slices.read_slices(spark, str(tmp_path)).filter("idx = 'id5' and position > 0").collect())) == [r for r in whole if r[0] == "id5" and r[1] > 0]
    # The bytes of these ids' lines and no others are planned, and what reading them takes is those bytes.
    lines = {next(iter(json.loads(x))): len(x.encode()) + 1 for p in (tmp_path / "data.json").glob("part-*") for x in p.read_text().split("\n") if x}
    wanted = sum(n for name, n in lines.items() if name in ids)
    index = [f"{tmp_path}/data.index"]
    assert site_slices.planned_bytes(index, ids) == wanted < site_slices.planned_bytes(index) == sum(lines.values())
    reader = site_slices.SliceReader({"indexes": json.dumps(index)})
    reader.ids = set(ids)
    assert {r["idx"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()} <= set(ids)
    assert site_slices.read_slices(spark, str(tmp_path), ["missing"]).count() == 0


def test_a_job_that_dies_between_sinks_leaves_nothing(spark, tmp_path, monkeypatch):
    write_events(tmp_path / "e.tsv", contig="T1.1")
    (tmp_path / "more.tsv").write_text((tmp_path / "e.tsv").read_text() + "".join(event("T2.1", p, SEQUENCE[p : p + 5], r, 90.0) for r in range(4) for p in (2, 3)))
    out = tmp_path / "out"
    prep = lambda events, *more: cli.main(["prep", "--events", str(tmp_path / events), "--out", str(out), *more], spark)
    prep("e.tsv")
    assert [next(iter(x)) for x in lines_of(out)] == ["T1.1"]
    for broken in ("write_index", "index_of"):
        with monkeypatch.context() as m:
            m.setattr(site_slices, broken, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                prep("more.tsv", "--resume")
        assert [next(iter(x)) for x in lines_of(out)] == ["T1.1"]
        assert readers.read_site_store(spark, f"{out}/data.json").select("idx").distinct().count() == 1
    with monkeypatch.context() as m:  # after every sink, before the manifest
        m.setattr(Commit, "finish", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            prep("more.tsv", "--resume")
    prep("more.tsv", "--resume")
    prep("more.tsv", "--resume")
    assert sorted(next(iter(x)) for x in lines_of(out)) == ["T1.1", "T2.1"]
    assert sorted(map(tuple, readers.read_prep_log(spark, str(out)).collect())) == [("T1.1", 20, True), ("T2.1", 4, True)]
    counts = spark.read.option("header", True).csv(commits.paths(spark, f"{out}/data.readcount"))
    assert sorted((r.idx, int(r.n_reads)) for r in counts.collect()) == [("T1.1", 20), ("T2.1", 4)]
    assert sorted({r.idx for r in readers.read_store(spark, str(out), ["T2.1"]).collect()}) == ["T2.1"]
    assert not os.path.exists(out / "_staging") or not os.listdir(out / "_staging")
    prep("e.tsv")  # anew
    assert [next(iter(x)) for x in lines_of(out)] == ["T1.1"]
    assert len(os.listdir(out / "data.json")) <= 1 + 4  # what died stays unread


def test_two_jobs_at_once(spark, tmp_path):
    one, other = Commit(spark, str(tmp_path)), Commit(spark, str(tmp_path), append=True)
    for job in (one, other):
        spark.range(2).write.parquet(job.path("x"))
    one.finish()
    other.finish()
    assert spark.read.parquet(*commits.paths(spark, f"{tmp_path}/x")).count() == 4
    racing = Commit(spark, str(tmp_path))
    spark.range(1).write.parquet(racing.path("x"))
    taken = tmp_path / "_commits" / "00000003"
    newest = commits._newest
    commits._newest, _ = (lambda s, f: (2, newest(s, f)[1])), taken.write_text(json.dumps({"x": ["q"]}))
    try:
        with pytest.raises(RuntimeError, match="another job"):
            racing.finish()
    finally:
        commits._newest = newest


def test_log_tells_ids_without_usable_reads_and_cut_ones(spark, tmp_path):
    lines = [event("T1", p, SEQUENCE[p : p + 5], r, 90.0) for r in range(3) for p in (2, 3)]
    lines += [event("T2", 2, "ACGTA", r, 90.0) for r in range(3)]  # one position only
    lines += [event("T3", p, "ACGTA" if r else "CCCCC", r, 90.0) for r in range(3) for p in (2, 3)]  # two 5-mers at a position
    (tmp_path / "e.tsv").write_text(HEADER + "".join(lines))
    cli.main(["prep", "--events", str(tmp_path / "e.tsv"), "--out", f"{tmp_path}/o"], spark)
    assert sorted(map(tuple, readers.read_prep_log(spark, f"{tmp_path}/o").collect())) == [("T1", 3, True), ("T2", 0, True), ("T3", 3, False)]
    cli.main(["prep", "--events", str(tmp_path / "e.tsv"), "--out", f"{tmp_path}/o", "--resume"], spark)
    assert readers.read_prep_log(spark, f"{tmp_path}/o").count() == 3  # nothing is done twice


def test_events_are_scanned_once(spark, tmp_path, monkeypatch):
    write_events(tmp_path / "e.tsv")
    read = []
    monkeypatch.setattr(readers, "read_events", lambda s, path, placed=False, f=readers.read_events: (read.append(1), f(s, path, placed).filter(F.assert_true(F.lit(True)).isNull()))[1])
    seen = spark.sparkContext.accumulator(0)
    real = cli.prep.combine_reads

    def counted(events):
        schema = events.schema
        return real(events.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), schema))

    monkeypatch.setattr(cli.prep, "combine_reads", counted)
    cli.main(["prep", "--events", str(tmp_path / "e.tsv"), "--out", f"{tmp_path}/o"], spark)
    assert len(read) == 1 and seen.value == 60


GTF = '{chr}\tx\t{kind}\t{a}\t{b}\t.\t+\t.\tgene_id "G1"; transcript_id "{tx}";\n'


def test_cap_and_last_transcript_go_by_the_annotations_lines(spark, tmp_path):
    """T9 stands before T1 in the annotation; reads stand in the events in falling order."""
    (tmp_path / "a.gtf").write_text("#c\n" + "".join(GTF.format(chr="c", kind=k, a=a, b=a + 19, tx=tx) for tx, a in (("T9", 500), ("T1", 100)) for k in ("transcript", "exon")))
    (tmp_path / "f.fa").write_text(f">T1\n{SEQUENCE}\n>T9\n{SEQUENCE}\n")
    lines = [event(tx, p, SEQUENCE[p : p + 5], r, 90.0 + r) for tx in ("T1", "T9") for r in range(9, -1, -1) for p in (3, 4)]
    (tmp_path / "e.tsv").write_text(HEADER + "".join(lines))
    fasta = readers.read_fasta(spark, str(tmp_path / "f.fa"))
    exons = readers.read_annotation(spark, str(tmp_path / "a.gtf"), fasta, placed=True)
    events = readers.read_events(spark, str(tmp_path / "e.tsv"), placed=True)
    # Thirteen reads: all ten of T9, then 9, 8 and 7 of T1, which win them.
    got = {r.position: r.y for r in dataprep.genome_sites(events, exons, fasta, 1, 12).sites.collect()}
    assert got == {g: y for low, y in ((100, [97.0, 98.0, 99.0]), (500, [90.0 + r for r in range(7)])) for g, y in ((low + 5, y), (low + 6, y))}
    # Without lines' places: ids in order, reads by number.
    plain = dataprep.genome_sites(events.drop("place"), exons.drop("place"), fasta, 1, 12).sites.collect()
    assert {r.position: r.y for r in plain}[105] == [90.0 + r for r in range(3, 10)]
    # One transcript: the first reads by line are the highest numbers here.
    counts = dataprep.transcript_sites(events, 1, 2).observed.filter("idx = 'T1'").select("read_index").distinct().collect()
    assert {r[0] for r in counts} == {9, 8, 7}
