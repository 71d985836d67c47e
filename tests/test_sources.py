import json

import pytest

from sigspark import cli
from sigspark.operators import prep
from sigspark.plans import dataprep
from sigspark.sources import config, readers, writers

HEADER = "contig\tposition\treference_kmer\tread_index\tstrand\tevent_index\tevent_level_mean\tevent_stdv\tevent_length\tmodel_kmer\tmodel_mean\tmodel_stdv\tstandardized_level\tstart_idx\tend_idx\n"


def event(contig, position, kmer, read, level, start=0, end=10):
    return f"{contig}\t{position}\t{kmer}\t{read}\tt\t1\t{level}\t1.5\t0.003\t{kmer}\t100.0\t2.0\t0.1\t{start}\t{end}\n"


SEQUENCE = "ACGTACGTACGTACGTACGT"


def write_events(path, level=100.0, reads=20, contig="T1.1"):
    lines = [event(contig, p, SEQUENCE[p : p + 5], r, level + r % 3) for r in range(reads) for p in (2, 3, 4)]
    path.write_text(HEADER + "".join(lines))


def test_annotation_and_fasta(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#c\nchr1\tx\ttranscript\t100\t119\t.\t+\t.\tgene_id "G1.3"; transcript_id "T1.1";\nchr1\tx\texon\t100\t119\t.\t+\t.\tgene_id "G1.3"; transcript_id "T1.1"; exon_number 1;\n')
    gff = tmp_path / "a.gff"
    gff.write_text("#c\nchr1\tx\tmRNA\t100\t119\t.\t+\t.\tID=transcript:T1;Parent=gene:G1\nchr1\tx\texon\t100\t119\t.\t+\t.\tParent=transcript:T1\n")
    fa = tmp_path / "t.fa"
    fa.write_text(f">T1.1 cdna gene:G1.3 rest\n{SEQUENCE[:10]}\n{SEQUENCE[10:]}\n>T2.1|G2.1|x\nAC\n")
    odd = tmp_path / "odd.fa"
    odd.write_text("\n>T1.1 c.12A>G gene:G1.3 x>y\r\nAC\r\nGT\r\n>T2.1\nAA\n")
    assert {tuple(r) for r in readers.read_fasta(spark, str(odd)).collect()} == {("T1", "ACGT", "G1"), ("T2", "AA", None)}
    fasta = readers.read_fasta(spark, str(fa))
    assert {tuple(r) for r in fasta.select("tx_id", "seq", "gene_id").collect()} == {("T1", SEQUENCE, "G1"), ("T2", "AC", "G2")}
    assert (readers.annotation_dialect(spark, str(gtf)), readers.annotation_dialect(spark, str(gff))) == ("gtf", "gff")
    for path in (gtf, gff):
        assert [tuple(r) for r in readers.read_annotation(spark, str(path), fasta).collect()] == [("T1", "G1", "chr1", "+", 100, 119)]


def test_transcript_and_genome_sites(spark, tmp_path):
    write_events(tmp_path / "e.tsv")
    events = readers.read_events(spark, str(tmp_path / "e.tsv"))
    made = dataprep.transcript_sites(events)
    assert {(r.position, r.kmer, len(r.y)) for r in made.sites.collect()} == {(p + 2, SEQUENCE[p : p + 5], 20) for p in (2, 3, 4)}
    assert [tuple(r) for r in made.counts.collect()] == [("T1.1", 20)]
    assert dataprep.transcript_sites(events, most=4).counts.first().n_reads == 5
    assert dataprep.transcript_sites(events, least=21).counts.count() == 0
    exons = spark.createDataFrame([("T1", "G1", "chr1", "+", 100, 119)], "tx_id string, gene_id string, chr string, strand string, g_start long, g_end long")
    fasta = spark.createDataFrame([("T1", SEQUENCE, "G1")], "tx_id string, seq string, gene_id string")
    genes = dataprep.genome_sites(events, exons, fasta)
    assert {(r.idx, r.position, r.kmer) for r in genes.sites.collect()} == {("G1", 100 + p + 2, SEQUENCE[p : p + 5]) for p in (2, 3, 4)}


def test_site_store_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("a", 5, "ACGTA", [1.5, 2.0]), ("a", 12, "CCCCC", [3.0]), ("b", 1, "GGGGG", [])], "idx string, position long, kmer string, y array<double>")
    writers.write_site_store(sites, str(tmp_path))
    lines = [json.loads(x) for p in (tmp_path / "data.json").glob("part-*") for x in p.read_text().splitlines()]
    assert {"a": {"5": {"ACGTA": [1.5, 2.0]}, "12": {"CCCCC": [3.0]}}} in lines
    assert sorted(map(tuple, readers.read_site_store(spark, f"{tmp_path}/data.json").collect())) == sorted(map(tuple, sites.collect()))
    writers.write_sites_parquet(sites, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sites").count() == 3


def test_config():
    spec = {"data": {"KO": {"r1": "p"}, "WT": {"r1": "q", "r2": "s"}}, "out": "o", "method": {"prefiltering": {"method": "t-test", "threshold": 0.2}}, "criteria": {"readcount_min": 3}}
    design = config.parse(spec)
    assert design.runs == {"KO": ["KO-r1"], "WT": ["WT-r1", "WT-r2"]} and design.criteria == config.Criteria(3, 1000)
    assert design.method.prefilter == "t-test" and design.method.threshold == 0.2 and not design.method.pooling
    for bad in ({}, {"data": {"A": {}}, "out": "o"}, spec | {"priors": {}}, spec | {"method": {"max_iters": 1}}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_command_line_end_to_end(spark, tmp_path):
    for name, level in (("ko", 100.0), ("wt", 110.0)):
        write_events(tmp_path / f"{name}.tsv", level)
        cli.main(["prep", "--events", str(tmp_path / f"{name}.tsv"), "--out", str(tmp_path / name)], spark)
    (tmp_path / "ref.csv").write_text("model_kmer,model_mean,model_stdv\n" + "".join(f"{SEQUENCE[p:p + 5]},101.0,2.0\n" for p in range(4)) + "GTACG,101.0,2.0\n")
    (tmp_path / "c.yml").write_text(f"data:\n  KO: {{r: {tmp_path}/ko}}\n  WT: {{r: {tmp_path}/wt}}\nout: {tmp_path}/out\nprior: {tmp_path}/ref.csv\n")
    cli.main(["diff", "--config", str(tmp_path / "c.yml"), "--save-models"], spark)
    table = readers.read_result_table(spark, f"{tmp_path}/out/diffmod.table")
    n = table.count()
    assert n == 3 and readers.read_models(spark, f"{tmp_path}/out/models").count() == 3
    cli.main(["diff", "--config", str(tmp_path / "c.yml"), "--resume"], spark)
    assert readers.read_result_table(spark, f"{tmp_path}/out/diffmod.table").count() == n
    finished = writers.completed_ids(spark, f"{tmp_path}/out/diffmod.log", "idx")
    assert [r[0] for r in finished.collect()] == ["T1.1"]
    (tmp_path / "strict.yml").write_text((tmp_path / "c.yml").read_text().replace("/out", "/none") + "criteria: {readcount_min: 500}\n")
    for more in ([], ["--resume"]):  # an id without a site left is finished too
        cli.main(["diff", "--config", str(tmp_path / "strict.yml"), *more], spark)
        assert [r[0] for r in writers.completed_ids(spark, f"{tmp_path}/none/diffmod.log", "idx").collect()] == ["T1.1"]
    cli.main(["prep", "--events", str(tmp_path / "ko.tsv"), "--out", str(tmp_path / "ko"), "--resume"], spark)
    assert readers.read_site_store(spark, f"{tmp_path}/ko/data.json").count() == 3
    cli.main(["post", "--dir", f"{tmp_path}/out"], spark)
    assert readers.read_result_table(spark, f"{tmp_path}/out/majority_direction_kmer_diffmod.table").count() == 3
    assert prep.strip_version("x") is not None
    with pytest.raises(SystemExit):
        cli.main(["prep", "--events", "e", "--out", "o", "--genome"], spark)
