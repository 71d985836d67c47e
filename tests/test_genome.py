"""Genome mode against a brute-force walk over reads, exons and bases."""

import random

from sigspark.operators import prep
from sigspark.plans import dataprep

EVENTS = "contig string, position long, reference_kmer string, read_index long, event_level_mean double, model_kmer string, start_idx long, end_idx long"


def brute(events, exons, seqs, least, most):
    genes, maps = {}, {}
    for tx, gene, strand, lo, hi in exons:
        genes.setdefault(gene, set()).add(tx)
        maps.setdefault(tx, []).append((strand, lo, hi))
    place = {}
    for tx, own in maps.items():
        own.sort(key=lambda e: e[1], reverse=own[0][0] == "-")
        at = 0
        for strand, lo, hi in own:
            for k in range(hi - lo + 1):
                g = hi - k if strand == "-" else lo + k
                near = g - lo < 2 or hi - g < 2
                place[tx, at + k] = g, "XXXXX" if near else seqs[tx][at + k - 2 : at + k + 3]
            at += hi - lo + 1
    sums = {}
    seen = {}
    for contig, pos, kmer, read, level, model, a, b in events:
        tx = contig.split(".")[0]
        seen.setdefault(tx, set()).add((read, contig))
        if kmer == model:
            s = sums.setdefault((contig, read), {}).setdefault((pos, kmer), [0.0, 0])
            s[0] += level * (b - a)
            s[1] += b - a
    out = {}
    for gene, txs in genes.items():
        reads = [(tx, r, c) for tx in sorted(txs) for r, c in sorted(seen.get(tx, ()))]
        if len(reads) < least:
            continue
        last = {}
        for tx, r, contig in reads[: most + 1]:
            if len(sums.get((contig, r), ())) > 1:
                last[r] = tx, contig
        if len(last) < least:
            continue
        sites = {}
        for r, (tx, contig) in last.items():
            for (pos, _), (s, n) in sums[contig, r].items():
                if (tx, pos + 2) in place:
                    g, kmer = place[tx, pos + 2]
                    if kmer != "XXXXX":
                        sites.setdefault(g, {}).setdefault(kmer, []).append(float(f"{s / n:.1f}") if n else None)
        for g in sorted(sites):
            if len(sites[g]) > 1 or "N" in next(iter(sites[g])):
                break
            for kmer, y in sites[g].items():
                out[gene, g, kmer] = sorted(y)
    return out


def test_genome_sites(spark):
    """T5's and T6's exons overlap: a base that two exons hold has a place in the transcript for each, and the reads at both are its reads."""
    rng = random.Random(8)
    exons = [("T1", "G1", "+", 100, 119), ("T1", "G1", "+", 200, 214), ("T2", "G1", "+", 200, 230), ("T3", "G2", "-", 500, 520), ("T3", "G2", "-", 540, 555), ("T4", "G3", "+", 900, 930), ("T5", "G4", "+", 700, 719), ("T5", "G4", "+", 712, 730), ("T6", "G5", "-", 750, 765), ("T6", "G5", "-", 760, 780)]
    genome = {g: rng.choice("ACGT") for g in range(100, 1000)}
    seqs = {}
    for tx in ("T1", "T2", "T3", "T4", "T5", "T6"):
        own = sorted((e for e in exons if e[0] == tx), key=lambda e: e[3], reverse=tx in ("T3", "T6"))
        seqs[tx] = "".join(genome[g] for _, _, strand, lo, hi in own for g in (range(hi, lo - 1, -1) if strand == "-" else range(lo, hi + 1)))
    seqs["T4"] = seqs["T4"][:15] + "N" + seqs["T4"][16:]
    events = []
    for tx, n in (("T1", 30), ("T2", 25), ("T3", 12), ("T4", 9), ("T5", 12), ("T6", 15)):
        for r in range(n):
            for p in rng.sample(range(0, len(seqs[tx]) - 4), rng.randint(1, 12)):
                kmer = seqs[tx][p : p + 5]
                for _ in range(rng.randint(1, 2)):
                    events.append((f"{tx}.1", p, kmer, r, 64.0 + rng.randint(0, 40) / 4, kmer if rng.random() < 0.9 else "NNNNN", 0, 8))
    frame = spark.createDataFrame(events, EVENTS)
    annotation = spark.createDataFrame([(t, g, "c", s, a, b) for t, g, s, a, b in exons], "tx_id string, gene_id string, chr string, strand string, g_start long, g_end long")
    fasta = spark.createDataFrame([(t, s, None) for t, s in seqs.items()], "tx_id string, seq string, gene_id string")
    for least, most in ((1, 1000), (10, 40), (40, 1000)):
        made = dataprep.genome_sites(frame, annotation, fasta, least, most)
        got = {(r.idx, r.position, r.kmer): r.y for r in made.sites.collect()}
        assert got == brute(events, exons, seqs, least, most)
    assert prep.complete_ids(spark.createDataFrame([("a", 1, "ANA"), ("b", 1, "XXXXX"), ("b", 1, "AAA")], "idx string, position long, kmer string")).filter("complete").first().idx == "b"
