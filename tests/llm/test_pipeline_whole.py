"""The pipeline over a whole table, each stage's rows against a plain statement of what it must keep."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sigspark.llm.queries import vocabulary

from .test_near_dedup import shingles
from .test_quality_language import base

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Rows into the first stage and out of each."""
    at, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out


def test_quality_rejects_what_fails_the_base_rules_and_keeps_trusted_documents(spark, sf_dir, steps):
    kept = {r.doc_id for r in steps[1]}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in steps[0]:
        n_words, _, _, _, repeated = base(r.text)[:5]
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        assert not (failed and r.doc_id in kept)
        if labels.get(r.doc_id) == (1, 0) and not failed:
            assert r.doc_id in kept
    assert not Counter(map(tuple, steps[1])) - Counter(map(tuple, steps[0]))


def test_language_keeps_nearly_all_of_clean_prose(steps):
    assert not Counter(map(tuple, steps[2])) - Counter(map(tuple, steps[1]))
    assert len(steps[2]) >= 0.98 * len(steps[1])


def test_near_dedup_keeps_one_of_each_component(steps):
    rows = sorted({tuple(r) for r in steps[2]}, key=lambda r: r[0])
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    first = {}
    for k in range(len(rows)):  # rows are in the order of their ids
        first.setdefault(find(k) if sets[k] else ("alone", k), rows[k])
    assert Counter(map(tuple, steps[3])) == Counter(first.values())


def test_mixing_reaches_its_targets(steps):
    rows, taken = steps[3], Counter(map(tuple, steps[4]))
    size = lambda t: len(WORD.findall(t or ""))
    held, got, lengths = Counter(), Counter(), defaultdict(set)
    for r in rows:
        held[r.source] += size(r.text)
        lengths[r.source].add(size(r.text))
    for row, n in taken.items():
        assert n <= 2
        got[row[3]] += n * size(row[1])
    assert not set(taken) - {tuple(r) for r in rows}
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(held.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * held[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * held[s]
            left -= 2 * held[s]
        free = [s for s in free if s not in target]
    for s in order:
        assert abs(got[s] - target[s]) <= max(lengths[s], default=0)


def test_packing_holds_every_id_once(steps):
    library = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in steps[4]:
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in steps[5]:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in steps[4]}
    for r in steps[5]:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
