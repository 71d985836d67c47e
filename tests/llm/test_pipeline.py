import importlib.util
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sigspark.llm import language_id, mixing, near_dedup, quality

from .conftest import CLASHES
from .test_near_dedup import WORDS, brute

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns, name
        assert stage(spark, empty, folder).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).collect() == []


def test_decisions_take_effect(spark, odd, folder):
    stages = dict(corpus_pipeline.STAGES)
    rows = Counter(tuple(r) for r in odd.collect())
    kept = quality.judge(odd.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").select("doc_id").collect()
    got = stages["quality rules"](spark, odd, folder).collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in kept) and not Counter(tuple(r) for r in got) - rows
    got = stages["language ID"](spark, odd, folder).collect()
    model = language_id.fit(language_id.learnable(odd))
    kept = language_id.predict(odd.select("doc_id", "text"), model).filter("not rejected").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in kept) and not Counter(tuple(r) for r in got) - rows
    got = stages["near-dedup"](spark, odd, folder)
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    # Ids are distinct or null here, but for a repeated row; texts without words are groups of their own.
    alone = {(i, t) for i, t in texts if not WORDS.findall(t or "")}
    groups = {c for i, n, c in brute(texts) if n}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(alone | {(i, t) for i, t in texts if i in groups and (i, t) not in alone})
    assert not Counter(tuple(r) for r in got.collect()) - rows
    got = Counter((r[0], r[3]) for r in stages["mixing"](spark, odd, folder).collect())
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id, r.source] += r.times
    assert got == +want


def test_near_dedup_stage_links_from_four_fifths(spark, folder):
    """Of 100 shingles, 10 or 12 are changed: similarities of 90 / 110 and 88 / 112, below 0.85 and on both sides of 0.8."""
    base = [f"w{i}" for i in range(104)]
    changed = {n: " ".join(base[: 104 - n] + [f"n{n}x{i}" for i in range(n)]) for n in (10, 12)}
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed[10])], "doc_id long, text string")
    apart = spark.createDataFrame([(1, " ".join(base)), (2, changed[12])], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert [r.doc_id for r in stage(spark, docs, folder).collect()] == [1]
    assert sorted(r.doc_id for r in stage(spark, apart, folder).collect()) == [1, 2]


def test_run_equals_its_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in pieces.select(*key).collect()) == Counter(tuple(r) for r in docs.select(*key).collect())
    assert pieces.count() > 0


def test_operators_cover_the_ten():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_entry_works_without_this_part(tmp_path):
    """A copy without the optional folder and module imports and lists the other queries."""
    import shutil

    shutil.copytree(REPO / "sigspark", tmp_path / "sigspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("sigspark.llm")


def test_nothing_else_imports_this_part():
    for path in (REPO / "sigspark").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "sigspark").parts:
            assert "llm" not in path.read_text(), path
    assert CLASHES and near_dedup.K and F
