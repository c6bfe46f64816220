import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

from . import test_bpe, test_decontam, test_near_copies
from .cases import CLASHES, table, with_clashes

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def kept(spark, data, tmp_path_factory):
    """What each stage kept."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, data).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, data, kept):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert all(df.columns == columns for df in kept[:-1])


def test_good_documents_stay(spark, data, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    stay = {r.doc_id for r in kept[0].collect()}
    right = [(d in stay) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.97


def test_one_of_each_class_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    assert sorted(repr(r.doc_id) for r in kept[1].collect()) == test_near_copies.kept_by_brute_force(rows)


def test_benchmark_passages_are_gone_and_the_rest_is_as_it_was(spark, data, kept):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in kept[1].collect()}
    hits = {d: (n, h) for d, n, h, _ in test_decontam.brute(list(before.items()), items)}
    after = {r.doc_id: r.text for r in kept[2].collect()}
    for d, text in before.items():
        n, h = hits[repr(d)]
        assert (d in after) == (h <= 0.5 * n)
        if d in after:
            assert (after[d] == text) == (h == 0)


def test_personal_data_is_gone(kept):
    before = {r.doc_id: r.text for r in kept[2].collect()}
    after = {r.doc_id: r for r in kept[3].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        clean = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "", after[d].text)
        assert clean == after[d].text and after[d].n_chars == len(after[d].text)
        if "<" not in after[d].text:
            assert after[d].text == text


def test_tokens_and_run(spark, data, kept):
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    final = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept[4].collect()}
    assert final == {d: test_bpe.digests(t) for d, t in texts.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, data).collect()} == {d: v[1] for d, v in final.items()}


def test_stages_take_empty_tables_and_awkward_rows(spark, data):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table(spark, []), data).collect() == [], name
        kept = stage(spark, with_clashes(table(spark)), data)
        assert kept.columns == [*columns, *CLASHES], name
        assert {r["fp"] for r in kept.collect()} <= {CLASHES["fp"]}
    assert corpus_pipeline.tokens(spark, table(spark, []), data).collect() == []


def test_the_rest_does_without_this_subpackage(tmp_path):
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(ROOT), str(copy)], check=True)
    subprocess.run(["rm", "-rf", f"{copy}/quarrylens/llm", f"{copy}/tests/llm", f"{copy}/corpus_pipeline.py"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
