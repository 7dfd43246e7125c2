from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.test_bpe import library
from tests.llm.test_minhash import brute as classes
from tests.llm.test_substrings import brute as windows


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_registration(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in entry.queries()}


def test_language_stage_keeps_clean_documents(stages):
    assert stages[1].count() >= 0.98 * stages[0].count()


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert Counter(r.doc_id for r in stages[2].collect()) == Counter(set(classes(rows).values()))


def test_repeated_passages_are_cut(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i: (t if not gone else kept) for (i, _, gone, kept), (j, t) in zip(windows(before), sorted(before, key=lambda r: str(r[0]))) if i == j}
    got = {r.doc_id: r.text for r in stages[3].collect()}
    assert got.keys() == {i for i, _ in before} and all(got[i] == t for i, t in want.items()) and len(want) > 0.9 * len(got)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mixture_repeats_documents(stages):
    size = {r.doc_id: len(r.text.split()) for r in stages[3].collect()}
    words, times = Counter(), Counter()
    for r in stages[4].collect():
        words[r.doc_id] += len(r.text.split())
        times[r.doc_id] += 1
    assert all(words[i] <= 3 * size[i] for i in words) and max(times.values()) > 1
    assert sum(words.values()) == pytest.approx(sum(size.values()), rel=0.02)


def test_tokens_equal_the_library(stages):
    rows = stages[4].collect()
    want = Counter((r.doc_id, n, ids) for r, (n, ids, _) in zip(rows, library([r.text for r in rows])))
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in stages[5].collect()) == want


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_odd_rows_pass_every_stage(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, "no id at all", "en", "a", None), (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 14),
            (3, "same text here", "en", "a", 14), (4, "wort " * 30_000, "de", None, 150_000), (5, "palabra otra más", None, "b", 16)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id for r in docs.collect()} <= {None, 3, 4, 5}


def test_tables_of_finished_stages_go(spark, sf_dir):
    """Only what the last stage gave is left in the work folder; tables that others wrote there stay."""
    from pathlib import Path

    from panelkit import session

    folder = lambda: set(Path(session.work_folder(spark).removeprefix("file://"), "panelkit", spark.sparkContext.applicationId).iterdir())
    other = session.materialise(spark.range(3), "other")
    before = folder()
    found = pipeline.run(spark, sf_dir)
    left = folder() - before
    assert len(left) == 1 and left.pop().name.startswith("pipeline-bpe") and before <= folder()
    assert found.count() > 0 and other.count() == 3
