import numpy as np
import pyarrow as pa

from panelkit.llm import language, queries, sampling, words

SPEECH = {"aa": "banana kala mata rasa ", "bb": "tokyo moho posto molo ", "cc": "ßüß öä ßöt äü "}


def small_model():
    texts, labels = [], []
    for k in range(400):
        lang = sorted(SPEECH)[k % 3]
        own = SPEECH[lang].split()
        rng = np.random.default_rng(k)
        texts.append(" ".join(rng.choice(own, rng.integers(1, 40))))
        labels.append(lang)
    return language.train(texts, labels)


def test_tables_equal_plain_convolution():
    model = small_model()
    column = pa.array(["banana", "", None, "äü" * 300, "x"])
    piece = next(words.pieces(column))
    window, text, used = language._windows(piece)
    assert list(text) == [0, 3, 3, 3, 3, 3, 4] and used.sum() == len(piece.data)
    pooled = np.concatenate([language._answers(model.filters[w], window).max(1) for w in language.WIDTHS], 1)
    want = np.maximum(pooled + model.bias, 0) @ model.weights + model.offset
    assert np.allclose(language.Predictor(model).logits(window), want, atol=1e-4)


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, SPEECH["aa"] * 50_000), (5, SPEECH["cc"]), (5, SPEECH["cc"]), (None, SPEECH["bb"])]
    got = language.identify(frame(rows).withColumnRenamed("block", "score"), small_model()).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "extra", "lang_pred", "score"}
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=str) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "cc"), (5, "cc"), (None, "bb")], key=str)
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 for r in got)
    assert language.identify(frame([]), small_model()).count() == 0


def test_no_labels(spark, frame):
    docs = frame([(1, "abc")]).withColumnRenamed("block", "lang")
    assert language.fit(docs.where("doc_id > 1")).languages == []
    assert [tuple(r) for r in language.identify(docs, language.fit(docs.where("doc_id > 1"))).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert [r.lang_pred for r in language.identify(docs, language.fit(docs)).collect()] == ["x"]


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'b', 'a') AS label")
    found = {r.label: r["count"] for r in sampling.labelled_sample(rows, "id", "label", 100, 1).groupBy("label").count().collect()}
    assert sum(found.values()) <= 200 and min(found.values()) > 60


def test_query_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(docs)
    held = [r for r in got if r.held_out]
    assert 0.1 * len(got) < len(held) < 0.35 * len(got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
