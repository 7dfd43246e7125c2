import numpy as np
import pyarrow as pa

from panelkit.llm import classifier, queries


def test_pooling_equals_plain_means(monkeypatch):
    monkeypatch.setattr(classifier, "BLOCK", 7)
    vectors = classifier.learn_vectors(["the cat sat on the mat", "a b c d"])
    texts = ["the cat", None, "", "a " * 50 + "b!", " \n", "x"]
    found = classifier.features(vectors, pa.array(texts))
    for k, t in enumerate(texts):
        piece = next(classifier.W.pieces(pa.array([t])))
        _, word, shape = classifier._buckets(piece)
        want = np.concatenate([vectors.words[word].mean(0), vectors.shapes[shape].mean(0)]) if len(word) else np.zeros(2 * classifier.DIMENSIONS)
        assert np.allclose(found[k][: 2 * classifier.DIMENSIONS], want, atol=1e-5)


def test_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(int)
    net = classifier.train(x, y, np.ones(3000))
    z = rng.normal(size=(3000, 6))
    p = net(z)
    assert np.abs(p - 1 / (1 + np.exp(-3 * z[:, 0]))).mean() < 0.12


def test_edges(spark, frame):
    rows = [(k, ("good words here " * 9) if k % 2 else "#### $$$$ !!!! " * 9) for k in range(200)] + [(900, None), (901, ""), (902, "good " * 200_000), (None, "x"), (5, "dup"), (5, "dup")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, None), (None, 1), (77777, 0), (4, 0)], "doc_id long, quality int")
    docs = frame(rows).withColumnRenamed("block", "score")
    got = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and set(got[0].asDict()) == {"doc_id", "text", "extra", "score"}
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 200 and r.text != "dup")
    none = classifier.fit(docs, labels.where("quality = 7"))
    assert {round(r.score, 3) for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(frame([]), none).count() == 0


def test_query(spark, sf_dir):
    got = queries.QUERIES["op10_quality_classifier"](spark, sf_dir).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    assert held and np.mean([a == b for a, b in held]) > 0.8
