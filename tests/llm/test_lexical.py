import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def scores(docs, text):
    """Every document's score, by the definition; (place, score) of those above 0."""
    bags = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    some, every = sum(n > 0 for n in sizes), sum(sizes)
    out = Counter()
    for term in terms(text):
        df = sum(term in b for b in bags)
        for k, bag in enumerate(bags):
            if term in bag:
                w = math.floor(1000 * math.log((2 * some + 2) / (2 * df + 1)))
                m = 75 + 25 * sizes[k] * some // every
                out[k] += w * (1_000_000_000 * bag[term] // (1000 * bag[term] + 12 * m))
    return {k: s for k, s in out.items() if s > 0}


def brute(docs, items, top):
    out = []
    for item, text in items:
        best = sorted((-s, docs[k][0] is None, docs[k][0] or 0) for k, s in scores(docs, text).items())[:top]
        out += [(item, n, None if missing else doc, -s) for n, (s, missing, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def rows(found):
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    stock = [f"w{k}" for k in range(40)] + ["Été", "été", "x1", "O'Neil", "ΑΒ"]
    made = lambda n: " ".join(rng.choice(stock[: rng.choice([4, 12, 45])]) for _ in range(n))
    docs = [(k, made(rng.choice([0, 1, 3, 20, 60]))) for k in range(400)]
    docs += [(500 + k, "w1 w2 w3 same") for k in range(60)] + [(7, "w5 w6"), (7, "w5 w6"), (None, "w5 w6 w7"), (900, None), (901, ""), (902, "., !"), (903, "w0 " * 30_000)]
    rng.shuffle(docs)
    items = [(k, made(rng.randint(1, 12))) for k in range(25)]
    items += [(30, None), (31, ""), (32, "--"), (33, "absent words"), (34, "same same W1"), (35, "w0 W0 w0"), (None, "w5"), (36, "w5"), (36, "w5"), (37, " ".join(stock) * 3)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"BLOCK_POSTINGS": 200, "ITEM_BYTES": 300, "DEPTH": 1, "PARTS": 3}])
@pytest.mark.parametrize("top", [20, 3])
def test_equals_brute_force(frame, spark, corpus, monkeypatch, limits, top):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical.rank_documents(frame(docs).withColumnRenamed("block", "rank").repartition(5), asked, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute(docs, items, top)


def test_stops_before_the_end_of_the_lists():
    """Documents looked up, and the same best ones as by adding up everything."""
    rng = np.random.default_rng(3)
    doc, term = np.divmod(rng.choice(20_000 * 5, 40_000, replace=False), 5)
    block = lexical.Block(doc, term, rng.pareto(1.0, 40_000).astype(np.int64) + 1, 20_000, 5)
    weight = np.array([5, 3, 2, 1, 1])
    found, got = block.best(np.arange(5), weight, 20, np.zeros(0, np.int64))
    want = np.zeros(20_000, np.int64)
    np.add.at(want, block.doc, weight[np.repeat(np.arange(5), np.diff(block.starts))] * block.impact)
    assert sorted(got)[-20:] == sorted(want)[-20:] and (want[found] == got).all()
    assert block.reads < 2_000
    none, _ = block.best(np.arange(5), weight, 20, np.full(20, want.max() * 10))
    assert len(none) <= 5 * lexical.DEPTH


def test_ties_at_the_bound_are_all_read(frame, spark):
    docs = [(k, "same") for k in range(300, 0, -1)] + [(400 + k, f"other{k}") for k in range(400)]
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = lexical.rank_documents(frame(docs).repartition(3), items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 21))


def test_empty_tables(frame, spark):
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert lexical.rank_documents(frame([]), items).count() == 0
    assert lexical.rank_documents(frame([(1, None)]), items).count() == 0
    assert lexical.rank_documents(frame([(1, "same")]), items.limit(0)).count() == 0


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z"), ("d", "z z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
