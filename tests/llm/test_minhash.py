import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelkit.llm import minhash, queries, words
from panelkit.llm.components import components


def grams(text, width=5):
    own = (text or "").split()
    return Counter([tuple(own)] if 0 < len(own) < width else [tuple(own[k : k + width]) for k in range(len(own) - width + 1)])


def similar(a, b):
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    every = a.keys() | b.keys()
    prob = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in both)
    return max(len(both) / len(every), prob)


def brute(rows):
    """Smallest id reachable by links, by comparing all pairs that share a shingle."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, own in sets.items():
        for g in own:
            by.setdefault(g, set()).add(i)
    for i in sorted(sets):
        for j in sorted({j for g in sets[i] for j in by[g] if j < i}):
            if similar(sets[i], sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_match_brute_force(frame):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, n = [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "two one"), (905, "one  two\n")], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(copy)))
    rows.append((800, " ".join(rng.choice(vocabulary) for _ in range(60_000))))
    rng.shuffle(rows)
    want = brute(rows)
    got = minhash.near_duplicates(frame([*rows, (None, "one two"), rows[0]])).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert set(got[0].asDict()) == {"doc_id", "text", "block", "extra", "class_id", "kept"}


def test_no_link_hangs_on_a_centre(spark, frame, monkeypatch):
    """With no centre compared at all, the second look finds every link; a chain of small edits is one class."""
    monkeypatch.setattr(minhash, "central_pairs", lambda members: members.where("id < 0").selectExpr("id AS a", "id AS b"))
    monkeypatch.setattr(minhash, "GROUP", 5)
    rng = random.Random(9)
    own = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(40):
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(f"y{rng.randrange(500)}" for _ in range(150))) for k in range(40, 60)]
    got = minhash.near_duplicates(frame(rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_second_look_goes_past_likest_mates(frame):
    """Sixty copies about as far apart as the bound: many a likest mate by registers fails, and a later one passes."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(300), 4):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    sets, want = [set(grams(t)) for _, t in rows], list(range(60))  # no shingle is repeated, so both similarities are the same
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((want[i], want[j]))
                want = [x if k == y else k for k in want]
    assert [r.class_id for r in minhash.near_duplicates(frame(rows)).orderBy("doc_id").collect()] == want


def test_set_jaccard_pairs_are_candidates():
    """Copies with one passage ten times: few share a band by counts (set Jaccard 0.96, probability Jaccard below 0.5), all do by sets."""
    rng = random.Random(4)
    texts = []
    for k in range(30):
        own = [f"t{k}w{j}" for j in range(104)]
        rng.shuffle(own)
        texts += [" ".join(own), " ".join(own[:40] + own[40:64] * 10 + own[64:])]
    batch = pa.record_batch([pa.array(range(60), pa.int64()), pa.array(texts)], ["id", "body"])
    bands = {i: set(b) for out in minhash._signed(5)([batch]) for i, b in zip(out.column(0).to_pylist(), out.column(2).to_pylist())}
    assert all(similar(grams(texts[2 * k]), grams(texts[2 * k + 1])) >= 0.9 for k in range(30))
    assert sum(bool(bands[2 * k] & bands[2 * k + 1]) for k in range(30)) == 30


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([])).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    value = words.mix(np.arange(400, dtype=np.uint64))
    order = np.argsort(value)
    want = minhash.likeness((value[order], a[order]), (value[order], b[order]))[1]
    hits = []
    for shift in range(30):
        moved = words.mix(value + np.uint64(shift))
        found = minhash.signatures(np.repeat([0, 1], 400), np.r_[moved, moved], np.r_[a, b].astype(float), 2)
        hits.append((found[0] == found[1]).mean())
    assert np.mean(hits) == pytest.approx(want, abs=0.03)


def test_short_text_has_one_shingle():
    piece = next(words.pieces(pa.array(["a b", "a b c d e f", "", None, "a b"])))
    text, value, count = minhash.shingles(piece, 5)
    assert list(text) == [0, 1, 1, 4] and value[0] == value[3] and list(count) == [1] * 4


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (7, 7), (None, 3)], "x long, y long")
    assert {tuple(r) for r in components(links, "x", "y").collect()} == {(k, 0) for k in range(41)} | {(100, 90), (90, 90)}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    assert {r.doc_id: r.class_id for r in queries.QUERIES["op8_minhash_near_dedup"](spark, sf_dir).collect()} == want
