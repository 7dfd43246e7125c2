import hashlib
import random
import re

from panelkit.llm import queries, substrings


def brute(rows, width=13):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in enumerate(t for _, t in rows)}
    ids = [i for i, _ in rows]
    first = {}
    for k, own in words.items():
        if ids[k] is None:
            continue
        for j in range(len(own) - width + 1):
            w = tuple(own[j : j + width])
            first[w] = min(first.get(w, ids[k]), ids[k])
    out = []
    for k, own in words.items():
        gone = set()
        for j in range(len(own) - width + 1):
            if ids[k] is not None and first[tuple(own[j : j + width])] < ids[k]:
                gone |= set(range(j, j + width))
        out.append((ids[k], len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone)))
    return sorted(out, key=str)


def test_matches_brute_force(frame):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(40)) for _ in range(6)]
    rows = [(3, None), (4, ""), (5, " \t\n"), (None, passages[0]), (None, passages[0]), (9, "é " * 30), (2, "é x " * 20), (2, "é x " * 20)]
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        rows.append((100 + rng.randint(0, 40), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows.append((50, " ".join(rng.choice(passages) for _ in range(2000))))
    found = substrings.remove_repeated_windows(frame(rows).repartition(3))
    assert set(found.columns) == {"doc_id", "text", "extra", "n_words", "n_removed", "kept", "removed"}
    got = found.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == brute(rows)
    assert all(r.n_removed == sum(s.last - s.first + 1 for s in r.removed) for r in got)


def test_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substrings, "COARSE", 4)
    rng = random.Random(5)
    rows = [(rng.randint(-50, 5000), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for _ in range(80)]
    got = substrings.remove_repeated_windows(frame(rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == brute(rows)


def test_empty_table(frame):
    assert substrings.remove_repeated_windows(frame([])).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute([(r.doc_id, r.text) for r in docs])}
    assert {tuple(r) for r in queries.QUERIES["op3_substring_dedup"](spark, sf_dir).collect()} == want
