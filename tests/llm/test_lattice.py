from itertools import product

import numpy as np
import pytest

from panelkit.llm import lattice, queries


def brute(rows, similarity=0.98):
    """Links and components by comparing all pairs of usable rows (id, vector, label)."""
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(ok):
        for b in ok[:p]:
            x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= similarity:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k in ok:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [(i, links[k], least[find(k)] if k in ok else i) for k, (i, _, _) in enumerate(rows)]


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 8))
    points, far = lattice.decode(x, 4)
    steps = np.array([p for p in product((-1, 0, 1), repeat=8)])
    for k, row in enumerate(x):
        options = [base + steps for base in (np.rint(row), np.rint(row - 0.5) + 0.5)]
        near = min(((o - row) ** 2).sum(1)[(np.rint(o.sum(1)) % 2 == 0)].min() for o in options)
        assert far[k][0] == pytest.approx(near)
        assert all((p % 2 == p[0] % 2).all() and p.sum() % 4 == 0 for p in points[k])


def rows_of(rng):
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(20):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 7)):
                rows.append((n := n + 1, [float(x) for x in base + rng.normal(size=16) * rng.choice([0, 0.02, 0.08])], label))
    for _ in range(40):
        rows.append((n := n + 1, rows[0][1], 1))
    v = rows[0][1]
    return rows + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None, *v[1:]], 1), (904, [float("nan"), *v[1:]], 1),
                   (905, [float("inf"), *v[1:]], 1), (906, v, None), (None, v, 1), (907, v[:8], 1), (908, [x * 1e-200 for x in v], 1),
                   (909, v, 3), (1, v, 1)]


@pytest.mark.parametrize("group", [2048, 7])
def test_matches_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(lattice, "GROUP", group)
    rows = rows_of(np.random.default_rng(5))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = lattice.near_vectors(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {i: (n, c) for i, n, c in brute(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op9_lattice_near_dedup"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
