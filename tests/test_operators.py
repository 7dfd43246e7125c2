import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import features as features_module
from panelkit.operators import impute, importance, inference, metrics, neighbours, panel, quality, segments, splits
from panelkit.operators.neighbours import knn_impute, nearest_donors
from panelkit.operators.permutation import permutation_drops
from panelkit.operators.quantiles import exact_quantiles
from panelkit.operators.ranks import average_ranks, hash_positions, positions, value_bounds
from panelkit.plans.reuse import DataChanged, check_unchanged, fingerprint_text
from panelkit.sources import dictionaries, fixed_values, pages, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources


def test_pages_parse_and_skip_errors(spark, tmp_path):
    record = lambda code, year, value: {"countryiso3code": code, "country": {"id": code, "value": code.title()}, "date": year, "value": value}
    (tmp_path / "NY.GDP.json").write_text(json.dumps([{"page": 1}, [record("AAA", "2001", 1.5), record("BBB", "2002", None), record("CCC", "1990", 3.0)]]))
    (tmp_path / "BAD.json").write_text(json.dumps([{"message": [{"id": "120"}]}]))
    (tmp_path / "EMPTY.json").write_text(json.dumps([{"total": 0}, []]))
    (tmp_path / "NULL.json").write_text(json.dumps([{"total": 0}, None]))
    found = pages.collect_indicators(spark, str(tmp_path), 2000, 2023).collect()
    assert [tuple(r) for r in found] == [("AAA", "Aaa", 2001, "NY.GDP", 1.5)]


def test_landed_pages_come_back_and_tell_their_problems(spark, tmp_path):
    good = [{"countryiso3code": "A", "country": {"id": "A", "value": "a"}, "date": "2001", "value": 1.0}]
    made = [("007", json.dumps([{"total": 1}, good])), ("007", json.dumps([{"total": 2}, good])), ("007", json.dumps([{"total": 9, "pages": 5}, good])),
            ("a/b+c d%", "<html>"), ("a/b+c d%", json.dumps([{"message": [{"id": "1"}]}])), ("a/b+c d%", json.dumps([{"total": 0}, None])), ("a/b+c d%", json.dumps([{"total": 3}, None]))]
    pages.land_pages(spark.createDataFrame(made, "indicator string, value string"), str(tmp_path / "p"))
    back = pages.read_pages(spark, str(tmp_path / "p"))
    assert sorted((r.indicator, r.value.strip()) for r in back.collect()) == sorted(made)
    assert {(r.indicator, r.problem): r.pages for r in pages.page_problems(back).collect()} == {
        ("007", "ok"): 2, ("007", "records differ"): 1, ("a/b+c d%", "no json"): 1, ("a/b+c d%", "error message"): 1, ("a/b+c d%", "ok"): 1, ("a/b+c d%", "records differ"): 1}
    assert pages.collect_indicators(spark, str(tmp_path / "p")).count() == 3


def test_landed_pages_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "PAGES_PER_FILE", 100)
    texts = ["", "a\x1eb", "two\nlines\n", *[json.dumps([{"total": 0}, [k]]) for k in range(400)]]
    path = tmp_path / "p"
    pages.land_pages(spark.createDataFrame([("x", t) for t in texts], "indicator string, value string").coalesce(1), str(path))
    assert len(list(path.rglob("part-*"))) == 5
    back = [tuple(r) for r in pages.read_pages(spark, str(path)).select("indicator", "value").collect()]
    assert sorted(back) == sorted(("x", t.replace("\x1e", "\x1f")) for t in texts)


def test_csv_round_trip_turns_nan_into_null(spark, tmp_path):
    df = frame(spark, [(1, float("nan")), (2, 2.0)], "id int, v double")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    back = tables.read_table(spark, str(tmp_path / "t"), "id int, v double", "csv")
    assert sorted((r.id, r.v) for r in back.collect()) == [(1, None), (2, 2.0)]


def test_feature_list_keeps_order_and_falls_back_to_columns(spark, tmp_path):
    path = str(tmp_path / "list")
    tables.write_feature_list(spark, ["b", "a"], path)
    df = frame(spark, [(1, 2, 3)], "a int, b int, t int")
    assert tables.read_feature_list(spark, path, df, "t") == ["b", "a"]
    assert tables.read_feature_list(spark, str(tmp_path / "none"), df, "t") == ["a", "b"]


def test_mapping_drops_comments_and_missing_file_is_empty(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"_comment": "x", "AAA": "North"}')
    assert [tuple(r) for r in dictionaries.read_mapping(spark, str(path)).collect()] == [("AAA", "North")]
    assert dictionaries.read_mapping(spark, str(tmp_path / "none.json")).count() == 0


def test_built_in_dictionaries(spark):
    assert dictionaries.indicators(spark).count() == 53
    assert dictionaries.display_names(spark).count() == 59
    assert dictionaries.categories(spark).select("category").distinct().count() == 11
    assert dictionaries.model_labels(spark).count() == 5
    path = f"{tables.__file__.rsplit('/', 1)[0]}/data/entity_regions.json"
    assert dictionaries.read_mapping(spark, path).count() == 178
    assert abs(sum(fixed_values.ENSEMBLE_WEIGHTS.values()) - 1) < 0.01


def test_report_text_is_in_order(spark, tmp_path):
    lines = frame(spark, [(2, "b"), (1, "a"), (3, "c")], "line_no int, line string")
    tables.write_report(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.split() == ["a", "b", "c"]


# ---------------------------------------------------------------- panel and quality


def test_widen_equals_folded_outer_joins(spark):
    long = frame(spark, [("A", 1, "x", 1.0), ("A", 1, "y", 2.0), ("B", 1, "y", 3.0)], "e string, t int, i string, v double")
    wide = panel.widen(long, ["e", "t"], "i", "v", ["x", "y"])
    joined = panel.outer_join_all([long.where(F.col("i") == n).select("e", "t", F.col("v").alias(n)) for n in "xy"], ["e", "t"])
    assert sorted(wide.collect()) == sorted(joined.collect())
    assert panel.repeated_keys(long, ["e", "t"], "i").count() == 0


def test_quality_helpers(spark):
    df = frame(spark, [(1, None, 1.0, "a"), (2, None, None, "b"), (3, 1.0, 2.0, "c")], "id int, u double, v double, s string")
    assert quality.numeric_columns(df, ["id"]) == ["u", "v"]
    assert quality.feature_columns(df, ["id", "s"], "v") == ["u"]
    kept, dropped = quality.drop_sparse_columns(df, ["u", "v"], 0.6)
    assert dropped == ["u"] and "u" not in kept.columns
    # strictly above: exactly at the threshold stays
    assert quality.drop_sparse_columns(df, ["u", "v"], 2 / 3)[1] == []
    assert quality.remaining_missing(df, ["u", "v"]).first()[0] == 3
    assert quality.drop_incomplete_rows(df, ["u", "v"]).count() == 1


def test_outlier_filters_drop_rows_with_missing_values(spark):
    rows = [(i, float(i)) for i in range(20)] + [(100, 1000.0), (101, None)]
    df = frame(spark, rows, "id int, v double")
    assert quality.iqr_filter(df, ["v"], 3.0).count() == 20
    assert quality.zscore_filter(df, ["v"], 3.0).count() == 20
    assert quality.remove_outliers(df, ["v"], None).count() == 22
    with pytest.raises(ValueError):
        quality.remove_outliers(df, ["v"], "other")


def test_dotted_columns(spark):
    df = frame(spark, [(1, 2.0), (2, None)], "id int, `NY.GDP.PCAP.CD` double")
    assert quality.missing_summary(df, ["NY.GDP.PCAP.CD"]).first()["missing"] == 1
    assert tables.safe_columns(df).columns == ["id", "NY_GDP_PCAP_CD"]
    derived, skipped = features_module.derive(df, fixed_values.FEATURE_SPECS)
    assert "log_gdp_per_capita" in derived.columns and len(skipped) == 5


def test_feature_registry(spark):
    df = frame(spark, [(1.0, 4.0)], "a double, b double")
    features_module.register_operation("product", lambda p: F.col(p["x"]) * F.col(p["y"]))
    specs = [
        {"name": "ab", "operation": "product", "dependencies": ["a", "b"], "parameters": {"x": "a", "y": "b"}},
        {"name": "aab", "operation": "product", "dependencies": ["a", "ab"], "parameters": {"x": "ab", "y": "b"}},
    ]
    assert features_module.derive(df, specs)[0].first()["aab"] == 16.0
    with pytest.raises(ValueError):
        features_module.derive(df, [{"name": "x", "operation": "nope", "dependencies": ["a"]}])


def test_lookup_and_unmatched(spark):
    df = frame(spark, [("A",), ("A",), ("Z",), ("Y",)], "k string")
    dim = frame(spark, [("A", "North")], "code string, label string")
    found = segments.lookup_segment(df, "k", dim)
    assert sorted(r.segment for r in found.collect()) == ["North", "North", "Other", "Other"]
    row = segments.unmatched_keys(df, "k", dim, 1).first()
    assert (row.unmatched_rows, row.unmatched_keys, row.first_keys, row.more_keys) == (2, 2, "Y", 1)


def test_small_segments_are_left_out(spark):
    df = frame(spark, [("a",)] * 5 + [("b",)] * 2 + [(None,)] * 9, "s string")
    assert {r.s for r in segments.large_segments(df, "s", 3).collect()} == {"a"}


# ---------------------------------------------------------------- quantiles and ranks


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "small"])
def test_bracketed_quantiles_equal_the_exact_ones(spark, kind):
    rng = np.random.default_rng(1)
    values = {"spread": rng.normal(size=9000), "ties": rng.integers(0, 7, 9000).astype(float),
              "hot": np.where(rng.random(9000) < 0.4, 5.0, rng.normal(size=9000)), "small": rng.normal(size=11)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(rng.random(len(values)) < 0.7, "a", "b"), "v": values}))
    probabilities = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    found = exact_quantiles(df, ["v"], probabilities, accuracy=100, gather_limit=50)[()]["v"]
    assert found == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12, abs=1e-12)
    pdf = df.toPandas()
    by_group = exact_quantiles(df, ["v"], probabilities, ["g"], accuracy=200, gather_limit=60)
    for g, part in pdf.groupby("g"):
        assert by_group[(g,)]["v"] == pytest.approx(list(np.quantile(part["v"], probabilities)), rel=1e-12, abs=1e-12)
    quick = exact_quantiles(df, ["v"], probabilities)[()]["v"]
    assert quick == pytest.approx(found, rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = frame(spark, [(1, None), (2, None)], "id int, v double")
    assert exact_quantiles(df, ["v"], [0.5])[()]["v"] == [None]
    assert exact_quantiles(df, ["v"], [0.5])[()]["v"] == [None]


def test_average_ranks_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.8 else "b", 7.0 if rng.random() < 0.4 else float(rng.randint(0, 60))) for _ in range(3000)]
    df = frame(spark, rows, "k string, v double")
    edges = value_bounds(df.groupBy("k", "v").count(), "v", 10)
    assert len(edges) >= 10
    found = {(r.k, r.v): r["rank"] for r in average_ranks(df, ["k"], "v", edges=edges).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    pdf["rank"] = pdf.groupby("k")["v"].rank(method="average")
    for (k, v), part in pdf.groupby(["k", "v"]):
        assert found[(k, v)] == part["rank"].iloc[0]


def test_positions_with_a_hot_value_are_a_permutation_in_order(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 3 else "b", 5.0 if rng.random() < 0.5 else rng.random() * 10) for i in range(3000)]
    df = frame(spark, rows, "id long, k string, v double")
    found = positions(df, ["k"], "v", "id", edges=value_bounds(df, "v", 100)).toPandas()
    for _, part in found.groupby("k"):
        part = part.sort_values("position")
        assert list(part["position"]) == list(range(1, len(part) + 1))
        assert part["v"].is_monotonic_increasing


def test_hash_positions_and_shuffle_keep_the_multiset(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 2).alias("v"))
    digested = df.withColumn("digest", F.md5(F.col("id").cast("string")))
    assert sorted(r.position for r in hash_positions(digested, [], "digest").collect()) == list(range(1, 501))
    shuffled = splits.shuffled_values(df, "id", ["v"], 3).toPandas()
    assert len(shuffled) == 1500
    for _, part in shuffled.groupby("replicate"):
        assert sorted(part["v_shuffled"]) == [2 * i for i in range(500)]
        assert sorted(part["id"]) == list(range(500))
        assert (part["v_shuffled"] != part["id"] * 2).mean() > 0.9
    again = splits.shuffled_values(df.repartition(7), "id", ["v"], 3).toPandas()
    key = ["replicate", "id"]
    pd.testing.assert_frame_equal(shuffled.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


# ---------------------------------------------------------------- imputation


def brute_force(pdf, columns, k):
    out = {}
    for _, r in pdf.iterrows():
        for f in columns:
            if not np.isnan(r[f]):
                continue
            hits = []
            for _, d in pdf.iterrows():
                if np.isnan(d[f]):
                    continue
                shared = [c for c in columns if not np.isnan(r[c]) and not np.isnan(d[c])]
                if shared:
                    squared = len(columns) / len(shared) * sum((r[c] - d[c]) ** 2 for c in shared)
                    hits.append((squared, d["id"]))
            out[(r["id"], f)] = [int(i) for _, i in sorted(hits)[:k]]
    return out


@pytest.mark.parametrize("case", ["random", "copies", "many_patterns", "large_cells", "crowded_leaf"])
def test_nearest_donors_equal_brute_force(spark, case, monkeypatch):
    rng = np.random.default_rng(5)
    n, columns = 160, ["a", "b", "c", "d"]
    values = rng.normal(size=(n, 4)) * [1, 10, 100, 3]
    if case == "copies":
        values[: n // 2] = np.round(values[0], 1)  # half of all rows are copies of one
    if case == "large_cells":
        monkeypatch.setattr(neighbours, "CELLS", 3)  # every cell is cut into blocks by its task
    if case == "crowded_leaf":
        monkeypatch.setattr(neighbours, "SAMPLED", 0)  # a tree grown from two rows
        monkeypatch.setattr(neighbours, "GUIDES", 2)
    share = 0.5 if case == "many_patterns" else 0.15
    values[rng.random((n, 4)) < share] = np.nan
    pdf = pd.DataFrame(values, columns=columns)
    pdf.insert(0, "id", rng.permutation(n) + 1000)
    df = frame(spark, [(int(r[0]), *[None if np.isnan(v) else float(v) for v in r[1:]]) for r in pdf.itertuples(index=False)],
               "id long, a double, b double, c double, d double")
    expected = {k: v for k, v in brute_force(pdf, columns, 3).items() if v}
    found = nearest_donors(df, "id", columns, 3, cell_rows=2 if case == "crowded_leaf" else 12, chunk_rows=15).toPandas()
    got = {}
    for (i, f), part in found.groupby(["id", "feature"]):
        got[(i, f)] = list(part.sort_values("rank")["donor"])
    assert got == expected


def test_visits_follow_the_data_not_the_number_of_donors(spark):
    """Columns driven by two factors: visits a receiver, and their growth when the rows double."""
    rates = []
    for n in (2_000, 4_000):
        rng = np.random.default_rng(1)
        values = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 6))
        values[rng.random(values.shape) < 0.03] = np.nan
        pdf = pd.DataFrame(values, columns=[f"c{j}" for j in range(6)])
        pdf.insert(0, "id", np.arange(n))
        visited = []
        nearest_donors(spark.createDataFrame(pdf), "id", list(pdf.columns[1:]), 5, cell_rows=64, visited=visited)
        rates.append(sum(visited) / np.isnan(values).any(axis=1).sum())
    assert rates[1] < 12 and rates[1] < 1.3 * rates[0]


def test_visits_look_at_the_cells_of_near_groups_only(monkeypatch):
    """Visits of all rounds are those that a look at all cells gives, from a small part of the bounds."""
    rng = np.random.default_rng(3)
    donors = rng.random((16_000, 2)).round(3)
    donors[rng.random(donors.shape) < 0.02] = np.nan
    tree = neighbours.Tree(donors, 1_024)
    home = tree.place(donors)
    boxes, asked = neighbours.Boxes.of(donors, home), []
    matrix = rng.random((400, 2))
    matrix[np.arange(400), rng.integers(0, 2, 400)] = np.nan
    batch = pd.DataFrame({"id": np.arange(400), "v0": matrix[:, 0], "v1": matrix[:, 1], "u0": 1e-5, "u1": 1e-5, "home": tree.place(matrix)})
    batch.loc[:4, ["u0", "u1"]] = np.nan  # no limit: every cell may matter
    plain = neighbours.Boxes.bounds
    monkeypatch.setattr(neighbours.Boxes, "bounds", lambda self, v, o: (asked.append(len(v) * len(self.names)), plain(self, v, o))[1])
    seen = {}
    for start, end in ((1, 5), (5, 25), (25, 10_000)):
        for out in neighbours._visits(boxes, 2, start, end)(iter([batch])):
            for row in out.itertuples():
                if row.cell >= 0:
                    assert (row.id, row.cell) not in seen
                    seen[row.id, row.cell] = True
    assert sum(asked) < 0.7 * 3 * 400 * len(boxes.names)
    for i in range(400):
        pattern = ~np.isnan(matrix[i])
        bound = plain(boxes, matrix[i][None], pattern)[0]
        reach = np.inf if i < 5 else 1e-5 * neighbours.SLACK
        must = {(i, int(c)) for c in boxes.names[(bound <= reach) & np.isfinite(bound) & boxes.holds[:, ~pattern].any(axis=1)] if c != batch["home"][i]}
        mine = {k for k in seen if k[0] == i}
        assert mine <= must
        gap = (donors[:, pattern] - matrix[i, pattern])[:, 0]
        near = (2 * gap**2 <= reach) & ~np.isnan(donors[:, ~pattern][:, 0])
        assert {(i, int(c)) for c in set(home[near]) if c != batch["home"][i]} <= mine


def test_knn_impute_falls_back_to_the_column_mean(spark):
    df = frame(spark, [(1, None, 2.0), (2, 4.0, None), (3, 8.0, None)], "id long, a double, b double")
    rows = {r.id: (r.a, r.b) for r in knn_impute(df, "id", ["a", "b"], 2).collect()}
    assert rows == {1: (6.0, 2.0), 2: (4.0, 2.0), 3: (8.0, 2.0)}


def test_knn_scale_and_fit_on(spark):
    train = frame(spark, [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 2.0, 30.0)], "id long, a double, b double")
    new = frame(spark, [(9, 0.9, None)], "id long, a double, b double")
    assert knn_impute(new, "id", ["a", "b"], 1, fit_on=train).first()["b"] == 20.0
    assert knn_impute(new, "id", ["a", "b"], 1, fit_on=train, scale=True).first()["b"] == pytest.approx(20.0)


def test_missing_value_strategies(spark):
    df = frame(spark, [(1, 1.0, None), (2, 3.0, None), (3, None, None), (4, 8.0, 1.0)], "id long, a double, b double")
    mean, kept = impute.handle_missing(df, ["a", "b"], "mean", 0.6)
    assert kept == ["a"] and mean.where("id = 3").first()["a"] == 4.0
    assert impute.handle_missing(df, ["a", "b"], "median", 0.6)[0].where("id = 3").first()["a"] == 3.0
    assert impute.handle_missing(df, ["a", "b"], "drop", 0.6)[0].count() == 3
    assert impute.handle_missing(df, ["a", "b"], "knn", 0.9, "id", 1)[0].where("a is null or b is null").count() == 0
    with pytest.raises(ValueError):
        impute.handle_missing(df, ["a"], "guess")


# ---------------------------------------------------------------- metrics and tests


def test_metrics_on_literals(spark):
    df = frame(spark, [(1, "m", "test", 1.0, 2.0), (2, "m", "test", 3.0, 3.0), (3, "m", "test", 0.0, 1.0)],
               "row_id int, model string, split string, label double, prediction double")
    row = metrics.extended_metrics(df).first()
    assert row.rmse == pytest.approx(math.sqrt(2 / 3)) and row.mae == pytest.approx(2 / 3)
    assert row.r2 == pytest.approx(1 - 2 / (14 / 3)) and row.mape == pytest.approx(50.0)
    assert row.max_error == 1.0 and row.median_abs_error == 1.0
    constant = df.withColumn("label", F.lit(1.0))
    assert metrics.regression_metrics(constant).first().r2 is None


def test_replicate_importance_equals_correlations_of_each_replicate(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=300) + 1e6, "b": rng.normal(size=300), "y": rng.normal(size=300)})
    pdf["y"] += pdf["b"] * 2
    pdf.loc[rng.random(300) < 0.1, "a"] = np.nan
    pdf["w"] = [list(map(int, w)) for w in rng.integers(0, 3, (300, 4))]
    pdf["m"] = [["p", "q"] if k % 3 else (["p"] if k % 2 else []) for k in range(300)]
    found = importance.replicate_importance(spark.createDataFrame(pdf).repartition(5), ["a", "b"], "y", F.col("m"), F.col("w"))
    got = {(r.model, r.replicate, r.feature): r.importance for r in found.collect()}
    for model in ("p", "q"):
        for k in range(4):
            own = pdf[[model in m for m in pdf["m"]]]
            copies = own.loc[own.index.repeat([w[k] for w in own["w"]])]
            squares = {f: np.corrcoef(*copies[[f, "y"]].dropna().to_numpy().T)[0, 1] ** 2 for f in ("a", "b")}
            for f, value in squares.items():
                assert got[model, k, f] == pytest.approx(value / sum(squares.values()), rel=1e-6)
    assert len(got) == 16


def test_replicate_importance_makes_the_weights_of_keys_in_the_task(spark):
    from functools import partial

    from panelkit.functions.hashing import flag_matrix, hash_flags

    rng = np.random.default_rng(3)
    rows = [(str(k * 37) if k % 50 else None, float(a), float(a + b), ["p", None] if k % 3 else ["q", "p"])
            for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "k string, a double, y double, m array<string>").repartition(3).withColumn("b", F.col("a") * F.col("y"))
    salts = [str(s) for s in range(12)]
    by_column = importance.replicate_importance(df, ["a", "b"], "y", F.col("m"), hash_flags(F.col("k"), salts, 80))
    by_key = importance.replicate_importance(df, ["a", "b"], "y", F.col("m"), F.col("k"), partial(flag_matrix, salts=salts, limit=80))
    found, known = ({(r.model, r.replicate, r.feature): r.importance for r in d.collect()} for d in (by_key, by_column))
    assert len(found) == 2 * 12 * 2 and found == pytest.approx(known, rel=1e-9)


@pytest.mark.parametrize("n", [1, 5, 11])
def test_exact_signed_rank_counts_all_signs(spark, n):
    sums = [sum(k + 1 for k in range(n) if signs >> k & 1) for signs in range(1 << n)]
    rows = spark.createDataFrame([(float(w), n) for w in range(n * (n + 1) // 4 + 1)], "w double, n long")
    for r in rows.withColumn("p", inference.exact_signed_rank(F.col("w"), F.col("n"))).collect():
        assert r.p == pytest.approx(min(1.0, 2 * sum(s <= r.w for s in sums) / len(sums)))


def test_signed_rank_is_exact_only_without_ties_and_zeros(spark):
    def p(differences):
        rows = [(k, "a", "b", float(d), 0.0) for k, d in enumerate(differences)]
        found = inference.wilcoxon(spark.createDataFrame(rows, "row_id long, model_a string, model_b string, error_a double, error_b double")).first()
        return found.w_p_value, math.erfc(abs(found.z_statistic) / math.sqrt(2))

    exact, normal = p([1, 2, 3, -4, 5])
    assert exact == pytest.approx(14 / 32) and exact != pytest.approx(normal)
    for other in ([1, 1, 3, -4, 5], [0, 1, 2, 3, -4, 5], [k * (-1) ** k for k in range(1, 53)]):
        found, normal = p(other)
        assert found == pytest.approx(normal)


def test_ensemble_weights_must_sum_to_one(spark):
    df = frame(spark, [(1, "a", "test", 1.0, 2.0), (1, "b", "test", 1.0, 4.0)],
               "row_id int, model string, split string, label double, prediction double")
    assert metrics.weighted_ensemble(df, {"a": 0.5, "b": 0.5}).first().prediction == 3.0
    with pytest.raises(ValueError):
        metrics.weighted_ensemble(df, {"a": 0.5, "b": 0.2})


def test_wilcoxon_on_a_small_example(spark):
    # differences 1, -2, 3, 3, 0: ranks 1, 2, 3.5, 3.5; the zero is dropped
    errors = [(1, 2.0, 1.0), (2, 1.0, 3.0), (3, 4.0, 1.0), (4, 5.0, 2.0), (5, 1.0, 1.0)]
    pairs = frame(spark, [(i, "a", "b", x, y) for i, x, y in errors], "row_id int, model_a string, model_b string, error_a double, error_b double")
    row = inference.wilcoxon(pairs).first()
    assert row.w_statistic == 2.0 and row.n_nonzero == 4
    variance = 4 * 5 * 9 / 24 - (8 - 2) / 48
    assert row.z_statistic == pytest.approx((2 - 5) / math.sqrt(variance))
    assert row.w_p_value == pytest.approx(math.erfc(abs(row.z_statistic) / math.sqrt(2)))


def test_published_consistency_matrix(spark):
    # fixed values: published rank correlations of five models; their mean is 0.467
    names = ["Decision Tree", "Random Forest", "Gradient Boosting", "XGBoost", "LightGBM"]
    upper = {(0, 1): 0.3692532554406494, (0, 2): 0.5494958410273587, (0, 3): 0.46994008977601726, (0, 4): 0.4296828788008573,
             (1, 2): 0.5075978959672707, (1, 3): 0.5669199298655758, (1, 4): 0.19063358938198308, (2, 3): 0.8114552893045005,
             (2, 4): 0.5455530362801466, (3, 4): 0.23359121213653789}
    rows = [(names[i], names[j], 1.0 if i == j else upper[min(i, j), max(i, j)]) for i in range(5) for j in range(5)]
    matrix = frame(spark, rows, "model_a string, model_b string, rho double")
    assert inference.consistency(matrix).first()[0] == pytest.approx(0.467, abs=5e-4)


def test_spearman_with_ties(spark):
    rows = [("a", f, v) for f, v in zip("pqrst", (1.0, 2.0, 2.0, 4.0, 5.0))] + [("b", f, v) for f, v in zip("pqrst", (2.0, 1.0, 3.0, 3.0, 9.0))]
    df = frame(spark, rows, "model string, feature string, importance double")
    found = {(r.model_a, r.model_b): r for r in inference.spearman_tests(df).collect()}
    a, b = pd.Series([1, 2.5, 2.5, 4, 5]), pd.Series([2, 1, 3.5, 3.5, 5])
    assert found["a", "b"].rho == pytest.approx(a.corr(b))
    assert found["a", "a"].rho == 1.0 and found["a", "a"].p_value == 0.0


def test_published_bootstrap_relation(spark):
    samples = frame(spark, [("m", "f", float(v)) for v in range(101)], "model string, feature string, importance double")
    row = importance.replicate_summary(samples).first()
    assert (row.ci_lower, row.ci_upper, row.ci_width) == pytest.approx((2.5, 97.5, 95.0))
    assert row.cv == pytest.approx(row.std_importance / row.mean_importance)


def test_permutation_drops_of_an_unused_feature_are_zero(spark):
    df = spark.range(400).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("z"), (F.col("id") * 3.0).alias("y"))
    drops = permutation_drops(df, "id", "y", ["x", "z"], ["x", "z"], lambda d: d.withColumn("prediction", F.col("x") * 3), 4)
    found = {r.feature: r.d for r in drops.groupBy("feature").agg(F.avg("score_drop").alias("d")).collect()}
    assert found["z"] == 0.0 and found["x"] > 1.0


# ---------------------------------------------------------------- splits and reuse


def test_split_is_stable_and_near_its_fraction(spark):
    df = spark.range(10000)
    a = splits.with_split(df.repartition(3), "id").where("split = 'train'")
    b = splits.with_split(df.repartition(11), "id").where("split = 'train'")
    assert sorted(a.collect()) == sorted(b.collect())
    assert 7800 < a.count() < 8200
    folds = df.select(splits.fold_column("id").alias("f")).groupBy("f").count().collect()
    assert len(folds) == 5 and all(1800 < r["count"] < 2200 for r in folds)


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (2, "b")], "id int, s string")
    assert fingerprint_text(df) == fingerprint_text(df.orderBy(F.desc("id")).repartition(3))
    stored = fingerprint_text(df)
    with pytest.raises(DataChanged):
        check_unchanged(df.limit(2), stored)
    assert not check_unchanged(df.distinct(), stored, raise_on_change=False)


def test_replicates_are_lined_up_with_one_shuffle_of_their_rows(spark, monkeypatch):
    """What a join with the shuffled values gives, copies and rows without a key too, but replicates are not shuffled by position or key."""
    monkeypatch.setattr(splits, "SHUFFLED_ROWS", 100)
    df = spark.createDataFrame([(k, float(k), k % 7 * 1.5) for k in range(300)] * 2 + [(None, 9.0, 9.0)], "id long, `v.w` double, y double")
    plain = df.join(splits.shuffled_values(df, "id", ["y"], 3), "id").select("replicate", "`v.w`", "y", "y_shuffled")
    found = splits.with_shuffled_values(df, "id", ["y"], 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 3 * 300 * 4
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not any("hashpartitioning(position" in line or "hashpartitioning(id" in line for line in plan.splitlines())
