import math

import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.functions.hashing import hash_bucket, hash_uniform, poisson_one
from panelkit.functions.probability import normal_two_sided, t_greater, t_two_sided
from panelkit.operators.splits import bootstrap_weight


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_published_two_sided_p_values(spark):
    # fixed values: published t statistics with 364 degrees of freedom and their p-values
    for t, p in ((4.858265723030262, 1.7626136817270078e-06), (0.46883925497990203, 0.6394652007439569),
                 (5.891734977950508, 8.706978868329438e-09)):
        assert one(spark, t_two_sided(F.lit(t), F.lit(364))) == pytest.approx(p, rel=1e-9)


def test_published_one_sided_p_value(spark):
    # fixed values: mean and population deviation of 50 score drops, t and p
    mean, std = 0.29653292598616066, 0.023613109811141775
    t = mean * math.sqrt(49) / std
    assert t == pytest.approx(87.90584969556603, rel=1e-12)
    assert one(spark, t_greater(F.lit(t), F.lit(49))) == pytest.approx(6.9277293504455025e-56, rel=1e-8)
    assert one(spark, t_greater(F.lit(-t), F.lit(49))) == pytest.approx(1.0)


def test_p_value_without_degrees_of_freedom_is_null(spark):
    assert one(spark, t_two_sided(F.lit(2.0), F.lit(0))) is None


def test_normal_tail(spark):
    assert one(spark, normal_two_sided(F.lit(1.959963984540054))) == pytest.approx(0.05, rel=1e-9)


def test_inverse_normal_round_trip(spark):
    for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999):
        z = one(spark, S.inverse_normal(F.lit(p)))
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, rel=1e-7)


def test_ratio_log_and_sum_edge_cases(spark):
    assert one(spark, S.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.divide(F.lit(3.0), F.lit(4.0), 100)) == 75.0
    assert one(spark, S.log1p(F.lit(-2.0))) is None
    null = F.lit(None).cast("double")
    assert one(spark, S.total([F.lit(2.0), null])) == 2.0
    assert one(spark, S.diversity([F.lit(1.0), F.lit(1.0), null])) == pytest.approx(0.5)
    assert one(spark, S.diversity([F.lit(0.0), F.lit(0.0)])) == 1.0


def test_bands_are_left_closed_and_bins_right_closed(spark):
    bands = [(0, 30, "low"), (30, 40, "mid"), (40, None, "high")]
    assert [one(spark, S.band(F.lit(float(v)), bands)) for v in (0, 29.9, 30, 40, 99)] == ["low", "low", "mid", "high", "high"]
    assert one(spark, S.band(F.lit(-1.0), bands)) is None
    edges, labels = [1.0, 2.0, 3.0], ["a", "b", "c", "d"]
    assert [one(spark, S.right_closed(F.lit(float(v)), edges, labels)) for v in (1, 1.5, 2, 3, 4)] == ["a", "b", "b", "c", "d"]
    assert one(spark, S.right_closed(F.lit(None).cast("double"), edges, labels)) is None


def test_labels_and_formats(spark):
    assert one(spark, S.title_case(F.lit("random_forest"))) == "Random Forest"
    assert one(spark, S.ellipsis(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, S.ellipsis(F.lit("abc"), 3)) == "abc"
    assert one(spark, S.interval(F.lit(0.1), F.lit(0.25))) == "[0.1000, 0.2500]"
    assert one(spark, S.escape_special(F.lit("a_b % & c"))) == r"a\_b \% \& c"
    assert [one(spark, S.stars(F.lit(p))) for p in (0.0001, 0.005, 0.03, 0.5)] == ["***", "**", "*", "ns"]
    assert one(spark, S.coefficient_of_variation(F.lit(0.0), F.lit(1.0))) is None


def test_adaptive_fraction(spark):
    assert [one(spark, S.adaptive_fraction(F.lit(n))) for n in (30, 80, 1000)] == [0.2, 0.125, 0.1]


def test_hashes_do_not_depend_on_partitioning(spark):
    few = spark.range(0, 1000, 1, 1).select("id", hash_bucket(F.col("id"), "s").alias("b"))
    many = spark.range(0, 1000, 1, 16).select("id", hash_bucket(F.col("id"), "s").alias("b"))
    assert sorted(few.collect()) == sorted(many.collect())


def test_poisson_weights_have_unit_mean_and_variance(spark):
    row = spark.range(20000).select(bootstrap_weight("id", 3).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert row[0] == pytest.approx(1.0, abs=0.03) and row[1] == pytest.approx(1.0, abs=0.05)
    assert one(spark, poisson_one(F.lit(0.9999999))) >= 6
    uniform = spark.range(5000).select(hash_uniform(F.col("id"), "u").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= uniform[0] and uniform[1] < 1 and uniform[2] == pytest.approx(0.5, abs=0.02)


def test_flags_of_many_salts_are_those_of_each_bucket(spark):
    from panelkit.functions.hashing import hash_bucket, hash_flags

    keys = spark.createDataFrame([(k,) for k in ["1", "22", "", "é", None, "7", "x" * 50, "y" * 53, "z" * 200]], "k string").repartition(3)
    salts = [str(s) for s in range(40)]
    rows = keys.select(F.array(*[F.when(hash_bucket(F.col("k"), s) < 80, 1).otherwise(0) for s in salts]).alias("plain"),
                       hash_flags(F.col("k"), salts, 80).alias("flags")).collect()
    assert len(rows) == 9 and all(r.plain == r.flags for r in rows)
    assert keys.where("k is null").select(hash_flags(F.col("k"), salts, 80).alias("flags")).first().flags == [0] * 40


def test_poisson_weights_of_a_task_are_those_of_the_column(spark):
    """Draws next to a step of the distribution function, keys of all lengths and a null key."""
    from panelkit.functions import hashing as H

    keys = [None, "", "x" * 80, *map(str, range(3_000))]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    salts = ["boot42:0", "boot42:17"]
    rows = df.select("i", *[H.poisson_one(H.hash_uniform(F.col("k"), s)).alias(f"w{n}") for n, s in enumerate(salts)]).orderBy("i").collect()
    assert H.poisson_matrix(keys, salts).tolist() == [[r["w0"], r["w1"]] for r in rows]
