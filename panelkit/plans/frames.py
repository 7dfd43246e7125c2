"""Modelling relations over the star-schema tables, each with the SQL that defines it.

The Spark builders and the SQL common table expressions describe the same relations, so every query can be
checked against an SQL engine on the same files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.hashing import flag_matrix, hash_bucket
from panelkit.operators.importance import replicate_importance
from panelkit.operators.splits import fold_column, split_column
from panelkit.plans.catalog import normal_two_sided_sql
from panelkit.session import materialise, sized

FEATURES = ["n_items", "qty_avg", "tax_avg", "disc_avg", "price_avg", "bal", "total"]
PARTS = ["ext_a", "ext_n", "ext_r"]
IDS = ["row_id", "entity", "region_key", "year", "month"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
MODELS = ["m_const", "m_entity", "m_lin", "m_prod", "m_ym"]
NULL_RATES = {"target": 10, "tax_avg": 70, "bal": 20, "qty_avg": 5, "disc_avg": 3}
REPLICATES = 100
FOLDS = 5
BANDS = [(0, 1500, "0-1500"), (1500, 2500, "1500-2500"), (2500, 3500, "2500-3500"), (3500, None, "3500+")]

_written: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> str:
    """Name, size and age of the tables below a folder, so that nothing is kept beyond a change of them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def written(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A relation that several steps of a plan read: built once per session and state of the tables, and kept as a table."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} {state(spark, sf_dir)}", label)
    if key not in _written:
        _written[key] = materialise(build(), label)
    return _written[key]


def forget_written() -> None:
    _written.clear()


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: line aggregates, order and customer attributes, derived target."""
    part = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_items"),
        F.avg("l_quantity").alias("qty_avg"),
        F.avg("l_tax").alias("tax_avg"),
        F.avg("l_discount").alias("disc_avg"),
        F.avg("l_extendedprice").alias("price_avg"),
        part("A").alias("ext_a"), part("N").alias("ext_n"), part("R").alias("ext_r"),
        F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("target"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nations = table(spark, sf_dir, "nation")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("n_name").alias("entity"),
            F.col("n_regionkey").alias("region_key"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
            "n_items", "qty_avg", "tax_avg", "disc_avg", "price_avg",
            F.col("c_acctbal").alias("bal"),
            F.col("o_totalprice").alias("total"),
            "ext_a", "ext_n", "ext_r", "target",
        )
    )


def frame_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame`` with values removed by a hash of row and column."""
    df = frame(spark, sf_dir)
    return df.withColumns(
        {c: F.when(hash_bucket(F.col("row_id"), c) >= rate, F.col(c)) for c, rate in NULL_RATES.items()}
    )


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(
        F.avg("value").alias("value")
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day panel with one column per event type: one aggregation, one shuffle."""
    return table(spark, sf_dir, "events").groupBy(
        "user_id", F.to_date("ts").alias("day")
    ).agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in EVENT_TYPES])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity x year averages of the frame."""
    return frame(spark, sf_dir).groupBy("entity", "region_key", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in [*FEATURES, "target"]]
    )


def region_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity to region name; one region is left out so that lookups can fail."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.where(F.col("n_regionkey") != 4).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("code"), F.col("r_name").alias("label"))


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictors fitted on the train split, one column each."""

    def build() -> DataFrame:
        df = frame(spark, sf_dir).select("row_id", "entity", "year", "month", "price_avg", "disc_avg", "target")
        df = materialise(df.withColumn("split", split_column("row_id")), "frame-split")
        train = df.where(F.col("split") == "train")
        fit = train.agg(
            F.avg("target").alias("mean"),
            F.regr_slope("target", "price_avg").alias("slope"),
            F.regr_intercept("target", "price_avg").alias("intercept"),
        ).first()
        by_entity = sized(train.groupBy("entity").agg(F.avg("target").alias("m_entity")), "entity-means")
        by_month = sized(train.groupBy("year", "month").agg(F.avg("target").alias("m_ym")), "month-means")
        return df.join(by_entity, "entity", "left").join(by_month, ["year", "month"], "left").select(
            "row_id", "split", F.col("target").alias("label"),
            F.lit(fit["mean"]).alias("m_const"), "m_entity",
            (F.col("price_avg") * F.lit(fit["slope"]) + F.lit(fit["intercept"])).alias("m_lin"),
            (F.col("price_avg") * F.col("disc_avg")).alias("m_prod"), "m_ym",
            "price_avg", "disc_avg",
        )

    return written(spark, sf_dir, "wide-predictions", build)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, model, split, label, prediction``; rows a predictor cannot score are left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in MODELS])
    return wide_predictions(spark, sf_dir).select("row_id", "split", "label", F.inline(pairs)).where(
        F.col("prediction").isNotNull()
    ).select("row_id", "model", "split", "label", "prediction")


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(F.col("split") == "test").drop("split")


def cv_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the train split: ``row_id, model, fold, label, prediction``."""

    def build() -> DataFrame:
        # the split is filtered on the written relation: on the frame it would be pushed under the joins, to every line
        df = materialise(frame(spark, sf_dir).select("row_id", "entity", "price_avg", "disc_avg", "target").withColumns(
            {"split": split_column("row_id"), "fold": fold_column("row_id")}), "fold-frame")
        df = df.where(F.col("split") == "train").drop("split")
        # five left-out fits as conditional aggregates of one pass
        kept = lambda c, k: F.when(F.col("fold") != k, F.col(c))
        fit = df.agg(*[
            a.alias(f"{n}{k}") for k in range(FOLDS) for n, a in (
                ("mean", F.avg(kept("target", k))),
                ("slope", F.regr_slope(kept("target", k), kept("price_avg", k))),
                ("intercept", F.regr_intercept(kept("target", k), kept("price_avg", k))),
            )
        ]).first()
        entity = sized(df.groupBy("entity").agg(*[F.avg(kept("target", k)).alias(f"e{k}") for k in range(FOLDS)]), "fold-means")

        def by_fold(make):
            expr = F.when(F.col("fold") == 0, make(0))
            for k in range(1, FOLDS):
                expr = expr.when(F.col("fold") == k, make(k))
            return expr

        scored = {
            "m_const": by_fold(lambda k: F.lit(fit[f"mean{k}"])),
            "m_entity": by_fold(lambda k: F.col(f"e{k}")),
            "m_lin": by_fold(lambda k: F.col("price_avg") * F.lit(fit[f"slope{k}"]) + F.lit(fit[f"intercept{k}"])),
            "m_prod": F.col("price_avg") * F.col("disc_avg"),
        }
        pairs = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("prediction")) for m, c in scored.items()])
        return df.join(entity, "entity", "left").select("row_id", "fold", F.col("target").alias("label"), F.inline(pairs)).where(
            F.col("prediction").isNotNull())

    return written(spark, sf_dir, "cv-predictions", build)


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, replicate, feature, importance`` from squared correlations on hashed subsamples."""

    def build() -> DataFrame:
        # written first: the hashes below would otherwise be pushed under the joins and run per line
        df = materialise(frame(spark, sf_dir).select("row_id", "year", "month", *FEATURES, "target"), "frame")
        models = F.array(
            F.when(F.col("year") % 2 == 0, "even_year").otherwise("odd_year"),
            F.when(F.col("month") <= 6, "first_half").otherwise("second_half"),
        )
        weights = partial(flag_matrix, salts=[str(r) for r in range(REPLICATES)], limit=80)
        return replicate_importance(df, FEATURES, "target", models, F.col("row_id"), weights)

    return written(spark, sf_dir, "importances", build)


def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One importance per model and feature: the mean over replicates."""
    return importances(spark, sf_dir).groupBy("model", "feature").agg(F.avg("importance").alias("importance"))


# ---------------------------------------------------------------- SQL definitions

def _null_case(column: str, rate: int) -> str:
    return (
        f"CASE WHEN CAST(('0x' || substr(md5(concat(row_id, ':{column}')), 1, 8)) AS BIGINT) % 100 >= {rate} "
        f"THEN {column} END AS {column}"
    )


def sql_bucket(key: str, salt: str, buckets: int = 100) -> str:
    return f"CAST(('0x' || substr(md5(concat({key}, ':{salt}')), 1, 8)) AS BIGINT) % {buckets}"


_kept = [c for c in [*IDS, *FEATURES, *PARTS, "target"] if c not in NULL_RATES]

CTES: dict[str, tuple[list[str], str]] = {
    "frame": ([], """
        SELECT o_orderkey AS row_id, n_name AS entity, n_regionkey AS region_key,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               n_items, qty_avg, tax_avg, disc_avg, price_avg, c_acctbal AS bal, o_totalprice AS total,
               ext_a, ext_n, ext_r, target
        FROM (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_items, avg(l_quantity) AS qty_avg,
                     avg(l_tax) AS tax_avg, avg(l_discount) AS disc_avg, avg(l_extendedprice) AS price_avg,
                     sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS ext_a,
                     sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS ext_n,
                     sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS ext_r,
                     avg(l_extendedprice * l_discount) AS target
              FROM lineitem GROUP BY l_orderkey) l
        JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey"""),
    "frame_nulls": (["frame"], f"""
        SELECT {', '.join(_kept)}, {', '.join(_null_case(c, r) for c, r in NULL_RATES.items())} FROM frame"""),
    "event_long": ([], """
        SELECT user_id, CAST(ts AS DATE) AS day, event_type, avg(value) AS value FROM events GROUP BY 1, 2, 3"""),
    "event_panel": ([], f"""
        SELECT user_id, CAST(ts AS DATE) AS day,
               {', '.join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in EVENT_TYPES)}
        FROM events GROUP BY 1, 2"""),
    "panel": (["frame"], f"""
        SELECT entity, region_key, year, count(*) AS n_rows,
               {', '.join(f"avg({c}) AS {c}" for c in [*FEATURES, 'target'])}
        FROM frame GROUP BY 1, 2, 3"""),
    "region_dim": ([], """
        SELECT n_name AS code, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE n_regionkey <> 4"""),
    "split_frame": (["frame"], f"""
        SELECT *, CASE WHEN {sql_bucket('row_id', '42')} < 80 THEN 'train' ELSE 'test' END AS split FROM frame"""),
    "wide_predictions": (["split_frame"], """
        SELECT f.row_id, f.split, f.target AS label, c.m AS m_const, e.m AS m_entity,
               f.price_avg * c.s + c.i AS m_lin, f.price_avg * f.disc_avg AS m_prod, y.m AS m_ym,
               f.price_avg, f.disc_avg
        FROM split_frame f
        CROSS JOIN (SELECT avg(target) AS m, regr_slope(target, price_avg) AS s,
                           regr_intercept(target, price_avg) AS i FROM split_frame WHERE split = 'train') c
        LEFT JOIN (SELECT entity, avg(target) AS m FROM split_frame WHERE split = 'train' GROUP BY 1) e
               ON e.entity = f.entity
        LEFT JOIN (SELECT year, month, avg(target) AS m FROM split_frame WHERE split = 'train' GROUP BY 1, 2) y
               ON y.year = f.year AND y.month = f.month"""),
    "predictions": (["wide_predictions"], " UNION ALL ".join(
        f"SELECT row_id, '{m}' AS model, split, label, {m} AS prediction FROM wide_predictions WHERE {m} IS NOT NULL"
        for m in MODELS)),
    "test_predictions": (["predictions"], "SELECT row_id, model, label, prediction, label - prediction AS e FROM predictions WHERE split = 'test'"),
    "fold_frame": (["split_frame"], f"""
        SELECT *, CAST({sql_bucket('row_id', 'fold42', 5)} AS INTEGER) AS fold FROM split_frame WHERE split = 'train'"""),
    "fold_fits": (["fold_frame"], """
        SELECT CAST(k AS INTEGER) AS k, avg(target) AS m, regr_slope(target, price_avg) AS s, regr_intercept(target, price_avg) AS i
        FROM fold_frame JOIN (SELECT unnest(range(5)) AS k) ON fold <> k GROUP BY 1"""),
    "fold_means": (["fold_frame"], """
        SELECT CAST(k AS INTEGER) AS k, entity, avg(target) AS m
        FROM fold_frame JOIN (SELECT unnest(range(5)) AS k) ON fold <> k GROUP BY 1, 2"""),
    "cv_predictions": (["fold_fits", "fold_means"], """
        SELECT row_id, 'm_const' AS model, fold, target AS label, m AS prediction FROM fold_frame JOIN fold_fits ON k = fold
        UNION ALL SELECT row_id, 'm_lin', fold, target, price_avg * s + i FROM fold_frame JOIN fold_fits ON k = fold
        UNION ALL SELECT row_id, 'm_prod', fold, target, price_avg * disc_avg FROM fold_frame
        UNION ALL SELECT row_id, 'm_entity', fold, target, m FROM fold_frame f JOIN fold_means x ON x.k = f.fold AND x.entity = f.entity"""),
    "sample_rows": (["frame"], f"""
        SELECT m.model, r.replicate, {', '.join(FEATURES)}, target
        FROM frame
        CROSS JOIN (SELECT unnest(range({REPLICATES})) AS replicate) r
        CROSS JOIN (SELECT unnest(['even_year', 'odd_year', 'first_half', 'second_half']) AS model) m
        WHERE CAST(('0x' || substr(md5(concat(row_id, ':', r.replicate)), 1, 8)) AS BIGINT) % 100 < 80
          AND CASE m.model WHEN 'even_year' THEN year % 2 = 0 WHEN 'odd_year' THEN year % 2 = 1
                           WHEN 'first_half' THEN month <= 6 ELSE month > 6 END"""),
    "sample_squares": (["sample_rows"], f"""
        SELECT model, CAST(replicate AS INTEGER) AS replicate,
               {', '.join(f"coalesce(pow(corr({f}, target), 2), 0) AS {f}" for f in FEATURES)}
        FROM sample_rows GROUP BY 1, 2"""),
    "importances": (["sample_squares"], " UNION ALL ".join(
        f"SELECT model, replicate, '{f}' AS feature, {f} / ({' + '.join(FEATURES)}) AS importance FROM sample_squares"
        for f in FEATURES)),
    "model_importances": (["importances"], """
        SELECT model, feature, avg(importance) AS importance FROM importances GROUP BY 1, 2"""),
}


def metric_columns(label: str = "label", prediction: str = "prediction") -> str:
    e = f"({label} - {prediction})"
    return (f"count(*) AS n, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae, "
            f"1 - sum({e} * {e}) / nullif(var_pop({label}) * count(*), 0) AS r2")


CTES.update({
    "metrics": (["predictions"], f"SELECT model, split, {metric_columns()} FROM predictions GROUP BY 1, 2"),
    "fold_metrics": (["cv_predictions"], """
        SELECT model, fold, avg((label - prediction) * (label - prediction)) AS mse,
               sqrt(avg((label - prediction) * (label - prediction))) AS rmse, avg(abs(label - prediction)) AS mae,
               1 - sum((label - prediction) * (label - prediction)) / nullif(var_pop(label) * count(*), 0) AS r2
        FROM cv_predictions GROUP BY 1, 2"""),
    "cv_summary": (["fold_metrics"], """
        SELECT model, sqrt(avg(mse)) AS cv_rmse_mean, stddev_pop(rmse) AS cv_rmse_std, avg(mae) AS cv_mae_mean,
               stddev_pop(mae) AS cv_mae_std, avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std
        FROM fold_metrics GROUP BY 1"""),
    "extended": (["predictions"], f"""
        SELECT model, split, {metric_columns()}, avg(e2.a / nullif(abs(label), 0)) * 100 AS mape,
               1 - var_pop(e2.e) / nullif(var_pop(label), 0) AS explained_variance, max(e2.a) AS max_error,
               avg(e2.e) AS residual_mean, stddev_pop(e2.e) AS residual_std,
               (avg(pow(e2.e, 3)) - 3 * avg(e2.e) * avg(pow(e2.e, 2)) + 2 * pow(avg(e2.e), 3)) / pow(stddev_pop(e2.e), 3) AS residual_skewness,
               kurtosis_pop(e2.e) AS residual_kurtosis, median(e2.a) AS median_abs_error
        FROM (SELECT *, {{'e': label - prediction, 'a': abs(label - prediction)}} AS e2 FROM predictions) GROUP BY 1, 2"""),
    "pairs": (["test_predictions"], """
        SELECT a.row_id, a.model AS model_a, b.model AS model_b, abs(a.e) AS error_a, abs(b.e) AS error_b
        FROM test_predictions a JOIN test_predictions b ON a.row_id = b.row_id AND a.model < b.model"""),
    "t_tests": (["pairs"], """
        SELECT model_a, model_b, count(*) AS n,
               avg(error_a - error_b) * sqrt(count(*) - 1) / nullif(stddev_pop(error_a - error_b), 0) AS t_statistic
        FROM pairs GROUP BY 1, 2"""),
    "signed": (["pairs"], """
        SELECT model_a, model_b, abs(d) AS abs_diff, d > 0 AS positive,
               rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d))
               + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0::DOUBLE AS rank
        FROM (SELECT model_a, model_b, ROUND(error_a - error_b, 6) AS d FROM pairs) WHERE d <> 0"""),
    "wilcoxon": (["signed"], """
        SELECT model_a, model_b, least(sum(CASE WHEN positive THEN rank ELSE 0 END), sum(CASE WHEN positive THEN 0 ELSE rank END)) AS w_statistic,
               count(*) AS n_nonzero FROM signed GROUP BY 1, 2"""),
    "wilcoxon_p": (["signed", "wilcoxon"], f"""
        SELECT model_a, model_b, {normal_two_sided_sql('z')} AS w_p_value FROM (
          SELECT w.model_a, w.model_b, (w_statistic - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - t.ties / 48) AS z
          FROM (SELECT *, n_nonzero::DOUBLE AS m FROM wilcoxon) w
          JOIN (SELECT model_a, model_b, sum(k * k * k - k) AS ties FROM (
                  SELECT model_a, model_b, abs_diff, count(*)::DOUBLE AS k FROM signed GROUP BY 1, 2, 3) GROUP BY 1, 2) t
            ON t.model_a = w.model_a AND t.model_b = w.model_b)"""),
    "bootstrap": (["importances"], """
        SELECT model, feature, avg(importance) AS mean_importance, stddev_pop(importance) AS std_importance,
               quantile_cont(importance, 0.025) AS ci_lower, quantile_cont(importance, 0.975) AS ci_upper,
               quantile_cont(importance, 0.975) - quantile_cont(importance, 0.025) AS ci_width,
               CASE WHEN avg(importance) > 0 THEN stddev_pop(importance) / avg(importance) END AS cv
        FROM importances GROUP BY 1, 2"""),
    "feature_ranks": (["model_importances"], """
        SELECT model, feature, importance, rank() OVER (PARTITION BY model ORDER BY importance)
               + (count(*) OVER (PARTITION BY model, importance) - 1) / 2.0::DOUBLE AS rank FROM model_importances"""),
    "spearman": (["feature_ranks"], """
        SELECT a.model AS model_a, b.model AS model_b, count(*) AS n,
               CASE WHEN a.model = b.model THEN 1.0::DOUBLE ELSE corr(a.rank, b.rank) END AS rho
        FROM feature_ranks a JOIN feature_ranks b ON a.feature = b.feature GROUP BY 1, 2"""),
})


def with_sql(names: str | list[str], body: str, **extra: str) -> str:
    """``WITH`` the named relations and everything they need, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in [names] if isinstance(names, str) else names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
