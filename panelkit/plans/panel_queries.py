"""Queries for sources, projections, filters, joins, aggregates, derivation and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.functions.hashing import hash_bucket
from panelkit.operators import impute, lookup, panel, quality, segments, splits
from panelkit.operators.features import derive
from panelkit.operators.quantiles import quantile_relation
from panelkit.operators.ranks import hash_positions
from panelkit.plans import frames as B
from panelkit.plans.catalog import q, query, r, rounded
from panelkit.plans.frames import with_sql
from panelkit.session import fresh_path
from panelkit.sources import dictionaries, pages, tables
from panelkit.sources import fixed_values as fixed

FEATURE_SPECS = [
    {"name": "price_rate", "operation": "ratio_scaled", "dependencies": ["price_avg", "total"],
     "parameters": {"numerator": "price_avg", "denominator": "total", "scale": 100}},
    {"name": "log_price", "operation": "log1p", "dependencies": ["price_avg"], "parameters": {"source": "price_avg"}},
    {"name": "ext_an", "operation": "sum", "dependencies": ["ext_a", "ext_n"],
     "parameters": {"columns": ["ext_a", "ext_n"]}},
    {"name": "ext_ratio", "operation": "ratio", "dependencies": ["ext_a", "ext_r"],
     "parameters": {"numerator": "ext_a", "denominator": "ext_r"}},
    {"name": "rate_gap", "operation": "difference", "dependencies": ["disc_avg", "tax_avg"],
     "parameters": {"minuend": "disc_avg", "subtrahend": "tax_avg"}},
    {"name": "flag_diversity", "operation": "diversity", "dependencies": ["ext_a", "ext_n", "ext_r"],
     "parameters": {"columns": ["ext_a", "ext_n", "ext_r"]}},
]
FEATURE_SQL = {
    "price_rate": "price_avg / nullif(total, 0) * 100",
    "log_price": "CASE WHEN price_avg > -1 THEN ln(1 + price_avg) END",
    "ext_an": "coalesce(ext_a, 0) + coalesce(ext_n, 0)",
    "ext_ratio": "ext_a / nullif(ext_r, 0)",
    "rate_gap": "disc_avg - tax_avg",
    "flag_diversity": "1 - (pow(coalesce(ext_a, 0) / nullif(coalesce(ext_a, 0) + coalesce(ext_n, 0) + coalesce(ext_r, 0), 0), 2)"
                      " + pow(coalesce(ext_n, 0) / nullif(coalesce(ext_a, 0) + coalesce(ext_n, 0) + coalesce(ext_r, 0), 0), 2)"
                      " + pow(coalesce(ext_r, 0) / nullif(coalesce(ext_a, 0) + coalesce(ext_n, 0) + coalesce(ext_r, 0), 0), 2))",
}
NULLABLE = ["n_items", "qty_avg", "tax_avg", "disc_avg", "price_avg", "bal", "total"]
KEPT = ["n_items", "qty_avg", "disc_avg", "price_avg", "bal", "total"]
QUARTILES = "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3"



def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


# ------------------------------------------------------------------ sources


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as indicator pages of at most 200 records, each followed by an error page and an empty page."""
    events = B.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("indicator"), F.floor(F.col("event_id") / 200).alias("page_no"),
        F.concat(F.lit("U"), F.col("user_id")).alias("code"), F.concat(F.lit("user "), F.col("user_id")).alias("name"),
        F.year("ts").alias("date"), F.when(hash_bucket(F.col("event_id"), "value") >= 10, F.col("value")).alias("value"),
    )
    texts = pages.page_texts(events, ["indicator", "page_no"], "code", "name", "date", "value")
    return texts.select("indicator", F.explode(F.array(
        F.col("value"), F.lit('[{"message":[{"id":"120","value":"invalid"}]}]'), F.lit('[{"total":0},[]]')
    )).alias("value"))


PAGE_ROWS = f"""SELECT concat('U', user_id) AS entity_code, concat('user ', user_id) AS entity_name,
    CAST(year(ts) AS INTEGER) AS year, event_type AS indicator, value
    FROM events WHERE value IS NOT NULL AND {B.sql_bucket('event_id', 'value')} >= 10"""


@query("s1_parse_pages", PAGE_ROWS)
def parse_pages(spark, sf_dir):
    return pages.parse_pages(landed_pages(spark, sf_dir))


@query("s2_collect_indicators", f"""SELECT indicator, entity_code, count(*) AS n, round(avg(value), 6) AS value
    FROM ({PAGE_ROWS}) WHERE year BETWEEN 2024 AND 2030 GROUP BY 1, 2""")
def collect_indicators(spark, sf_dir):
    long = pages.collect_indicators(spark, page_files(spark, sf_dir), 2024, 2030)
    return long.groupBy("indicator", "entity_code").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("value"))


def page_files(spark, sf_dir) -> str:
    """A folder with every page as a file of its own."""
    path = fresh_path(spark, "landed-pages")
    pages.land_pages(landed_pages(spark, sf_dir), path)
    return path


@query("s2b_page_problems", """SELECT indicator, problem, n * CASE problem WHEN 'ok' THEN 2 ELSE 1 END AS pages FROM (
    SELECT event_type AS indicator, count(DISTINCT floor(event_id / 200)) AS n FROM events GROUP BY 1) CROSS JOIN (SELECT unnest(['ok', 'error message']) AS problem)""")
def page_problems(spark, sf_dir):
    return pages.page_problems(pages.read_pages(spark, page_files(spark, sf_dir)))


@query("s3_table_scan", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total,
    CAST(min(o_orderdate) AS VARCHAR) AS first_date FROM orders GROUP BY 1""")
def table_scan(spark, sf_dir):
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    scanned = tables.read_table(spark, f"{sf_dir}/orders.parquet", schema)
    return scanned.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").cast("string").alias("first_date")
    )


@query("s4_feature_list_scan", with_sql("frame_nulls", " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, count({c}) AS present FROM frame_nulls" for i, c in enumerate(NULLABLE))))
def feature_list_scan(spark, sf_dir):
    path = fresh_path(spark, "feature-list")
    tables.write_feature_list(spark, NULLABLE, path)
    df = B.frame_nulls(spark, sf_dir)
    names = tables.read_feature_list(spark, path, df, "target")
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("present")) for i, c in enumerate(names)
    ])))


@query("s5_json_mapping", "SELECT c_name AS code, c_mktsegment AS label FROM customer")
def json_mapping(spark, sf_dir):
    texts = B.table(spark, sf_dir, "customer").select(
        F.to_json(F.create_map(F.lit("_comment"), F.lit("segments"), F.col("c_name"), F.col("c_mktsegment"))).alias("text")
    )
    return dictionaries.parse_mapping(texts, "text")


CATEGORY_ROWS = [("money", "price_avg"), ("money", "total"), ("money", "bal"), ("rates", "disc_avg"), ("rates", "tax_avg")]
CATEGORY_SQL = "(VALUES " + ", ".join(f"('{c}', '{f}')" for c, f in CATEGORY_ROWS) + ") AS c(category, feature)"


def category_dimension(spark):
    return spark.createDataFrame(CATEGORY_ROWS, "category string, feature string")


@query("s6_dictionaries", with_sql("frame_nulls", f"""
    SELECT p.feature, p.missing, coalesce(c.category, 'uncategorised') AS category
    FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing FROM frame_nulls" for c in NULLABLE)}) p
    LEFT JOIN {CATEGORY_SQL} ON c.feature = p.feature"""))
def dictionary_join(spark, sf_dir):
    counted = quality.missing_summary(B.frame_nulls(spark, sf_dir), NULLABLE, only_missing=False)
    listed = counted.select(F.col("variable").alias("feature"), "missing")
    return lookup.with_category(listed, category_dimension(spark)).select("feature", "missing", "category")


PANEL_SQL = with_sql("panel", f"SELECT entity, year, n_rows, {q(['price_avg', 'target'], 4)} FROM panel")


@query("s8_csv_sink", PANEL_SQL)
def csv_sink(spark, sf_dir):
    path = fresh_path(spark, "panel-csv")
    source = B.panel(spark, sf_dir).select("entity", "year", "n_rows", "price_avg", "target")
    tables.write_table(source, path, "csv")
    return rounded(tables.read_table(spark, path, source.schema, "csv"), 4)


# ------------------------------------------------------------------ projections and filters


@query("p1_nested_projection", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    CAST(value AS DOUBLE) AS value FROM events""")
def nested_projection(spark, sf_dir):
    parsed = F.from_json("props", "k string")
    return B.table(spark, sf_dir, "events").select("event_id", parsed["k"].cast("int").alias("k"), F.col("value").cast("double"))


@query("p2_drop_null_values", f"""SELECT event_type, count(*) AS n FROM events
    WHERE value IS NOT NULL AND {B.sql_bucket('event_id', 'value')} >= 10 GROUP BY 1""")
def drop_null_values(spark, sf_dir):
    kept = F.when(hash_bucket(F.col("event_id"), "value") >= 10, F.col("value"))
    long = B.table(spark, sf_dir, "events").select("event_type", kept.alias("value"))
    return long.where(F.col("value").isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p3_year_range", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders
    WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1""")
def year_range(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders").select("o_orderdate")
    # the range is stated on the stored column too, so row groups are skipped
    bounded = orders.where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1999-01-01"))
    return panel.between_years(bounded.select(F.year("o_orderdate").alias("year")), "year", 1996, 1998).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"))


@query("p4_year_feature", with_sql("frame", "SELECT year, year AS year_feature, count(*) AS n FROM frame GROUP BY 1, 2"))
def year_feature(spark, sf_dir):
    return panel.with_year_feature(B.frame(spark, sf_dir)).groupBy("year", "year_feature").agg(F.count(F.lit(1)).alias("n"))


@query("p5_known_target", with_sql("frame_nulls", "SELECT row_id, round(target, 4) AS target FROM frame_nulls WHERE target IS NOT NULL"))
def known_target(spark, sf_dir):
    return quality.known_target(B.frame_nulls(spark, sf_dir), "target").select("row_id", r("target", 4).alias("target"))


@query("p8_drop_sparse_columns", with_sql("frame_nulls", f"SELECT row_id, {q(['qty_avg', 'disc_avg', 'bal', 'total'], 4)} FROM frame_nulls"))
def drop_sparse(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir).select("row_id", "qty_avg", "tax_avg", "disc_avg", "bal", "total")
    return rounded(quality.drop_sparse_columns(df, df.columns[1:], 0.6)[0], 4)


@query("p9_drop_incomplete_rows", with_sql("event_panel",
    f"SELECT user_id, CAST(day AS VARCHAR) AS day, {q(B.EVENT_TYPES)} FROM event_panel WHERE {' AND '.join(f'{t} IS NOT NULL' for t in B.EVENT_TYPES)}"))
def drop_incomplete(spark, sf_dir):
    return day_text(rounded(quality.drop_incomplete_rows(B.event_panel(spark, sf_dir), B.EVENT_TYPES)))


OUTLIER_COLUMNS = ["n_items", "qty_avg", "tax_avg", "disc_avg", "price_avg", "bal", "total", "target"]
_bounds = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in OUTLIER_COLUMNS)


@query("p10_iqr_filter", with_sql("frame", f"""SELECT row_id, round(target, 4) AS target FROM frame, (SELECT {_bounds} FROM frame) b
    WHERE {' AND '.join(f'{c} BETWEEN {c}_1 - 1.0 * ({c}_3 - {c}_1) AND {c}_3 + 1.0 * ({c}_3 - {c}_1)' for c in OUTLIER_COLUMNS)}"""))
def iqr_filter(spark, sf_dir):
    return quality.iqr_filter(B.frame(spark, sf_dir), OUTLIER_COLUMNS, 1.0).select("row_id", r("target", 4).alias("target"))


_moments = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in OUTLIER_COLUMNS)


@query("p11_zscore_filter", with_sql("frame", f"""SELECT row_id, round(target, 4) AS target FROM frame, (SELECT {_moments} FROM frame) b
    WHERE {' AND '.join(f'abs(({c} - {c}_m) / nullif({c}_s, 0)) < 3' for c in OUTLIER_COLUMNS)}"""))
def zscore_filter(spark, sf_dir):
    return quality.zscore_filter(B.frame(spark, sf_dir), OUTLIER_COLUMNS, 3.0).select("row_id", r("target", 4).alias("target"))


_band_case = "CASE " + " ".join(
    f"WHEN target >= {lo}" + (f" AND target < {hi}" if hi is not None else "") + f" THEN '{label}'" for lo, hi, label in B.BANDS
) + " END"


@query("p12_band_mask", with_sql("frame", "SELECT row_id, round(target, 4) AS target FROM frame WHERE target >= 1500 AND target < 2500"))
def band_mask(spark, sf_dir):
    low, high, _ = B.BANDS[1]
    df = B.frame(spark, sf_dir).where((F.col("target") >= low) & (F.col("target") < high))
    return df.select("row_id", r("target", 4).alias("target"))


@query("p13_segment_mask", with_sql(["frame", "region_dim"], """SELECT row_id, round(target, 4) AS target FROM frame
    JOIN region_dim ON code = entity WHERE label = 'EUROPE'"""))
def segment_mask(spark, sf_dir):
    labelled = segments.lookup_segment(B.frame(spark, sf_dir), "entity", B.region_dimension(spark, sf_dir))
    return labelled.where(F.col("segment") == "EUROPE").select("row_id", r("target", 4).alias("target"))


@query("p14_minimum_segment", with_sql("frame", """SELECT row_id, entity, year, month FROM frame
    WHERE (entity, year, month) IN (SELECT (entity, year, month) FROM frame GROUP BY entity, year, month HAVING count(*) >= 8)"""))
def minimum_segment(spark, sf_dir):
    df = B.frame(spark, sf_dir).select("row_id", "entity", "year", "month")
    df = df.withColumn("segment", F.concat_ws("|", "entity", "year", "month"))
    return segments.large_segments(df, "segment", 8).drop("segment")


@query("p16_category_features", with_sql("frame", f"""SELECT f.pos, f.feature, s.mean FROM
    ({' UNION ALL '.join(f"SELECT {i} AS pos, '{c}' AS feature" for i, c in enumerate(B.FEATURES))}) f
    JOIN {CATEGORY_SQL} ON c.feature = f.feature AND c.category = 'money'
    JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean FROM frame" for c in B.FEATURES)}) s
      ON s.feature = f.feature"""))
def category_features(spark, sf_dir):
    chosen = lookup.of_category(tables.feature_list(spark, B.FEATURES), category_dimension(spark), "money")
    described = quality.describe(B.frame(spark, sf_dir), B.FEATURES).select(F.col("variable").alias("feature"), r("mean", 4).alias("mean"))
    return chosen.join(described, "feature").select("pos", "feature", "mean")


@query("p17_feature_lookup", with_sql("frame", "SELECT 'price_avg' AS feature, count(price_avg) AS present, round(avg(price_avg), 4) AS mean FROM frame"))
def feature_lookup(spark, sf_dir):
    name = lookup.first_matching(tables.feature_list(spark, B.FEATURES), "PRICE").first()["feature"]
    return B.frame(spark, sf_dir).agg(F.count(name).alias("present"), r(F.avg(name), 4).alias("mean")).select(
        F.lit(name).alias("feature"), "present", "mean")


# ------------------------------------------------------------------ joins


@query("j1_outer_join_pivot", with_sql("event_panel", f"SELECT user_id, CAST(day AS VARCHAR) AS day, {q(B.EVENT_TYPES)} FROM event_panel"))
def outer_join_pivot(spark, sf_dir):
    long = B.event_long(spark, sf_dir)
    return day_text(rounded(panel.widen(long, ["user_id", "day"], "event_type", "value", B.EVENT_TYPES)))


@query("j1b_outer_join_frames", with_sql("event_panel", f"SELECT user_id, CAST(day AS VARCHAR) AS day, {q(B.EVENT_TYPES)} FROM event_panel"))
def outer_join_frames(spark, sf_dir):
    long = B.event_long(spark, sf_dir)
    parts = [
        long.where(F.col("event_type") == t).select("user_id", "day", F.col("value").alias(t)) for t in B.EVENT_TYPES
    ]
    return day_text(rounded(panel.outer_join_all(parts, ["user_id", "day"])))


@query("j2_region_lookup", with_sql(["frame", "region_dim"], """SELECT row_id, entity, coalesce(label, 'Other') AS segment
    FROM frame LEFT JOIN region_dim ON code = entity"""))
def region_lookup(spark, sf_dir):
    df = B.frame(spark, sf_dir).select("row_id", "entity")
    return segments.lookup_segment(df, "entity", B.region_dimension(spark, sf_dir)).select("row_id", "entity", "segment")


NAME_ROWS = [("n_items", "Number of items"), ("QTY_AVG", "Average quantity"), ("price_avg", "Average price"),
             ("bal", "Account balance"), ("total", "Order total (%)")]
NAME_SQL = "(VALUES " + ", ".join(f"('{c}', '{d}')" for c, d in NAME_ROWS) + ") AS d(code, display)"


def _title(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({expr}, '_', ' '), ' '), "
            "lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')")


def name_dimension(spark):
    return spark.createDataFrame(NAME_ROWS, "code string, display string")


def display_sql(expr: str) -> str:
    return (f"coalesce((SELECT display FROM {NAME_SQL} WHERE d.code = {expr}), "
            f"(SELECT min_by(display, d.code) FROM {NAME_SQL} WHERE upper(d.code) = upper({expr})), {_title(expr)})")


_long_counts = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS present FROM frame_nulls" for c in NULLABLE)


@query("j3_display_names", with_sql("frame_nulls", f"SELECT p.feature, p.present, {display_sql('p.feature')} AS display FROM ({_long_counts}) p"))
def display_names(spark, sf_dir):
    counts = B.frame_nulls(spark, sf_dir).agg(*[F.count(c).alias(c) for c in NULLABLE])
    long = counts.unpivot([], NULLABLE, "feature", "present")
    return lookup.display_name(long, "feature", name_dimension(spark)).select("feature", "present", "display")


LABEL_ROWS = [("M_CONST", "Constant"), ("m_entity", "Entity mean"), ("m_lin", "Straight line"), ("m_prod", "Product")]
LABEL_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LABEL_ROWS) + ") AS l(key, label)"


def label_dimension(spark):
    return spark.createDataFrame(LABEL_ROWS, "key string, label string")


def label_sql(expr: str) -> str:
    return f"coalesce((SELECT label FROM {LABEL_SQL} WHERE lower(l.key) = lower({expr})), {_title(expr)})"


@query("j4_model_labels", with_sql("predictions", f"""SELECT model, n, {label_sql('model')} AS label_text
    FROM (SELECT model, count(*) AS n FROM predictions GROUP BY 1) p"""))
def model_labels(spark, sf_dir):
    counts = B.predictions(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return lookup.model_label(counts, "model", label_dimension(spark)).select("model", "n", "label_text")


# ------------------------------------------------------------------ aggregates


@query("a1_stage_counts", with_sql("frame_nulls", f"""SELECT step, stage, n AS rows, n - lag(n) OVER (ORDER BY step) AS change FROM (
    SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM frame_nulls UNION ALL
    SELECT 1, 'known target', count(*) FROM frame_nulls WHERE target IS NOT NULL UNION ALL
    SELECT 2, 'complete', count(*) FROM frame_nulls WHERE target IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in KEPT)})"""))
def stage_counts(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir)
    known = quality.known_target(df, "target")
    return quality.stage_audit({"all": df, "known target": known, "complete": quality.drop_incomplete_rows(known, KEPT)})


@query("a2_distinct_entities", "SELECT count(*) AS rows, count(DISTINCT user_id) AS entities FROM events")
def distinct_entities(spark, sf_dir):
    return panel.panel_size(B.table(spark, sf_dir, "events"), "user_id")


@query("a3_distinct_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY 1")
def distinct_years(spark, sf_dir):
    return panel.distinct_years(B.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


def _missing_sql(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS percentage FROM {relation}"
        for c in columns)


@query("a4_missing_summary", with_sql("event_panel", f"SELECT * FROM ({_missing_sql('event_panel', ['user_id', *B.EVENT_TYPES])}) WHERE missing > 0"))
def missing_summary(spark, sf_dir):
    return rounded(quality.missing_summary(B.event_panel(spark, sf_dir), ["user_id", *B.EVENT_TYPES]))


@query("a5_missing_shares", with_sql("frame_nulls", f"SELECT * FROM ({_missing_sql('frame_nulls', NULLABLE)}) WHERE percentage > 30"))
def missing_shares(spark, sf_dir):
    found = quality.missing_summary(B.frame_nulls(spark, sf_dir), NULLABLE)
    return rounded(found.where(F.col("percentage") > 30))


@query("a6_remaining_missing", with_sql("event_panel", f"SELECT CAST(sum({' + '.join(f'CASE WHEN {t} IS NULL THEN 1 ELSE 0 END' for t in B.EVENT_TYPES)}) AS BIGINT) AS missing_cells FROM event_panel"))
def remaining_missing(spark, sf_dir):
    return quality.remaining_missing(B.event_panel(spark, sf_dir), B.EVENT_TYPES)


@query("a7_quartiles", with_sql("frame_nulls", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {', '.join(f'round(quantile_cont({c}, {p}), 6) AS q{j}' for j, p in enumerate([0.25, 0.5, 0.75]))} FROM frame_nulls"
    for c in NULLABLE)))
def quartiles(spark, sf_dir):
    return rounded(quantile_relation(B.frame_nulls(spark, sf_dir), NULLABLE, [0.25, 0.5, 0.75]))


@query("a8_target_summary", with_sql("frame", """SELECT round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std,
    round(min(target), 6) AS min, round(max(target), 6) AS max FROM frame"""))
def target_summary(spark, sf_dir):
    return rounded(quality.summary(B.frame(spark, sf_dir), "target"))


def describe_sql(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM {relation}"
        for c in columns)


@query("a9_descriptive_table", with_sql("frame_nulls", describe_sql("frame_nulls", [*NULLABLE, "target"])))
def descriptive_table(spark, sf_dir):
    return rounded(quality.describe(B.frame_nulls(spark, sf_dir), [*NULLABLE, "target"]))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known target, sparse columns dropped, medians filled, features derived, split and region attached."""
    df = quality.known_target(B.frame_nulls(spark, sf_dir), "target")
    df, _ = impute.handle_missing(df, NULLABLE, "median", 0.6)
    df, _ = derive(df, FEATURE_SPECS)
    df = splits.with_split(df, "row_id")
    return segments.lookup_segment(df, "entity", B.region_dimension(spark, sf_dir))


def regional_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = prepared(spark, sf_dir).groupBy("segment", "split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean"), F.stddev_pop("target").alias("std"),
        F.avg("bal").alias("bal_mean"), F.avg("flag_diversity").alias("diversity_mean"),
    )
    return rounded(summary)


@query("a10_segment_summary", with_sql(["split_frame", "frame_nulls", "region_dim"], f"""
    SELECT coalesce(label, 'Other') AS segment, f.split, count(*) AS n, round(avg(k.target), 6) AS mean,
           round(stddev_pop(k.target), 6) AS std, round(avg(coalesce(k.bal, m.bal)), 6) AS bal_mean,
           round(avg({FEATURE_SQL['flag_diversity'].replace('ext_', 'f.ext_')}), 6) AS diversity_mean
    FROM frame_nulls k JOIN split_frame f ON f.row_id = k.row_id
    CROSS JOIN (SELECT median(bal) AS bal FROM frame_nulls WHERE target IS NOT NULL) m
    LEFT JOIN region_dim ON code = f.entity WHERE k.target IS NOT NULL GROUP BY 1, 2"""))
def segment_summary(spark, sf_dir):
    return regional_summary(spark, sf_dir)


_quartile_case = """CASE WHEN price_avg <= q1 THEN 'Low' WHEN price_avg <= q2 THEN 'Lower-Middle'
    WHEN price_avg <= q3 THEN 'Upper-Middle' WHEN price_avg > q3 THEN 'High' END"""


@query("a11_segment_counts", with_sql("frame", f"""SELECT {_quartile_case} AS segment, count(*) AS n
    FROM frame, (SELECT {QUARTILES.format(c='price_avg')} FROM frame) b GROUP BY 1"""))
def segment_counts(spark, sf_dir):
    df = segments.quartile_segment(B.frame(spark, sf_dir).select("price_avg"), "price_avg")
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy("segment")


@query("a12_unmapped_keys", with_sql(["frame", "region_dim"], """
    SELECT CAST(sum(n) AS BIGINT) AS unmatched_rows, count(*) AS unmatched_keys,
           array_to_string(list_slice(list(entity ORDER BY entity), 1, 3), ',') AS first_keys,
           greatest(count(*) - 3, 0) AS more_keys
    FROM (SELECT entity, count(*) AS n FROM frame WHERE entity NOT IN (SELECT code FROM region_dim) GROUP BY 1)"""))
def unmapped_keys(spark, sf_dir):
    return segments.unmatched_keys(B.frame(spark, sf_dir), "entity", B.region_dimension(spark, sf_dir), 3)


# ------------------------------------------------------------------ derivation


def _feature_query(key: str, name: str) -> None:
    spec = next(s for s in FEATURE_SPECS if s["name"] == name)

    @query(key, with_sql("frame", f"SELECT row_id, round({FEATURE_SQL[name]}, 6) AS {name} FROM frame"))
    def run(spark, sf_dir):
        return rounded(derive(B.frame(spark, sf_dir), [spec])[0].select("row_id", name))


for _key, _name in (("f1_ratio_scaled", "price_rate"), ("f2_log1p", "log_price"), ("f3_sum", "ext_an"),
                    ("f4_ratio", "ext_ratio"), ("f5_difference", "rate_gap"), ("f6_diversity", "flag_diversity")):
    _feature_query(_key, _name)


@query("f7_feature_runner", with_sql("frame", f"""SELECT row_id, round(({FEATURE_SQL['ext_an']}) / nullif(total, 0), 6) AS an_share,
    round(ln(1 + ({FEATURE_SQL['ext_an']}) / nullif(total, 0)), 6) AS log_share FROM frame"""))
def feature_runner(spark, sf_dir):
    specs = [
        FEATURE_SPECS[2],
        {"name": "an_share", "operation": "ratio", "dependencies": ["ext_an", "total"],
         "parameters": {"numerator": "ext_an", "denominator": "total"}},
        {"name": "log_share", "operation": "log1p", "dependencies": ["an_share"], "parameters": {"source": "an_share"}},
        {"name": "skipped", "operation": "log1p", "dependencies": ["absent"], "parameters": {"source": "absent"}},
    ]
    return rounded(derive(B.frame(spark, sf_dir), specs)[0].select("row_id", "an_share", "log_share"))


@query("f8_shipped_specs", with_sql("frame", f"SELECT row_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in FEATURE_SQL.items())} FROM frame"))
def shipped_specs(spark, sf_dir):
    return rounded(derive(B.frame(spark, sf_dir), FEATURE_SPECS)[0].select("row_id", *FEATURE_SQL))


# indicator codes of the shipped specs, played by columns of the frame
ROLES = {
    "SP.URB.TOTL": "n_items", "SP.POP.TOTL": "qty_avg", "NY.GDP.PCAP.CD": "total", "NE.EXP.GNFS.ZS": "ext_a", "NE.IMP.GNFS.ZS": "ext_n",
    "SH.XPD.CHEX.GD.ZS": "price_avg", "SE.XPD.TOTL.GD.ZS": "bal", "SL.TLF.CACT.MA.ZS": "disc_avg", "SL.TLF.CACT.FE.ZS": "tax_avg",
    "NV.AGR.TOTL.ZS": "ext_a", "NV.IND.TOTL.ZS": "ext_n", "NV.SRV.TOTL.ZS": "ext_r",
}


@query("f8b_indicator_specs", with_sql("frame", f"""SELECT row_id, round(n_items / nullif(qty_avg, 0) * 100, 6) AS urbanization_rate,
    round(CASE WHEN total > -1 THEN ln(1 + total) END, 6) AS log_gdp_per_capita, round(coalesce(ext_a, 0) + coalesce(ext_n, 0), 6) AS trade_openness,
    round(price_avg / nullif(bal, 0), 6) AS health_to_edu_ratio, round(disc_avg - tax_avg, 6) AS gender_labor_gap,
    round({FEATURE_SQL['flag_diversity']}, 6) AS economic_diversity FROM frame"""))
def indicator_specs(spark, sf_dir):
    coded = B.frame(spark, sf_dir).select("row_id", *[F.col(c).alias(code) for code, c in ROLES.items()])
    derived, skipped = derive(coded, fixed.FEATURE_SPECS)
    assert not skipped
    return rounded(derived.select("row_id", *[s["name"] for s in fixed.FEATURE_SPECS]))


@query("f10_quartile_bins", with_sql("frame", f"""SELECT row_id, {_quartile_case} AS segment
    FROM frame, (SELECT {QUARTILES.format(c='price_avg')} FROM frame) b"""))
def quartile_bins(spark, sf_dir):
    return segments.quartile_segment(B.frame(spark, sf_dir).select("row_id", "price_avg"), "price_avg").select("row_id", "segment")


@query("f11_bands", with_sql("frame", f"SELECT row_id, {_band_case} AS segment FROM frame"))
def bands(spark, sf_dir):
    return B.frame(spark, sf_dir).select("row_id", S.band(F.col("target"), B.BANDS).alias("segment"))


@query("f15_title_case", f"SELECT event_type, n, {_title('k')} AS title FROM (SELECT event_type, concat(event_type, '_count') AS k, count(*) AS n FROM events GROUP BY 1, 2)")
def title_case(spark, sf_dir):
    counts = B.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "n", S.title_case(F.concat("event_type", F.lit("_count"))).alias("title"))


@query("f16_ellipsis", """SELECT p_partkey, CASE WHEN length(p_name || ' / ' || p_type) > 15
    THEN substr(p_name || ' / ' || p_type, 1, 15) || '...' ELSE p_name || ' / ' || p_type END AS short_name,
    substr(p_name, 1, 8) AS cut_name FROM part""")
def ellipsis(spark, sf_dir):
    text = F.concat_ws(" / ", "p_name", "p_type")
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", S.ellipsis(text, 15).alias("short_name"), F.substring("p_name", 1, 8).alias("cut_name"))


@query("f17_formatting", """SELECT p_brand, printf('[%.2f, %.2f]', min(p_retailprice), max(p_retailprice)) AS span,
    regexp_replace(concat(p_brand, '_%'), '([%&_])', '\\\\\\1', 'g') AS escaped FROM part GROUP BY p_brand""")
def formatting(spark, sf_dir):
    ends = B.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return ends.select("p_brand", S.interval(F.col("lo"), F.col("hi"), 2).alias("span"),
                       S.escape_special(F.concat("p_brand", F.lit("_%"))).alias("escaped"))


@query("f19_adaptive_fraction", """SELECT user_id, count(*) AS n,
    round(least(0.2::DOUBLE, greatest(0.1::DOUBLE, 10.0::DOUBLE / count(*))), 6) AS test_fraction FROM events GROUP BY 1""")
def adaptive_fraction(spark, sf_dir):
    counts = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("test_fraction", r(S.adaptive_fraction(F.col("n"))))


# ------------------------------------------------------------------ imputation


@query("i1_mean_impute", with_sql("frame_nulls", f"""SELECT row_id, {', '.join(f'round(coalesce(f.{c}, m.{c}), 4) AS {c}' for c in KEPT)}
    FROM frame_nulls f, (SELECT {', '.join(f'avg({c}) AS {c}' for c in KEPT)} FROM frame_nulls) m"""))
def mean_impute(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir).select("row_id", *KEPT)
    return rounded(impute.mean_impute(df, KEPT), 4)


@query("i2_median_impute", with_sql("frame_nulls", f"""SELECT row_id, {', '.join(f'round(coalesce(f.{c}, m.{c}), 4) AS {c}' for c in KEPT)}
    FROM frame_nulls f, (SELECT {', '.join(f'median({c}) AS {c}' for c in KEPT)} FROM frame_nulls) m"""))
def median_impute(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir).select("row_id", *KEPT)
    return rounded(impute.median_impute(df, KEPT), 4)


_shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in KEPT)
_squares = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in KEPT)
_lacking = [c for c in KEPT if c in B.NULL_RATES]


def _knn_sql(final: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT row_id, '{f}' AS feature, unnest(min_by({{'donor': donor, 'd2': d2, 'value': value}}, {{'d2': d2, 'donor': donor}}, 5)) AS hit
        FROM (SELECT r.row_id, d.row_id AS donor, d.{f} AS value, {len(KEPT)}.0::DOUBLE / nullif({_shared}, 0) * ({_squares}) AS d2
              FROM frame_nulls r JOIN frame_nulls d ON r.{f} IS NULL AND d.{f} IS NOT NULL)
        WHERE d2 IS NOT NULL GROUP BY row_id"""
        for f in _lacking)
    return with_sql("frame_nulls", final, hits=parts)


NEIGHBOURS_SQL = _knn_sql("""SELECT row_id, feature, hit.donor AS donor, round(sqrt(hit.d2), 4) AS distance,
    round(hit.value, 4) AS value FROM hits""")


@query("j5_knn_join", NEIGHBOURS_SQL)
def knn_join(spark, sf_dir):
    found = impute_neighbours(spark, sf_dir)
    return rounded(found.select("row_id", "feature", "donor", "distance", "value"), 4)


def impute_neighbours(spark, sf_dir):
    from panelkit.operators.neighbours import nearest_donors

    return nearest_donors(B.frame_nulls(spark, sf_dir), "row_id", KEPT, 5)


@query("w5_neighbour_ranks", _knn_sql("""SELECT row_id, feature, hit.donor AS donor,
    CAST(row_number() OVER (PARTITION BY row_id, feature ORDER BY hit.d2, hit.donor) AS INTEGER) AS rank FROM hits"""))
def neighbour_ranks(spark, sf_dir):
    return impute_neighbours(spark, sf_dir).select("row_id", "feature", "donor", "rank")


@query("i3_knn_impute", _knn_sql(f"""SELECT f.row_id, {', '.join(
    f"round(coalesce(f.{c}, h.{c}, m.{c}), 4) AS {c}" if c in _lacking else f"round(f.{c}, 4) AS {c}" for c in KEPT)}
    FROM frame_nulls f LEFT JOIN (SELECT row_id, {', '.join(f"avg(CASE WHEN feature = '{c}' THEN hit.value END) AS {c}" for c in _lacking)}
    FROM hits GROUP BY 1) h ON h.row_id = f.row_id CROSS JOIN (SELECT {', '.join(f'avg({c}) AS {c}' for c in _lacking)} FROM frame_nulls) m"""))
def knn_impute(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir).select("row_id", *KEPT)
    return rounded(impute.knn_impute(df, "row_id", KEPT, 5), 4)


@query("i4_handle_missing", with_sql("frame_nulls", f"SELECT row_id, {q(KEPT, 4)} FROM frame_nulls WHERE {' AND '.join(f'{c} IS NOT NULL' for c in KEPT)}"))
def handle_missing(spark, sf_dir):
    df = B.frame_nulls(spark, sf_dir).select("row_id", *NULLABLE)
    kept, columns = impute.handle_missing(df, NULLABLE, "drop", 0.6)
    return rounded(kept.select("row_id", *columns), 4)


# ------------------------------------------------------------------ splits and resampling


@query("r1_split", with_sql("split_frame", "SELECT row_id, split FROM split_frame"))
def split(spark, sf_dir):
    return splits.with_split(B.frame(spark, sf_dir).select("row_id"), "row_id").select("row_id", "split")


_uniform = "CAST(('0x' || substr(md5(concat(row_id, ':{salt}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("r2_segment_split", with_sql("frame", f"""SELECT row_id, segment, round(f, 6) AS test_fraction,
    CASE WHEN {_uniform.format(salt='42')} < 1 - f THEN 'train' ELSE 'test' END AS split
    FROM (SELECT row_id, concat(entity, '|', year) AS segment,
          least(0.2::DOUBLE, greatest(0.1::DOUBLE, 10.0::DOUBLE / count(*) OVER (PARTITION BY entity, year))) AS f FROM frame)"""))
def segment_split(spark, sf_dir):
    df = B.frame(spark, sf_dir).select("row_id", F.concat_ws("|", "entity", "year").alias("segment"))
    return splits.with_segment_split(df, "row_id", "segment").select(
        "row_id", "segment", r("test_fraction").alias("test_fraction"), "split")


@query("r3_folds", with_sql("frame", f"SELECT row_id, CAST({B.sql_bucket('row_id', 'fold42', 5)} AS INTEGER) AS fold FROM frame"))
def folds(spark, sf_dir):
    return B.frame(spark, sf_dir).select("row_id", splits.fold_column("row_id").alias("fold"))


def _poisson_sql(u: str) -> str:
    cumulative, term, cases = 0.0, 0.36787944117144233, []
    for k in range(12):
        if k:
            term /= k
        cumulative += term
        cases.append(f"WHEN {u} < {cumulative!r}::DOUBLE THEN {k}")
    return f"CASE {' '.join(cases)} ELSE 12 END"


@query("r4_bootstrap_weights", with_sql("frame", f"""SELECT row_id, CAST(b.b AS INTEGER) AS replicate, CAST({_poisson_sql('u')} AS INTEGER) AS weight
    FROM (SELECT row_id, b, CAST(('0x' || substr(md5(concat(row_id, ':boot42:', b)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
          FROM frame CROSS JOIN (SELECT unnest(range(10)) AS b)) b"""))
def bootstrap_weights(spark, sf_dir):
    weights = splits.bootstrap_weights("row_id", 10)
    return B.frame(spark, sf_dir).select("row_id", F.posexplode(weights).alias("replicate", "weight"))


_shuffle_sql = """SELECT p.replicate, b.row_id, round(p.price_avg, 4) AS price_avg_shuffled, round(p.disc_avg, 6) AS disc_avg_shuffled
    FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':base42'))) AS pos FROM frame) b
    JOIN (SELECT CAST(k AS INTEGER) AS replicate, price_avg, disc_avg,
                 row_number() OVER (PARTITION BY k ORDER BY md5(concat(row_id, ':perm42:', k))) AS pos
          FROM frame CROSS JOIN (SELECT unnest(range(3)) AS k)) p ON p.pos = b.pos"""


def _shuffle(spark, sf_dir):
    df = B.frame(spark, sf_dir).select("row_id", "price_avg", "disc_avg")
    shuffled = splits.shuffled_values(df, "row_id", ["price_avg", "disc_avg"], 3)
    return shuffled.select("replicate", "row_id", r("price_avg_shuffled", 4).alias("price_avg_shuffled"),
                           r("disc_avg_shuffled").alias("disc_avg_shuffled"))


@query("w6_column_shuffle", with_sql("frame", """SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':base42'))) AS position FROM frame"""))
def column_shuffle(spark, sf_dir):
    df = B.frame(spark, sf_dir).select("row_id", F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":base42"))).alias("digest"))
    return hash_positions(df, [], "digest").select("row_id", "position")


@query("r5_permutation", with_sql("frame", _shuffle_sql))
def permutation(spark, sf_dir):
    return _shuffle(spark, sf_dir)


# ------------------------------------------------------------------ small results


@query("o1_sorted_missing", with_sql("frame_nulls", f"""SELECT *, CAST(row_number() OVER (ORDER BY percentage DESC, variable) AS INTEGER) AS place
    FROM ({_missing_sql('frame_nulls', NULLABLE)}) WHERE missing > 0"""))
def sorted_missing(spark, sf_dir):
    from panelkit.operators.ranks import small_rank

    found = rounded(quality.missing_summary(B.frame_nulls(spark, sf_dir), NULLABLE))
    return found.withColumn("place", small_rank([], [F.col("percentage").desc(), F.col("variable")])).orderBy("place")


@query("o6_preview", with_sql("panel", f"SELECT entity, year, n_rows, {q(['target'], 4)} FROM panel ORDER BY entity, year LIMIT 5"))
def preview(spark, sf_dir):
    return rounded(panel.preview(B.panel(spark, sf_dir).select("entity", "year", "n_rows", "target"), ["entity", "year"]), 4)


@query("a22_fingerprint", """SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment,
    '","c_nationkey":', c_nationkey, '}')), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM customer""")
def fingerprint(spark, sf_dir):
    from panelkit.plans.reuse import fingerprint as compute

    df = B.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return compute(df)
