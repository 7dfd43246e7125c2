"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import materialise

SPACE = r"\x20\x09-\x0D"
WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 23
#: Rows of a source are dealt to strata of about this size; each stratum meets its share of the target on its own.
STRATUM_ROWS = 256
#: Strata of a source that hand on what a whole document takes too much or too little; the next chain starts anew.
CHAIN = 256

ADDED = ["size", "source_size", "target", "taken"]


def word_count(text: str | Column) -> Column:
    """Number of runs of non-space characters; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    marks = F.regexp_replace(column, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x")
    return F.when(column.rlike(f"[^{SPACE}]"), F.length(marks)).otherwise(F.lit(0)).cast("long")


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` (distinct in ``column``) with their position in code-point order, from 0, null last; no task sees all rows."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, F.col(column).asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "dealt-sources")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last())
    placed = dealt.withColumn("__in", F.row_number().over(inside) - 1).join(offsets, "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)


def water_fill(sources: DataFrame, total: int | None = None, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (``source_size, weight``) with ``target``: shares of ``total`` by weight, clamped at ``epochs`` sizes.

    Each round clamps the sources whose share exceeds their cap and deals what is left to the others by weight, until
    no share is above its cap. ``total`` is the sum of all sizes unless given; if all caps together are less, every target is its cap.
    """
    cap = F.col("source_size") * F.lit(epochs)
    if total is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, -1.0
    while True:
        open_ = F.lit(free < 0) | (cap >= F.lit(level) * F.col("weight"))
        row = sources.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, cap)).alias("c")).first()
        weight, clamped = float(row["w"] or 0), float(row["c"] or 0)
        if weight == free or not weight:
            break
        free, level = weight, (total - clamped) / weight
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when((cap < share) | F.lit(not weight), cap).otherwise(share).cast("double"))


def _mixed(docs: DataFrame, key: str, text: str, source: str, weights: Sequence[float], epochs: float, seed: int) -> DataFrame:
    """What ``mix_sources`` gives, with the columns it is made from."""
    docs = docs.drop(*ADDED).withColumn("size", word_count(text))
    sources = materialise(docs.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs")), "source-sizes")
    placed = numbered(sources, source, "__place")
    turn = F.array(*[F.lit(w) for w in weights])
    weighted = materialise(placed.withColumn("weight", F.get(turn, F.pmod("__place", F.lit(len(weights))).cast("int"))), "weights")
    targets = water_fill(weighted, None, epochs).withColumnRenamed(source, "__source").drop("weight", "__place")
    joined = docs.join(targets, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    strata = F.ceil(F.col("__docs") / F.lit(STRATUM_ROWS))
    dealt = joined.withColumn("__rate", rate).withColumn("__order", digest).withColumn(
        "__stratum", F.pmod(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"), strata))
    own = Window.partitionBy(source, "__stratum")
    earlier = own.orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor((F.col("__rate") - F.floor("__rate")) * F.sum("size").over(own) + F.lit(0.5))
    left = budget - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return dealt.withColumn("__part", part).withColumn("taken", (F.floor("__rate") * F.col("size") + F.col("__part")).cast("long"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source) and ``taken`` (words the mix takes, repeats counted).

    Sources in code-point order, null last (null is a source of its own), weigh ``weights`` in turn; they share the sum of all sizes
    by ``water_fill``. A source takes each document ``floor(target / source_size)`` times; of the rest of its target every stratum takes
    whole documents in the order of a seeded hash of the id, and of the last one only the words that are left. No document exceeds
    ``ceil(epochs)`` sizes. Null and wordless texts have size 0 and are not taken. Rows may repeat. Input columns called like
    a result column are replaced.
    """
    return _mixed(docs, key, text, source, weights, epochs, seed).drop("__rate", "__order", "__stratum", "__docs", "__part")


def mix_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``mix_sources`` in whole documents: ``taken`` is a multiple of ``size``.

    The document of a stratum that ``mix_sources`` takes a part of is taken once more or not, by a draw from the hash of its id whose
    chance is that part, plus what the strata before it in the chain are short, as a share of its size.
    """
    mixed = _mixed(docs, key, text, source, weights, epochs, seed)
    border = (F.col("__part") > 0) & (F.col("__part") < F.col("size"))
    draw = F.conv(F.substring("__order", 9, 8), 16, 10).cast("double") / F.lit(2.0**32)
    chained = mixed.where(border).groupBy(F.col(source).alias("__source"), F.floor(F.col("__stratum") / F.lit(CHAIN)).alias("__chain")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__stratum").alias("stratum"), "size", F.col("__part").alias("part"), draw.alias("draw")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("owed"), F.array().cast("array<bigint>").alias("whole"))

    def step(a: Column, x: Column) -> Column:
        owed = a["owed"] + x["part"]
        take = owed > x["draw"] * x["size"]
        return F.struct(F.when(take, owed - x["size"]).otherwise(owed).cast("long").alias("owed"),
                        F.when(take, F.concat(a["whole"], F.array(x["stratum"]))).otherwise(a["whole"]).alias("whole"))

    drawn = chained.select("__source", F.explode(F.aggregate("all", start, step)["whole"]).alias("__chosen"))
    drawn = materialise(drawn.withColumn("__once", F.lit(1)), "whole-documents")
    found = mixed.join(drawn, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__stratum") == F.col("__chosen")), "left")
    part = F.when(border, F.coalesce("__once", F.lit(0)) * F.col("size")).otherwise(F.col("__part"))
    taken = found.withColumn("taken", (F.floor("__rate") * F.col("size") + part).cast("long"))
    return taken.drop("__rate", "__order", "__stratum", "__docs", "__part", "__source", "__chosen", "__once")


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each repetition that ``taken`` holds: whole texts, then the first words of a text for what is left."""
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    rest = F.col("taken") - whole * F.col("size")
    rows = whole + F.when(rest > 0, F.lit(1)).otherwise(F.lit(0))
    spread = mixed.where("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), rows.cast("int"))))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    cut = F.array_join(F.slice(words, 1, rest.cast("int")), " ")
    return spread.withColumn(text, F.when(F.col("__copy") > whole, cut).otherwise(F.col(text))).drop("__copy")
