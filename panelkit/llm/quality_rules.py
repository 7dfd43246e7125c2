"""Quality rules with DataFrame functions only: counts of a text, and how far its histograms are from those of its language.

The common words of a language are counted over all its documents. A text's histogram over character classes and its histogram over the
common words of its language are compared, by Jensen-Shannon distance, with the language's medians, drawn towards the whole corpus' where
the language has few documents. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.mixing import SPACE
from panelkit.session import materialise, settled, sized

# Character classes, in the order in which they are taken out of a text; the last bin of the histogram is what remains.
CLASSES = {"lower": "a-z", "space": SPACE, "other": r"^\x00-\x7F", "upper": "A-Z", "points": r".,;:!?'\"()\-", "digits": "0-9", "symbols": "#*$%&|<>"}

MIN_WORDS = 50
#: Common words of a language: the most frequent ones of at most so many letters, held by at least this share of its documents (those without text count).
COMMON, COMMON_LETTERS, COMMON_SHARE = 24, 6, 0.05
#: A language's medians weigh as its documents, the corpus' as so many; bounds widen with the latter's weight.
PRIOR_DOCS = 2
#: A histogram over common words counts from so many words on, one over characters from so many characters on.
GUARD_WORDS, GUARD_CHARS = 100, 200
#: Bounds of the distances: common words alone; characters and common words together.
WORDS_ALONE, CHARS_BOTH, WORDS_BOTH = 0.29, 0.17, 0.25

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*COUNTS, "base_failed", "char_distance", "word_distance", "nearest", "kept"]
BINS = {"char_histogram": len(CLASSES) + 1, "word_histogram": COMMON + 1}


def _words(body: Column) -> Column:
    return F.array_remove(F.split(body, f"[{SPACE}]+"), "")


def common_words(docs: DataFrame, text: str, language: str) -> DataFrame:
    """``language, common``: the words that most documents of a language hold, from the most frequent on (ties in code-point order)."""
    own = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    short = F.transform(F.filter(_words(F.col(text)), lambda w: F.length(w) <= COMMON_LETTERS), F.lower)
    held = own.select(F.col(language).alias("language"), F.explode(F.array_distinct(short)).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
    sizes = docs.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("language")).agg(F.count("*").alias("docs"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    best = held.join(sizes, "language").where(F.col("n") >= COMMON_SHARE * F.col("docs")).withColumn("rank", rank).where(F.col("rank") <= COMMON)
    return best.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"))


def measured(docs: DataFrame, text: str = "text", common: str = "common") -> DataFrame:
    """``docs`` with the counts and the two histograms of each text (arrays of counts, last bin all else); ``common`` is an array of words or null."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n")
    one = docs.withColumn("__words", _words(body)).withColumn("__lines", F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))).withColumn("__left", body)
    # Each class is taken out of what the classes before have left, so that only the first pass sees the whole text.
    for name, chars in CLASSES.items():
        one = one.withColumn("__next", F.regexp_replace("__left", f"[{chars}]+", "")).withColumn(
            f"__{name}", (F.length("__left") - F.length("__next")).cast("long")).withColumn("__left", F.col("__next")).drop("__next")
    words = F.col("__words")
    # Steps are columns of their own where an array is looked at by place: inside a lambda it would be made again for each element.
    windows = F.transform(words, lambda x, k: F.xxhash64(x, F.get("__words", k + 1), F.get("__words", k + 2)))
    short = F.filter(words, lambda w: F.length(w) <= COMMON_LETTERS)
    bins = F.filter(F.transform(short, lambda w: F.array_position(F.col(common), F.lower(w))), lambda k: k > 0)
    placed = F.sort_array(F.transform("__hashes", lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
    two = one.withColumn("__hashes", F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))).withColumn(
        # Places matter only where some window is found twice.
        "__windows", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), placed).otherwise(F.array().cast("array<struct<h:bigint,k:int>>"))).withColumn(
        "__hits", F.coalesce(F.sort_array(bins), F.array().cast("array<bigint>")))
    same = lambda x, k: (x["h"] == F.get("__windows", k - 1)["h"]) | (x["h"] == F.get("__windows", k + 1)["h"])
    again = F.filter("__windows", lambda x, k: F.coalesce(same(x, k), F.lit(False)))
    # The last place of each bin in the sorted hits; the difference of two is a count.
    ends = F.filter(F.transform("__hits", lambda x, k: F.struct(x.alias("bin"), (k + 1).cast("long").alias("end"), F.get("__hits", k + 1).alias("next"))),
                    lambda r: r["next"].isNull() | (r["next"] != r["bin"]))
    three = two.withColumn("__again", F.sort_array(F.transform(again, lambda x: x["k"]))).withColumn("__ends", ends)
    runs = F.transform("__ends", lambda r, k: F.struct(r["bin"].alias("bin"), (r["end"] - F.coalesce(F.get("__ends", k - 1)["end"], F.lit(0))).alias("n")))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "__again", start, lambda a, k: F.struct(k.alias("last"), (a["n"] + F.least(F.lit(3), k - a["last"])).alias("n")), lambda a: a["n"])
    found = three.withColumn("__runs", runs).select(
        *docs.columns, F.size("__words").cast("long").alias("n_words"), (F.length(body) - F.col("__space")).cast("long").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.array(*[F.col(f"__{c}") for c in CLASSES], F.length("__left").cast("long")).alias("char_histogram"),
        F.transform(F.sequence(F.lit(1).cast("long"), F.lit(COMMON).cast("long")), lambda k: F.coalesce(
            F.get(F.filter("__runs", lambda r: r["bin"] == k), F.lit(0))["n"], F.lit(0).cast("long"))).alias("__common"), F.size("__hits").alias("__n"))
    return found.withColumn("word_histogram", F.concat("__common", F.array(F.col("n_words") - F.col("__n")))).drop("__common", "__n")


def _shares(histogram: str) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return F.transform(histogram, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(features: DataFrame, language: str) -> DataFrame:
    """``language, chars, words, weight``: the median share of every bin over a language's documents that pass the base rules, mixed with
    that over all documents that do; ``weight`` is the part of the language's own. The corpus' medians alone have a null language."""
    rows = features.where(~F.col("base_failed")).select(
        F.col(language).cast("string").alias("language"), *[_shares(name).alias(name) for name in BINS])
    medians = [F.percentile_approx(F.get(name, F.lit(k)), 0.5, 1000).alias(f"{name}{k}") for name, n in BINS.items() for k in range(n)]
    packed = [F.array(*[F.col(f"{name}{k}") for k in range(n)]).alias(name) for name, n in BINS.items()]
    every = rows.agg(*medians).select(*packed)
    own = rows.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n"), *medians).select("language", "n", *packed)
    corpus = every.first()  # one row
    if corpus["char_histogram"][0] is None:
        return own.select("language", F.col("char_histogram").alias("chars"), F.col("word_histogram").alias("words"), F.lit(1.0).alias("weight"))
    whole = {name: F.array(*[F.lit(float(v)) for v in corpus[name]]) for name in BINS}
    weight = F.col("n") / (F.col("n") + F.lit(PRIOR_DOCS))
    mixed = own.withColumn("weight", weight).select("language", *[
        F.zip_with(name, whole[name], lambda x, y: F.col("weight") * x + (1 - F.col("weight")) * y).alias(name) for name in BINS], "weight")
    alone = features.sparkSession.range(1).select(F.lit(None).cast("string").alias("language"), *[whole[name].alias(name) for name in BINS], F.lit(0.0).alias("weight"))
    return mixed.unionByName(alone).select("language", _shares("char_histogram").alias("chars"), _shares("word_histogram").alias("words"), "weight")


def _compared(features: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """``features`` with ``__best``: the distances to the reference of ``language`` (the corpus', where it has none)."""
    rows = features.withColumn("__language", F.col(language).cast("string"))
    joined = rows.join(known.where("language IS NOT NULL"), rows["__language"] == known["language"], "left")
    alone = known.where("language IS NULL").first()  # one row at most
    if alone is not None:
        for name in ("chars", "words"):
            joined = joined.withColumn(name, F.coalesce(name, F.array(*[F.lit(v) for v in alone[name]])))
    chars, words = distance(_shares("char_histogram"), F.col("chars")), distance(_shares("word_histogram"), F.col("words"))
    best = F.struct((chars + words).alias("sum"), chars.alias("chars"), words.alias("words"), F.col("language"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return joined.withColumn("__best", F.when(F.col("chars").isNotNull(), best)).drop("__language", "language" if language != "language" else "__none", "chars", "words", "weight")


def judge(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """``docs`` without its text, with the counts, ``base_failed``, the distances to the language compared with, its name and ``kept``.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than half of them in repeated three-word windows. A text is not
    kept if it fails that, or if its common words are further than ``WORDS_ALONE`` from its language's, or
    if both its characters and its words are further than ``CHARS_BOTH`` and ``WORDS_BOTH``. These bounds hold for a language of many documents; with n documents
    that pass the base rules they lie the square of ``PRIOR_DOCS / (n + PRIOR_DOCS)`` of the way towards 1. Null and empty texts have counts of 0 and fail.
    A document without a language is measured for each language of the corpus and takes the nearest (ties: the first by name). With no document
    that passes the base rules there is nothing to compare with: distances are null and the base rules decide. Rows may repeat. Input columns called
    like a result column are replaced.
    """
    names = [c for c in docs.columns if c not in (text, *ADDED, *BINS)]
    plain = settled(docs.select(*names, *([] if language in names else [language]), F.col(text).alias("__text")), "quality-input")
    common = sized(common_words(plain, "__text", language), "quality-common")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def features(rows: DataFrame, label: str, name: str) -> DataFrame:
        joined = rows.join(common.withColumnRenamed("language", "__l").withColumnRenamed("common", "__list"), F.col(label) == F.col("__l"), "left").drop("__l")
        return materialise(measured(joined, "__text", "__list").drop("__text", "__list").withColumn("base_failed", failed), name)

    told = features(plain.where(F.col(language).isNotNull()), language, "quality-features")
    languages = common.select(F.collect_set("language")).first()[0]  # names alone
    # A row's number is written before it is read again, so it stays the same.
    untold = plain.where(F.col(language).isNull()).withColumn("__row", F.monotonically_increasing_id())
    options = F.array(*[F.lit(x) for x in sorted(languages)]) if languages else F.array(F.lit(None).cast("string"))
    guessed = features(untold.withColumn("__guess", F.explode(options)), "__guess", "quality-guesses")
    first = guessed.where(F.col("__guess").isNull() if not languages else F.col("__guess") == sorted(languages)[0])
    known = sized(references(told.unionByName(first.drop("__row", "__guess")), language), "quality-references")
    best = _compared(guessed, known, "__guess")
    nearest = best.groupBy("__row").agg(F.min("__best").alias("__least"))
    # Counts do not depend on the guess: any one row of a document has them.
    settled_guess = first.join(nearest, "__row").withColumnRenamed("__least", "__best").drop("__row", "__guess")
    judged = _compared(told, known, language).unionByName(settled_guess)
    wide = lambda bound: bound + (1 - bound) * (1 - F.col("__best.weight")) ** 2
    far = ((F.col("n_words") >= GUARD_WORDS) & (F.col("__best.words") > wide(WORDS_ALONE))) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= GUARD_CHARS) & (F.col("__best.chars") > wide(CHARS_BOTH)) & (F.col("__best.words") > wide(WORDS_BOTH)))
    return judged.select(
        *names, *COUNTS, "base_failed", F.col("__best.chars").alias("char_distance"), F.col("__best.words").alias("word_distance"),
        F.col("__best.language").alias("nearest"), (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
