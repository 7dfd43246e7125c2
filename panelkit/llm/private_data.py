"""Personal data with DataFrame functions only: fixed formats, and further candidates that boosted trees decide on.

Generators propose spans generously: each is a pattern, its matches and the text between them give places and contexts without a
second look at the text. Spans of the fixed formats count as they are. What the other generators find outside of them is described by its
format and the words before it, scored by gradient-boosted trees and kept above its kind's threshold; of overlapping ones the likelier stays.
The trees are fitted by aggregates over a bounded table of labelled sentences, calibrated and given thresholds on a held-out part of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import materialise

# The formats that always count. Quantifiers give nothing back and a run is entered at its start (or where the match before
# it ended), which changes no match but keeps the search linear in the text.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
#: What a text must hold for a format to be looked for at all.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}

#: Candidates of the method: (pattern, what a text must hold).
GENERATORS = {
    "secret": (r"(?:(?<![A-Za-z0-9_+/=-])|\G)[A-Za-z0-9_+/=-]{16,}+", "[A-Za-z0-9_+/=-]{16}"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+", "[A-Z]{2}[0-9]{2}"),
    "number": (r"[0-9](?:[\x20./-]?[0-9]){6,}+", r"[0-9](?:[\x20./-]?[0-9]){6}"),
    "spelled": (r"(?i)(?:(?<![a-z0-9._-])|\G)[a-z0-9._-]++(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[a-z0-9-]++"
                r"(?:(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]++)++", r"(?i)[\x20\[(]dot[\x20\])]"),
}
KINDS = [*BASE_PATTERNS, *GENERATORS]

#: Hides what the fixed formats found from the generators; one code point stands for one.
MASK = "￼"
#: Code points before and after a candidate that count as its context.
BEFORE, AFTER = 40, 8
#: Steps of a running sum that share one growing array.
STRIDE = 256

#: Labelled sentences for the trees, every fourth held out; trees, the pull towards 0 and the share of a tree that counts.
TRAINING_ROWS, TREES, RIDGE, RATE = 8_000, 16, 1.0, 0.8
#: Share of held-out candidates above a kind's threshold that must be personal data.
PRECISION = 0.98
SEED = 29

COUNTED = [f"n_{k}" for k in BASE_PATTERNS]
ADDED = [*COUNTED, "base", "spans"]

# Words before a candidate that speak for or against it, in English, German, French and Spanish.
CONTEXT = {
    "secret_words": "key|token|secret|passw|pwd|auth|bearer|credential|schlüssel|kennwort|jeton|mot de passe|clave|contraseña",
    "person_words": "ssn|social security|passport|identity|tax id|ausweis|steuer|sécurité sociale|passeport|pasaporte|dni|nif",
    "phone_words": "phone|tel|call|mobile|cell|fax|anruf|handy|appel|móvil|llam",
    "bank_words": "iban|account|bank|konto|compte|cuenta|payee|transfer|überweis|virement",
    "mail_words": "mail|contact|write|reach|kontakt|schreib|courriel|écri|correo|escrib",
    "public_words": "commit|sha|md5|checksum|version|isbn|issn|order|invoice|page|build|revision|uuid|issue|doi|hash|release|track|serial|file|path|article"
                    "|population|since|dated?\\b|year|bestell|version|seite|commande|pedido",
}


def _sum_of(column: Column) -> Column:
    return F.aggregate(column, F.lit(0), lambda a, x: a + x)


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``struct(state, outs)``: from ``start``, the state after each item by ``step(state, item)``, and ``out(state before, item)`` for each.

    An array that grows by one element is copied each time, so outs are gathered in runs of ``STRIDE``. ``kind`` is the type of an out.
    """
    pace = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["outs"], F.array(out(a["state"], x))).alias("outs"))
    none = F.array().cast(f"array<{kind}>")
    count = F.ceil(F.size(items) / F.lit(STRIDE)).cast("int")
    runs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * STRIDE + 1, F.lit(STRIDE))))

    def run(a: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(a["state"].alias("state"), none.alias("outs")), pace)
        # The inner result is used twice: a one-element array holds it.
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["outs"])).alias("outs"))), F.lit(0))

    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    whole = F.aggregate(F.coalesce(runs, F.array()), first, run)
    return F.get(F.transform(F.array(whole), lambda w: F.struct(w["state"].alias("state"), F.flatten(w["outs"]).alias("outs"))), F.lit(0))


def _found(docs: DataFrame, text: str, pattern: str, hint: str, name: str) -> DataFrame:
    """``docs`` with ``name``: every match with its place and the text before and after it (null where the hint is missing)."""
    body = F.col(text)
    near = body.rlike(hint)
    cut = docs.withColumn("__m", F.when(near, F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))).withColumn(
        "__g", F.when(F.size("__m") > 0, F.split(body, pattern, -1)))
    pairs = F.zip_with("__m", F.slice("__g", 1, F.size("__m")), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    placed = running(pairs, F.lit(0), lambda at, x: at + x["g"] + x["n"], lambda at, x: at + x["g"], "int")["outs"]
    whole = F.transform("__m", lambda m, k: F.struct(
        m.alias("m"), F.get("__at", k).alias("start"), (F.get("__at", k) + F.length(m)).alias("end"),
        F.right(F.get("__g", k), F.lit(BEFORE)).alias("before"), F.left(F.get("__g", k + 1), F.lit(AFTER)).alias("after")))
    return cut.withColumn("__at", F.when(F.size("__m") > 0, placed)).withColumn(name, F.when(F.size("__m") > 0, whole)).drop("__m", "__g", "__at")


def luhn(digits: Column) -> Column:
    """Whether a run of digits passes the check digit rule."""
    value = lambda c, k: F.when(k % 2 == 0, c).otherwise(2 * c - F.when(c > 4, F.lit(9)).otherwise(F.lit(0)))
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, k: value(c.cast("int"), k))
    return _sum_of(figures) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    """Whether a match of a fixed format counts."""
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    size = F.length(_digits(match))
    if kind == "card":
        return F.when((F.length(match) >= 13) & size.between(13, 19), luhn(_digits(match))).otherwise(F.lit(False))
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def _counts(kind: str, hit: Column) -> Column:
    return passes(kind, hit["m"])


def _masked(body: Column, kind: str) -> Column:
    """The text with what counts of a fixed format hidden."""
    pattern = BASE_PATTERNS[kind]
    parts = F.zip_with(
        F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)),
        lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).when(passes(kind, m), F.repeat(F.lit(MASK), F.length(m))).otherwise(m)))
    return F.array_join(parts, "")


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__email`` to ``__phone`` (start and end of what counts, in order) and ``__rest``, the text without them."""
    found = docs
    for kind, pattern in BASE_PATTERNS.items():
        found = _found(found, text, pattern, _HINTS[kind], "__hits")
        counts = F.filter("__hits", partial(_counts, kind))
        spans = F.transform(counts, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        found = found.withColumn(f"__{kind}", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))).drop("__hits")
    found = found.withColumn("__rest", F.col(text))
    for kind in BASE_PATTERNS:
        found = found.withColumn("__rest", F.when(F.size(f"__{kind}") > 0, _masked(F.col("__rest"), kind)).otherwise(F.col("__rest")))
    return found


def _mod97(code: Column) -> Column:
    """Remainder of an account number by the rule of its check digits."""
    plain = F.regexp_replace(code, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97)


def _share(match: Column, others: str) -> Column:
    """Tenths of a match that are not ``others``, rounded down."""
    return (10 * F.length(F.regexp_replace(match, others, "")) / F.length(match)).cast("int")


#: Whole numbers that describe a candidate, and the bounds at which trees may cut them.
FEATURES: dict[str, tuple[Callable[[Column], Column], list[int]]] = {
    "kind": (lambda c: c["kind"], [1, 2, 3]),
    "length": (lambda c: F.length(c["m"]), [9, 11, 13, 20, 28, 36]),
    "digits": (lambda c: _share(c["m"], "[^0-9]"), [1, 3, 5, 8, 10]),
    "capitals": (lambda c: _share(c["m"], "[^A-Z]"), [1, 3, 6]),
    "signs": (lambda c: F.length(F.regexp_replace(c["m"], "[A-Za-z0-9]", "")), [1, 2, 3, 5]),
    "hex": (lambda c: c["m"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"), [1]),
    "variety": (lambda c: (10 * F.size(F.array_distinct(F.split(F.left(c["m"], F.lit(64)), ""))) / F.least(F.length(c["m"]), F.lit(64))).cast("int"), [3, 5, 7]),
    "changes": (lambda c: F.length(F.regexp_replace(F.regexp_replace(c["m"], "[A-Za-z]+", "a"), "[0-9]+", "0")), [2, 4, 8, 14]),
    "check": (lambda c: F.when(c["kind"] == 1, F.when(F.length(c["m"]) <= 48, _mod97(c["m"]) == 1)).when(
        (c["kind"] == 2) & F.length(_digits(c["m"])).between(13, 19), luhn(_digits(c["m"]))).otherwise(F.lit(False)).cast("int"), [1]),
    "grouped": (lambda c: c["m"].rlike(r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$").cast("int"), [1]),
    "dated": (lambda c: c["m"].rlike(r"^(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})").cast("int"), [1]),
    "set_equal": (lambda c: c["before"].rlike(r"[=:]\s*[\"']?$").cast("int"), [1]),
    "quoted": (lambda c: (c["before"].rlike("[\"'`]$") & c["after"].rlike("^[\"'`]")).cast("int"), [1]),
    "inside": (lambda c: (c["before"].rlike("[A-Za-z0-9/._-]$") | c["after"].rlike(r"^(?:[A-Za-z/_]|\.[A-Za-z])")).cast("int"), [1]),
    **{name: (lambda c, w=words: F.lower(c["before"]).rlike(w).cast("int"), [1]) for name, words in CONTEXT.items()},
}
TESTS = [(name, bound) for name, (_, bounds) in FEATURES.items() for bound in bounds]


def _tagged(kind: int, hit: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[hit[n].alias(n) for n in ("m", "start", "end", "before", "after")])


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__candidates``: kind (place in ``GENERATORS``), start, end and features of everything the generators propose."""
    found, names = docs, []
    for k, (kind, (pattern, hint)) in enumerate(GENERATORS.items()):
        found = _found(found, text, pattern, hint, "__hits")
        mixed = F.filter("__hits", lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")) if kind == "secret" else F.col("__hits")
        tagged = F.transform(mixed, partial(_tagged, k))
        found = found.withColumn(f"__{kind}_hits", F.when(F.size(mixed) > 0, F.transform(tagged, lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), *[F.coalesce(f(c), F.lit(0)).cast("int").alias(n) for n, (f, _) in FEATURES.items()])))).drop("__hits")
        names.append(f"__{kind}_hits")
    kept = F.filter(F.array(*names), lambda x: x.isNotNull())
    return found.withColumn("__candidates", F.flatten(kept)).drop(*names)


@dataclass
class Trees:
    """Boosted trees of depth 2 over ``TESTS``: per tree its three tests and four leaves, and what turns a sum into a probability."""

    prior: float = 0.0
    trees: list[tuple[list[int], list[float]]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(GENERATORS))

    def margin(self, value: Callable[[str], Column]) -> Column:
        """The sum of all trees' leaves; ``value`` gives a feature."""
        test = lambda k: value(TESTS[k][0]) >= TESTS[k][1]
        total = F.lit(self.prior)
        for (top, low, high), leaves in self.trees:
            below = F.when(test(low), F.lit(leaves[1])).otherwise(F.lit(leaves[0]))
            total = total + F.when(test(top), F.when(test(high), F.lit(leaves[3])).otherwise(F.lit(leaves[2]))).otherwise(below)
        return total

    def probability(self, value: Callable[[str], Column]) -> Column:
        return 1 / (1 + F.exp(-(self.margin(value) * self.slope + self.shift)))


def sentences(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """``text, kind, start, end, label``: made sentences with one value each, its place and whether it is personal data."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed * 100 + k)), F.lit(n)).cast("int")
    pick = lambda k, options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), draw(k, len(options)) + 1)
    figures = F.lpad(F.abs(F.xxhash64("id", F.lit(seed + 1))).cast("string"), 18, "4")
    f = lambda a, n: F.substring(figures, a, n)
    word = lambda k: pick(k, "the house river und lichten weg maison chemin casa grande note list report open small north".split())
    filler = lambda k: F.concat_ws(" ", word(k), word(k + 1), word(k + 2))
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "x")
    hexes = pick(20, [F.substring(digest, 1, 32), F.substring(digest, 1, 40), digest, F.substring(mixed, 1, 24), F.substring(mixed, 1, 40), F.concat(F.lit("sk-"), F.substring(mixed, 2, 32))])
    code = pick(21, ["DE", "FR", "ES", "GB"])
    checked = F.concat(code, F.lpad((98 - _mod97(F.concat(code, F.lit("00"), figures))).cast("string"), 2, "0"), figures)
    wrong = F.concat(code, F.lpad((1 + (98 - _mod97(F.concat(code, F.lit("00"), figures))) % 96).cast("string"), 2, "0"), figures)
    spaced = lambda x: F.when(draw(22, 2) == 0, x).otherwise(F.trim(F.regexp_replace(x, "(.{4})", "$1 ")))
    person = F.concat(word(23), F.lit("."), word(24))
    at, dot = pick(25, [" at ", " [at] ", "(at)"]), pick(25, [" dot ", " [dot] ", "(dot)"])
    address = F.concat(person, at, word(26), F.lit("mail"), dot, pick(27, ["com", "org", "de", "net"]))
    grouped = F.concat(f(1, 3), F.lit("-"), f(4, 2), F.lit("-"), f(6, 4))
    dated = F.concat(F.lit("19"), f(1, 2), F.lit("-0"), pick(28, list("123456789")), F.lit("-1"), f(3, 1))
    assign = lambda *names: pick(29, [n + s for n in names for s in (" = \"", ": ", "=", " is ", ' = "')])
    cases = [
        ("secret", 1, assign("token", "api key", "secret", "password", "auth", "clave", "Kennwort"), hexes),
        ("secret", 0, pick(30, ["commit ", "sha256: ", "md5 = ", "checksum: ", "file ", "build ", "/path/", "uuid ", "see ", "", "release ", "hash: \""]), hexes),
        ("secret", 0, pick(31, ["", "see ", "token ", "key "]), F.concat(word(32), F.lit("-"), word(33), F.lit("-"), word(34), F.lit("-v"), f(1, 1))),
        ("account", 1, pick(35, ["iban ", "IBAN: ", "account ", "Konto ", "pay to ", "", "compte ", "cuenta: "]), spaced(checked)),
        ("account", 0, pick(36, ["", "model ", "order ", "version ", "see ", "serial "]), spaced(wrong)),
        ("number", 1, pick(37, ["ssn ", "SSN: ", "social security number ", "tax id ", "DNI "]), grouped),
        ("number", 1, pick(38, ["passport ", "Ausweis ", "pasaporte ", "passeport no. "]), f(1, 9)),
        ("number", 1, pick(39, ["phone ", "tel. ", "call ", "mobile: ", "Handy ", "fax "]), F.concat(F.lit("0"), f(1, 3), F.lit(" "), f(4, 3), F.lit("-"), f(7, 4))),
        ("number", 0, pick(40, ["", "on ", "since ", "dated ", "year "]), dated),
        ("number", 0, pick(41, ["", "order ", "isbn ", "invoice no. ", "page ", "population ", "issue ", "tracking ", "id "]), pick(42, [f(1, 9), f(1, 13), f(1, 16), F.concat(f(1, 3), F.lit("-"), f(4, 10)), F.concat(f(1, 3), F.lit(" "), f(4, 3), F.lit(" "), f(7, 3))])),
        ("spelled", 1, pick(43, ["mail me: ", "contact ", "write to ", "", "reach ", "Kontakt: "]), address),
        ("spelled", 0, pick(44, ["", "look ", "we met ", "stay ", "he was "]), F.concat(word(45), F.lit(" at "), word(46), F.lit(" dot "), word(47))),
    ]
    which = draw(1, len(cases))
    choose = lambda part: F.element_at(F.array(*[part(c) for c in cases]), which + 1)
    rows_ = spark.range(rows).select(
        "id", choose(lambda c: F.lit(list(GENERATORS).index(c[0]))).alias("kind"), choose(lambda c: F.lit(c[1])).alias("label"),
        F.concat(filler(2), F.lit(" "), choose(lambda c: c[2] if isinstance(c[2], Column) else F.lit(c[2]))).alias("__head"),
        choose(lambda c: c[3]).alias("__value"), filler(8).alias("__tail"))
    close = F.when(F.col("__head").endswith('"'), F.lit('" ')).otherwise(pick(11, [" ", ". ", ", "]))
    return rows_.select(
        "id", "kind", "label", F.concat("__head", "__value", close, "__tail").alias("text"), F.length("__head").alias("start"),
        (F.length("__head") + F.length("__value")).alias("end"))


def fit(spark: SparkSession, labelled: DataFrame | None = None, text: str = "text") -> Trees:
    """Trees, calibration and thresholds from labelled sentences (``id, text, kind, start, end, label``; by default ``sentences``).

    The sentences become a small table of distinct feature vectors with counts; each level of a tree is one aggregate over it, so the
    driver sees sums alone. Three quarters fit the trees, the rest calibrates and sets thresholds. A kind with no bound that meets
    ``PRECISION`` takes nothing.
    """
    rows = materialise(labelled if labelled is not None else sentences(spark), "private-data-sentences")
    names = list(FEATURES)
    proposed = candidates(rows.withColumnRenamed("kind", "__asked"), text).select("id", "__asked", "label", "start", "end", F.explode("__candidates").alias("c"))
    hit = (F.col("c.kind") == F.col("__asked")) & (F.col("c.start") < F.col("end")) & (F.col("c.end") > F.col("start"))
    counted = proposed.select(
        (F.pmod(F.col("id"), F.lit(4)) == 0).alias("held"), F.when(hit, F.col("label")).otherwise(F.lit(0)).alias("y"), *[F.col(f"c.{n}").alias(n) for n in names]
    ).groupBy("held", *names).agg(F.sum("y").cast("double").alias("y"), F.count("*").cast("double").alias("n"))
    table = materialise(counted.coalesce(1).sortWithinPartitions("held", *names), "private-data-vectors")
    fitted, held = table.where(~F.col("held")), table.where("held")
    model = Trees()
    total = fitted.agg(F.sum("y"), F.sum("n")).first()
    if not total[1] or not 0 < total[0] < total[1]:
        return Trees(prior=-20.0, thresholds=[2.0] * len(GENERATORS))
    model.prior = math.log(total[0] / (total[1] - total[0]))
    for _ in range(TREES):
        _grow(model, fitted)
    _calibrate(model, held)
    return model


def _best_test(row, sums: dict[int, tuple[float, float]]) -> tuple[int, tuple[float, float], tuple[float, float]]:
    """The test with the largest gain, and the leaf values (below, from its bound on)."""
    every = (row["g"], row["h"])
    score = lambda g, h: g * g / (h + RIDGE)
    gains = [(round(score(*sums[k]) + score(every[0] - sums[k][0], every[1] - sums[k][1]), 9), -k) for k in sums]
    k = -max(gains)[1]
    leaf = lambda g, h: round(-RATE * g / (h + RIDGE), 6)
    return k, leaf(every[0] - sums[k][0], every[1] - sums[k][1]), leaf(*sums[k])


def _grow(model: Trees, table: DataFrame) -> None:
    chance = 1 / (1 + F.exp(-model.margin(F.col)))
    rows = table.withColumns({"__g": F.col("n") * chance - F.col("y"), "__h": F.col("n") * chance * (1 - chance)})
    passed = [F.when(F.col(name) >= bound, F.col("__g" if part == "g" else "__h")).otherwise(F.lit(0.0)) for name, bound in TESTS for part in "gh"]
    sums = [F.sum(p).alias(f"s{k}") for k, p in enumerate(passed)]
    of = lambda row: {k: (row[f"s{2 * k}"], row[f"s{2 * k + 1}"]) for k in range(len(TESTS))}
    whole = rows.agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), *sums).first()
    top, below, above = _best_test(whole, of(whole))
    name, bound = TESTS[top]
    halves = {r["side"]: r for r in rows.groupBy((F.col(name) >= bound).alias("side")).agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), *sums).collect()}
    tests, leaves = [top, top, top], [below, below, above, above]
    for side, at in ((False, 1), (True, 2)):
        if side in halves:
            tests[at], leaves[2 * at - 2], leaves[2 * at - 1] = _best_test(halves[side], of(halves[side]))
    model.trees.append((tests, leaves))


def _calibrate(model: Trees, held: DataFrame) -> None:
    rows = held.select("kind", "y", "n", F.round(model.margin(F.col), 6).alias("m"))
    for _ in range(6):  # Newton steps of a logistic curve through the held-out margins, with one added case of each label
        chance = 1 / (1 + F.exp(-(F.col("m") * model.slope + model.shift)))
        lost, wide = F.col("n") * chance - F.col("y"), F.col("n") * chance * (1 - chance)
        s = rows.agg(F.sum(lost * F.col("m")), F.sum(lost), F.sum(wide * F.col("m") * F.col("m")), F.sum(wide * F.col("m")), F.sum(wide)).first()
        if s[0] is None:
            return
        g, j, aa, ab, bb = s[0] + (model.slope - 1), s[1] + model.shift, s[2] + 1, s[3], s[4] + 1
        d = aa * bb - ab * ab
        model.slope, model.shift = model.slope - (bb * g - ab * j) / d, model.shift - (aa * j - ab * g) / d
    chance = F.round(1 / (1 + F.exp(-(F.col("m") * model.slope + model.shift))), 2).alias("p")
    steps = rows.groupBy("kind", chance).agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()  # at most 101 a kind
    for kind in range(len(GENERATORS)):
        taken = good = 0.0
        model.thresholds[kind] = 2.0
        for row in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["p"]):
            taken, good = taken + row["n"], good + row["y"]
            if row["p"] >= 0.5 and good >= PRECISION * taken:
                model.thresholds[kind] = row["p"] - 0.005


def _certain(kind: int, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("k"), span["start"].alias("start"), span["end"].alias("end"), F.lit(1.0).alias("score"))


def find_private(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_email`` to ``n_phone``, ``base`` and ``spans``: arrays of ``kind, start, end, score``.

    ``base`` has what counts of the fixed formats, leftmost and not overlapping within a kind; ``spans`` also what the trees take of the generators'
    candidates outside of them, of overlapping ones the likelier (equally likely: the one that starts first, then the earlier kind). Both are ordered
    by kind, as in ``KINDS``, then start; places are code points, ends exclusive; the score of a fixed format is 1. Null and empty texts have none.
    Rows may repeat and need no id. Input columns called like a result column are replaced.
    """
    trees = model or fit(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, *ADDED)]
    found = candidates(base_spans(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__text")), "__text"), "__rest")
    limits = F.array(*[F.lit(float(t)) for t in trees.thresholds])
    scored = F.transform("__candidates", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.round(trees.probability(lambda n: c[n]), 6).alias("p")))
    likely = F.sort_array(F.filter("__scored", lambda c: c["p"] >= F.get(limits, c["kind"])))
    kind = "struct<start:int,end:int,kind:int,p:double>"
    nothing = F.lit(None).cast(kind)
    apart = lambda last, x: last.isNull() | (x["start"] >= last["end"])
    sweep = running(
        F.col("__likely"), nothing, lambda last, x: F.when(apart(last, x) | (x["p"] > last["p"]), x).otherwise(last),
        lambda last, x: F.when(apart(last, x), last), kind)
    found = found.withColumn("__scored", scored).withColumn("__likely", F.when(F.size("__candidates") > 0, likely)).withColumn(
        "__swept", F.when(F.size("__likely") > 0, sweep)).withColumn("__taken", F.filter(F.concat(F.col("__swept.outs"), F.array("__swept.state")), lambda x: x.isNotNull()))
    base = [F.transform(f"__{k}", partial(_certain, n)) for n, k in enumerate(BASE_PATTERNS)]
    extra = F.sort_array(F.transform("__taken", lambda x: F.struct((x["kind"] + len(BASE_PATTERNS)).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["p"].alias("score"))))
    labels = F.array(*[F.lit(k) for k in KINDS])
    named = lambda spans: F.transform(spans, lambda x: F.struct(F.get(labels, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    found = found.withColumn("__base", F.concat(*base)).withColumn(
        "__all", F.concat("__base", F.coalesce(extra, F.array().cast("array<struct<k:int,start:int,end:int,score:double>>"))))
    return found.select(*names, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE_PATTERNS], named(F.col("__base")).alias("base"), named(F.col("__all")).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """A text with each span replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    kind = "struct<start:int,end:int,kind:string>"
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    joined = lambda last, x: F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
    apart = lambda last, x: last.isNull() | (x["start"] >= last["end"])
    swept = running(ordered, F.lit(None).cast(kind), lambda last, x: F.when(apart(last, x), x).otherwise(joined(last, x)), lambda last, x: F.when(apart(last, x), last), kind)
    apiece = F.filter(F.concat(swept["outs"], F.array(swept["state"])), lambda x: x.isNotNull())
    whole = F.col(text)
    parts = F.get(F.transform(F.array(apiece), lambda own: F.concat(F.transform(own, lambda x, k: F.concat(
        F.substring(whole, F.coalesce(F.get(own, k - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(own, k - 1)["end"], F.lit(0))),
        F.lit("["), x["kind"], F.lit("]"))), F.array(F.substring(whole, F.coalesce(F.get(own, F.size(own) - 1)["end"], F.lit(0)) + 1, F.length(whole))))), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(whole)
