import math
import random
import re
from collections import Counter

import pytest

from panelkit.llm import quality_rules, queries


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if times[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_and_edges(spark):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b c a b c"), (5, "a a a a a a"), (6, "x\n\nx\nx \n"), (7, "#*$%&|<> é😀"), (7, "#*$%&|<> é😀"), (None, "a")]
    rows += [(100 + k, rng.choice([" ", "\n", "\t\t"]).join(rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.randint(0, 120)))) for k in range(80)]
    rows.append((50, " ".join(rng.choice(["alpha", "beta", "of", "the"]) for _ in range(40_000))))
    docs = spark.createDataFrame([(i, t, None, 9) for i, t in rows], "doc_id long, text string, lang string, kept int")
    got = quality_rules.judge(docs).collect()
    assert set(got[0].asDict()) == {"doc_id", "lang", *quality_rules.ADDED}
    want = [(i, *counts(t)) for i, t in rows]
    assert sorted([(r.doc_id, *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in got], key=str) == sorted(want, key=str)
    assert all(r.kept == (not r.base_failed) and r.nearest is None for r in got)  # no language: the corpus' reference, with the widest bounds


def test_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    rows = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = rows.select(quality_rules.distance(rows.p, rows.q), quality_rules.distance(rows.p, rows.p)).first()
    assert got[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and got[1] == 0


CLASSES = ["[a-z]", "[ \\t-\\r]", r"[^\x00-\x7F]", "[A-Z]", r"[.,;:!?'\"()\-]", "[0-9]", r"[#*$%&|<>]"]


def plain_judge(rows):
    """(id, kept, nearest) by the definition, with Python lists."""
    lower = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    shares = lambda h: [x / max(sum(h), 1) for x in h]
    median = lambda values: sorted(values)[math.ceil(len(values) / 2) - 1]

    def apart(p, q):
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))

    common = {}
    for lang in {r[2] for r in rows} - {None}:
        docs = [set(w for w in lower(t) if len(w) <= 6) for _, t, x in rows if x == lang and t is not None]
        held = Counter(w for d in docs for w in d)
        common[lang] = [w for w, n in sorted(held.items(), key=lambda x: (-x[1], x[0])) if n >= 0.05 * len(docs)][:24]

    def histograms(text, lang):
        text, words = text or "", lower(text)
        chars = [len(re.findall(c, text)) for c in CLASSES]
        own = common.get(lang, [])
        hits = [words.count(own[k]) if k < len(own) else 0 for k in range(24)]
        return shares(chars + [len(text) - sum(chars)]), shares(hits + [len(words) - sum(hits)])

    base = [counts(t) for _, t, _ in rows]
    guess = min(common) if common else None
    passed = [(x, *histograms(t, guess if x is None else x)) for (_, t, x), c in zip(rows, base) if not c[-1]]
    whole = [[median([p[k][b] for p in passed]) for b in range(n)] for k, n in ((1, 8), (2, 25))] if passed else None

    def reference(lang):
        own = [p for p in passed if p[0] == lang and lang is not None]
        w = len(own) / (len(own) + 2)
        parts = [[w * median([p[k][b] for p in own]) + (1 - w) * whole[k - 1][b] if own else whole[k - 1][b] for b in range(n)] for k, n in ((1, 8), (2, 25))]
        return [shares(x) for x in parts], w

    out = []
    for (i, text, lang), c in zip(rows, base):
        best = (0, 0, 0, None, 0)
        if passed:
            options = []
            for guess in [lang] if lang is not None or not common else sorted(common):
                (chars, words), w = reference(guess)
                p, q = histograms(text, guess)
                a, b = apart(p, chars), apart(q, words)
                options.append((a + b, a, b, guess if w else None, w))
            best = min(options, key=lambda o: (round(o[0], 9), str(o[3])))
        wide = lambda bound: bound + (1 - bound) * (1 - best[4]) ** 2
        far = (c[0] >= 100 and best[2] > wide(0.29)) or (c[0] >= 50 and c[1] >= 200 and best[1] > wide(0.17) and best[2] > wide(0.25))
        out.append((i, not c[-1] and not far, best[3]))
    return out


def corpus(polish):
    rng = random.Random(66)
    stock = {"en": "the of and house with water over", "pl": "nie jest sie dom woda przez był", "zz": "一 二 三 四 五"}
    prose = lambda lang, n: " ".join(rng.choice(stock[lang].split()) if rng.random() < 0.5 else "".join(rng.choice("abcdełmno") for _ in range(8)) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("#$%&*|<>") for _ in range(6)) for _ in range(n))
    rows = [("en", prose("en", rng.randint(60, 200))) for _ in range(60)] + [("pl", prose("pl", 120)) for _ in range(polish)]
    rows += [("zz", prose("zz", 120)), (None, prose("pl", 150)), (None, prose("en", 150)), (None, junk(150)), ("en", junk(120)), ("pl", junk(120)), ("en", ""), ("pl", None)]
    return [(k, t, x) for k, (x, t) in enumerate(rows)]


@pytest.mark.parametrize("polish", [9, 10])
def test_kept_equals_brute_force(spark, polish):
    rows = corpus(polish)
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.kept, r.nearest) for r in got) == plain_judge(rows)
    kept = {r.doc_id: r.kept for r in got}
    junk = {i: x for i, t, x in rows if t and set(t) <= set("#$%&*|<> ")}
    assert len(junk) == 3 and not any(kept[i] for i, x in junk.items() if x)
    assert all(kept[i] for i, t, _ in rows if t and i not in junk and not counts(t)[-1])


def test_distances_of_many_languages(spark):
    rows = [(k, " ".join(f"w{k}x{j % 7}" if j % 3 else f"y{j}" for j in range(90)), f"l{k % 40:02}") for k in range(120)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.kept, r.nearest) for r in got) == plain_judge(rows)


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op6_quality_rules"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[c] for c in [*quality_rules.COUNTS, "base_failed"]) for r in got} == {i: counts(t) for i, t in docs.items()}
    junk = {i for i, t in docs.items() if not counts(t)[-1] and counts(t)[0] >= 100 and 20 * counts(t)[2] > len(t)}
    assert junk and not any(r.kept for r in got if r.doc_id in junk)
    assert sum(r.kept for r in got if not r.base_failed and r.n_symbols < 10) > 0.97 * sum(not r.base_failed and r.n_symbols < 10 for r in got)
