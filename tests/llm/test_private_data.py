import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelkit.llm import private_data, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        odd = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and odd % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if counts(k, m[0])]


@pytest.fixture(scope="module")
def model(spark):
    return private_data.fit(spark)


def triples(spans):
    return [(s.kind, s.start, s.end) for s in spans]


def texts():
    rng = random.Random(12)
    odd = [None, "", "a@b.c_d@e.f", "a@b@c.d", "a@b..c x@y.z.", "1.2.3.4.5.6.7.8", "0001.02.255.0 256.1.1.1", "é 4111 1111 1111 1111é", "+1 (743) 555-3824 ",
           "4111-1111-1111-1111-4", "+12345678 9 .", "😀" * 5 + "x@y.zz", "@.@.", "+1+22 333 4444 55", "9" * 3000, "1.1.1." * 200, "a@" * 300]
    made = ["".join(rng.choice("a@.1 -+(5_é2\n") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    cards = [" ".join(str(rng.randint(10**12, 10**19 - 1)) for _ in range(4)) for _ in range(60)]
    ips = [".".join(str(rng.choice([0, 7, 99, 100, 199, 200, 249, 250, 255, 256, 300, "007", "0255"])) for _ in range(rng.randint(3, 6))) for _ in range(200)]
    return odd + made + cards + ips + ["x.y@z.org 10.0.0.1 4111111111111111, " * 700, "9 " * 40_000, "a" * 200_000, "1.2" * 30_000]


def test_base_equals_brute_force(frame, model):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a@b.c"), (3, "1.1.1.1"), (3, "1.1.1.1")]
    got = private_data.find_private(frame(rows).withColumnRenamed("block", "spans"), model=model).collect()
    assert set(got[0].asDict()) == {"doc_id", "extra", *private_data.ADDED}
    want = [(k, base(t)) for k, t in rows]
    assert sorted([(r.doc_id, triples(r.base)) for r in got], key=str) == sorted(want, key=str)
    order = {k: n for n, k in enumerate(private_data.KINDS)}
    for r in got:
        n = len(r.base)
        assert triples(r.spans)[:n] == triples(r.base) and [r[c] for c in private_data.COUNTED] == [sum(s.kind == k for s in r.base) for k in PATTERNS]
        extra = r.spans[n:]
        assert [(order[s.kind], s.start) for s in extra] == sorted((order[s.kind], s.start) for s in extra)
        places = sorted((s.start, s.end) for s in extra)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def test_trees_take_what_is_private_and_leave_the_rest(frame, model):
    digest = hashlib.sha1(b"1").hexdigest()
    private = [f'he wrote token = "{digest}" there', f"password: {digest[:32]}", "IBAN: DE89 3704 0044 0532 0130 00.", "ssn 406-25-7783,", "write to anna.berg at webmail dot org"]
    clean = [f"commit {digest} fixed", f"sha256: {digest}", "IBAN: DE88 3704 0044 0532 0130 00.", "dated 1969-09-14, the", "order 4785380592391138 came", "look at this dot there",
             "internationalisation-of-long-words-v2", "ordinary prose without any of it", "===================="]
    got = private_data.find_private(frame([(k, t) for k, t in enumerate(private + clean)]), model=model).collect()
    taken = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in got}
    assert [[k for k, _ in taken[k]] for k in range(len(private))] == [["secret"], ["secret"], ["account"], ["number"], ["spelled"]]
    assert all(0.5 < s <= 1 for found in taken.values() for _, s in found)
    assert [taken[k] for k in range(len(private), len(private + clean))] == [[]] * len(clean)


def test_thresholds_hold_on_other_sentences(spark, model):
    other = private_data.sentences(spark, 2_000, seed=77).withColumnRenamed("start", "__s").withColumnRenamed("end", "__e")
    found = private_data.find_private(other, model=model).select(
        "label", F.exists("spans", lambda s: (s["start"] < F.col("__e")) & (s["end"] > F.col("__s"))).alias("hit"))
    n = {(r.label, r.hit): r["count"] for r in found.groupBy("label", "hit").count().collect()}
    assert n[1, True] > 0.95 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.03 * n[1, True]


def test_running_sums_over_many_runs(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: x).alias("x"), F.array().cast("array<int>").alias("none"))
    total = lambda items: private_data.running(items, F.lit(0), lambda a, x: a + x, lambda a, x: a, "int")
    got = rows.select(total(F.col("x")).alias("a"), total(F.col("none")).alias("b")).first()
    assert got.a.outs == [k * (k - 1) // 2 for k in range(1, 1501)] and got.a.state == 1500 * 1501 // 2 and got.b.outs == []


def test_redaction(frame, model):
    rows = [(1, "é a@b.cc and 1.2.3.4"), (2, "none"), (3, None), (4, "+1.22.33.4444 x")]
    docs = frame(rows).drop("block", "extra")
    found = private_data.find_private(docs, model=model).join(docs, "doc_id")
    assert {r[0]: r[1] for r in found.select("doc_id", private_data.redacted("text", "spans")).collect()} == {
        1: "é [email] and [ip]", 2: "none", 3: None, 4: "[phone] x"}


def test_empty_table(frame, model):
    assert private_data.find_private(frame([]), model=model).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_personal_data"](spark, sf_dir).collect()
    for r in got:
        own = base(docs[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and r.spans.startswith(written)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in own) for k in PATTERNS]
    secrets = {i for i, t in docs.items() if t and re.search(r'token = "[0-9a-f]{40}"', t)}
    assert secrets == {r.doc_id for r in got if "secret" in r.spans}
