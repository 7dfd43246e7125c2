import random
import re

from panelkit.llm import licenses, queries

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = sorted((k, label) for phrase, label in BASE.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase)
    places = [k for k, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 15))] for _ in range(rng.randint(1, 4))]
        text = [rng.randrange(5) for _ in range(60)]
        automaton = licenses.Automaton(sequences)
        inside = {(tuple(s[a:b]), n, b) for n, s in enumerate(sequences) for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        strings = {s for s, _, _ in inside}
        for end, (length, state) in enumerate(automaton.statistics(text), 1):
            want = max((n for n in range(end + 1) if n == 0 or tuple(text[end - n : end]) in strings))
            assert length == want
            if length:
                assert automaton.ends[state] == {(n, b) for s, n, b in inside if s == tuple(text[end - length : end])}


def test_spans(frame):
    long = licenses.TEMPLATES[1][1]
    cut = " ".join(long.split()[:20] + ["odd", "words"] + long.split()[20:])
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (4, "intro\n" + cut + " end"), (5, "LICENSED UNDER CC BY-NC 4.0."),
            (6, "under the license of the rights"), (7, "All  rights-reserved all rights reserved"), (7, "All  rights-reserved all rights reserved"),
            (8, "é " * 200_000 + "cc by"), (None, "general public license"), (9, "all"), (10, "rights reserved")]
    got = licenses.scan_licenses(frame(rows)).withColumnRenamed("block", "b").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].labels for k in (1, 2, 3, 4, 5, 6, 7, 8, None, 9)] == ["", "", "mit", "mit", "cc-by,cc-by-nc", "", "reserved", "cc-by", "gpl", ""]
    assert [tuple(by[3].spans[0])[:3], (by[4].spans[0].first, by[4].spans[0].last)] == [("mit", 0, 4), (1, len(licenses.tokens(cut)))]
    assert by[8].first_word == 200_000 and by[1].first_word is None and by[2].score == 0
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
    assert licenses.scan_licenses(frame([])).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op5_license_scan"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {i: base(t) for i, t in docs.items()}
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert ("mit" in r.labels.split(",")) == ("Released under the MIT License." in docs[r.doc_id])


def test_chains_of_a_long_repeated_notice():
    """Spans of a notice repeated thousands of times: as many as repeats, equal to those of one, and not in quadratic time."""
    import time

    import pyarrow as pa

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    notice = max((t for _, t in licenses.TEMPLATES), key=len)
    one = licenses.scan_column(scanner, pa.array([notice]))[0]
    start = time.time()
    many = licenses.scan_column(scanner, pa.array([(notice + " some other words between these two ") * 2_000]))[0]
    assert time.time() - start < 60
    whole = [s for s in many["spans"] if s["share"] > 0.99]
    assert one["spans"] and len(whole) >= 2_000 and set(one["labels"].split(",")) <= set(many["labels"].split(","))
    sizes = {s["last"] - s["first"] for s in whole if s["label"] == one["spans"][0]["label"]}
    assert one["spans"][0]["last"] - one["spans"][0]["first"] in sizes
