import hashlib
import random
import re

import pyarrow as pa
import pytest

from panelkit.llm import infill


def plain(key, text, unit="line", rate=100, suffix_first=50, marks=infill.SENTINELS, seed=7):
    """n, form, prefix and middle lengths and the output, by slices of a Python string."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return n, form, len(pre), len(mid), s + suf + p + pre + m + mid if form == "spm" else p + pre + s + suf + m + mid


def texts():
    rng = random.Random(13)
    odd = [None, "", "\n", "\n\n\n", "a", "é", "😀\né\n", "x<P>y", "<S", "<M>", "a<\n<\n>", "<\n" * 9, "é\r\n b\x85c", "\x00\n\x00"]
    made = ["".join(rng.choice("aé€😀\n\n <>P") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return odd + made + ["é b\n" * 30_000, "x" * 200_000, "😀" * 50_000 + "\n"]


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize("options", [{}, {"rate": 60, "suffix_first": 20, "marks": ("[pre]", "[suf]", "[mid]"), "seed": 3}])
def test_equals_slices_and_comes_back(frame, unit, options):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a\nb\n"), (5, "é"), (5, "é")]
    docs = frame(rows).withColumnRenamed("block", "form")
    marks = options.get("marks", infill.SENTINELS)
    got = infill.fill_in_middle(docs, unit=unit, **options).withColumn("back", infill.restored(marks=marks)).collect()
    assert set(got[0].asDict()) == {"doc_id", "extra", *infill.ADDED, "back"}
    want = [(k, *plain(k, t, unit, **options), t or "") for k, t in rows]
    assert sorted([(r.doc_id, *(r[c] for c in infill.ADDED), r.back) for r in got], key=str) == sorted(want, key=str)


def test_pieces_are_cut_anywhere(monkeypatch):
    monkeypatch.setattr(infill.W.pieces, "__defaults__", (16,))
    rows = texts()[:60]
    numbers = infill.np.random.default_rng(4).integers(0, 1 << 32, (len(rows), 4))
    small = infill.transform_column(pa.array(rows, pa.string()), numbers)
    monkeypatch.undo()
    assert small.equals(infill.transform_column(pa.array(rows, pa.string()), numbers))


def test_index_converts_both_ways():
    text = "aé€😀b" * 20
    index = infill.Exceptions.of(infill.np.frombuffer(text.encode(), infill.np.uint8))
    points = infill.np.arange(len(text) + 1)
    places = infill.np.array([len(text[:k].encode()) for k in points])
    assert (index.to_places(points) == places).all() and (index.to_points(places) == points).all()


def test_empty_table_and_odd_marks(frame):
    assert infill.fill_in_middle(frame([])).count() == 0
    for marks in [("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "y"), ("", "x", "y")]:
        with pytest.raises(ValueError):
            infill.fill_in_middle(frame([]), marks=marks)
    with pytest.raises(ValueError):
        infill.fill_in_middle(frame([]), unit="word")
