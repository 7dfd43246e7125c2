import random
import re

import pytest

from panelkit.llm import pages, queries


@pytest.mark.parametrize("markup, want", [
    (None, []), ("", []), ("plain  text\n here", ["plain text here"]),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>a</ul></nav><p>x &amp; &lt;y&gt;&#233;&nbsp;z<footer>f</footer></body>", ["x & <y>é z"]),
    ("<div class='ad big'>buy<div>more</div></div><p>a<b>b</b>c<br>d<p>e", ["abc d", "e"]),
    ("<header>site</header><article><header><h1>Title</h1><span>by me</span></header><p>One</p><aside>side</aside><p>Two</article><p>after", ["Title", "One", "Two"]),
    ("<script>var t='</p>';</script><p title='a > b'>q</p><!-- <p>no</p> --><p>r", ["q", "r"]),
    ("<div id=cookie-notice>c</div><div class=comments><article><p>first!</article></div><main><p>m</main>", ["m"]),
    ("<p class=ad>gone<p>here<ul><li>i<li class='share'>s<li>j</ul>", ["here", "i", "j"]),
    ("a < b <<p>c</p> <3", ["a < b <", "c", "<3"]), ("<form><p>f<input></form>x<select><option>o</select>y", ["xy"]),
    ("<p>x<script>never closed <p>y", ["x"]), ("<p>x<!-- never closed <p>y", ["x"]), ("<p hidden>h<p style='display: none'>n<p>s", ["s"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
])
def test_lines(markup, want):
    assert pages.lines(markup)[0] == want


def test_common_subsequence_is_longest():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = pages.shared_lines(a, b)
        assert len(found) == length(a, b) and found == sorted(set(found))
        place = -1
        for k in found:
            place = b.index(a[k], place + 1)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [0, 10, 200_000])
def test_common_subsequence_of_many_equal_lines(monkeypatch, limit):
    monkeypatch.setattr(pages, "PAIRS", limit)
    rng = random.Random(2)
    for _ in range(150):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 20))] for _ in range(2))
        found = pages.shared_lines(a, b)
        place = -1
        for k in found:
            place = b.index(a[k], place + 1)
        assert len(found) == longest(a, b) and found == sorted(set(found))


def test_common_subsequence_of_long_listings():
    import time

    start = time.time()
    assert len(pages.shared_lines(["x"] * 50_000, ["x"] * 50_000)) == 50_000
    a, b = [["a", "b"][k % 2] for k in range(20_000)], [["b", "a", "c"][k % 3] for k in range(20_000)]
    assert len(pages.shared_lines(a, b)) == len(pages.shared_lines(b, a)) > 13_000
    assert time.time() - start < 10


STORY = "Rivers rose again on Monday and the lower fields stood under water for a third week in a row. "


def extracted(spark, rows):
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_a_teaser_does_not_hide_the_story(spark):
    page = lambda k: f"<div>Acme</div><div>{STORY}{k}</div><div>{STORY}More {k}.</div><article><p>Teaser {k}</p></article><div>Imprint</div>"
    got = extracted(spark, [(k, f"https://a.example/n/{k}", page(k)) for k in range(5)] + [(9, "https://b.example/n", page(9))])
    assert all(got[k] == f"{STORY}{k}\n{STORY}More {k}." for k in range(5))
    assert got[9] == f"Acme\n{STORY}9\n{STORY}More 9.\nImprint"  # alone on its host


def test_names_inside_an_article_need_the_neighbours_vote(spark):
    page = lambda k: f'<article><p class="alert">Body {k}</p><p class="notice">Read our terms</p><p class="ad">Buy {k}</p><p>Rest {k}</article>'
    got = extracted(spark, [(k, f"https://a.example/n/{k}", page(k)) for k in range(4)] + [(9, None, page(9))])
    assert all(got[k] == f"Body {k}\nRest {k}" for k in range(4)) and got[9] == "Body 9\nRead our terms\nRest 9"


def test_comments_by_other_names(spark):
    page = '<main><p>Text</p></main><div id="respond"><article class="c"><p>first!</p></article></div><div id="discussion"><article><p>second</p></article></div>'
    assert extracted(spark, [(1, None, page)]) == {1: "Text"}


def test_short_pages_lose_their_template_and_copies_keep_their_text(spark):
    frame = lambda body: f"<div>Acme Daily News</div><div>Home of all the news</div><p>{body}</p><div>Imprint and contact</div>"
    got = extracted(spark, [(k, f"https://a.example/{k}", frame(f"B{k}")) for k in range(4)])
    assert got == {k: f"B{k}" for k in range(4)}
    # a group of copies between other pages, all of one template
    rows = [(k, f"https://b.example/{k}", frame(STORY * 3 if 2 <= k < 7 else f"{STORY}{k}")) for k in range(10)]
    assert extracted(spark, rows) == {k: (STORY * 3).strip() if 2 <= k < 7 else f"{STORY}{k}" for k in range(10)}
    # near copies of a long text share their paragraphs with every neighbour
    rows = [(k, f"https://c.example/{k}", f"<p>{STORY * 3}</p><p>{STORY * 2}end</p><p>No {k}</p>") for k in range(5)]
    assert all(text.startswith(STORY) for text in extracted(spark, rows).values())


def plain_text(rows):
    """Every page's text by comparing it with its neighbours one by one, with the plain recurrence for common subsequences."""
    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = 1 + t[i + 1][j + 1] if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    path = lambda url: url.split("/", 3)[3].split("/")
    hosts, out = {}, {}
    for k, url, page in rows:
        own = tuple(x for x, _ in pages.blocks(page))
        group = hosts.setdefault(url.split("/")[2], {})
        if own:
            group[own] = min(group.get(own, (url, k)), (url, k))
    for k, url, page in rows:
        blocks = pages.blocks(page)
        own = [x for x, _ in blocks]
        order = sorted((u, o) for o, (u, _) in hosts[url.split("/")[2]].items())
        at = next((n for n, (_, o) in enumerate(order) if list(o) == own), None)
        gone = set()
        if at is not None:
            sides = [order[n] if 0 <= n < len(order) else None for n in (at - 1, at + 1)]
            score = [-1 if x is None else next((n for n, (p, q) in enumerate(zip(path(order[at][0]), path(x[0]))) if p != q), min(len(path(order[at][0])), len(path(x[0])))) for x in sides]
            near, far = sides if score[0] >= score[1] else sides[::-1]
            if far is None:
                beyond = at - 2 if near == sides[0] else at + 2
                far = order[beyond] if 0 <= beyond < len(order) else None
            chars = lambda f: sum(len(own[x]) for x in f)
            if near is not None:
                gone = set(common(own, near[1]))
                if chars(gone) > 0.8 * chars(range(len(own))):
                    gone &= set(common(own, far[1])) if far is not None else set()
                    if chars(gone) > 0.8 * chars(range(len(own))) and (len(gone) == len(own) or max(len(own[x]) for x in gone) >= 160):
                        gone = set()
        out[k] = "\n".join(pages.chosen(blocks, gone))
    return out


def test_mixed_hosts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(160):
        host, distinct = rng.choice("abc"), lambda n: [f"Own line {rng.randrange(10**6)} of page" for _ in range(n)]
        body = [f"Site {host}", f"Menu {host}", *distinct(rng.randint(0, 4)), f"Imprint {host}"][rng.randint(0, 1) :]
        markup = "".join(rng.choice([f"<div>{x}</div>", f"<p>{x}", f"<article><p class='notice'>{x}</article>"]) for x in body)
        rows.append((k, f"https://{host}.example/{rng.choice(['x', 'y'])}/{k:03d}", markup if rng.random() < 0.9 else "<p>Copied page</p><p>of two lines</p>"))
    assert extracted(spark, rows) == plain_text(rows)


def test_neighbours_tell_the_template(spark):
    def page(k, body):
        return f"<div>Acme Daily</div><div>Home of news</div><p>{body}</p><p>Story {k} goes on for some words more.</p><div>Imprint 2020</div>"

    rows = [(k, f"https://a.example/{'x' if k < 6 else 'y'}/{k:02d}?q=1", page(k, f"Body number {k}")) for k in range(12)]
    rows += [(50, "https://b.example/1", page(50, "Alone on its host")), (51, None, page(51, "No url")), (52, "nonsense", "<p>n</p>"),
             (53, "https://c.example/1", "<article><p>Same</p></article>"), (54, "https://c.example/2", "<article><p>Same</p></article>"),
             (55, "https://d.example/1", "<p>A copy of it</p>"), (56, "https://d.example/2", "<p>A copy of it</p>"), (56, "https://d.example/2", "<p>A copy of it</p>"),
             (57, "https://e.example/", None), (58, "https://e.example/x", ""), (None, "https://e.example/y", "<p>z</p>" * 20_000)]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = pages.main_text(frame).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    by = {r.page_id: r.text for r in got}
    assert all(by[k] == f"Body number {k}\nStory {k} goes on for some words more." for k in range(12))
    assert by[50].startswith("Acme Daily\n") and by[51].endswith("Imprint 2020") and by[52] == "n"
    assert by[53] == by[54] == "Same" and by[55] == by[56] == "A copy of it" and by[57] == by[58] == "" and len(by[None]) == 39_999
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, sf_dir):
    import html

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op4_html_extraction"](spark, sf_dir).collect()
    assert {r.page_id for r in got} == set(source)
    for r in got:  # the pages' own form: one article of h1, p, b and br
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)
