import html
import random
import re
import time

import pytest

from blockscope.llm import html_extract as h

LONG = "A paragraph that is long enough to be taken for text by its length alone, says the test."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<html><body></body></html>", ""),
        (f"<p>{LONG}</p>", LONG),
        ("<article><p>x</p></article>", "x"),
        ("<article><p>a &lt;b&gt; &amp;amp; &#233;</p></article>", "a <b> &amp; é"),
        ("<article><p> a\n\t b&nbsp;c </p><p>d<br>e</p></article>", "a b c\nd e"),
        ("<article><h1>T</h1><p>one<p>two<ul><li>three<li>four</ul></article>", "T\none\ntwo\nthree\nfour"),
        ("<article><p>one</p><script>var a='<p>no</p>';</script><style>p{}</style><p>two</p></article>", "one\ntwo"),
        ("<article><p>one</p><!-- <p>no</p> --><p>two</p></article>", "one\ntwo"),
        ("<nav>menu</nav><article><p>text</p></article><footer>foot</footer>", "text"),
        ("<article><p>text</p><form><input><label>mail</label></form><p>more</p></article>", "text\nmore"),
        ("<article><p>text</p><div class='ad'>buy<div>now</div></div><p>more</p></article>", "text\nmore"),
        ("<article><p>text</p><section id='comments'><p>first!</p></section></article>", "text"),
        ("<main><article><p>text</p></article><article class='comment'><p>me</p></article></main>", "text"),
        ("<article><aside>side</aside><p><a href='x'>only a link</a></p><p>text</p></article>", "only a link\ntext"),
        ("<div class=cookie-notice>we use</div><article>bare <b>text</b></article>", "bare text"),
        ("<article><p>cut off</p><p>here <b", "cut off\nhere"),
        ("<article><p>x < y and y > z</p></article>", "x < y and y > z"),
        ("no markup at all", "no markup at all"),
        (f"<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div>{LONG}</div><div>short</div>"
         "<p><a href=c>About</a></p><p><a href=d>Jobs</a></p><p><a href=e>Terms</a></p>", f"{LONG}\nshort"),
        ("<head><title>t</title><body><article><p>text</article>", "text"),
        ("<article><header><h1>Title</h1></header><p>text</p></article>", "Title\ntext"),
        ("<article><p class=ad>buy<p>text</article>", "text"),
        ("<article><p hidden>unseen</p><p class='adbox top'>buy</p><p class=address>Main St</p></article>", "Main St"),
    ],
)
def test_main_text(page, text):
    assert h.main_text(page) == text


LINKS = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Jobs</a></li></ul>"
TEASER = "<article><h2><a href=t>More</a></h2><p>teaser</p></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p></main>{LINKS}{TEASER}", f"T\n{LONG}\n{LONG}\nMore\nteaser"),
        (f"<main><h1>T</h1><p>{LONG}</p>{TEASER}<p>end</p></main>", f"T\n{LONG}\nMore\nteaser\nend"),
        (f"{TEASER}{LINKS}<div><p>{LONG}</p><p>short</p></div>{LINKS}", f"More\nteaser\n{LONG}\nshort"),
        (f"<div>far</div>{LINKS}<article><p>x</p></article>{LINKS}<div>off</div>", "x"),
        (f"<div>far</div>{LINKS}<div><p>{LONG}</p><p>short</p></div>{LINKS}<div>off</div>", f"{LONG}\nshort"),
    ],
)
def test_window_sums_choose_with_and_without_an_article(page, text):
    assert h.main_text(page) == text


def test_surge_and_dive():
    assert h.spans([0, 50, 0, 0, 5, 0, 0, 0, 60], 40) == [(1, 5), (8, 9)]
    assert h.spans([10, 10, 10], 40) == []
    assert h.spans([], 1) == []


def test_very_long_page():
    page = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert h.main_text(page).count("\n") == 49_999
    assert h.main_text("<p>" * 20_000 + "x") == "x"


def brute_spans(weights, surge):
    """Line by line: in text from a surge on, as long as a window that starts at the line holds any weight."""
    kept, run, found = [], False, []
    for at, weight in enumerate(weights):
        block = sum(weights[at : at + h.WINDOW])
        run = (run and block > 0) or (weight > 0 and block >= surge)
        kept.append(run)
    at = 0
    while at < len(weights):
        if not kept[at]:
            at += 1
            continue
        end = at
        while end < len(weights) and kept[end]:
            end += 1
        # a window of no weight ends a range even where the next one surges at once
        last = max(k for k in range(at, end) if weights[k])
        found.append((at, last + 1))
        at = end
    return found


def test_curve_equals_brute_force():
    draw = random.Random(5)
    for _ in range(3000):
        weights = [draw.choice([0, 0, 0, 5, 15, 25, 60]) for _ in range(draw.randrange(0, 30))]
        for surge in (1, h.SURGE):
            assert h.spans(weights, surge) == brute_spans(weights, surge)


def test_a_line_of_an_article_does_not_surge_by_itself():
    """The window decides inside an article too; boilerplate in it does not part its lines."""
    assert h.INSIDE < h.SURGE
    assert h.main_text(f"<article><p>lone</p></article>{LINKS}<div>{LONG}</div>") == LONG
    assert h.main_text(f"<article><p>lone</p><p>pair of lines</p></article>{LINKS}<div>{LONG}</div>") == f"lone\npair of lines\n{LONG}"
    notice = "<div class=notice><p>a</p><p>b</p><p>c</p></div>"
    assert h.main_text(f"<article><h1>T</h1>{notice}<p>{LONG}</p></article>") == f"T\n{LONG}"
    assert h.main_text(f"<div>far</div>{LINKS}<article><p>x</p></article>") == "x"


@pytest.mark.parametrize("tag", ["aside", "a", "article", "div"])
def test_many_open_tags_take_little_time(tag):
    began = time.monotonic()
    h.main_text(f"<{tag}>x" * 100_000 + f"</{tag}><p>y" * 100)
    assert time.monotonic() - began < 30


def test_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (2, None, "<article>é</article>", "t"), (2, None, "<article>é</article>", "t"), (None, "v", "", "t")],
        "page_id long, url string, html string, text string",
    )
    out = h.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "u", "", 0), (2, None, "é", 1), (2, None, "é", 1), (None, "v", "", 0)], key=str
    )
    assert h.extract(pages.limit(0)).count() == 0


def test_pages_give_back_their_documents(spark):
    """Every page renders the document its path names: a headline and then its lines."""
    home = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{home}/documents.parquet").collect()}
    table = spark.read.parquet(f"{home}/pages.parquet")
    pages = {r.page_id: r.html for r in table.collect()}
    for r in h.extract(table).collect():
        lines = texts[int(re.search(r"/(\d+)", r.url)[1])].split("\n")
        lines = [" ".join(x.split()) for x in lines]
        headline = html.unescape(re.search(r"<article>\s*<h1[^>]*>(.*?)</h1>", pages[r.page_id], re.S)[1])
        assert r.text.split("\n") == [" ".join(headline.split()), *[x for x in lines if x]]
        assert r.n_chars == len(r.text)
