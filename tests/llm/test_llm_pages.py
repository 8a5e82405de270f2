"""Page texts: templates of made-up sites, awkward markup, and the given pages against a plain re-statement."""

from __future__ import annotations

import html
import re

import pytest
from llm_cases import rows_of, words

from edaflux.llm import page_text, queries

SCHEMA = "page_id bigint, url string, html string, host string, gone string, body int"


def pages(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def site(n: int, seed: int) -> tuple[list[tuple], dict]:
    """Pages of one host: an unnamed menu of changing links, a notice and a box inside the article that return on every
    page, a box on one page only, and a paragraph that many articles share."""
    rows, want = [], {}
    for k in range(n):
        title, one, two = (" ".join(words(12, seed * 1000 + 3 * k + i)) for i in range(3))
        shared = "The same words stand in every article."
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(4 + k % 3, seed * 77 + k))
        own = "<div>Only here</div>" if k == 2 else ""
        rows.append((
            seed * 100 + k, f"https://Site{seed}.example.com:8080/{k}",
            f'<body><div class=top><ul>{menu}</ul></div><div class=x>We value your privacy {k}</div><main><h1>{title}</h1>'
            f"<p>{one}<p>{shared}{own}<div class=b>Join our list of {1000 + k} readers</div><p>{two}</main><div>Imprint</div>",
        ))
        want[seed * 100 + k] = " ".join([title, one, shared, *(["Only here"] if own else []), two])
    return rows, want


def test_templates_go_and_articles_stay(spark):
    rows, want = site(12, 1)
    few, few_want = site(3, 2)  # too few pages to tell: the box inside the article stays
    copies = [(900 + k, f"https://copies.example.com/{k}", "<main><div>A box that copies share</div><p>Text</main>") for k in range(9)]
    got = {r["page_id"]: r["text"] for r in page_text.page_texts(pages(spark, rows + few + copies)).collect()}
    assert {k: got[k] for k in want} == want
    for k, text in few_want.items():
        assert re.sub(r" Join our list of \d+ readers", "", got[k]) == text and got[k] != text
    assert all(got[900 + k] == "A box that copies share Text" for k in range(9))


def test_templates_of_pages_without_an_article(spark):
    rows, want = [], {}
    for k in range(10):
        text = " ".join(words(9, 50 + k))
        links = "".join(f"<a href=/{w}>{w}</a> " for w in words(3 + k % 4, k))
        rows.append((k, "http://plain.example.org/", f"<body><div>{links}</div><div><div>{text}</div></div><div>All rights reserved 20{k:02}</div>"))
        want[k] = text
    assert {r["page_id"]: r["text"] for r in page_text.page_texts(pages(spark, rows)).collect()} == want


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just words  and\n\tmore", "just words and more"), ("<nav>menu</nav>", ""),
    ("<p>a &amp; b&nbsp;c &lt;i&gt; &#233; &eacute &am", "a & b c <i> é é &am"),
    ("<p>one<br>two<p><b>th</b>ree<!-- no -->!<script>var t='</p>';</script><style>p{}</style>", "one two three!"),
    ("<div><p class=ad>buy<p>text<ul><li class='cookie-box'>ok?<li>item</ul><form><p>mail</form>end</div>", "text item end"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>x<div id=comments><p>first!</div></article>out", "Title x"),
    ("<aside>a<article>no</article></aside><article>yes</article>", "yes"),
    ("<head><title>t<body><p>unclosed head", "unclosed head"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p>cut off <a href='x", "cut off"), ("<div>" * 3000 + "deep", "deep"), ("<p>" + "long " * 300_000, ("long " * 300_000).strip()),
    ("<nav><div>open</div><p>menu</nav></nav></p>text", "text"), ("<div role=navigation>m</div><main>t</main>", "t"),
])
def test_markup(page, text):
    blocks, trees, _ = page_text.parsed(page)
    assert " ".join(blocks) == text
    assert all(0 <= a < z <= len(blocks) for _, a, z, _ in trees)


def test_awkward_rows(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "not a url", None), (2, "http://u@h.example:1/x", ""), (3, "HTTP://[::1/", "<p>é😀")]
    got = page_text.page_texts(pages(spark, rows))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(1, None, "a", 1), (1, None, "a", 1), (None, "not a url", "", 0), (2, "http://u@h.example:1/x", "", 0), (3, "HTTP://[::1/", "é😀", 2)]
    assert rows_of(got) == sorted(want, key=repr)
    assert page_text.page_texts(pages(spark, [])).count() == 0


def test_counts_are_of_distinct_texts(spark):
    """The hash of a template is gone only where distinct texts beside it are many enough."""
    rows, _ = site(12, 3)
    again = page_text.page_texts(pages(spark, rows * 3))
    once = {tuple(r) for r in page_text.page_texts(pages(spark, rows)).collect()}
    assert {tuple(r) for r in again.collect()} == once and again.count() == 36


def test_given_pages(spark, sf_dir):
    df = queries.table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op11_html_extraction"](spark, sf_dir).collect()}
    want = {}
    for r in df.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
    assert got == want
