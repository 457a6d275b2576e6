"""Main text of layouts that the training generator does not make."""

import html
import re
import time

import pytest

from gridloom.llm import html_extract

L = "The first paragraph tells what happened in the town that day and why it matters to people."
S = "Short one here"
CASES = {
    "p in a div": (f"<article><h1>Title of it</h1><div><p>{L}</p></div><p>{L}</p></article>", f"Title of it\n{L}\n{L}"),
    "short p in a div": (f"<article><h1>Title of it</h1><div><p>First paragraph ..</p></div><p>{S}</p></article>", f"Title of it\nFirst paragraph ..\n{S}"),
    "section in section": (f"<main><section><h2>Part</h2><section><p>{L}</p><p>{S}</p></section></section></main>", f"Part\n{L}\n{S}"),
    "cell in spans": (f"<article><p>{L}</p><table><tr><td><div><span>cell one</span></div></td><td><div><span>2</span></div></td></tr></table></article>", f"{L}\ncell one\n2"),
    "linked words": (f"<article><p>See <b><a href='/x'>the report of the year</a></b> for more</p></article>", "See the report of the year for more"),
    "396": ("<article><p>"+L+"</p>"+"<div>"*396+f"<p>{L}</p>"+"</div>"*396+"</article>", f"{L}\n{L}"),
    "5000": ("<article><p>"+L+"</p>"+"<div>"*5000+f"<p>{L}</p>"+"</div>"*5000+f"<p>{S}</p></article>", f"{L}\n{L}\n{S}"),
    "wp": (f"<body class='home has-sidebar'><div id='wrapper'><div id='page'><header class='site-header'><a href=/>Site</a><nav><ul><li><a href=/a>A</a></li></ul></nav></header><div id='content' class='site-content with-sidebar'><div class='entry'><div class='entry-header'><h1>Title</h1></div><div class='entry-content'><p>{L}</p><ul><li>one</li><li>two</li></ul><p>{S}</p></div></div><div id='comments'><h3>2 comments</h3><ol><li><p>{L}</p></li></ol></div></div><aside class='widget'><p>{L}</p></aside></div></div><footer><p>&copy; 2020 {S}</p></footer></body>", f"Title\n{L}\none\ntwo\n{S}"),
    "table layout": (f"<body><table><tr><td><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></td><td><h1>Title</h1><p>{L}</p><p>{L}</p></td></tr></table><div class=footer>{S}</div></body>", f"Title\n{L}\n{L}"),
    "dl details figure": (f"<article><dl><dt>Term</dt><dd>{S}</dd></dl><details><summary>More</summary><p>{L}</p></details><figure><img src=x><figcaption>A caption</figcaption></figure></article>", f"Term\n{S}\nMore\n{L}\nA caption"),
    "article header": (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{L}</p><footer>by someone</footer></article></body>", f"Title\n{L}"),
    "pure body": (f"<body><p>{L}</p><p>{L}</p></body>", f"{L}\n{L}"),
    "bare": (f"{L} {L}", f"{L} {L}"),
    "inline ad": (f"<article><p>{L} <span class='ad'>Buy now</span></p></article>", L),
    "div soup": (f"<div><div><div><h1>Title</h1><div>{L}</div><div>{L}</div></div></div><div class='sidebar'><div>{L}</div></div></div>", f"Title\n{L}\n{L}"),
    "notice": (f"<div class='cookie-notice'>{L}</div><main><div class='notice'>{L}</div><p>{L}</p></main>", L),
    "form": (f"<main><form><p>{L}</p><input></form><p>{S}</p></main>", S),
    "list only article": (f"<article><ul><li><a href=/1>first linked thing</a></li><li><a href=/2>second linked thing</a></li><li><a href=/3>third</a></li></ul></article>", "first linked thing\nsecond linked thing\nthird"),
    "code": (f"<article><pre><code>x = 1\ny = 2</code></pre><p>{S}</p></article>", f"x = 1 y = 2\n{S}"),
    "comment articles": (f"<article><p>{L}</p></article><section id='comments'><article class='comment'><p>{L}</p></article></section>", L),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    source, want = CASES[name]
    assert html_extract.main_text(f"<html><head><title>t</title></head>{source}</html>", html_extract.trained()) == want


def test_time_grows_with_the_page_alone():
    t = time.time()
    html_extract.main_text("<div>" * 100_000 + "x" + "</b></p>" * 100_000, html_extract.trained())
    assert time.time() - t < 60


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of it.</p></article>")], "page_id long, url string, html string")
    for name in ("text", "n_chars", "block", "score"):
        pages = pages.withColumn(name, pages.page_id)
    assert html_extract.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert html_extract.extract(pages).first()["text"] == "Some text of it." and html_extract.extract(pages.limit(0)).count() == 0


def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)[^>]*>", "\0", a)))
        assert got[r["page_id"]] == "\n".join(y for x in a.split("\0") if (y := re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(x)).strip()))
