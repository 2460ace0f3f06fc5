"""Main text of pages: elements, names and densities one by one, made pages whole, given pages against their article element."""

import html
import random
import re

import pytest

from claimcheck.llm import html_text, queries
from claimcheck.llm.html_text import main_text
from tests.conftest import TESTDATA

LONG = "The men of the village went to the river in the morning and they came back with more water than the day before. " * 3
LONG = LONG.strip()
KEPT = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>One  two\n\tthree</p>", "One two three"),
        ("<p>a<b>b</b>c <i>d</i></p>", "abc d"),
        ("<p>a<br>b<br><br>c</p>", "a b\nc"),
        ("<p>a<p>b<p>c", "a\nb\nc"),
        ("<ul><li>a<li>b</ul><table><tr><td>x<td>y</table>", "a\nb\nx\ny"),
        ("<p>&amp;&lt;&#8364;&#x41;&eacute;&nbsp;&copy &unknown; &am</p>", "&<€Aé © &unknown; &am"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p title='a>b' data=\"x>y\">t</p>", "t"),
        ("<p title=\"open>t</p><p>u</p>", "t\nu"),
        ("<p>t<!-- > <p>no</p> --><!-->u</p>", "tu"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>t</p><textarea>no</textarea>", "t"),
        ("<SCRIPT>no</SCRIPT><P CLASS=Ad>no</P><P>t</P>", "t"),
        ("<p>t</p><div class='post-comments'><p>no</p></div><p>u</p>", "t\nu"),
        ("<p>t</p><article class=comment><p>no</p></article>", "t"),
        ("<p>t</p><aside><p>no</p></aside><form><p>no</p></form><footer>no</footer>", "t"),
        ("<p>t</p><div style='display: none'>no</div><div hidden>no</div><div aria-hidden=true>no</div>", "t"),
        ("<header><h1>Title</h1></header><p>t</p>", "Title\nt"),
        ("<p>t</p><div class='no-sidebar has-comments'>u</div>", "t\nu"),
        ("<h2>Part<p>t", "Part\nt"),
        ("<p>nul\0byte</p>", "nul�byte"),
    ],
)
def test_inside_an_article(inside, text):
    assert main_text(f"<body><nav><a href=/>home</a></nav><article>{inside}</article><p>{LONG}</p>") == text


def test_without_article_density_decides():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(8)) + "</ul>"
    page = f"<div>{menu}</div><h1>Title</h1>{KEPT}<p>Short.</p>{KEPT}<div>{menu}</div><p>&copy; 2020 Us</p>"
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_ambiguous_blocks_take_the_nearest_label():
    links = "<p><a href=x>one link after the other</a></p>"
    # The middle one is as near to the links: outside an article it goes, inside one it stays.
    some = f"{KEPT}<p>near the text</p><p>between</p><p>near links</p>{links}"
    assert main_text(f"<div>{some}</div>") == f"{LONG}\nnear the text"
    assert main_text(f"<article>{some}</article>") == f"{LONG}\nnear the text\nbetween"
    assert main_text(f"<div>{links}<h2>Of what follows</h2>{KEPT}</div>") == f"Of what follows\n{LONG}"
    assert main_text(f"<div>{KEPT}<h2>More</h2>{links}</div>") == LONG
    assert main_text("<div><p>nothing decided</p></div>") == ""
    assert main_text("<article><p>nothing decided</p></article>") == "nothing decided"


def test_links_and_words():
    words = "Qwzx " * 60
    assert main_text(f"<div><p>{words}</p>{KEPT}</div>") == LONG
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert main_text(f"<article>{KEPT}<p>Read <a href=x>another story</a></p></article>") == LONG
    assert main_text(f"<article>{KEPT}<p><a name=x>An anchor is no link</a></p></article>") == f"{LONG}\nAn anchor is no link"


def test_broken_and_wrapped_pages():
    assert main_text(f"<html><head><meta charset=x><body><p>x</p>{KEPT}") == f"x\n{LONG}"
    assert main_text(f"<nav><ul><li>no<article>{KEPT}</article>") == LONG
    assert main_text(f"<form id=all><div>{KEPT}<p>Your name</p></div></form>") == f"{LONG}\nYour name"
    assert main_text("<form><p>Give us your address and we will send you the news of the week.</p></form>" + KEPT) == LONG
    assert main_text(f"<div role=main>{KEPT}</div><div>{KEPT}</div>") == LONG
    assert main_text(f"<main><h1>T</h1><article>{KEPT}</article><p><a href=x>more</a></p></main>") == f"T\n{LONG}"
    assert main_text("<article><p>cut <a href='x") == "cut"
    assert main_text(f"<article></article>{KEPT}") == LONG
    assert main_text("") == main_text("<p>") == main_text("<article>") == ""
    assert main_text("<" * 1000 + "\"" * 1000 + "<p>") == ""


def test_long_pages_take_linear_time():
    page = "<article>" + "<p class=\"x\" title='\">word <b>and" * 40_000
    assert len(html_text.blocks(page)) > 0


def sentence(rng, n):
    return " ".join(rng.choice("the of and river stone water light under house in morning to people was".split()) for _ in range(n)) + "."


def made_page(rng):
    """(html, text) of a page put together from an article and all that surrounds one."""
    paragraphs = [sentence(rng, rng.randrange(1, 60)) + rng.choice(["", " & <so> on", " “é”"]) for _ in range(rng.randrange(1, 8))]
    title = sentence(rng, 5)
    tag = rng.choice(["article", "main", "div role=main"])
    noise = [
        lambda: f"<nav>{''.join(f'<a href=/{k}>{sentence(rng, 2)}</a>' for k in range(5))}</nav>",
        lambda: f"<div class='{rng.choice(['ad', 'ad-slot', 'top-banner', 'cookie-notice', 'newsletter', 'sidebar left'])}'><p>{sentence(rng, 40)}</p></div>",
        lambda: f"<aside><h3>{sentence(rng, 3)}</h3><p>{sentence(rng, 50)}</p></aside>",
        lambda: f"<form action=x><label>{sentence(rng, 3)}</label><input name=q><button>Go</button></form>",
        lambda: f"<script>document.write('<p>{sentence(rng, 30)}</p>')</script>",
        lambda: f"<section id=comments><h2>Comments</h2><article class=comment><p>{sentence(rng, 60)}</p></article></section>",
    ]
    some = lambda: "".join(rng.choice(noise)() for _ in range(rng.randrange(3)))
    body = "".join(f"<p>{html.escape(p)}{rng.choice(['</p>', ''])}" + (some() if rng.random() < 0.2 else "") for p in paragraphs)
    page = (
        f"<!doctype html><html><head><title>{title}</title></head><body><header><p>{sentence(rng, 40)}</p></header>{some()}"
        f"<{tag}><h1>{html.escape(title)}</h1>{body}</{tag.split()[0]}>{some()}<footer><p>{sentence(rng, 60)}</p></footer></body></html>"
    )
    return page, "\n".join([title, *paragraphs])


def test_made_pages(spark):
    made = [made_page(random.Random(k)) for k in range(300)]
    pages = spark.createDataFrame([(k, f"u{k}", page) for k, (page, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, KEPT, "x"), (2, KEPT, "x"), (None, "<p>" * 100_000 + "a" * 300_000, "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert out.columns == ["page_id", "text", "n_chars"]
    assert sorted(tuple(r) for r in out.where("page_id IS NOT NULL").collect()) == [(1, "", 0), (2, "", 0), (2, LONG, len(LONG)), (2, LONG, len(LONG))]
    assert out.count() == 5
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_query_against_the_article_element(spark):
    folder = f"{TESTDATA}/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op12_html_text"](spark, folder).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search("<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(p).split()) for p in re.split("<[^>]*>", article)]
        assert row["text"] == "\n".join(filter(None, parts)) and row["n_chars"] == len(row["text"])
