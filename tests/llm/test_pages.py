"""Operator 4 against the test pages' template, and page by page."""

import html
import re

import pyarrow.parquet as pq

from furrow.llm.html_text import extract, main_text
from furrow.llm.queries import op4_html_text

LONG = "some words of the article that go on for a while, as they do. " * 4


def _template(page):
    """Blocks of the <article> of a page of the test table."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_op4_over_a_table(spark, sf):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    rows = op4_html_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == _template(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


def test_pages_without_an_article_element():
    page = (f"<html><body><div class='top-nav'><a href=/>Home</a> Start</div><div id=header>Site</div><h1>Title</h1><p>{LONG}</p><p>Short.</p>"
            f"<p>{LONG}</p><ul><li><a href=x>one link</a></li></ul><div class=comments><p>{LONG}</p></div><div>&copy; 2020</div></body>")
    text = " ".join(LONG.split())
    assert main_text(page) == f"Title\n\n{text}\n\nShort.\n\n{text}"


def test_parts_left_out_inside_an_article():
    page = (f"<main><article><header><h1>T</h1></header><p>{LONG}<script>var x='</p>';</script></p><aside>see also</aside><form><p>mail</p></form>"
            f"<div class='ad-box'>buy</div><p hidden>no</p><p>end</p><section id='comments'><article><p>{LONG}</p></article></section></article></main><p>{LONG}</p>")
    assert main_text(page) == "T\n\n" + " ".join(LONG.split()) + "\n\nend"


def test_odd_pages(spark):
    cases = {None: "", "": "", "plain": "plain", "<p>a<!-- x": "a", "a < b &amp; c": "a < b & c", "<p>x&nbsp;&#233;\n y": "x é y", "<script>only": "",
             "<nav>menu": "", "<article><p>z": "z", "<b><b><b>": "", "<article>" + "<p>w</p>" * 5000: "\n\n".join(["w"] * 5000)}
    for page, text in cases.items():
        assert main_text(page) == text
    df = spark.createDataFrame([(p, "t") for p in cases], "html string, Text string")
    assert [r.text for r in extract(df).collect()] == list(cases.values())
    assert extract(df.limit(0)).count() == 0


def test_unmarked_pages_keep_short_endings_and_lists():
    text = " ".join(LONG.split())
    items = "".join(f"<li>item {n}</li>" for n in range(8))
    page = (f"<body><div><a href=/>Home</a></div><div class=post><h1>Title</h1><p>By me</p><p>May 1</p><p>{LONG}</p><ul>{items}</ul><p>{LONG}</p>"
            f"<p>One.</p><p>Two.</p><p>The end.</p></div><div>&copy; 2020</div></body>")
    want = ["Title", "By me", "May 1", text, *(f"item {n}" for n in range(8)), text, "One.", "Two.", "The end."]
    assert main_text(page) == "\n\n".join(want)
    assert main_text(f"<h1>Title</h1><p>{LONG}</p><p>The end.</p>") == f"Title\n\n{text}\n\nThe end."
    assert main_text(f"<div><div>{LONG}</div><div>The end.</div></div><p>foot</p>") == f"{text}\n\nThe end."


def test_windows_select_inside_an_article():
    text = " ".join(LONG.split())
    links = "<li><a href=x>another story of this site</a></li>" * 4
    four = "\n\n".join(["another story of this site"] * 4)
    assert main_text(f"<article><p>{LONG}</p><ul>{links}</ul><p>The end.</p><ul>{links}</ul></article>") == f"{text}\n\n{four}\n\nThe end.\n\n{four}"
    assert main_text(f"<article><h1><a href=x>T</a></h1><p>{LONG}</p><h2><a href=x>U</a></h2><ul>{links}</ul></article><ul>{links}</ul>") == f"T\n\n{text}\n\nU\n\n{four}"
    assert main_text(f"<article><div><p>{LONG}</p><p>See <a href=x>this</a></p></div><div><p>5 shares</p></div></article>") == f"{text}\n\nSee this"
    assert main_text("<article><p><a href=x>all linked</a></p></article>") == "all linked"


def test_unmarked_table_equals_the_marked_one(sf):
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        page = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        page = re.sub(r"<main\b[^>]*>", "<div>", page).replace("</main>", "</div>")
        assert main_text(page) == _template(r["html"])


def test_deeply_nested_and_unmatched_elements():
    assert main_text("<div>x" * 20_000 + "</td>" * 20_000).startswith("x\n\nx")


def test_names_beside_words_for_text():
    text = " ".join(LONG.split())
    for page in (f"<article><div class='share-text content'><h1>T</h1><p>{LONG}</p></div></article><p>foot</p>",
                 f"<article><h1>T</h1><p class='research notice-body'>{LONG}</p></article>",
                 f"<div><h1>T</h1><div id=promo-story><p>{LONG}</p><div class=ad-box>buy</div><form>mail</div></div><div class=foot>x</div>",
                 f"<article><h1>T</h1><div class=promo><p>{LONG}</p></div></article>"):
        assert main_text(page) == f"T\n\n{text}"
    # little text, or readers' text, goes whatever stands beside the name
    assert main_text(f"<article><p>{LONG}</p><div class='share-text'>Tell a friend</div><p>End.</p><div class='comment-body'><p>{LONG * 9}</p></div></article>") == f"{text}\n\nEnd."
    assert main_text(f"<div><p>{LONG}</p><div class=cookie-banner><div><p>{LONG}</p></div></div></div>") == text
    assert main_text("<div class=notice-text><p>") == ""


def test_named_elements_end_with_their_tag():
    text = " ".join(LONG.split())
    assert main_text(f"<div><div class=ad-box><form><p>mail</div><p>{LONG}</p></div>") == text
    assert main_text(f"<div><p class=ad-box>buy<p>{LONG}</p></div>") == text
    assert main_text(f"<div class=widget><div class=widget>a</div>b</div><div><p>{LONG}</p></div>") == text
    assert main_text(f"<div class=nav><a href=/>x</a><article><p>{LONG}</p></article></div>") == text


def _plain(page):
    """The lines of a part that is <p> lines alone: all of them are its text."""
    return "\n\n".join(" ".join(x.split()) for x in re.findall(r"<p>(.*?)</p>", page))


def test_parts_of_plain_lines_are_whole():
    import random
    rng = random.Random(3)
    for _ in range(200):
        page = "".join("<p>" + "word " * rng.choice([1, 2, 5, 40, 200]) + "</p>" for _ in range(rng.randrange(1, 30)))
        assert main_text(f"<article>{page}</article>") == _plain(page)
        assert main_text(f"<ul><li><a href=/>Home</a></li></ul><div class=post>{page}</div><div class=nav>{page}</div>") == _plain(page)
