"""Hand-made pages for each rule, and the articles of the test pages by another way."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm.htmltext import first_pass, blocks, extracted, main_text
from tagloom.llm.queries import QUERIES

LONG = "It was the first day of the year and they had come to the house by the river with all that they had. " * 3
LONG = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   \n", ""), ("<p></p><div> &nbsp;</div>", ""), ("just words", ""),
        (f"<p>{LONG}</p>", LONG),
        (f"<h1>Title</h1><p>{LONG}</p>", f"Title {LONG}"),
        (f"<div><p>{LONG}</p></div><p>x</p><p><a href=1>{LONG}</a></p>", LONG),
        (f"<div><p>{LONG}</p></div><p>x</p><p>y</p><p><a href=1>{LONG}</a></p>", f"{LONG} x"),
        ("<article><h1>A</h1><p>b c.</p><p>qq</p></article>", "A b c. qq"),
        (f"<p>{LONG}</p><article><p>in it</p></article><p>{LONG}</p>", "in it"),
        ("<article><header><h1>T</h1></header><p>a&amp;b &#233;&#x1F642; &lt;i&gt;</p></article>", "T a&b é🙂 <i>"),
        ("<article>a<br>b  c\n d<b>e</b>f</article>", "a b c def"),
        ("<header><p>site</p></header><article>x<footer>by me</footer></article>", "x"),
        (f"<div class='Cookie-notice'><p>{LONG}</p></div><p>{LONG}</p>", LONG),
        (f"<div id=sidebar><div><p>{LONG}</p></div></div><p>{LONG} a</p>", f"{LONG} a"),
        (f"<article><p>x y</p><section class='comments'><article><p>{LONG}</p></article></section></article>", "x y"),
        (f"<article><p>x y</p></article><article class=comment>{LONG}</article>", "x y"),
        ("<main><form><label>Mail</label><p>fill in</p></form><p>text</p></main>", "text"),
        ("<main><script>var a='</p>';</script><style>p{}</style><noscript>no</noscript><p>text</p></main>", "text"),
        ("<main><p>one<p>two<b>three<p>four</main>", "one twothree four"),
        ("<main><!-- <p>gone</p> --><p>a</p><!-- open <p>b</p>", "a"),
        ("<main><p>1 < 2 and <unclosed</p></main>", "1 < 2 and"),
        ('<main><p title="a>b">kept</p><p title="open>rest</p></main>', "kept rest"),
        ("<main><ul><li><a href=x>menu</a></li><li>item of the list</li></ul></main>", "item of the list"),
        ("<MAIN><P>Upper</P></MAIN>", "Upper"),
        ("<main><script>never closed <p>x</p></main>", ""),
        (f"<div role=navigation>{LONG}</div><div class=post>{LONG}</div>", LONG),
        (f"<body class='has-sidebar'><p>{LONG}</p></body>", LONG),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


def test_short_blocks_follow_the_nearest_decided_one():
    links = "<p><a href=x>" + "link text " * 20 + "</a></p>"
    page = f"{links}<p>near links</p><p>m</p><p>n</p><p>near text</p><p>{LONG}</p>"
    assert main_text(page) == f"n near text {LONG}"
    undecided = [first_pass(b, False) for b in blocks(page)]
    assert undecided == [False, None, None, None, None, True]


def test_few_stop_words_are_no_text():
    assert main_text("<p>" + "keyword stuffing seo cheap " * 20 + "</p>") == ""


def test_long_page_and_many_open_tags():
    page = "<main>" + "<div><b>" * 20_000 + "<p>deep</p>" + f"<p>{LONG}</p>" * 2_000 + "<a '" * 200 + "</main>"
    assert main_text(page).startswith("deep It was") and main_text(page).count("river") == 6_000


def test_edge_rows(spark):
    page = f"<p>{LONG}</p>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (None, None, page, None), (2, "v", None, "t"), (3, "w", "", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumn("n", F.lit(1))
    got = extracted(df)
    assert got.columns == ["page_id", "url", "n", "text"]
    want = [(1, "u", 1, LONG), (1, "u", 1, LONG), (None, None, 1, LONG), (2, "v", 1, ""), (3, "w", 1, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert extracted(df.limit(0)).collect() == []


def test_query_against_the_articles(spark, sf_dir):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, QUERIES["op6_html_extraction"](spark, sf_dir).collect())) == sorted(want)
