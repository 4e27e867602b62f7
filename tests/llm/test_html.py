import html
import re
import time

import duckdb
import pytest

from weirflow.llm import html_text, queries

SF = "/root/testdata/sf0.001"


def text_of(source, weights=None):
    return html_text.main_text(source, weights or html_text.Weights())


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("no tags &amp; all text", "no tags & all text"),
        ("<nav>a b c</nav><article>one <b>t</b>wo<p>three<p>four</article><footer>x y z</footer>", "one two three four"),
        ("<BODY><DIV ID=menu><A HREF=x>Home</A></DIV><ARTICLE CLASS='post'><H1>Ti&#116;le</H1>a&nbsp;b<br>c</ARTICLE>", "Title a b c"),
        ("<article>before<div class='ad'>buy this</div>after<aside>see also</aside> end</article>", "before after end"),
        ("<article>text of it</article><section id='comments'><article>a longer reader comment than the text is</article></section>", "text of it"),
        ("<article>text<form><label>name</label><input><button>go</button></form> on</article>", "text on"),
        ("<article>a<script>var x='</article><p>no';</script>b<style>p{}</style><noscript>c</noscript></article>", "ab"),
        ("<article>a<!-- b --> c<!--> d<!-- never closed <p>e</article>", "a c d"),
        ("<article>1 < 2 && 3 > 2 &lt;b&gt; <3</article>", "1 < 2 && 3 > 2 <b> <3"),
        ("<article>cut in a tag <p class='x", "cut in a tag"),
        ("<title>t</title><div class=cookieNotice>We use cookies</div><div><p>main words here</p></div><div class='related-posts'>other</div>", "main words here"),
        ("<main><p>x y</p></main><p>and outside of it</p>", "and outside of it"),
        ("<ul><li><a>x</a></li><li><a>y</a></li></ul><p>see <a>this page</a> of us</p><ul><li>listed</li></ul>", "see this page of us listed"),
        ("<article>p<table><tr><td>1<td>2<tr><td>3</table></article>", "p 1 2 3"),
        ("<article>seen<i hidden>unseen</i><span aria-hidden=false>, too</span></article>", "seen, too"),
        ("<p>only</p></nav></div><p>stray ends</p>", "only stray ends"),
    ],
)
def test_pages(source, text):
    assert text_of(source) == text


def test_region_is_the_best_of_all():
    import itertools
    import random

    draw = random.Random(3)
    for _ in range(300):
        gains = [draw.randint(-4, 4) for _ in range(draw.randint(0, 9))]
        start, end = html_text.best_region(gains)
        sums = [sum(gains[a:b]) for a, b in itertools.combinations(range(len(gains) + 1), 2)]
        assert sum(gains[start:end]) == max([0, *sums])


def test_unknown_class_names_are_learned_from_marked_pages(spark):
    pages = [(i, None, f"<body><div class='zq'>Buy number {i} now</div><article><p>text {i}</p><div class='ok'>more</div></article></body>") for i in range(300)]
    pages += [(300, "u", "<body><div class='zq'>Buy it now and here and there</div><div><p>plain page</p></div></body>"), (301, None, None), (301, None, None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert (300, "u", "plain page", 10) in found and (301, None, "", 0) in found
    assert html_text.extract(df).count() == 303
    assert {t for i, _, t, _ in found if i < 300} == {f"text {i} more" for i in range(300)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_whole_table_against_the_markup_itself(spark):
    found = {r.page_id: r for r in queries.queries()["op11_html_main_text"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(found) == len(rows)
    for page_id, url, source in rows:
        inner = re.search("<article>(.*?)(</article>|$)", source, re.DOTALL)[1]
        expected = " ".join(html.unescape(re.sub("</?(p|br|h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (found[page_id].url, found[page_id].text, found[page_id].n_chars) == (url, expected, len(expected))


@pytest.mark.parametrize("unit", ["<", "<a ", "<a x='", "<!--", "<p>", "<div>", "</div>", "&amp", "<a =\"'", "<script>", "<p class=", "<x></y>", "<svg>", "<li><p>", "a <b>b</b> "])
def test_hostile_pages_take_linear_time(unit):
    began = time.time()
    text_of("<article>x " + unit * (400_000 // len(unit)))
    assert time.time() - began < 20
