"""Main text: the cut against all labelings, templates written by hand, the page table."""
import itertools
import random
import re

import pytest
from pyspark.sql import types as T

from rolloutlens.llm import common as C
from rolloutlens.llm import htmlmain as H

BODY = "This paragraph of the article is long enough to read as prose, and it ends with a full stop."
MORE = "A second paragraph follows it. It has <b>bold</b> words and an <a href='/x'>odd link</a> inside."
PLAIN_MORE = "A second paragraph follows it. It has bold words and an odd link inside."


def test_cut_is_the_least_of_all_labelings():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 10)
        s = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(labels):
            return (sum(abs(x) for x, y in zip(s, labels) if (x > 0) != y)
                    + sum(w for i, j, w in links if labels[i] != labels[j]))
        least = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert cost(H.min_cut(s, links)) == pytest.approx(least)


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and more</a></li></ul></nav>",
    "<header><a href='/'>The site</a><p>Welcome to our site, which has a slogan.</p></header>",
    "<div id='cookie-notice'><p>We use cookies to improve your visit. By going on you accept them.</p></div>",
    "<aside class='sidebar'><p>Other stories that you may like to read, each with a long title.</p></aside>",
    "<div class='ad'>Buy this thing now, it is cheap.</div>", "<footer>&copy; 2024 The site. All rights reserved.</footer>",
    "<form action='/s'><label>Your mail address, please.</label><input name=q><button>Send it</button></form>",
    "<script>var t = '</p><p>not text at all, really not.</p>';</script>", "<style>p { color: red }</style>",
    "<section id='comments'><h2>Comments</h2><div class='comment'><p>What a fine article, I read it twice, thank you.</p></div></section>",
    "<!-- a comment <p>with markup that is not shown.</p> -->", "<noscript>Please turn on scripts to see this page.</noscript>"])
@pytest.mark.parametrize("page", [
    "<html><head><title>T</title></head><body>{n}<article><h1>The title &amp; more</h1><p>{b}</p><p>{m}</p></article>{n}</body></html>",
    "<html><body class='home'>{n}<div class='wrap'><div class='content'><h1>The title &amp; more</h1><p>{b}</p>{n}<p>{m}</p></div></div>{n}</body></html>",
    "<body><main>{n}<h1>The title &amp; more</h1><p>{b}<p>{m}</main>{n}"])
def test_boilerplate_goes_and_the_article_stays(page, noise):
    got = H.main_text(page.format(n=noise, b=BODY, m=MORE))
    assert got == f"The title & more\n\n{BODY}\n\n{PLAIN_MORE}"


LONG = "Readers of these pages get twenty per cent off every order that they place with us before the end of May."
TEN = "Buy this thing now, it is cheap and very good."


@pytest.mark.parametrize("noise", [
    f"<div class='ad'>{TEN}</div>", f"<div class='ad'>{LONG}</div>", f"<div class='ad'>{LONG[:-1]}</div>", f"<div class='ad'><p>{LONG}</p></div>",
    f"<div class='ad'><p>{LONG}</p><p>{LONG}</p></div>", f"<p class='advert'>{LONG}</p>", f"<div class='ad'><div class='text'><p>{LONG}</p></div></div>",
    f"<div class='notice'>{LONG}</div>", f"<p class='notice'>{LONG}</p>", f"<div id='cookie-notice'><h2>{LONG}</h2><p>{LONG}</p></div>",
    f"<aside><p>{LONG}</p></aside>", f"<form><fieldset><p>{LONG}</p></fieldset></form>", f"<div hidden><p>{LONG}</p></div>",
    *[f"<p class='comment'>{LONG}</p>" * k for k in (1, 2, 3, 4, 9)], f"<section class='comments'><article><p>{LONG}</p></article></section>",
    f"<article class='comment'><p>{LONG}</p></article>", f"<ol class='commentlist'><li class='comment'><p>{LONG}</p></li></ol>"])
@pytest.mark.parametrize("page", ["<article><p>{b}</p>{n}<p>{m}</p></article>", "<article><p>{b}</p><p>{m}</p>{n}</article>",
                                  "<main><article>{n}<p>{b}</p><p>{m}</p></article></main>", "<main><div class='content'><p>{b}</p><p>{m}</p></div>{n}</main>"])
def test_long_boilerplate_inside_the_article_goes(page, noise):
    assert H.main_text(page.format(n=noise, b=BODY, m=MORE)) == f"{BODY}\n\n{PLAIN_MORE}"


@pytest.mark.parametrize("header", ["<header>{}</header>", "<header class='entry-header'>{}</header>", "<div class='article-header'>{}</div>"])
def test_the_standfirst_in_an_article_header_stays(header):
    page = "<article>" + header.format(f"<p>{LONG}</p>") + f"<p>{BODY}</p></article>"
    assert H.main_text(page) == f"{LONG}\n\n{BODY}"


def test_formulas_and_fallback_text_are_read_inline():
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m</annotation></semantics></math>"
    page = (f"<article><p>{BODY}</p><p>We see that {formula} holds for all of them, as was to be shown.</p>"
            f"<p>The table <object data='t.pdf'><param name='a'>of all results</object> is <svg><path d=''/><title>x</title></svg>here.</p></article>")
    assert H.main_text(page).split("\n\n") == [BODY, "We see that E=m holds for all of them, as was to be shown.", "The table of all results is here."]


def test_white_space_references_and_short_blocks():
    page = f"<article><p>{BODY}</p><p> a&nbsp;&lt;b&gt;\n c<br>d &#x41;&#66; </p><ul><li>one item</li><li>two</ul><pre>x\n  y</pre><p>{BODY}</p></article>"
    assert H.main_text(page).split("\n\n") == [BODY, "a <b> c d AB", "one item", "two", "x y", BODY]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>x", "</div></p>", "<a href=\"x>q", "<nav>only a menu</nav>"])
def test_nothing_to_extract(page):
    assert H.main_text(page) == ""


def test_broken_and_long_pages():
    deep = "<div>" * 3000 + f"<p>{BODY}" + "</div>" * 10
    assert H.main_text(deep) == BODY
    many = "<article>" + f"<p>{BODY}</p>" * 3000 + "</article>"
    assert H.main_text(many) == "\n\n".join([BODY] * 3000)


MB = 1 << 20
BROKEN = {
    "open tags": "<a ", "open quotes": '<a "', "bold, other ends": "<b>" * 8000 + "</i>", "svg": "<svg>", "quotes with ends": "<a '>'", "mixed quotes": "<a '\"b>",
    "quoted ends": "<a x=\"y>", "nested blocks": "<p><div>" + "<b>" * 8000, "headings in bold": "<h2>", "rules": "x<hr>", "comments": "<!-- ", "ends": "</",
    "list items": "<li><ul>" + "<b>" * 2000 + "<li>", "cells": "<td>", "heads": "<head>", "names": "<aaaa", "references": "&amp", "unknown data": "<![CDATA[x",
    "classes": "<div class='a b c d'", "paragraphs": f"<p>{BODY}</p>", "short paragraphs": "<p>One or two.</p>", "links": "<p><a href=x>one</a> two three four.</p>"}


@pytest.mark.parametrize("kind", sorted(BROKEN))
@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
def test_time_is_linear_in_the_page(kind, end):
    import time
    unit = BROKEN[kind]
    page = (unit * (MB // len(unit) + 1))[:MB] + end
    t = time.process_time()
    H.main_text(page[:MB // 8])
    small = time.process_time() - t
    t = time.process_time()
    H.main_text(page)
    whole = time.process_time() - t
    assert whole < 20 and whole < 30 * small + 0.5, (small, whole)  # eight times as long a page


def test_scanner_reads_tags_as_the_rule_says():
    """Against the rule as one regular expression, on short random pages."""
    rule = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                      r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
    rng = random.Random(4)
    for _ in range(20000):
        page = "".join(rng.choice(["<", ">", "a", "<a ", "</b", "'", '"', "<!--", "-->", " ", "x=", "/", "<![CDATA[", "]]>", "<?"]) for _ in range(rng.randint(1, 16)))
        scan, pos = H.Scanner(page), 0
        while pos <= len(page):
            m, got = rule.search(page, pos), scan.next(pos)
            if m is None:
                assert got is None, page
                break
            name = m.group(2) or m.group(5) or ""
            assert got[:5] == (m.start(), m.end(), name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""), page
            pos = m.end()


TOPIC = "The council voted on the new rules last night, and most members spoke in favour of them at length."


@pytest.mark.parametrize("page", [
    "<main><div class='legal news'><p>{t}</p><p>{b}</p></div></main>", "<main><section id='search-for-truth'><p>{t}</p><p>{b}</p></section></main>",
    "<article><section class='social-issues'><p>{t}</p><p>{b}</p></section></article>", "<main><div class='related-work'><p>{t}</p><p>{b}</p></div></main>",
    "<article><div id='the-long-notice-period'><p>{t}</p><p>{b}</p></div></article>", "<main><div class='legal'><p>{t}</p><p>{b}</p></div></main>",
    "<article><section><h2>Letters to a friend</h2><p>{t}</p><p>{b}</p></section></article>", "<main><div data-id='comments' data-adult='no'><p>{t}</p><p>{b}</p></div></main>"])
def test_a_class_word_among_others_does_not_remove_prose(page):
    assert H.main_text(page.format(t=TOPIC, b=BODY)).endswith(f"{TOPIC}\n\n{BODY}")


@pytest.mark.parametrize("noise", [
    f"<div class='adunit'><p>{LONG}</p></div>", f"<div data-ad='top'><p>{LONG}</p></div>", f"<div data-ad-slot=12><p>{LONG}</p></div>",
    f"<amp-ad><p>{LONG}</p></amp-ad>", f"<div class='topBanner'><p>{LONG}</p></div>", f"<div class='sponsored-content box-2'><p>{LONG}</p></div>",
    f"<div class='x1 adcontainer js-slot'><p>{LONG}</p></div>", f"<section class='voices'><h2>What our readers think</h2><p>{LONG}</p><div><p>{LONG}</p></div></section>",
    f"<section><h3>Reader opinions (3)</h3><div><b>Ann</b><p>{LONG}</p></div><div><b>Bob</b><p>{LONG}</p></div></section>",
    f"<div><h4>12 Comments</h4><ol><li><p>{LONG}</p></li></ol></div>", f"<div class='social-share'><p>{LONG}</p></div>"])
def test_boilerplate_without_a_plain_class_word_goes(noise):
    assert H.main_text(f"<article><p>{BODY}</p><p>{MORE}</p>{noise}</article>") == f"{BODY}\n\n{PLAIN_MORE}"


def test_page_table_against_its_article_element(spark):
    import html
    rows = C.table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r["page_id"]: r for r in H.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        art = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", t.replace("<br>", " "))).split()) for t in re.split(r"</?(?:p|h1)>", art)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_edge_rows_and_empty_table(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])
    rows = [(1, None, None, "clash", "clash"), (None, "u", f"<p>{BODY}</p>", "clash", "clash"), (2, "u", "", None, None), (2, "u", "", None, None)]
    got = sorted(map(tuple, H.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", BODY, len(BODY)), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
