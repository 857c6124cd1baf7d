"""Main text: any length of paragraph, left-out and crossed end tags, hostile pages, and the driver's pages against a plain extraction."""

import html
import re
import time

import pytest

from voxelspark.llm import common, html_main


@pytest.fixture(scope="module")
def tree():
    return html_main.train_tree(*html_main.labelled_blocks())


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}", "<body><nav><ul><li><a href=/>m</a></ul></nav><div class=ad>x y z</div><article><h1>t</h1>{}</article><footer>c d</footer>"])
def test_paragraphs_of_any_length_are_kept(tree, around):
    for n in range(1, 301):
        text = " ".join(f"w{i}" for i in range(n))
        assert text in html_main.main_text(around.replace("{}", f"<p>{text}</p>"), tree)


@pytest.mark.parametrize("words", [1, 8, 40, 200])
@pytest.mark.parametrize("shape", ["<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<nav><p>{}</p></nav>", "<form><label>{}</label></form>", "<section id=comments><p>{}</p></section>", "<footer>{}</footer>", "<div style='display: none'><p>{}</p></div>", "<div hidden>{}</div>"])
def test_the_rest_is_dropped(tree, shape, words):
    other = " ".join(["y"] * words)
    for page in ("<article><p>One two</p></article>{}", "<article><p>One two</p>{}</article>", "{}<main><p>One two</p></main>"):
        assert html_main.main_text(page.replace("{}", shape.replace("{}", other)), tree) == "One two"


def test_class_names_of_paragraphs_do_not_count_within_an_article(tree):
    assert html_main.main_text("<article><h2 class=tags>One</h2><p class=side>two three</p></article>", tree) == "One two three"


MISLEADING = ["social-history", "side-story", "comments-policy", "search_theory", "menu-engineering", "legal-studies", "tag-team", "notice-periods", "has-sidebar", "content-with-sidebar", "banner-story"]


@pytest.mark.parametrize("name", MISLEADING)
def test_names_that_mislead(tree, name):
    """Main text in elements whose names only contain a word of boilerplate stays; lists of links and what stands outside the article go."""
    for n in (1, 5, 40, 200):
        text = " ".join(f"w{i}" for i in range(n))
        for page in ("<div class={0}><p>{1}</p><p>{1}</p></div>", "<div id={0}><article><h1>t</h1><p>{1}</p><p>{1}</p></article></div>", "<article><p>{1}</p><div class={0}><p>{1}</p></div></article>", "<nav><a href=/>m</a></nav><main><section class={0}><h2>{1}</h2><p>{1}</p></section></main><footer>f</footer>"):
            got = html_main.main_text(page.format(name, text), tree)
            assert got.count(text) == page.count("{1}"), (page, n, got)
    linked = "".join(f"<p><a href=/>y{i} y y</a></p>" for i in range(4))
    assert html_main.main_text(f"<article><h1>t</h1><p>One two three</p><div class={name}>{linked}</div></article>", tree) == "t One two three"
    assert html_main.main_text(f"<article><p>One two three</p></article><div class={name}><p>y y y y y</p></div>", tree) == "One two three"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "ads-300x250", "page-footer", "site_nav", "social-icons", "related-posts", "cookie-notice", "newsletter-signup", "comments", "comment-body", "sidebar__inner", "x comments-list y", "top-bar", "story-tags"])
def test_names_of_boilerplate(tree, name):
    assert html_main.main_text(f"<article><p>One two</p><div class='{name}'><p>y y y</p></div></article><div class='{name}'><p>y y</p></div>", tree) == "One two"


def test_parsing():
    texts = lambda page: [t for t, _ in html_main.blocks(page)]
    assert texts("<a href=x/>One</a> two<p>b<i>c<div>d</i>e</div>f") == ["One two", "bc", "de", "f"]
    assert texts("a<!-- <p> -->b<![CDATA[x]]>c<?y?>d 1 < 2 <3 </ x") == ["abcd 1 < 2 <3 </ x"]
    assert texts("<p title='a>b' x=\"c>d\" y=e/>One<p data-x='never closed>two") == ["One", "two"]
    assert texts("<script>if (a</b) '<p>x'</script><p>One</p><textarea><p>no</textarea>two") == ["One", "two"]
    assert texts("<svg><title>no<p/></title><path/></svg>One<svg/>two") == ["Onetwo"]


@pytest.mark.parametrize("part", ["<b>", "<b><p>x", '<a "', '<a x="', "<svg>", "<button>", "<div>x", "<!--", "x<!-- -->", "<", "<select><svg><button><template>", "<ul><li>x", "<table><tr><td>x", "</p>", "&amp;", "<p class='"])
def test_hostile_pages_take_seconds(part):
    began = time.time()
    html_main.blocks(part * (1_000_000 // len(part)))
    assert time.time() - began < 20


def test_pages_against_a_plain_extraction(spark):
    """The made pages' article without markup, taken by patterns that know how these pages are written."""
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html_main.extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        found = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"<!--.*?-->|</?b>", "", found[1] if found else "", flags=re.S))
        want = " ".join(html.unescape(plain).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "u", None, "t", 1), (1, None, "<p>One &amp; two</p>", None, 2), (None, "u", "", "x", 3), (1, None, "<p>One &amp; two</p>", None, 2)], "page_id long, url string, html string, text string, n_chars int")
    got = html_main.extract_main_text(rows).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in [(1, "u", "", 0), (1, None, "One & two", 9), (None, "u", "", 0), (1, None, "One & two", 9)])
    assert html_main.extract_main_text(rows.limit(0)).count() == 0
