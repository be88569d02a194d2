"""Main text chosen by ratios: wrappers with telling names, menus without them, renamed elements, broken and deep pages."""

from __future__ import annotations

import html
import re
import time

import pytest

from cropstats.llm import html_text, queries

BODY = [f"Sentence {k}, which is long enough to count, ends here. And a second one, as long, follows it." for k in range(5)]
ARTICLE = "".join(f"<p>{b}</p>" for b in BODY)
MENU = "<ul>" + "".join(f"<li><a href=x{k}>Menu item {k}</a></li>" for k in range(8)) + "</ul>"


def lines(page: str) -> list[str]:
    return html_text.main_text(page).split("\n")


@pytest.mark.parametrize("wrapper", ['<div class="article-content ad-free">', '<div id="social-policy">', '<form id="f" action="/">', '<div class="post-wrapper sponsored-by-none">', '<div class="main-sidebar-left-content">'])
def test_a_name_that_holds_a_word_of_noise_keeps_the_article(wrapper):
    tag = wrapper[1:].split()[0]
    assert lines(f"<body>{MENU}{wrapper}{ARTICLE}</{tag}><footer>f</footer></body>") == BODY


@pytest.mark.parametrize("noise", ['<div class="comments"><p>{}</p></div>', '<div class="user-comments"><p>{}</p></div>', '<div id="ad-box"><p>{}</p></div>', '<p class="cookie-notice">{}</p>',
                                   '<form><p>{}</p></form>', '<aside>{}</aside>', '<p hidden>{}</p>', '<div class="newsletter-box">{}</div>', '<div class="site-header">{}</div>'])
def test_what_is_named_as_noise_goes(noise):
    assert lines(f"<body><div>{ARTICLE}{noise.format(BODY[0])}</div></body>") == BODY


def test_a_small_part_of_a_name_means_nothing():
    assert lines(f'<body><div>{ARTICLE}<p class="legal-notice-of-appeal">The appeal, as filed, is here.</p></div></body>') == [*BODY, "The appeal, as filed, is here."]


def test_ratios_drop_blocks_inside_the_container():
    notice = "<div>We use small files, all right.</div>"
    for page in (f"<body><div>{MENU}<h1>Title</h1>{ARTICLE}{notice}</div></body>", f"<body>{MENU}<h1>Title</h1>{ARTICLE}{notice}</body>"):
        assert lines(page) == ["Title", *BODY]
    listed = f"<body><div>{MENU}<h1>Title</h1><div>By me</div>{ARTICLE}<ul><li>one</li><li>two</li></ul></div></body>"
    assert lines(listed) == ["Title", "By me", *BODY, "one", "two"]


def test_pages_with_article_renamed(spark):
    """The tables' pages: what stands in the article element, also where it is a div without a name."""
    pages = [r.html for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        expected = []
        for block in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside, flags=re.S)):
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", block.replace("<br>", " "))).split())
            expected += [text] if text else []
        for given in (page, page.replace("<article", "<div").replace("</article", "</div")):
            assert lines(given) == expected


def test_deep_and_broken_pages_take_linear_time():
    started = time.monotonic()
    for part in ("<b>x ", "<div>x", "<a href=x>y", "<center><p>a.</section>", "<p class='a' <li>x", "<ul><li>x"):
        html_text.main_text(part * 20_000)
    assert time.monotonic() - started < 30
    whole = html_text.main_text(f"<div>{'<p>Long, and long again.</p>' * 50_000}</div>")
    assert whole.count("\n") == 49_999


def test_defined_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    page = f"<article>{ARTICLE}</article>"
    given = spark.createDataFrame([(1, None, page, "x", 0), (1, None, page, "x", 0), (None, "u", None, None, None), (2, "u", "", "y", 1)], schema).repartition(3)
    text = "\n".join(BODY)
    assert sorted(map(tuple, html_text.extract(given).collect()), key=str) == sorted([(1, None, text, len(text))] * 2 + [(None, "u", "", 0), (2, "u", "", 0)], key=str)
