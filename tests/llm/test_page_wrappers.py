"""Article text in elements whose name sounds like chrome, and beside teaser cards."""

import pytest

from casebook.llm import html
from casebook.llm.markup import INSIDE, OUTSIDE, read_page

STORY = "<p>The story is told here at length.</p><p>And it goes on for a while.</p>"
LINES = ["The story is told here at length.", "And it goes on for a while."]


@pytest.mark.parametrize("attribute", [
    "class='content no-sidebar'", "class='has-sidebar'", "class='layout with-header'", "class='page comments-open'",
    "class=elementor-widget-container", "class='widget'", "id=sidebar",
])
@pytest.mark.parametrize("tag", ["div", "form"])
def test_wrappers_keep_the_article(tag, attribute):
    chrome = "<nav>menu</nav><div class='ad'>buy</div>"
    plain = read_page(f"<body><{tag} {attribute}>{chrome}{STORY}</{tag}></body>").blocks
    assert plain == [(OUTSIDE, t) for t in LINES]
    marked = read_page(f"<body><{tag} {attribute}>{chrome}<article>{STORY}</article></{tag}></body>").blocks
    assert marked == [(INSIDE, t) for t in LINES]


def test_small_chrome_still_goes():
    blocks = read_page(f"<div class=related><article>card</article></div><main>{STORY}<form>send</form><div class=comments>{'long ' * 99}</div></main>").blocks
    assert blocks == [(INSIDE, t) for t in LINES]


def test_an_advert_longer_than_the_article_goes():
    assert read_page("<div class=ad>a long advert indeed</div><article>short</article>").blocks == [(INSIDE, "short")]


def test_a_teaser_card_does_not_hide_the_body(spark):
    page = f"<body><div>{STORY * 3}</div><article>Read this too</article></body>"
    row = html.main_text(spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")).first()
    assert row["text"] == " ".join(LINES * 3 + ["Read this too"])
