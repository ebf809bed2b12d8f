"""Broken pages are read in time that grows with their size only."""

import time

import pytest

from casebook.llm.markup import read_page

MEGABYTE = 1_000_000
BAD = {
    "unfinished tags": "<script ", "unfinished quotes": "<a '", "names without an end": "<a", "ends inside quotes": "<a '>' ",
    "both quotes": "<a '\">", "soft elements": '<div class="menu">', "soft and content": '<div class="menu"><article>x',
    "raw without an end": "<script></script ", "text in soft": '<div class="menu"><p>x', "comments": "<!-", "marks": "<!", "quotes": "\"'<b ",
}


@pytest.mark.parametrize("pattern", BAD.values(), ids=BAD.keys())
def test_a_megabyte_takes_seconds_at_most(pattern):
    half = time.perf_counter()
    read_page(pattern * (MEGABYTE // 2 // len(pattern)))
    half = time.perf_counter() - half
    whole = time.perf_counter()
    read_page(pattern * (MEGABYTE // len(pattern)))
    whole = time.perf_counter() - whole
    assert whole < 5 and whole < 4 * half + 0.5


def test_nested_soft_elements_with_text():
    start = time.perf_counter()
    page = read_page('<div class="menu">' * 20_000 + "<p>x" * 20_000)
    assert time.perf_counter() - start < 2
    assert len(page.lines) == 20_000


def test_tag_ends_with_and_without_closed_quotes():
    assert read_page('<p title="a > b">one</p>').lines == ["one"]
    assert read_page("<p title='a > b>one</p> two").lines == ["b>one", "two"]  # the quote stays open: the first > ends the tag
    assert read_page("<p '>' <p '>' one").lines == ["'", "' one"]
    assert read_page("a < b <p>c").lines == ["a < b", "c"]
    assert read_page("a <!-- never closed <p>b").lines == ["a"]
    assert read_page("<title>t</title ").title == "t</title"
