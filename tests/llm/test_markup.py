import random

from casebook.llm.markup import INSIDE, OUTSIDE, read_page, shared_lines


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_form_a_longest_common_subsequence():
    draw = random.Random(3)
    for _ in range(2000):
        a, b = ([draw.choice("abcde") for _ in range(draw.randint(0, 12))] for _ in range(2))
        flags = shared_lines(a, b)
        kept = [x for x, f in zip(a, flags, strict=True) if f]
        rest = iter(b)
        assert len(kept) == _longest(a, b) and all(x in rest for x in kept)


def test_roles_classes_and_hidden_elements():
    blocks = read_page(
        "<body><div role=main>a<p style='display: none'>x</p><aside>s</aside><header><h1>T</h1></header>b"
        "<ul class=share><li>tw</ul></div><p hidden>q</p>z"
    ).blocks
    assert blocks == [(INSIDE, "a"), (INSIDE, "T"), (INSIDE, "b"), (OUTSIDE, "z")]
    nested = read_page("<article><p>one<div class='comments'><p>c1<div>c2</div></div><p>two</article>tail").blocks
    assert nested == [(INSIDE, "one"), (INSIDE, "two"), (OUTSIDE, "tail")]


def test_broken_markup_is_read_leniently():
    assert read_page("<p>a &lt; b &amp b &#233; <a href='x>y'>l</a>i<!-- open").blocks == [(OUTSIDE, "a < b & b é li")]
    assert read_page("<script>if (a</p>b) {}").blocks == []
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert read_page(deep).blocks == [(OUTSIDE, "x")]
