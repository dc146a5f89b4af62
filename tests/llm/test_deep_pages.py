"""Pages whose markup is deep or badly nested take time and memory in proportion to their length."""

import time
import tracemalloc

import pytest

from papyra.llm import html_text


@pytest.mark.parametrize(
    ("page", "n"),
    [
        ("<div>" * 100_000 + "<p>x</p>" * 100_000, 100_000),
        ("<a>" * 20_000 + "<div>" * 20_000 + "</a>" * 20_000 + "<p>x", 1),
        ("<x>" * 50_000 + "y", 1),
        ("<span>" * 20_000 + "<p>x" + "</span>" * 20_000, 1),
        ("".join(f"<div class={'abcdefghij'[i % 10] * (i % 97 + 1)}>t" for i in range(20_000)), 20_000),
    ],
)
def test_deep_pages(page, n):
    began = time.process_time()
    own = html_text.blocks(page)
    html_text.features(own)
    assert len(own) == n and time.process_time() - began < 20
    html_text._paths.clear()
    tracemalloc.start()
    html_text.blocks(page[: len(page) // 10] if n == 1 else page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_paths_of_badly_nested_pages():
    own = html_text.blocks("<div class='main'><a><p>one</a> two</p><b>three<p>four</b> five</div>six")
    assert [(b.text, b.path, b.linked) for b in own] == [
        ("one two", ("div", ".main", "p"), 3), ("three", ("div", ".main", "b"), 0), ("four five", ("div", ".main", "p"), 0), ("six", (), 0),
    ]
    # a block's slots are those of its path, however it was made
    for b in own[:3]:
        assert html_text.Block(b.text, b.path, 0).slots() == b.slots()
