"""Markup that must not hide the text behind it."""

import pytest

from sextant.llm.html_text import blocks_of


def shown(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "between",
    ['<svg class="i"/>', "<svg />", "<math/>", "<svg-icon name=x></svg-icon>", "<title-bar>", "<select-x/>", "<template-x></template-x>", "<svg><path d='M0'/><text>no</text></svg>"],
)
def test_what_follows_raw_names_is_kept(between):
    assert shown(f"<p>one</p>{between}<p>two</p>") == ["one", "two"]


def test_head_that_is_not_closed():
    head = "<!doctype html><html><head><title>t</title><meta charset=x>\n<link rel=a><script>no</script>"
    assert shown(head + "<p>one</p><p>two</p>") == ["one", "two"]
    assert shown(head + "<a href=x>one</a> two") == ["one two"]
    assert shown(head + "one<p>two") == ["one", "two"]
    assert shown(head + "only text") == ["only text"]
    assert shown(head + "<svg></svg>one") == ["one"]
    assert shown(head + "</head><body>one</body>") == ["one"]
