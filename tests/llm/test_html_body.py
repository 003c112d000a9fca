"""Main text whose parts stand directly in the body."""

import pytest

from tramlines.llm import html_density

NAV = '<nav><a href="/">Home</a><a href="/x">News</a></nav>'
PART = "<p>Some words in a row, with more to say than before.</p><p>And yet more words, as was said already.</p>"
TEXT = "Some words in a row, with more to say than before. And yet more words, as was said already."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"{NAV}<h1>Title</h1><div>{PART}</div><footer>x</footer>", f"Title {TEXT}"),
        (f"{NAV}<section>{PART}</section><section>{PART}</section><footer>x</footer>", f"{TEXT} {TEXT}"),
        (f"<p>A loose paragraph, with words of its own.</p><div>{PART}</div>", f"A loose paragraph, with words of its own. {TEXT}"),
        (f'<h1>Title</h1><div>{PART}</div><div><a href="/a">one link</a> <a href="/b">two links</a> <a href="/c">three links</a></div>', f"Title {TEXT}"),
        (f'<ul><li><a href="/a">one link</a></li><li><a href="/b">two links</a></li></ul><div>{PART}</div>', TEXT),
    ],
)
def test_siblings_in_the_body(body, text):
    assert html_density.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == text
