"""Page parsing: broken and deep pages in time that grows with their length; densities against their definition."""

import math
import random
import time

import pytest

from tramlines.llm import html_density

BROKEN = {
    "open tags": "<b ", "open names": "<b<i", "open quotes": "<b \"<i '", "declarations": "<! ", "nested": "<div>", "paragraphs": "<p>x",
    "closed blocks under open ones": ("<b>", "<div>x</div>"), "stray ends": ("<div>", "</i>"), "ends behind a cell": ("<i><td><div>", "</i>"), "long name": ("<a", "x"),
}


@pytest.mark.parametrize("kind", BROKEN)
def test_time_grows_with_the_length(kind):
    def seconds(size):
        head, tail = BROKEN[kind] if isinstance(BROKEN[kind], tuple) else (BROKEN[kind], "")
        k = size // len(head + tail)
        start = time.process_time()
        html_density.main_text(head * k + tail * k)
        return time.process_time() - start

    # Four times the length in about four times the time; a square would take sixteen times as long.
    small = max(seconds(100_000), 0.05)
    assert seconds(400_000) < 10 * small


def test_what_no_bracket_closes_is_text():
    assert html_density.main_text("<p>one <b two <i three") == "one <b two <i three"
    assert html_density.main_text("<p>one <b title='>' > two <i \"> three</p>") == "one two <i \"> three"
    assert html_density.main_text('<p>a <b " <i>c</i> d</p>') == 'a <b " c d'
    assert html_density.main_text("<p>a <!-- b > c --> d <!doctype x> e <!-- f") == "a d e"


class Naive:
    """An element of a well-formed page, counted by walking all below it for every figure."""

    def __init__(self, tag, parts):
        self.tag, self.parts = tag, parts

    def html(self):
        return f"<{self.tag}>" + "".join(p if isinstance(p, str) else p.html() for p in self.parts) + f"</{self.tag}>"

    def kids(self):
        return [p for p in self.parts if not isinstance(p, str)]

    def below(self):
        return [n for k in self.kids() for n in (k, *k.below())]

    def texts(self, linked=False):
        """(text, inside a link) of every piece of text below."""
        linked = linked or self.tag == "a"
        return [t for p in self.parts for t in ([(p, linked)] if isinstance(p, str) else p.texts(linked))]

    def counts(self, linked=False):
        found = self.texts(linked)
        return sum(len(t) for t, _ in found), len(self.below()), sum(len(t) for t, on in found if on), sum(n.tag == "a" for n in self.below())

    def density(self, body):
        c, t, lc, lt = self.counts()
        if not c:
            return 0.0
        all_, _, links, _ = body.counts()
        base = math.log(c / max(1, c - lc) * max(1, lc) + max(1, links) / max(1, all_) * c + math.e)
        ratio = c / max(1, lc) * max(1, t) / max(1, lt)
        return c / max(1, t) * math.log(max(ratio, 1.0000001)) / math.log(max(base, 1.0000001))


def expected(body):
    """The main text by its definition: every node's children summed, the path walked from the body."""
    nodes = [body, *body.below()]
    score = lambda n: (sum(k.density(body) for k in n.kids()), n.density(body))
    most = max(score(n) for n in nodes if n.texts())
    best = [n for n in nodes if n.texts() and score(n) == most]
    path = [n for n in nodes if n is best[-1] or best[-1] in n.below()]
    threshold = min(n.density(body) for n in path)

    def kept(n):
        c, _, lc, _ = n.counts()
        return c > 0 and (n.density(body) >= threshold or n.tag not in ("div", "section") and 10 * lc <= 3 * c)

    def emit(n, whole):
        inside = "".join(p if isinstance(p, str) else emit(p, True) if whole or p is best[-1] or p not in path and kept(p) else emit(p, False) if p in path else "" for p in n.parts)
        return inside if n.tag in ("a", "b") else f"\0{inside}\0"

    blocks = (" ".join(b.split()) for b in emit(body, best[-1] is body).split("\0"))
    return " ".join(b for b in blocks if b), len(best)


def grow(rng, depth, tag="body", linked=False):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "a", "b", "block", "block"])
        if kind == "block" and depth and tag in ("body", "div", "section"):
            parts.append(grow(rng, depth - 1, rng.choice(["div", "section", "p", "h2"]), linked))
        elif kind in ("a", "b") and not (kind == "a" and linked) and tag not in ("a", "b"):
            parts.append(grow(rng, 0, kind, linked or kind == "a"))
        elif not parts or not isinstance(parts[-1], str):
            parts.append("".join(rng.choice("abcde") for _ in range(rng.choice([1, 3, 20, 90]))))
    return Naive(tag, parts)


def test_densities_by_their_definition():
    rng, clear = random.Random(6), 0
    for _ in range(400):
        body = grow(rng, 4)
        text, ties = expected(body)
        if ties == 1:  # of equal nodes any may be the article
            clear += 1
            assert html_density.main_text(body.html()) == text
    assert clear > 300
