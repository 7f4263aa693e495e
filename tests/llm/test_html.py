"""The block rules against plain versions of both passes, pages that once lost text, and hostile markup."""

import random
import time

import pytest

from lexiflow.llm import html_blocks as hb
from lexiflow.llm.queries import table

PAGES = "/root/testdata/sf0.01"

LOST = [
    ('<article><div style="overflow:hidden"><p>The text of the article is here and it is for you.</p></div></article>', "The text of the article is here and it is for you."),
    ('<article class="post no-sidebar"><p>The text of the article is here.</p></article>', "The text of the article is here."),
    ('<div id="page" class="has-sidebar"><main><p>The text of it is here.</p></main></div>', "The text of it is here."),
    ("<article><p>Some words of the text that are long.</p><p><a href=x>Linked one</a></p><p>And the rest of it.</p></article>", "Some words of the text that are long.\nLinked one\nAnd the rest of it."),
    ("<nav><a href=a>首页</a></nav><div>" + "".join(f"<p>{'这是一个很长的段落。' * 32}{i}</p>" for i in range(3)) + "</div><div class=footer>版权</div>", "\n".join(f"{'这是一个很长的段落。' * 32}{i}" for i in range(3))),
    ('<article><p>Kept here.</p><div hidden>gone</div><p style="display: none">gone</p><section class="user-comments"><p>' + "It is not of the article but of a reader. " * 9 + "</p></section></article>", "Kept here."),
]


@pytest.mark.parametrize(("page", "want"), LOST)
def test_pages_that_once_lost_text(page, want):
    assert hb.main_text(page) == want


def plain_label(b, has_main, known):
    n, links = len(b.text), b.linked > 0.4 * len(b.text)
    density = b.stops / b.words if b.words else 0
    s = 0
    if known and density >= 0.22:
        s += 1
    if known and density < 0.1 and (n >= 60 or b.place == hb.MAIN):
        s -= 1
    s += 1 if n >= 180 else -1 if n < 60 else 0
    if b.place == hb.MAIN:
        s += 2 - (1 if links else 0)
        if not (b.item and links):
            s = max(s, 0)
        return None if s == 0 else s > 0
    if links:
        s -= 3
    if b.place == hb.NAMED:
        s -= 3
    elif b.place == hb.MAIN_IN_NAMED:
        s -= 1 if has_main else 0
    else:
        s += (1 if not known and n >= 180 else 0) - (2 if has_main else 0) - (1 if b.heading else 0)
    if n >= 180:
        return None if s == 0 else s > 0
    if s <= -2:
        return False
    return True if s > 0 and n >= 60 else None


def plain_second(found, labels):
    out = []
    for i, (b, x) in enumerate(zip(found, labels, strict=True)):
        if x is None:
            inside = b.place == hb.MAIN

            def nearest(order, inside=inside):
                for j in order:
                    if labels[j] is not None and (not inside or found[j].place == hb.MAIN):
                        return labels[j]
                return None

            p, q = nearest(range(i - 1, -1, -1)), nearest(range(i + 1, len(found)))
            if inside:
                x = not (False in (p, q)) or (True in (p, q) and not b.item)
            elif p is None or q is None:
                x = True in (p, q)
            else:
                x = (p and q) or ((p or q) and b.stops >= 0.22 * max(1, b.words)) or (b.heading and q)
        out.append(bool(x))
    return out


def test_both_passes_equal_plain_versions():
    rng = random.Random(6)
    frame = ["<article>", "</article>", "<div class=ad>", "<div>", "</div>", "<main>", "</main>", "<ul><li>", "</li></ul>", "<h2>", "</h2>", "<div class='side menu'>", "<p>", "<p>", "<p>"]
    words = ["the", "of", "and", "Zorb", "quux", "to", "<a href=x>link of it</a>", "frob", "is"]
    seen = set()
    for _ in range(600):
        page = "".join(rng.choice(frame) + " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 20, 60]))) for _ in range(rng.randint(1, 14)))
        found = hb.blocks(page)
        has_main = any(b.place == hb.MAIN for b in found)
        for known in (True, False):
            labels = [hb.label(b, has_main, known) for b in found]
            assert labels == [plain_label(b, has_main, known) for b in found]
            assert hb.second_pass(found, labels) == plain_second(found, labels)
            seen |= {(b.place, x) for b, x in zip(found, labels, strict=True)}
    assert len(seen) >= 9


def test_stop_words_and_the_second_pass_decide_on_given_pages(spark, monkeypatch):
    pages = [r.html for r in table(spark, PAGES, "pages").select("html").collect()]
    whole = [hb.main_text(p) for p in pages]
    labels = [[hb.label(b, True) for b in hb.blocks(p)] for p in pages]
    with monkeypatch.context() as m:
        m.setattr(hb, "second_pass", lambda found, labels: [x is True for x in labels])
        assert sum(hb.main_text(p) != w for p, w in zip(pages, whole, strict=True)) > len(pages) / 5
    with monkeypatch.context() as m:
        m.setattr(hb, "STOP_WORDS", frozenset())
        assert sum([hb.label(b, True) for b in hb.blocks(p)] != x for p, x in zip(pages, labels, strict=True)) > len(pages) / 5


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<span>x ", "<b>", "</b>x", "<script>", "<!--", "<a \"'>", "<p>x<div>", "<![x", "<"])
def test_hostile_markup_takes_linear_time(unit):
    page = unit * ((1 << 20) // len(unit))
    start = time.process_time()
    hb.main_text(page)
    hb.main_text("<b>" * 100_000 + "</i>x" * 100_000)
    assert time.process_time() - start < 8
