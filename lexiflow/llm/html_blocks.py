"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one gives each block a score: for its
length, for its density of stop words (if the page's language is one whose stop words are
known), against its density of links, and for or against the elements it stands in, an
``<article>`` or ``<main>`` or one whose name tells of menus, adverts or comments.  That is
good, bad or, for a short block without evidence, undecided.  In pass two an undecided block
inherits the label of its nearest decided neighbours, bad if they differ.  Blocks of elements
that never hold article text (menus, forms, scripts, hidden ones) take no part.

The page is read once from left to right; unclosed or unmatched markup costs no second look.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he his in is it its not of on or she that the their they this to was we were which with you
    als am an auch auf aus bei das dem den der des die ein eine einer er es für hat ich im in ist mit nach nicht sich sie sind und von war wie wird zu zum
    au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une
    al como con de del el en es esta la las lo los más no o para pero por que se su sus un una y""".split()
)
# fixed values: elements that start and end blocks, never hold article text, or hold the article
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
BAD = frozenset("aside button dialog fieldset footer form head iframe label legend menu nav noscript object option select svg template textarea title".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: words in class, id or role that mark what is not the article
BAD_NAMES = frozenset("ad ads adbox adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split())

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: what follows a tag's name: quoted values may hold a >
REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
RAW = frozenset("script style noscript template textarea iframe svg".split())
ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
#: a word after one of these says what an element has or lacks beside it ("has-sidebar")
BESIDE = frozenset("has no non not with without".split())

MAX_LINK_DENSITY = 0.4
SHORT, LONG = 60, 180
LOW_STOPS, HIGH_STOPS = 0.1, 0.22
#: density of stop words of a whole page below which its language isn't known
KNOWN_LANGUAGE = 0.03

# where a block stands
NEVER, NAMED, PLAIN, MAIN, MAIN_IN_NAMED = range(5)


class Block:
    __slots__ = ("text", "linked", "place", "heading", "item", "words", "stops")

    def __init__(self, text: str, linked: int, place: int, heading: bool, item: bool):
        self.text, self.linked, self.place, self.heading, self.item = text, linked, place, heading, item
        words = WORD.findall(text.lower())
        self.words, self.stops = len(words), sum(w in STOP_WORDS for w in words)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(raw)} if raw.strip() else {}


def _bad_name(attrs: dict[str, str]) -> bool:
    for key in ("class", "id", "role"):
        for name in attrs.get(key, "").split():
            words = [w.lower() for w in PART.findall(name)]
            if any(w in BAD_NAMES and (not i or words[i - 1] not in BESIDE) for i, w in enumerate(words)):
                return True
    return False


def _place(tag: str, attrs: dict[str, str], outer: int) -> int:
    """Where the inside of an element stands, given where the element stands."""
    if outer == NEVER or tag in BAD or (tag == "header" and outer not in (MAIN, MAIN_IN_NAMED)):
        return NEVER
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or NOT_SHOWN.search(attrs.get("style", "")):
        return NEVER
    if tag in MAIN_TAGS or attrs.get("role", "").lower() == "main":
        return MAIN_IN_NAMED if outer in (NAMED, MAIN_IN_NAMED) else MAIN
    if tag not in ("html", "body") and _bad_name(attrs):
        return NAMED
    return outer


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, where its inside stands
    holders: list[str] = []  # the block elements of the stack
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = breaks = headings = 0
    low, last = page.lower(), page.rfind(">")
    if len(low) != len(page):  # a few characters change their length
        low = "".join(c.lower() if c < "\x80" else c for c in page)

    def place() -> int:
        return stack[-1][1] if stack else PLAIN

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text and place() != NEVER:
            out.append(Block(text, linked, place(), headings > 0, open_tags.get("li", 0) > 0))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                breaks = 0
            if open_tags.get("a"):
                linked += len(SPACE.sub(" ", text).strip())

    def pop() -> None:
        nonlocal headings
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        if tag in BLOCK:
            holders.pop()
        headings -= tag in HEADINGS

    at = 0
    while at < len(page):
        i = page.find("<", at)
        if i < 0 or i > last:  # no tag ends behind here, but a comment or a raw element may begin
            i = page.find("<!--", at) if i >= 0 else -1
            say(page[at : i if i >= 0 else len(page)])
            break
        if page.startswith("<!--", i):
            say(page[at:i])
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), i):
            say(page[at:i])
            at = page.find(">", i) + 1
            continue
        m = TAG.match(page, i)
        if not m:
            say(page[at : i + 1])
            at = i + 1
            continue
        say(page[at:i])
        end = REST.match(page, m.end())
        at = end.end() if end else page.find(">", i) + 1
        tag, attrs, closing = m[1].lower(), page[m.end() : at - 1], page[i + 1] == "/"
        if tag in RAW and not closing and not attrs.endswith("/"):
            found = low.find("</" + tag, at)
            at = page.find(">", found) + 1 if found >= 0 else 0
            at = at or len(page)
            if tag not in BLOCK:
                continue
        if tag in BLOCK:
            close()
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            parts.append(" ")
        elif closing:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and tag not in RAW and not attrs.endswith("/"):
            if tag == "p" and holders and holders[-1] == "p":  # a paragraph ends the one before it
                while stack[-1][0] != "p":
                    pop()
                pop()
            stack.append((tag, _place(tag, _attributes(attrs), place())))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in BLOCK:
                holders.append(tag)
            headings += tag in HEADINGS
    close()
    return out


def score(b: Block, has_main: bool, known: bool) -> int:
    """Evidence for (above 0) or against (below 0) a block."""
    density = b.stops / max(1, b.words)
    # a few words may well have no stop word among them: such a block stays undecided, in an article or not
    s = (density >= HIGH_STOPS) - (density < LOW_STOPS and (len(b.text) >= SHORT or b.place == MAIN)) if known else 0
    s += (len(b.text) >= LONG) - (len(b.text) < SHORT)
    links = b.linked > MAX_LINK_DENSITY * len(b.text)
    if b.place == MAIN:
        # the article holds it: without links it isn't dropped for its own looks, nor is a linked paragraph
        return s + 2 - links if b.item and links else max(0, s + 2 - links)
    s -= 3 * links
    if b.place == MAIN_IN_NAMED:
        return s - has_main
    if b.place == NAMED:
        return s - 3
    if not known and len(b.text) >= LONG:
        s += 1
    return s - 2 * has_main - b.heading


def label(b: Block, has_main: bool, known: bool = True) -> bool | None:
    """Pass one: True good, False bad, None undecided."""
    s = score(b, has_main, known)
    if b.place == MAIN or len(b.text) >= LONG:
        return None if s == 0 else s > 0
    if s <= -2:
        return False
    return None if s <= 0 or len(b.text) < SHORT else True


def leans_good(b: Block) -> bool:
    """A short block full of function words: one good neighbour is enough."""
    return b.stops >= HIGH_STOPS * max(1, b.words)


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones; blocks of an article from those of articles."""
    n = len(labels)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        seen: list[bool | None] = [None] * n
        last: dict[bool, bool | None] = {True: None, False: None}
        for i in order:
            inside = found[i].place == MAIN
            seen[i] = last[inside]
            if labels[i] is not None:
                last[inside] = labels[i]
                if inside:
                    last[False] = labels[i]
        sides.append(seen)
    out = []
    for b, x, p, q in zip(found, labels, *sides, strict=True):
        if x is None:
            near = {y for y in (p, q) if y is not None}
            if b.place == MAIN:
                x = False not in near or (True in near and not b.item)
            else:
                x = near == {True} or (True in near and leans_good(b)) or (b.heading and q is True)
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has_main = any(b.place == MAIN for b in found)
    known = sum(b.stops for b in found) >= KNOWN_LANGUAGE * sum(b.words for b in found)
    labels = [label(b, has_main, known) for b in found]
    if found and not any(labels) and any(x is None for x in labels):
        # no block says anything for itself: what isn't known to be bad is the text
        labels = [x is None for x in labels]
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, labels), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null or empty html and pages without main text give an empty text.  White space
    inside a block becomes one space, character references are decoded, blocks are
    joined by one newline.  Repeated rows stay repeated; an empty table gives an empty
    result; other columns are not read.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
