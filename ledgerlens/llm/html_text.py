"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by
length, share of stop words and share of text in links; blocks inside menus,
forms, adverts, comments and the like are refused by their element, role, class
or id. The second pass gives each undecided block (short, or long with few stop
words) the label of its nearest decided neighbours: inside an article element
that has no refused text near, the article's own edges count as good, elsewhere
the page's edges count as refused.

Defined cases: null or empty html gives the empty string; broken markup is read
as far as possible: a ``<`` without a letter, ``/``, ``!`` or ``?`` after it is text;
a quoted value without an end, or after which no tag ends, ends at the next ``>``; a
tag, comment or raw element without an end runs to the end of the page; null and
repeated ids are kept row by row, repeated pages give the same text; nothing is cut
from long pages, the time is linear in their length, and few are read at once; extra
columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, text_slices

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just
    like more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were
    what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit
    nach nicht noch nur oder ohne sein sich sie sind so um und uns unter von vor war was wenn werden wie wir wird zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en entre est et eux il ils je la le les leur lui mais me même mon ne nous on ou où par pas plus pour
    qu que qui sa sans se ses son sont sur te tu un une vous
    al como con de del desde dos el ella ellos en entre era es esa ese esta este fue ha hasta hay la las le les lo los más me mi muy no nos o para pero por
    porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya""".split()
)
#: Elements, roles and words of classes or ids that aren't main text.
REFUSED_TAGS = frozenset("nav footer aside form dialog menu button select fieldset noscript".split())
REFUSED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
STRONG_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs
    comment comments disqus replies respond cookie cookies consent gdpr newsletter subscribe signup login share sharing social related recommended popup
    modal pagination pager widget""".split()
)
WEAK_WORDS = frozenset("header masthead footer banner notice notices alert overlay toolbar topbar copyright disclaimer legal search skip side".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
RAW_TAGS = frozenset("script style title textarea template iframe xmp noembed noframes svg math object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<(?:[!?]|/)[^>]*(?:>|\Z)", re.S)
QUOTED, CLOSE = re.compile(r"=\s*(?=[\"'])"), re.compile(">")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, FEW_STOPS, MANY_STOPS, MOST_LINKS = 70, 200, 0.15, 0.30, 0.5
GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "brief"


def refused(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in REFUSED_TAGS or tag == "header" and not in_main:
        return True
    if not attributes.strip():
        return False
    given = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if given.get("role") in REFUSED_ROLES or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return True
    words = set(re.split(r"[^a-z]+", f"{given.get('class', '')} {given.get('id', '')}"))
    return bool(words & STRONG_WORDS) or bool(words & WEAK_WORDS) and not words & MAIN_WORDS


class Tags:
    """The tags of a page, read forwards. How a tag goes on after a quoted value
    depends on the place alone, so places that lead to no end are followed once."""

    def __init__(self, page: str) -> None:
        self.page, self.near, self.dead = page, {}, set()

    def next(self, pattern: re.Pattern, at: int) -> tuple[int, int]:
        """Start and stop of the next match, past the page's end if there is none."""
        asked, start, stop = self.near.get(pattern, (1, 0, 0))
        if not asked <= at <= start:
            m = pattern.search(self.page, at)
            start, stop = m.span() if m else (len(self.page) + 1,) * 2
            self.near[pattern] = at, start, stop
        return start, stop

    def close(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: the place of its >, or of
        the page's end."""
        passed, here = [], at
        while here not in self.dead:
            passed.append(here)
            end, (start, value) = self.next(CLOSE, here)[0], self.next(QUOTED, here)
            if end > len(self.page):
                break
            if end < value:
                return end
            quote = self.page.find(self.page[value], value + 1)
            if quote < 0:
                return self.next(CLOSE, value)[0]
            here = quote + 1
        self.dead.update(passed)
        return min(self.next(CLOSE, at)[0], len(self.page))

    def token(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next tag, comment or declaration: start, stop, name in lower case (of
        a tag), whether it closes, attributes."""
        m = TOKEN.search(self.page, at)
        if not m or m[2] is None:
            return m and (m.start(), m.end(), "", False, "")
        stop = self.close(m.end())
        return m.start(), stop + 1, m[2].lower(), bool(m[1]), self.page[m.end() : stop]


class Block:
    __slots__ = ("text", "linked", "refused", "main", "heading", "label")

    def __init__(self, text: str, linked: int, is_refused: bool, main: bool, heading: bool) -> None:
        self.text, self.linked, self.refused, self.main, self.heading, self.label = text, linked, is_refused, main, heading, ""


@lru_cache(64)
def ending(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, refused, main
    depth = Counter()  # open elements by name
    parts: list[tuple[str, bool]] = []
    links, breaks, at, heading = 0, 0, 0, False

    def flush() -> None:
        nonlocal breaks
        text = SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = len(SPACE.sub(" ", html.unescape("".join(p for p, a in parts if a))).strip())
            top = stack[-1] if stack else ("", False, False)
            out.append(Block(text, linked, top[1], top[2], heading))
        parts.clear()
        breaks = 0

    tags = Tags(page)
    while True:
        m = tags.token(at)
        text = page[at : m[0] if m else len(page)]
        if text:
            parts.append((text, links > 0))
            if not text.isspace():
                breaks = 0
        if not m:
            break
        _, at, tag, closing, attributes = m
        if not tag:
            continue
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                end = tags.next(ending(tag), at)[0]
                at = tags.next(CLOSE, end)[1] if end < len(page) else len(page)
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append((" ", False))
            breaks += 1
            if breaks > 1:
                flush()
        elif tag in INLINE_TAGS:
            if not closing and tag in ("span", "label") and refused(tag, attributes, bool(stack and stack[-1][2])):
                end = tags.next(ending(tag), at)[0]
                at = tags.next(CLOSE, end)[1] if end < len(page) else at
        elif tag in VOID_TAGS:
            if tag == "hr":
                flush()
        elif closing:
            flush()
            links = 0
            heading = False
            if depth[tag]:
                while depth[tag]:
                    depth.subtract([name := stack.pop()[0]])
                    if name == tag:
                        break
        else:
            flush()
            heading = tag in HEADINGS
            if tag == "p" or tag in HEADINGS:
                continue
            up = stack[-1] if stack else ("", False, False)
            if tag == "li" and up[0] == "li" or tag in ("td", "th", "tr", "dt", "dd", "option") and up[0] == tag:
                depth.subtract([stack.pop()[0]])
                up = stack[-1] if stack else ("", False, False)
            main = up[2] or tag in ("article", "main")
            no = up[1] or refused(tag, attributes, up[2])
            if not attributes.endswith("/"):
                stack.append((tag, no, main and not no))
                depth[tag] += 1
    flush()
    return out


def first_pass(b: Block) -> str:
    n = len(b.text)
    if b.refused or b.linked > MOST_LINKS * n:
        return BAD
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0
    if n < SHORT:
        return BAD if b.linked and not b.main else BRIEF
    if stops >= MANY_STOPS:
        return GOOD if n > LONG or b.main else NEAR
    if stops >= FEW_STOPS:
        return GOOD if b.main else NEAR
    return NEAR if b.main else BAD


def classify(found: list[Block]) -> list[Block]:
    first = [first_pass(b) for b in found]
    if GOOD not in first:  # nothing long enough: what is nearest to it leads
        first = [GOOD if f == NEAR else f for f in first]
    # refused blocks say nothing of text in an article; links beside text do
    n = len(found)
    before, after = [BAD] * n, [BAD] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, last_main = BAD, GOOD
        for i in order:
            to[i] = last_main if found[i].main else last
            if first[i] in (GOOD, BAD):
                if found[i].main:
                    last_main = first[i]
                elif found[i].refused and last_main == BAD:
                    last_main = GOOD
                last = first[i]
    for i, b in enumerate(found):
        sides = {before[i], after[i]}
        if first[i] in (GOOD, BAD):
            b.label = first[i]
        elif len(sides) == 1:
            b.label = before[i]
        elif b.heading:
            b.label = after[i]
        else:
            b.label = GOOD if first[i] == NEAR or b.main else BAD
    return found


def extract(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == GOOD) if page else ""


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): page_id, url, text, n_chars."""
    ship(pages.sparkSession)

    def run(batches):
        for some in text_slices(batches, "html"):
            for start in range(0, some.num_rows, 256):
                part = some.slice(start, 256)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
