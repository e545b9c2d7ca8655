"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies every block by its stop-word density, length and
link density, with the part of the page it stands in as context; the second lets short and doubtful blocks inherit the
class of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import DataFrame

from reportloom.llm.tags import OPENING, TagEnds

# Frequent words of the languages, in no particular role but that.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there "
    "they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui "
    "sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht noch sich "
    "sie sind so über um und von war wie zu zum zur "
    "al como con de del el ella en es esta este la las lo los más no o para pero por que se sin su sus un una y".split()
)

# Letters of the languages above besides a to z, and the share of other letters from which a text is none of them.
_OWN_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzàâæçèéêëîïôœùûüÿäößáíñóúªº")
FOREIGN = 0.01

LONG, SHORT = 200, 70
MANY_STOP_WORDS, SOME_STOP_WORDS = 0.30, 0.10
LINK_DENSITY = 0.4

_SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas select textarea button datalist audio video map".split())
_BOILERPLATE = frozenset("nav aside footer form dialog menu".split())
_MAIN = frozenset("article main".split())
_CONTAINERS = frozenset("div section header ul ol dl table span p li td details figure blockquote body".split()) | _BOILERPLATE | _MAIN
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A class or id counts if all parts of the whole name are known: ``cookie-notice`` does, ``has-sidebar`` does not.
_NAMES = re.compile(
    r"^(ads?|advert|adverts|advertisements?|advertising|adsense|banner|sponsor|sponsors|sponsored|promos?|promotions?|cookies?|"
    r"consent|gdpr|notices?|alerts?|popups?|modal|overlay|sidebars?|menus?|nav|navs|navbar|navigation|breadcrumbs?|comments?|"
    r"commentlist|respond|replies|reply|disqus|footers?|masthead|topbar|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|subscription|signup|login|widgets?|pagination|pager|copyright|legal)$"
)
_NOT_MAIN = re.compile(r"^(ads?|advert|adverts|advertisements?|sponsor|sponsors|sponsored|promos?|comments?|reply|replies|related|recommended)$")
_BESIDE = frozenset("site page main top bottom bar area list box block body links buttons posts".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
# What says so for certain; a nested article or main resets the other marks.
_FIRM = _BOILERPLATE - {"form"}


@dataclass
class Block:
    text: str
    linked: int
    main: bool
    boilerplate: bool
    place: int


def _named(value: str, names: re.Pattern, in_main: bool) -> bool:
    """Whether a whole class or id of the value is made of known names and words that go beside them."""
    for name in value.lower().split():
        rest = [w for w in re.split(r"[_-]+", name) if w and w not in _BESIDE]
        if rest and all(names.match(w) or w == "header" and not in_main for w in rest):
            return True
    return False


def _mark(tag: str, attributes: str, in_main: bool) -> int:
    """0, 1 for likely boilerplate or 2 for certain boilerplate."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes or ""):
        found.setdefault(name.lower(), value.strip("\"'"))
    if tag in _FIRM or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")):
        return 2
    if tag in _BOILERPLATE or tag == "header" and not in_main:
        return 1
    if tag == "body":
        return 0
    names = _NOT_MAIN if tag in _MAIN else _NAMES
    named = any(_named(found.get(a, ""), names, in_main or tag in _MAIN) for a in ("class", "id"))
    return int(named or bool(_ROLES.intersection(found.get("role", "").lower().split())))


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed and misnested tags, comments and cut-off pages are tolerated."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    stack: list[tuple[str, bool, int, int]] = []  # tag, in the main part, boilerplate, place
    main, boilerplate, place, places = False, 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, min(linked, len(text)), main, boilerplate > 0, place))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if in_link:
            linked += len(raw)

    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()  # skipped tags that are not closed any more
    at, end, ends, last = 0, len(page), TagEnds(page), page.rfind(">")
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            text(page[at : stop if stop >= 0 else end])
            at = stop if stop >= 0 else end
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at < last:
            at = page.find(">", at) + 1
            continue
        match = OPENING.match(page, at)
        behind = ends.after(match.end()) if match and at < last else -1
        if behind < 0:
            text("<")
            at += 1
            continue
        tag, closing, attributes, at = match.group(2).lower(), match.group(1), page[match.end() : behind - 1], behind
        if tag in _SKIPPED and not closing:
            if not attributes.endswith("/"):
                found = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = page.find(">", found.end()) if found else -1
                if stop < 0:
                    unclosed.add(tag)
                at = stop + 1 if stop >= 0 else (end if tag in ("script", "style") else at)
            if tag not in _INLINE:
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag not in _INLINE:
            close()
            in_link = 0
        if tag in _CONTAINERS and tag not in _VOID:
            if closing:
                for i in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    if stack[i][0] == tag:
                        if tag in _INLINE and (stack[i][2] != boilerplate):
                            close()
                        _, main, boilerplate, place = stack[i]
                        open_tags.subtract(gone[0] for gone in stack[i:])
                        del stack[i:]
                        break
            elif not attributes.endswith("/"):
                marked = _mark(tag, attributes, main)
                if tag in ("p", "li", "td", "span") and not marked:
                    continue  # often left open, and of no weight
                if tag in _INLINE:
                    close()
                stack.append((tag, main, boilerplate, place))
                open_tags[tag] += 1
                if tag in _MAIN or marked:
                    places += 1
                    place = places
                if tag in _MAIN and boilerplate == 1:
                    boilerplate = 0
                main, boilerplate = main or tag in _MAIN, max(boilerplate, marked)
    close()
    return blocks


def unlisted(text: str) -> bool:
    """Whether the letters of a text show that none of the languages with stop words fits it."""
    letters = list(filter(str.isalpha, text.lower()))
    return sum(c not in _OWN_LETTERS for c in letters) > FOREIGN * len(letters)


def stop_word_density(text: str) -> float:
    """Share of stop words in the words; bars, dashes and the like between them are none."""
    words = [w for w in text.lower().split() if len(w) > 1 or w.isalnum()]
    return sum(w.strip(".,;:!?()%*#$&\"'") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block, foreign: bool = False) -> str:
    """``good``, ``bad``, ``near`` (doubtful) or ``short`` (says too little by itself).

    Links make a block bad, many stop words in a long one good. Few stop words make a long block bad and a shorter one
    no more than ``short``, as the few words of a single paragraph may well hold none. In the main part such a block is
    ``near``: code and tables have few stop words too. On a ``foreign`` page no list of stop words fits, so length and
    links decide; a wide letter counts as two.
    """
    length = len(block.text)
    if block.boilerplate or block.linked / length > LINK_DENSITY:
        return "bad"
    if foreign:
        length += sum(unicodedata.east_asian_width(c) in "WF" for c in block.text)
    if length < SHORT:
        return "short" if not block.linked or block.main else "bad"
    if foreign:
        return "good" if length > LONG else "near"
    density = stop_word_density(block.text)
    if density >= MANY_STOP_WORDS and length > LONG:
        return "good"
    if density >= SOME_STOP_WORDS or block.main:
        return "near"
    return "bad" if length > LONG else "short"


def foreign_page(blocks: list[Block]) -> bool:
    """Whether the unmarked text of a page has few stop words and letters of other languages than those with lists."""
    text = " ".join(b.text for b in blocks if not b.boilerplate)
    return stop_word_density(text) < SOME_STOP_WORDS and unlisted(text)


def best_run(blocks: list[Block], kinds: list[str], foreign: bool = False) -> list[str]:
    """The kinds, with the best run of undecided blocks made good on a page that has no good block.

    A run is what lies between two bad blocks or two parts of the page. The one with the most stop words is the best,
    then the longest, then the first; its ``near`` blocks become good, or all if it has none. A run with few stop words is
    no text, so all of them may be passed over.
    """
    if "good" in kinds:
        return kinds
    best, span, start = (0, 0), range(0), 0
    for i in range(1, len(blocks) + 1):
        same = i < len(blocks) and blocks[i].place == blocks[start].place and kinds[i] != "bad"
        if same and kinds[start] != "bad":
            continue
        if kinds[start] != "bad":
            text = " ".join(b.text for b in blocks[start:i])
            density = stop_word_density(text)
            worth = (round(density * len(text.split())), len(text))
            if worth > best and (foreign or density >= SOME_STOP_WORDS):
                best, span = worth, range(start, i)
        start = i
    wanted = "near" if any(kinds[i] == "near" for i in span) else "short"
    return ["good" if i in span and kind == wanted else kind for i, kind in enumerate(kinds)]


def second_pass(blocks: list[Block], kinds: list[str]) -> list[bool]:
    """Whether each block is kept.

    A doubtful block takes the class of the nearest decided blocks before and after it. Decided blocks of its own part of
    the page come first; where those disagree or there is none, a block of the main part is kept, and outside of one a
    near block is kept if either neighbour is good and a short one only if both are.
    """
    decided = [i for i, k in enumerate(kinds) if k in ("good", "bad")]
    kept = []
    d = 0
    for i, kind in enumerate(kinds):
        while d < len(decided) and decided[d] <= i:
            d += 1
        if kind in ("good", "bad"):
            kept.append(kind == "good")
            continue
        around = ([decided[d - 1]] if d else []) + ([decided[d]] if d < len(decided) else [])
        own = [kinds[j] for j in around if blocks[j].place == blocks[i].place]
        if blocks[i].main:
            kept.append(not own or "good" in own)
        else:
            near = own or [kinds[j] for j in around]
            kept.append(bool(near) and ("good" in near if kind == "near" else "bad" not in near))
    return kept


def main_text(page: str | None) -> str:
    """Kept blocks joined by a line feed; empty for a null, empty or text-free page."""
    blocks = blocks_of(page or "")
    foreign = foreign_page(blocks)
    kinds = best_run(blocks, [first_pass(b, foreign) for b in blocks], foreign)
    kept = second_pass(blocks, kinds)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) for every page; repeated rows stay repeated."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield pd.DataFrame({id_col: batch["id"], url_col: batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    selected = pages.selectExpr(f"`{id_col}` as id", f"`{url_col}` as url", f"cast(`{html_col}` as string) as html")
    return selected.mapInPandas(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
