"""Tags of an HTML page in time linear to the page, however broken it is."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

_PLAIN = re.compile(r"[^>\"']*")
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = ("script", "style")


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes. A tag that never ends is none.

    A search that fails is remembered with its quoted spans: whatever starts outside of these meets the same rest of the
    page and fails too. There are three states, outside and inside either quote, so only few searches reach the end.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.failed: list[tuple[int, list[int], list[int]]] = []

    def after(self, at: int) -> int:
        """Position behind the tag whose attributes begin at ``at``; -1 if there is none."""
        for start, opens, closes in self.failed:
            i = bisect_right(opens, at) - 1
            if at >= start and (i < 0 or at > closes[i]):
                return -1
        page, opens, closes, spot = self.page, [], [], at
        while True:
            spot = _PLAIN.match(page, spot).end()
            if spot < len(page) and page[spot] == ">":
                return spot + 1
            close = page.find(page[spot], spot + 1) if spot < len(page) else -1
            if close < 0:
                if spot < len(page):
                    opens.append(spot)
                    closes.append(len(page))
                self.failed.append((at, opens, closes))
                return -1
            opens.append(spot)
            closes.append(close)
            spot = close + 1


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name, without quotes, character references decoded; of a repeated name the first."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in "\"'":
            value = value[1:-1] if len(value) > 1 else ""
        found.setdefault(name.lower(), html.unescape(value).strip())
    return found


def opening_tags(page: str, wanted: frozenset[str]) -> Iterator[tuple[str, dict[str, str]]]:
    """Opening tags of the wanted names with their attributes; what stands in comments, scripts and styles is no tag."""
    ends, at, size = TagEnds(page), 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else size
            continue
        match = OPENING.match(page, at)
        end = ends.after(match.end()) if match else -1
        if end < 0:
            at += 1
            continue
        closing, name = match.group(1), match.group(2).lower()
        if not closing and name in wanted:
            yield name, attributes_of(page[match.end() : end - 1])
        at = end
        if not closing and name in _RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = stop.start() if stop else size
