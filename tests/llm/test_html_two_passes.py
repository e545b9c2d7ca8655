"""The two passes against a second, plain implementation, and pages whose main part is not marked."""

import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from reportloom.llm import html_text

FOLDER = "/root/testdata/sf0.01"
BLOCK_TAGS = {"p", "li", "ul", "div", "nav", "article", "footer", "h1", "body", "html"}


@pytest.fixture(scope="module")
def pages():
    return [page for page in pq.read_table(f"{FOLDER}/pages.parquet")["html"].to_pylist() if page]


def without_main(page):
    return re.sub(r"(</?)article\b", r"\1div", page)


class Cutter(HTMLParser):
    """Blocks of a page as (text, letters in links, part of the page), for the few tags of the tests' pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.linked, self.in_link, self.hidden, self.blocks, self.path, self.parted = [], 0, False, 0, [], [(0, "")], 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, min(self.linked, len(text)), *self.path[-1]))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link = True
        if tag in BLOCK_TAGS:
            self.cut()
        if tag in ("nav", "article", "footer", "div"):
            part = {"nav": "beside", "footer": "beside", "article": "main"}.get(tag, "beside" if ("class", "ad") in attrs else self.path[-1][1])
            if part != self.path[-1][1]:
                self.parted += 1
                self.path.append((self.parted, part))
            else:
                self.path.append(self.path[-1])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.hidden -= 1
        if tag == "a":
            self.in_link = False
        if tag in BLOCK_TAGS:
            self.cut()
        if tag in ("nav", "article", "footer", "div"):
            self.path.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data) if self.in_link else 0


def stops(text):
    words = [w for w in text.lower().split() if len(w) > 1 or w.isalnum()]
    return len([w for w in words if w.strip(".,;:!?()%*#$&\"'") in html_text.STOP_WORDS]), max(1, len(words))


def plain_text(page):
    cutter = Cutter()
    cutter.feed(page)
    cutter.close()
    cutter.cut()
    blocks, kinds = cutter.blocks, []
    for text, linked, _, part in blocks:
        found, words = stops(text)
        if part == "beside" or linked > 0.4 * len(text):
            kinds.append("bad")
        elif len(text) < 70:
            kinds.append("bad" if linked and part != "main" else "short")
        elif len(text) > 200 and found >= 0.3 * words:
            kinds.append("good")
        elif part == "main" or found >= 0.1 * words:
            kinds.append("near")
        else:
            kinds.append("bad" if len(text) > 200 else "short")
    if "good" not in kinds:
        runs = []
        for a in range(len(blocks)):
            for b in range(a + 1, len(blocks) + 1):
                inside = blocks[a:b]
                if "bad" in kinds[a:b] or len({x[2] for x in inside}) > 1:
                    break
                whole = " ".join(x[0] for x in inside)
                found, words = stops(whole)
                open_before = a and kinds[a - 1] != "bad" and blocks[a - 1][2] == blocks[a][2]
                open_after = b < len(blocks) and kinds[b] != "bad" and blocks[b][2] == blocks[a][2]
                if found >= 0.1 * words and not open_before and not open_after:
                    tokens = len(whole.split())
                    runs.append((round(found / words * tokens), len(whole), -a, a, b))
        if runs:
            *_, a, b = max(runs)
            wanted = "near" if "near" in kinds[a:b] else "short"
            kinds = [("good" if a <= i < b and k == wanted else k) for i, k in enumerate(kinds)]
    lines = []
    for i, (text, _, place, part) in enumerate(blocks):
        before = next((j for j in range(i - 1, -1, -1) if kinds[j] in ("good", "bad")), None)
        after = next((j for j in range(i + 1, len(blocks)) if kinds[j] in ("good", "bad")), None)
        around = [j for j in (before, after) if j is not None]
        own = [kinds[j] for j in around if blocks[j][2] == place]
        near = own or [kinds[j] for j in around]
        if kinds[i] in ("good", "bad"):
            keep = kinds[i] == "good"
        elif part == "main":
            keep = not own or "good" in own
        elif kinds[i] == "near":
            keep = "good" in near
        else:
            keep = near != [] and "bad" not in near
        lines += [text] if keep else []
    return "\n".join(lines)


@pytest.mark.parametrize("change", [str, without_main])
def test_equals_a_plain_version(pages, change):
    for page in map(change, pages):
        assert html_text.main_text(page) == plain_text(page)


def test_pages_without_a_marked_main_part_keep_their_text(pages):
    marked, plain = ([html_text.main_text(change(page)) for page in pages] for change in (str, without_main))
    lost = sum(bool(a) and not b for a, b in zip(marked, plain))
    assert lost <= 0.02 * len(pages)
    assert sum(a != b for a, b in zip(marked, plain)) <= 0.06 * len(pages)
    assert all(set(b.split("\n")) <= set(a.split("\n")) for a, b in zip(marked, plain) if b)


def test_a_page_of_doubtful_blocks_keeps_its_best_run():
    words = "the cat sat on a mat and was seen by birds near old trees at dawn yet nobody came"
    page = f"<div><p>short one</p><p>{words}</p><p>tail</p></div><div class='ad'>buy</div><div><p>{words[:75]}</p></div>"
    assert html_text.main_text(page) == f"short one\n{words}\ntail"
    assert html_text.main_text("<div><p>on the mat</p></div>") == "on the mat"
    assert html_text.main_text("<div><p>products offers imprint</p></div>") == ""
