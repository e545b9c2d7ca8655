"""Pages and words that once took quadratic time."""

import random
import time

import pytest

from reportloom.llm import bpe, html_text
from reportloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("page", [
    "<a " * 330_000, '<a "x" ' * 140_000, "<a '" * 200_000 + '">', "<div>" * 100_000 + "</p>" * 100_000, "<svg>" * 150_000, "</svg" * 150_000,
    "<!" * 300_000, "<svg></svg" * 60_000, "<div>" * 100_000 + "</div>" * 100_000, "<" * 500_000, '<a "" ' * 100_000 + '" >',
], ids=range(11))
def test_broken_pages_end_soon(page):
    begin = time.process_time()
    html_text.blocks_of(page)
    assert time.process_time() - begin < 10


def test_blocks_of_small_pages():
    def shown(page):
        return [(b.text, b.linked) for b in html_text.blocks_of(page)]

    assert shown("<p>a<b>b</b> c</p><p>d <a href='x>y'>e</a></p>") == [("ab c", 0), ("d e", 1)]
    assert shown("x < y <!-- <p>z --> w<br>v") == [("x < y w v", 0)]
    assert shown("<script>var a = '</p>';</script>t<style>u") == [("t", 0)]
    assert shown("<div>a<svg>b</div>c") == [("a b", 0), ("c", 0)]
    assert shown("a<!doctype html>b<?pi?>c<!--") == [("abc", 0)]
    assert shown("a <b c") == [("a <b c", 0)] and shown("1 <a href=\"q") == [('1 <a href="q', 0)]


def test_a_word_of_a_million_letters():
    from tokenizers import Tokenizer

    model, library = bpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    draw = random.Random(1)
    for word in ["a" * 1000, "".join(draw.choices("acgt", k=3000)), "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "ab" * 777 + "c"]:
        ids = model.encode(word)
        assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode(word, add_special_tokens=False).ids)
        symbols = [model.ids[s] for s in model.fragments(word)[0]]
        assert model.long_fragment(list(symbols)) == bpe.Bpe.fragment(model, model.fragments(word)[0])
    begin = time.process_time()
    assert len(model.encode("".join(draw.choices("acgt", k=1_000_000)))) > 1_000_000
    assert time.process_time() - begin < 60
