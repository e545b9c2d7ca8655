"""Names of containers: parts of a class or id, nested articles, the word hidden."""

import pytest

from reportloom.llm import html_text

TEXT = "The house of the stone is far from the water, and the light of the garden is in it as it was in the days that we had with you. " * 2
FULL = " ".join(TEXT.split())


@pytest.mark.parametrize("container", [
    'div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="content-with-sidebar"', 'div class="social-science"',
    'div class="legal-news"', 'div class="navy-theme"', 'section id="discussion"', 'article class="post comments-open"',
    'div class="x hidden md:block"', 'div title="the hidden valley"', 'div data-note="display: none"',
])
def test_a_part_of_a_name_decides_nothing(container):
    assert html_text.main_text(f"<body><{container}><p>{TEXT}</p></{container.split()[0]}></body>") == FULL


@pytest.mark.parametrize("outer", ['div class="sidebar"', "form", 'div role="banner"'])
@pytest.mark.parametrize("inner", ["article", "main"])
def test_a_nested_article_resets_a_likely_mark(outer, inner):
    tag = outer.split()[0]
    assert html_text.main_text(f"<{outer}><p>{TEXT}</p><{inner}><p>{TEXT}</p></{inner}><p>{TEXT}</p></{tag}>") == FULL


@pytest.mark.parametrize("outer", [
    'div class="sidebar"', 'div class="cookie-notice big"', 'div id="site-footer"', "nav", "aside", "div hidden", "div hidden=''",
    'div aria-hidden="true"', 'div style="display:none"', 'article class="comment"', 'div role="navigation"',
])
def test_known_names_and_hidden_parts_still_go(outer):
    assert html_text.main_text(f"<{outer}><p>{TEXT}</p></{outer.split()[0]}>") == ""
    if outer in ("nav", "aside", "div hidden"):
        assert html_text.main_text(f"<{outer}><article><p>{TEXT}</p></article></{outer.split()[0]}>") == ""
