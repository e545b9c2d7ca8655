"""Texts in languages without a list of stop words."""

import pytest

from reportloom.llm import html_text, quality

TEXTS = {
    "ru": "Старый дом стоит далеко от реки, и вечером свет из его окон виден на другом берегу. Каждый год весной жители приходят сюда за водой. ",
    "pl": "Stary dom stoi daleko od rzeki, a wieczorem światło z jego okien widać na drugim brzegu. Każdego roku wiosną mieszkańcy przychodzą tu po wodę. ",
    "tr": "Eski ev nehirden uzakta duruyor ve akşamları pencerelerinin ışığı karşı kıyıdan görünüyor. Her yıl ilkbaharda insanlar buraya su almak için gelir. ",
    "zh": "老房子离河很远，晚上从它的窗户里透出的光在对岸都能看见。每年春天，居民们都会来这里取水，然后沿着小路慢慢走回村子，一路上谈论着天气和收成。",
}


@pytest.mark.parametrize("language", TEXTS)
def test_articles_in_plain_blocks_are_kept(language):
    text = " ".join((TEXTS[language] * 2).split())
    page = f"<body><nav><a href='/'>x</a></nav><div><p>{text}</p><p>{TEXTS[language]}</p></div><div><a href='/y'>{text}</a></div></body>"
    assert html_text.main_text(page) == f"{text}\n{TEXTS[language].strip()}"


@pytest.mark.parametrize("language", ["ru", "pl", "tr"])
def test_clean_texts_get_no_bad_vote(language):
    assert quality.BAD not in quality.votes(TEXTS[language])


def test_listed_languages_are_still_judged():
    junk = "products contact imprint offers downloads support careers press partners events " * 3
    place = quality.LABELLERS.index(quality._stop_words)
    assert quality.votes(junk)[place] == quality.BAD and html_text.main_text(f"<p>{junk}</p>") == ""
