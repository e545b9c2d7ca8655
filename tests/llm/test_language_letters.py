"""Scripts of many letters: no letter of a sample is unknown, sorted moves count as the dense table does."""

import random

from reportloom.llm import language_id


def test_two_languages_of_a_large_script():
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    rng.shuffle(letters)
    pairs = {"x": [a + b for a, b in zip(letters, letters[1:])], "y": [b + a for a, b in zip(letters, letters[1:])]}
    latin = "".join(rng.choice("abcdefghij ") for _ in range(8000))
    texts = {lang: ["".join(rng.choice(p) for _ in range(3000)) for _ in range(2)] for lang, p in pairs.items()}
    parsers = language_id.train({"x": texts["x"][:1], "y": texts["y"][:1], "z": [latin]}, 20_000)
    best, score = parsers.judge([texts["x"][1][:200], texts["y"][1][:200], latin[50:90]])
    assert best.tolist() == ["x", "y", "z"] and (score > 0.05).all()


def test_sorted_moves_equal_the_dense_table(monkeypatch):
    rng = random.Random(4)
    sample = {lang: ["".join(rng.choice(letters) for _ in range(900))] for lang, letters in (("x", "abcd "), ("y", "cdefgh "))}
    dense = language_id.train(sample, 1000)
    monkeypatch.setattr(language_id, "_DENSE", 0)
    thin = language_id.train(sample, 1000)
    texts = ["", "q", "ab cd", "".join(rng.choice("abcdefghq !") for _ in range(700))]
    count = [p.phrases([p.symbols(t) for t in texts]).tolist() for p in (dense, thin)]
    assert thin.tables[0].table is None and dense.tables[0].table is not None and count[0] == count[1]
