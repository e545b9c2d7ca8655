"""Every labelled language is learned, whatever the length and the number of its texts."""

import pytest

from reportloom.llm import language_id


@pytest.mark.parametrize("texts", [1, 3])
def test_few_long_texts_and_many_copies(spark, texts):
    rows = [(f"l{i}", f"{chr(97 + i)}b{chr(98 + i)} {k} " * 20_000) for i in range(8) for k in range(texts)]
    rows += [("copies", "zyx zxy ")] * 2000 + [("copies", f"word {i} ") for i in range(3)]
    rows += [("late", "12 " * 500 + "ööö ")] + [("late", "1 2 " * 500 + str(i)) for i in range(20)] + [("none", "123")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    sample = language_id.labelled_sample(docs, 200)
    assert set(sample) == {f"l{i}" for i in range(8)} | {"copies", "late"}
    assert len(sample["copies"]) == 4 and all(len(t) <= 200 for lang in sample.values() for t in lang)
    assert set(language_id.fit(docs, 200).languages) == set(sample)
