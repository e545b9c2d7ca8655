"""The pipeline's stages on small rows, each against what it must keep of its own input."""

import collections

import corpus_pipeline


def test_stages(spark, tmp_path):
    base = "the house of the stone is far from the water and the light of the garden is in it " * 2
    texts = [base + f"number {i} and more of it {i * 7} stands here" for i in range(60)] + [base + "x", base + "X", base + "y", "123 !!", None]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = collections.Counter(r.doc_id for r in docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert set(kept["language_id"]) == set(range(63))
    assert set(kept["exact_dedup"]) == set(range(63)) - {60}
    assert set(kept["near_dedup"]) <= set(kept["exact_dedup"]) and 62 not in kept["near_dedup"]
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and kept["bpe"] == kept["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(kept["bpe"].values())
