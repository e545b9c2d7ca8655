"""The sharding query deals whole documents."""

import zlib

from reportloom.llm import queries, sharding


def test_documents_reach_their_shards(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} é" if i % 7 else None, "en", "s", 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    dealt = []
    into_shards = sharding.into_shards
    monkeypatch.setattr(sharding, "into_shards", lambda frame, *a, **b: dealt.append(into_shards(frame, *a, **b)) or dealt[0])
    got = {r.doc_id: r for r in queries.op7_sharding(spark, str(tmp_path)).collect()}
    assert set(docs.columns) < set(dealt[0].columns) and len(got) == 100
    for i, text, *_ in rows:
        data = (text or "").encode()
        assert (got[i]["size"], got[i].text_crc32) == (len(data) + 16, zlib.crc32(data))
