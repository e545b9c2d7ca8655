"""Stages decide row by row: null ids, one id with several texts, repeated rows."""

import collections

from reportloom.llm import exact_dedup, language_id, mixing, near_dedup

SCHEMA = "doc_id bigint, text string, source string"
COPY = "one two three four five six seven eight nine ten eleven twelve"


def left(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_exact_copies_go_row_by_row(spark):
    rows = [(None, "a"), (None, "b"), (1, "A"), (2, "x"), (2, "y"), (3, "X"), (4, "r"), (4, "r"), (4, "R"), (None, "n"), (None, "n"), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    stays = exact_dedup.without_copies(docs)
    assert stays.columns == docs.columns
    found = left(stays)
    assert found.pop((4, "r"), 0) + found.pop((4, "R"), 0) == 1
    assert found == collections.Counter([(None, "b"), (1, "A"), (2, "y"), (3, "X"), (None, "n"), (6, "")])


def test_near_copies_go_row_by_row(spark):
    near = COPY.replace("one", "zero")
    rows = [(1, COPY), (2, near), (2, "quite another text of its own"), (None, near), (None, "a text without an id"), (3, "r s"), (3, "r s"), (4, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    stays = near_dedup.without_near_copies(docs, percent=70)
    assert stays.columns == docs.columns
    assert left(stays) == collections.Counter([(1, COPY), (2, "quite another text of its own"), (None, "a text without an id"), (3, "r s"), (4, None)])


def test_language_rejects_rows_not_ids(spark):
    parsers = language_id.train({"x": ["abab"], "y": ["bbaa"]}, 100)
    rows = [(None, "123"), (None, "ab"), (1, None), (1, "ba"), (1, "ba"), (2, "!")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    stays = language_id.in_known_language(docs, parsers)
    assert stays.columns == docs.columns
    assert left(stays) == collections.Counter({(None, "ab"): 1, (1, "ba"): 2})


def test_columns_of_any_name_keep_their_data(spark):
    """Names that the stages might want for themselves, with null and shared ids."""
    names = ["_row", "_gone", "_GONE2", "_mix_source", "_mix_rate", "__row"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(None, "a", "s"), (None, "b", "s"), (1, "A", "t"), (2, "x", "s"), (2, "y", None), (3, COPY, "s"), (4, COPY.replace("one", "zero"), "s")]
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], schema)
    whole = {tuple(r) for r in docs.collect()}
    for stage, count in (
        (exact_dedup.without_copies(docs), 6), (near_dedup.without_near_copies(docs, percent=70), 5),
        (exact_dedup.without_copies(docs.filter("doc_id is not null and text <> 'y'")), 4),
    ):
        assert stage.columns == docs.columns and {tuple(r) for r in stage.collect()} <= whole and stage.count() == count
    mixed = mixing.mix_sources(docs, budget=3.0).select(*docs.columns).collect()
    assert mixed and {tuple(r) for r in mixed} <= whole
