"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import ascii_lower, attach, told_apart, without_rows
from reportloom.session import cut_lineage

_HASHES = 2
_WORD = 64


def _slots(bits: int) -> list[Column]:
    """One slot for each hash; every hash has its own part of the filter, so a row never hits a slot twice."""
    part = bits // _HASHES
    return [F.lit(i * part) + F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(part)) for i in range(_HASHES)]


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Power of two for the rows, between 2^10 and ``max_bits``."""
    return min(max_bits, max(1 << 10, 1 << (rows * bits_per_row - 1).bit_length() if rows else 0))


def possibly_repeated(digests: DataFrame, bits: int) -> DataFrame:
    """The digests with ``maybe``: whether all slots of a row were hit at least twice.

    First pass: count the hits of every slot and keep those with two or more as a bit map, a word of 64 slots a row.
    Second pass: look the slots of every row up in it. The map has at most ``bits`` / 64 rows of 16 bytes, which is the
    bound that allows it to be broadcast.
    """
    hits = digests.select(F.explode(F.array(*_slots(bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    words = (
        hits.filter("n > 1")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(slot % {_WORD} as int))")).alias("bits"))
    )
    out = digests
    found = []
    for i, slot in enumerate(_slots(bits)):
        out = out.withColumn(f"slot{i}", slot).withColumn(f"word{i}", F.shiftright(F.col(f"slot{i}"), 6))
        side = F.broadcast(words.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}")))
        out = out.join(side, f"word{i}", "left")
        bit = F.expr(f"shiftright(bits{i}, cast(slot{i} % {_WORD} as int)) & 1")
        found.append(F.coalesce(bit, F.lit(0)) == 1)
    maybe = found[0]
    for one in found[1:]:
        maybe = maybe & one
    return out.select(*digests.columns, maybe.alias("maybe"))


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 27
) -> DataFrame:
    """For every row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id of a group
    stays. Rows with the same id and text share one decision; a null id is smaller than any other. The text is read
    once; only digests are stored (runs jobs). Rows that the filter clears pass straight through, the others shuffle by
    digest. Beyond ``max_bits`` / ``bits_per_row`` rows the filter clears fewer rows; results stay exact.
    """
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    digests = cut_lineage(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256")))
    tested = cut_lineage(possibly_repeated(digests, filter_bits(digests.count(), bits_per_row, max_bits)))
    passed = tested.filter("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256"
    )
    shuffled = tested.filter("maybe").drop("maybe")
    groups = shuffled.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    decided = attach(shuffled, groups, ["text_sha256"]).select("id", "keep_id", "group_size", "text_sha256")
    return passed.union(decided).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, all columns as they were: of the largest id, a null id being the smallest.

    Rows that share an id, or have none, are decided one by one, so one of several rows with the same id and text stays
    and other texts of their id are not touched. Runs jobs.
    """
    rows, key = told_apart(docs, id_col, nulls_first=True)
    gone = duplicate_groups(rows, key, text_col).filter("not kept").select(key)
    return without_rows(rows, key, gone, docs.columns)
