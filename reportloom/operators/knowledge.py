"""Knowledge entries: add, update, delete, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.vocabulary import KNOWLEDGE_DOMAINS

_PATCHED = ["title", "content", "category", "tags", "related_metrics", "source"]


def split_by_domain(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a valid domain, and the others with the reason."""
    valid = F.coalesce(F.col("domain").isin(KNOWLEDGE_DOMAINS), F.lit(False))
    reason = F.concat(
        F.lit("Ogiltig domain: "), F.coalesce("domain", F.lit("None")),
        F.lit(". Giltiga: " + ", ".join(KNOWLEDGE_DOMAINS)),
    )
    return items.filter(valid), items.filter(~valid).withColumn("error", reason)


def new_entries(items: DataFrame) -> DataFrame:
    """Valid items as entries with a key derived from their content, empty lists for missing ones, no vector."""
    accepted, _ = split_by_domain(items)
    empty = F.array().cast("array<string>")
    return accepted.select(
        F.sha2(F.concat_ws("|", "domain", "category", "title", "content"), 256).alias("id"),
        "domain", "category", "title", "content",
        F.coalesce("tags", empty).alias("tags"), F.coalesce("related_metrics", empty).alias("related_metrics"),
        "source", F.lit(None).cast("array<float>").alias("embedding"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )


def update_entries(knowledge: DataFrame, patches: DataFrame) -> DataFrame:
    """Entries with the non-null fields of their patch; a new title or content clears the vector for re-encoding.

    ``patches``: id and the patchable fields, one row per id.
    """
    new = patches.select("id", *[F.col(c).alias(f"_{c}") for c in _PATCHED])
    joined = knowledge.join(new, "id", "left")
    changed = F.coalesce(*[F.when(F.col(f"_{c}").isNotNull(), True) for c in _PATCHED], F.lit(False))
    stale = F.col("_title").isNotNull() | F.col("_content").isNotNull()
    out = []
    for c in knowledge.columns:
        if c in _PATCHED:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        elif c == "embedding":
            out.append(F.when(~stale, F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(changed, F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def delete_entries(knowledge: DataFrame, ids: DataFrame) -> DataFrame:
    return knowledge.join(ids.select("id"), "id", "left_anti")


def unknown_ids(ids: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Ids asked for that have no entry."""
    return ids.join(knowledge.select("id"), "id", "left_anti")


def list_knowledge(knowledge: DataFrame, domain: str | None = None, category: str | None = None) -> DataFrame:
    """Entries by domain, category and title, each with the size of its group and the grand total.

    Flat rows: a large category is never gathered in one cell.
    """
    wanted = knowledge
    if domain is not None:
        wanted = wanted.filter(F.col("domain") == domain)
    if category is not None:
        wanted = wanted.filter(F.col("category") == category)
    sizes = wanted.groupBy("domain", "category").agg(F.count("*").alias("in_category"))
    total = wanted.agg(F.count("*").alias("total"))
    return (
        wanted.select("domain", "category", "title", "id", "tags")
        .join(sizes, ["domain", "category"]).withColumn("total", total.scalar())
        .orderBy("domain", "category", "title", "id")
    )
