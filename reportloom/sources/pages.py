"""Page text to rows: markdown tables, sections, merged documents, image annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.classify import keyword_section_type
from reportloom.functions.scale import running_total
from reportloom.functions.text import strip

_HEADING = r"^(#{1,3})(?U:\s+)(.+)$"
_RULE = r"(?U)^[-|:\s]+$"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")


def parse_markdown_tables(pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Markdown table texts as ``columns`` and ``rows`` (label, values, order).

    Empty cells vanish and separator lines are those of blanks, bars and hyphens only.
    """
    lines = F.filter(_lines(F.col(markdown)), lambda x: x != "")
    body = F.filter(
        F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), lambda x: ~x.rlike(r"^[-| ]*$")
    )

    def row(line: Column, i: Column) -> Column:
        cells = _cells(line)
        return F.struct(
            F.coalesce(F.get(cells, F.lit(0)), F.lit("")).alias("label"),
            F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))).alias("values"),
            (i + 1).cast("int").alias("order"),
        )

    first = F.coalesce(F.get("_lines", F.lit(0)), F.lit(""))
    return pages.withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>"))).select(
        *pages.columns, _cells(first).alias("columns"), F.transform(body, row).alias("rows")
    )


def _is_text(line: Column) -> Column:
    return (line != "") & ~line.startswith("|") & ~line.rlike(_RULE)


def _is_long(line: Column) -> Column:
    return ~line.startswith("|") & (F.length(line) > 50)


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of documents from their page text (doc_id, page_num, markdown).

    A heading opens a section; text runs on over page ends; before the first heading a line of over 50
    characters opens a section without a heading. Sections under 100 characters are dropped. Pages are cut at
    their headings inside the row; only the number of headings before a page needs other rows.
    """
    lined = pages.select("doc_id", "page_num", _lines(F.coalesce("markdown", F.lit(""))).alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_HEADING), i)), lambda i: i.isNotNull())
    marked = lined.withColumn("heads", heads).select(
        "*", F.size("heads").alias("n_heads"),
        # Long lines count only before the page's first heading.
        F.size(F.filter(
            F.slice("lines", F.lit(1), F.coalesce(F.get("heads", F.lit(0)), F.size("lines"))), _is_long
        )).alias("n_long"),
    )
    offsets = running_total(
        marked.select("doc_id", "page_num", "n_heads", "n_long"), ["doc_id"], "page_num",
        {"n_heads": "heads_before", "n_long": "long_before"},
    ).select("doc_id", "page_num", "heads_before", "long_before")
    parts = F.transform(
        F.sequence(F.lit(0), F.size("heads")),
        lambda k: F.struct(
            k.alias("k"),
            F.when(k > 0, F.get("lines", F.get("heads", k - 1))).alias("heading"),
            F.slice(
                "lines",
                F.when(k > 0, F.get("heads", k - 1) + 2).otherwise(1),
                F.when(k < F.size("heads"), F.get("heads", k)).otherwise(F.size("lines"))
                - F.when(k > 0, F.get("heads", k - 1) + 1).otherwise(0),
            ).alias("lines"),
        ),
    )
    cutted = marked.select("doc_id", "page_num", F.explode(parts).alias("p")).select("doc_id", "page_num", "p.*")
    placed = cutted.join(offsets, ["doc_id", "page_num"]).withColumn("section_no", F.col("heads_before") + F.col("k"))
    opens = F.get(F.filter(F.transform("lines", lambda x, i: F.when(_is_long(x), i)), lambda i: i.isNotNull()), F.lit(0))
    open_at = F.when((F.col("section_no") == 0) & (F.col("long_before") == 0), opens)
    waits = (F.col("section_no") == 0) & (F.col("long_before") == 0)
    after = F.filter(F.slice("lines", F.col("open_at") + 2, F.size("lines") - F.col("open_at") - 1), _is_text)
    opened = F.concat(F.array(F.get("lines", F.col("open_at"))), after)
    kept = (
        F.when(waits & F.col("open_at").isNull(), F.array().cast("array<string>"))
        .when(waits, opened).otherwise(F.filter("lines", _is_text))
    )
    title = F.when(F.col("k") > 0, strip(F.regexp_extract("heading", _HEADING, 2))).when(
        F.col("open_at").isNotNull(), F.concat(F.lit("Text från sida "), F.col("page_num").cast("string"))
    )
    texts = placed.withColumn("open_at", open_at).select(
        "doc_id", "section_no", "page_num", title.alias("title"), F.array_join(kept, "\n").alias("text")
    )
    grouped = texts.groupBy("doc_id", "section_no").agg(
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page_num"))).alias("title"),
        F.min(F.when(F.col("title").isNotNull(), F.col("page_num"))).alias("page"),
        F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_num", "text")))).alias("parts"),
    )
    content = strip(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    return (
        grouped.select("doc_id", "section_no", "title", "page", content.alias("content"))
        .filter(F.col("title").isNotNull() & (F.length("content") >= 100))
        .withColumn("section_type", keyword_section_type(F.col("title"), F.col("content")))
    )


def document_metadata(pages: DataFrame) -> DataFrame:
    """Metadata of each document from the annotation of its first page, with defaults, and its page count.

    ``pages``: doc_id, page_num, annotation (JSON text or null). Unreadable JSON counts as none.
    """
    first = pages.groupBy("doc_id").agg(
        F.min_by("annotation", "page_num").alias("a"), F.count("*").alias("antal_sidor")
    )
    read = F.from_json("a", "company_name string, period string, currency string, language string")
    return first.withColumn("m", read).select(
        "doc_id",
        F.coalesce("m.company_name", F.lit("Okänt")).alias("bolag"),
        F.coalesce("m.period", F.lit("")).alias("period"),
        F.coalesce("m.currency", F.lit("SEK")).alias("valuta"),
        F.coalesce("m.language", F.lit("sv")).alias("sprak"),
        "antal_sidor",
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Page texts under their page line; in (doc_id, page_num) order they read as the whole document."""
    return pages.filter(F.coalesce("markdown", F.lit("")) != "").select(
        "doc_id", "page_num",
        F.concat(F.lit("--- Sida "), F.col("page_num").cast("string"), F.lit(" ---\n"), "markdown").alias("text"),
    )


def document_texts(pages: DataFrame) -> DataFrame:
    """One text per document. Only for documents that fit in a cell; ``page_texts`` has no such bound."""
    return page_texts(pages).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]), "\n\n")
        .alias("full_text")
    )


def annotated_charts(images: DataFrame) -> DataFrame:
    """Charts and diagrams among annotated page images (doc_id, page_num, image_no, annotation)."""
    read = F.from_json(
        "annotation", "element_type string, chart_type string, title string, description string, data_summary string"
    )
    return images.withColumn("a", read).filter(F.col("a.element_type").isin("chart", "diagram")).select(
        "doc_id",
        F.concat(F.lit("chart_p"), F.col("page_num").cast("string"), F.lit("_"), F.col("image_no").cast("string")).alias("id"),
        F.col("page_num").alias("page"),
        "a.element_type",
        F.coalesce("a.chart_type", F.lit("other")).alias("chart_type"),
        F.coalesce("a.title", F.lit("")).alias("title"),
        F.coalesce("a.description", F.lit("")).alias("description"),
        "a.data_summary",
    )


def html_to_lines(html: Column) -> Column:
    """HTML as plain lines with ``#`` headings: scripts and tags out, block ends as line ends."""
    text = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<h1[^>]*>", "\n# ")
    text = F.regexp_replace(text, r"(?i)<h2[^>]*>", "\n## ")
    text = F.regexp_replace(text, r"(?i)<h3[^>]*>", "\n### ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|article|nav|ul|ol|li|br|table|tr|section|footer|h[1-6])\b[^>]*>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")
