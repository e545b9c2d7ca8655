"""Databook: statements, tables, charts, notes and texts of many periods in aligned form."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.classify import mapped_table_type
from reportloom.functions.labels import row_class, row_key
from reportloom.functions.naming import sheet_name
from reportloom.functions.scale import first_per_key, first_places, previous_values, ranked, running_total
from reportloom.functions.text import strip
from reportloom.session import cut_lineage
from reportloom.vocabulary import (
    CHART_SHEET,
    LEGACY_SEPARATOR,
    LEGACY_SHEETS,
    NOTE_COLUMNS,
    NUMBERS_SEPARATOR,
    SHEET_ORDER,
    TEXT_SEPARATOR,
    UNIT_COLUMNS,
)

_GROUP = ["company_id", "statement"]
_AT_ONCE = 1 << 16  # rows of a group that one task orders by itself


def statement_order(rows: DataFrame, at_once: int = _AT_ONCE) -> DataFrame:
    """Order of all row names of a statement over its periods, each name once.

    ``rows``: company_id, statement, period_no (0 is the first period), row_no, name. The first period gives
    the base. A row that is new later goes right after the row before it, else to the end. Statements of up to
    ``at_once`` names are ordered by a task each. In larger ones, inserting after a row makes the new row its child, and of
    two children the later one comes first, so the list is the preorder of a forest: an Euler tour of it is ranked by
    pointer doubling, two numbers for each name, in as many rounds as the length of the tour has bits. Runs jobs.
    """
    keyed = rows.filter(F.coalesce("name", F.lit("")) != "").withColumn("row_key", row_key(F.col("name")))
    before = previous_values(keyed, [*_GROUP, "period_no"], "row_no", {"row_key": "prev_key"})
    hangs = (F.col("period_no") > 0) & (F.coalesce("prev_key", F.lit("")) != "")
    nodes = cut_lineage(first_per_key(
        before.select(*_GROUP, "row_key", "period_no", "row_no", F.col("name").alias("label"), F.when(hangs, F.col("prev_key")).alias("anchor")),
        [*_GROUP, "row_key"],
        ["period_no", "row_no"],
    ))
    sizes = nodes.groupBy(*_GROUP).agg(F.count("*").alias("names"))
    out = f"{', '.join(f'{c} {nodes.schema[c].dataType.simpleString()}' for c in _GROUP)}, row_key string, label string, position bigint"
    if sizes.filter(F.col("names") > at_once).isEmpty():
        return nodes.groupBy(*_GROUP).applyInPandas(_insertion_order, out)
    sizes = cut_lineage(sizes)
    small = nodes.join(sizes.filter(F.col("names") <= at_once), _GROUP, "left_semi").groupBy(*_GROUP).applyInPandas(_insertion_order, out)
    return small.unionByName(_tour_order(nodes.join(sizes.filter(F.col("names") > at_once), _GROUP, "left_semi")))


def _insertion_order(nodes: pd.DataFrame) -> pd.DataFrame:
    """The names of one statement, each put after its anchor or to the end, as a linked list."""
    nodes = nodes.sort_values(["period_no", "row_no"], kind="stable").reset_index(drop=True)
    spot = {key: i for i, key in enumerate(nodes["row_key"])}
    following, first, last = [-1] * len(nodes), 0, -1
    for i, anchor in enumerate(nodes["anchor"]):
        at = last if anchor is None or anchor != anchor else spot[anchor]
        if at >= 0:
            following[i], following[at] = following[at], i
        if at == last:
            last = i
    order, at = [], first if len(nodes) else -1
    while at >= 0:
        order.append(at)
        at = following[at]
    placed = nodes.iloc[order].assign(position=range(1, len(order) + 1))
    return placed[[*_GROUP, "row_key", "label", "position"]]


def _tour_order(nodes: DataFrame) -> DataFrame:
    """Preorder of the forest of anchors by an Euler tour: every node is entered and left, and only entering counts.

    ``spot`` numbers the names of a statement by their first occurrence. The tour goes from a name to its latest child,
    from the last child back to the parent, and from a root to the next root.
    """
    placed = cut_lineage(ranked(nodes, _GROUP, ["period_no", "row_no"], "spot"))
    parents = placed.select(*_GROUP, F.col("row_key").alias("anchor"), F.col("spot").alias("parent"))
    linked = placed.join(parents, [*_GROUP, "anchor"], "left")
    # Children of a name from the latest to the earliest, roots from the earliest to the latest.
    turned = linked.select(*_GROUP, "spot", "parent", F.coalesce("parent", F.lit(0)).alias("above"),
                           F.when(F.col("parent").isNull(), F.col("spot")).otherwise(-F.col("spot")).alias("turn"))
    siblings = cut_lineage(ranked(turned, [*_GROUP, "above"], ["turn"], "place"))
    after = siblings.select(*_GROUP, "above", (F.col("place") - 1).alias("place"), F.col("spot").alias("next_sibling"))
    first = siblings.filter("place = 1").select(*_GROUP, F.col("above").alias("spot"), F.col("spot").alias("first_child"))
    known = siblings.join(after, [*_GROUP, "above", "place"], "left").join(first, [*_GROUP, "spot"], "left")

    def enter(spot: str) -> Column:
        return F.col(spot) * 2

    def leave(spot: str) -> Column:
        return F.col(spot) * 2 + 1

    steps = F.array(
        F.struct(enter("spot").alias("at"), F.coalesce(enter("first_child"), leave("spot")).alias("to"), F.lit(1).cast("bigint").alias("ahead")),
        F.struct(leave("spot").alias("at"), F.coalesce(enter("next_sibling"), leave("parent")).alias("to"), F.lit(0).cast("bigint").alias("ahead")),
    )
    tour = cut_lineage(known.select(*_GROUP, F.explode(steps).alias("s")).select(*_GROUP, "s.*"))
    while not tour.filter(F.col("to").isNotNull()).isEmpty():
        further = tour.select(*_GROUP, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("ahead").alias("_ahead"))
        tour = cut_lineage(tour.join(further, [*_GROUP, "to"], "left").select(
            *_GROUP, "at", F.col("_to").alias("to"), (F.col("ahead") + F.coalesce("_ahead", F.lit(0))).alias("ahead")
        ))
    entered = tour.filter(F.col("at") % 2 == 0).select(*_GROUP, F.expr("at div 2").alias("spot"), "ahead")
    totals = placed.groupBy(*_GROUP).agg(F.count("*").alias("names"))
    return placed.join(entered, [*_GROUP, "spot"]).join(totals, _GROUP).select(
        *_GROUP, "row_key", "label", (F.col("names") - F.col("ahead") + 1).alias("position")
    )


def period_matrix(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Value of every row name in every period that has it; the first matching row of a period counts.

    ``rows``: company_id, statement, period, period_no, row_no, name, value, row_type.
    """
    keyed = rows.withColumn("row_key", row_key(F.col("name")))
    firsts = first_per_key(
        keyed.select(*_GROUP, "period", "period_no", "row_key", "row_no", "value", "row_type"),
        [*_GROUP, "period", "period_no", "row_key"],
        ["row_no"],
    )
    kinds = firsts.groupBy(*_GROUP, "row_key").agg(F.max_by("row_type", "period_no").alias("last_type"))
    head = order.join(kinds, [*_GROUP, "row_key"]).select(
        *_GROUP, "row_key", "label", "position", row_class(F.col("last_type"), F.col("label")).alias("row_class")
    )
    return head.join(firsts.select(*_GROUP, "row_key", "period", "period_no", "value"), [*_GROUP, "row_key"])


def wide_matrix(matrix: DataFrame, periods: list[str]) -> DataFrame:
    """The matrix with one column per period label of the export."""
    return (
        matrix.groupBy(*_GROUP, "position", "row_key", "label", "row_class").pivot("period", periods).agg(F.first("value"))
    )


def _clean(header: Column) -> Column:
    return strip(F.lower(F.coalesce(header, F.lit("none"))))


def table_dump(tables: DataFrame, known_types_only: bool = False, clip: bool = False) -> DataFrame:
    """Cells of the sheet tables, unit and note columns out.

    ``tables``: company_id, period, period_no, id, table_type, title, page_number, columns, rows. A type without a sheet
    of its own goes to ``other``; ``known_types_only`` leaves such tables out. Values beyond the headers have a null
    header; ``clip`` leaves them out. A table without rows has its headers as cells with null ``row_no`` and ``value``. A
    missing title becomes that of the sheet.
    """
    units, skipped = UNIT_COLUMNS, UNIT_COLUMNS + NOTE_COLUMNS
    kind = mapped_table_type(F.col("table_type"), F.col("title"))
    known = kind.isin([t for t, _ in SHEET_ORDER])
    wanted = tables.filter(known) if known_types_only else tables
    sheet_titles = F.create_map(*[F.lit(x) for pair in SHEET_ORDER for x in pair])
    typed = wanted.withColumn("sheet_type", F.when(known, kind).otherwise("other")).withColumn(
        "title", F.coalesce(F.when(F.col("title") != "", F.col("title")), sheet_titles[F.col("sheet_type")])
    )
    label_first = (F.size("columns") > 0) & _clean(F.get("columns", F.lit(0))).isin(["", *units])
    all_columns = F.coalesce(F.col("columns"), F.array().cast("array<string>"))
    value_columns = F.when(label_first, F.slice(all_columns, F.lit(2), F.greatest(F.size(all_columns) - 1, F.lit(0)))).otherwise(
        all_columns
    )
    step1 = typed.withColumn("_vc", value_columns).withColumn("_label_first", label_first)
    spots = F.filter(
        F.transform("_vc", lambda c, i: F.when(_clean(c).isin(skipped), i)), lambda i: i.isNotNull()
    )
    sample = F.coalesce(F.get("rows", F.lit(0))["values"], F.array().cast("array<string>"))
    width = F.size(all_columns) - F.when(F.col("_label_first"), 1).otherwise(0)
    has_units = F.greatest(F.size(sample) - 1, F.lit(0)) >= width
    step2 = step1.withColumn("_skip", spots).withColumn("_drop", (F.size(spots) > 0) & has_units)
    kept = F.filter("_vc", lambda c: ~_clean(c).isin(skipped))
    page = F.col("page_number")
    shown = F.when(
        F.coalesce(page, F.lit(0)) != 0, F.concat("title", F.lit(" (s. "), page.cast("string"), F.lit(")"))
    ).otherwise(F.col("title"))
    rows = step2.select(
        "company_id", "period", "period_no", "id", "sheet_type", shown.alias("table_title"), kept.alias("headers"),
        "_skip", "_drop", F.posexplode_outer("rows").alias("row_no", "row"),
    )
    tail = F.slice(F.col("row.values"), F.lit(2), F.greatest(F.size("row.values") - 1, F.lit(0)))
    values = F.when(F.col("_drop"), F.filter(tail, lambda v, i: ~F.array_contains(F.col("_skip"), i))).otherwise(tail)
    shown_values = F.slice(values, F.lit(1), F.size("headers")) if clip else values
    heads = F.transform("headers", lambda _: F.lit(None).cast("string"))
    cells = rows.select(
        "company_id", "period", "period_no", "id", "sheet_type", "table_title", "row_no",
        F.col("row.label").alias("label"), F.col("row.type").alias("row_type"), "headers",
        F.posexplode_outer(F.when(F.col("row_no").isNull(), heads).otherwise(shown_values)).alias("cell_no", "value"),
    )
    return cells.withColumn("header", F.get("headers", F.col("cell_no"))).drop("headers")


# The line starts that mark a bullet.
_BULLET = r"^[•*–-] "


def _bullets(content: Column) -> Column:
    """Distinct bullets of a text: up to 50 characters after the mark, in lower case."""
    lines = F.transform(F.split(content, "\n"), strip)
    marked = F.filter(lines, lambda x: x.rlike(_BULLET))
    return F.array_sort(F.array_distinct(F.filter(
        F.transform(marked, lambda x: strip(F.lower(F.substring(x, 3, 50)))), lambda x: x != ""
    )))


def _first_sentence(content: Column) -> Column:
    """First long line with a full stop or bullet: 100 characters in lower case without blanks; null if none."""
    lines = F.transform(F.split(content, "\n"), strip)
    long = F.filter(lines, lambda x: (F.length(x) > 50) & x.rlike("[.•]"))
    return F.replace(F.lower(F.substring(F.get(long, F.lit(0)), 1, 100)), F.lit(" "), F.lit(""))


_BLOCK_WEIGHT = 1 << 18  # sections and bullets that one task settles in a round
_BY_SECTION = ["company_id", "section_no"]


def unique_sections(sections: DataFrame, block_weight: int = _BLOCK_WEIGHT) -> DataFrame:
    """Sections a databook keeps: no earlier kept section has the same title or the same content.

    ``sections``: company_id, section_no (order of the company's sections over its periods), title, page, content.
    Contents are the same when they share their first sentence, or min(3, bullets of either) bullets, which is
    the rule "three in common, or over 70 % of the smaller set". Copies are folded to their first. Then a task for each
    company settles its earliest sections, up to ``block_weight`` sections and bullets; mostly that is all. What is
    left of larger companies loses the rivals of the kept ones, which are found through an index of rare bullets; those
    without any possible earlier rival are kept at once, and the next block follows. Rounds follow the size of what is
    left over the size of a block, not the length of a chain of rivals. Runs jobs.
    """
    described = sections.filter(F.coalesce("title", F.lit("")) != "").select(
        *_BY_SECTION, "title", F.coalesce("page", F.lit(999)).alias("page"),
        _bullets(F.coalesce("content", F.lit(""))).alias("bullets"),
        F.coalesce(_first_sentence(F.coalesce("content", F.lit(""))), F.lit("")).alias("sentence"),
    )
    folded = cut_lineage(
        described.groupBy("company_id", "title", "bullets", "sentence").agg(
            F.min("section_no").alias("section_no"), F.min_by("page", "section_no").alias("page")
        )
    )
    left = cut_lineage(_rarest_first(folded))
    kept, index = [], None
    while True:
        settled = cut_lineage(_settled_blocks(left, block_weight))
        kept.append(settled.filter("kept").select(*_BY_SECTION))
        rest = left.join(settled, _BY_SECTION, "left_anti")
        if rest.isEmpty():
            break
        index = cut_lineage(_bullet_index(left)) if index is None else index
        left = cut_lineage(_without_rivals(rest, left.join(kept[-1], _BY_SECTION, "left_semi"), index))
        free = cut_lineage(_without_earlier(left, index))
        kept.append(free.select(*_BY_SECTION))
        left = cut_lineage(_without_rivals(left.join(free, _BY_SECTION, "left_anti"), free, index))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept).join(folded.select(*_BY_SECTION, "title", "page"), _BY_SECTION)


def _rarest_first(folded: DataFrame) -> DataFrame:
    """Sections with their bullets from the rarest in the company to the most frequent, and ``n``, how many."""
    flat = folded.select(*_BY_SECTION, F.explode("bullets").alias("bullet"))
    uses = flat.groupBy("company_id", "bullet").agg(F.count("*").alias("uses"))
    ordered = flat.join(uses, ["company_id", "bullet"]).groupBy(*_BY_SECTION).agg(
        F.array_sort(F.collect_list(F.struct("uses", "bullet"))).alias("by_uses")
    )
    none = F.array().cast("array<struct<uses:bigint,bullet:string>>")
    return folded.drop("bullets").join(ordered, _BY_SECTION, "left").withColumn(
        "by_uses", F.coalesce("by_uses", none)
    ).select(
        *_BY_SECTION, "title", "sentence", F.transform("by_uses", lambda b: b["bullet"]).alias("bullets"),
        F.size(F.filter("by_uses", lambda b: b["uses"] == 1)).alias("alone"), F.size("by_uses").alias("n"),
    )


def _settled_blocks(left: DataFrame, block_weight: int) -> DataFrame:
    """The earliest open sections of each company with the decision on them (company_id, section_no, kept)."""
    weighed = left.withColumn("weight", F.col("n").cast("bigint") + 1)
    blocks = running_total(weighed, ["company_id"], "section_no", {"weight": "before"}).filter(F.col("before") < block_weight)
    types = {c: left.schema[c].dataType.simpleString() for c in _BY_SECTION}
    return blocks.groupBy("company_id").applyInPandas(
        _first_wins, f"company_id {types['company_id']}, section_no {types['section_no']}, kept boolean"
    )


def _same_bullets(a: frozenset[str], b: frozenset[str]) -> bool:
    return len(a & b) >= min(3, len(a), len(b)) > 0


def _first_wins(block: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice over the sections of one block in order.

    Two sections of three bullets or more that share three also share one of all but their two most frequent ones; one
    with fewer shares its rarest.
    """
    block = block.sort_values("section_no")
    titles: set[str] = set()
    sentences: set[str] = set()
    rare, small, anywhere = defaultdict(list), defaultdict(list), defaultdict(list)
    kept: list[bool] = []
    for title, sentence, bullets in zip(block["title"], block["sentence"], block["bullets"]):
        own, ordered = frozenset(bullets), list(bullets)
        seen = title in titles or (sentence != "" and sentence in sentences)
        if not seen and ordered:
            probes = [(rare, ordered[:-2]), (small, ordered)] if len(ordered) >= 3 else [(small, ordered), (anywhere, ordered[:1])]
            met = {id(other): other for index, keys in probes for key in keys for other in index.get(key, ())}
            seen = any(_same_bullets(own, other) for other in met.values())
        kept.append(not seen)
        if seen:
            continue
        titles.add(title)
        sentences.add(sentence)
        for key in ordered:
            anywhere[key].append(own)
        for key in ordered[:-2] if len(ordered) >= 3 else ordered[:1]:
            (rare if len(ordered) >= 3 else small)[key].append(own)
    return block[_BY_SECTION].assign(kept=kept)


def _bullet_index(sections: DataFrame) -> DataFrame:
    """Bullets that occur elsewhere too, and how they are looked up.

    ``rare``: of a section of three or more, not among its two most frequent; ``small``: the rarest one of a section of
    fewer. Rivals meet under a bullet that is rare in both or small in one of them.
    """
    return sections.select(*_BY_SECTION, "n", "alone", F.posexplode("bullets").alias("i", "bullet")).filter(
        F.col("i") >= F.col("alone")
    ).select(
        *_BY_SECTION, "bullet", ((F.col("n") >= 3) & (F.col("i") < F.col("n") - 2)).alias("rare"),
        ((F.col("n") < 3) & (F.col("i") == 0)).alias("small"),
    )


def _without_rivals(rest: DataFrame, kept: DataFrame, index: DataFrame) -> DataFrame:
    """``rest`` without the sections of a title, sentence or bullets of ``kept``."""
    left = rest.join(kept.select("company_id", "title").distinct(), ["company_id", "title"], "left_anti")
    said = kept.filter("sentence <> ''").select("company_id", "sentence").distinct()
    left = cut_lineage(left.join(said, ["company_id", "sentence"], "left_anti"))
    winners = index.join(kept, _BY_SECTION, "left_semi").select(
        "company_id", "bullet", F.col("section_no").alias("kept_no"), F.col("rare").alias("kept_rare"), F.col("small").alias("kept_small")
    )
    met = index.join(left, _BY_SECTION, "left_semi").join(winners, ["company_id", "bullet"]).filter(
        (F.col("rare") & F.col("kept_rare")) | F.col("small") | F.col("kept_small")
    ).select(*_BY_SECTION, "kept_no").distinct()
    theirs = kept.select("company_id", F.col("section_no").alias("kept_no"), F.col("bullets").alias("kept_bullets"))
    shared = F.size(F.array_intersect("bullets", "kept_bullets"))
    lost = met.join(left.select(*_BY_SECTION, "bullets"), _BY_SECTION).join(theirs, ["company_id", "kept_no"]).filter(
        shared >= F.least(F.lit(3), F.size("bullets"), F.size("kept_bullets"))
    ).select(*_BY_SECTION).distinct()
    return left.join(lost, _BY_SECTION, "left_anti")


def _without_earlier(left: DataFrame, index: DataFrame) -> DataFrame:
    """Sections that no earlier open one can be a rival of."""
    number = F.col("section_no")

    def later(key: str) -> DataFrame:
        firsts = left.groupBy("company_id", key).agg(F.min("section_no").alias("first"))
        used = left.filter(F.col(key) != "").select(*_BY_SECTION, key)
        return used.join(firsts, ["company_id", key]).filter(F.col("first") < number).select(*_BY_SECTION)

    entries = index.join(left, _BY_SECTION, "left_semi")
    firsts = entries.groupBy("company_id", "bullet").agg(
        F.min(F.when(F.col("rare"), number)).alias("first_rare"), F.min(F.when(F.col("small"), number)).alias("first_small"),
        F.min(number).alias("first"),
    )
    behind = entries.join(firsts, ["company_id", "bullet"]).filter(
        (F.col("rare") & (F.col("first_rare") < number)) | (F.col("first_small") < number) | (F.col("small") & (F.col("first") < number))
    ).select(*_BY_SECTION)
    blocked = later("title").unionByName(later("sentence")).unionByName(behind).distinct()
    return left.join(blocked, _BY_SECTION, "left_anti")


def unique_by_title(sections: DataFrame, threshold: float = 0.8, block: int = 256) -> DataFrame:
    """Sections of a title without near copies among the earlier kept ones.

    ``sections``: company_id, title, section_no, content. Two texts are near copies when over ``threshold`` of
    the first one's leading characters occur in the other. Only how often a lead has each character matters, so leads of
    the same characters are folded to their first. Then every round settles the ``block`` earliest open leads of each
    title, many titles in a batch, and the rest of longer ones meets the kept ones of the block as one row of its title.
    Runs jobs.
    """
    lead = F.replace(F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 200)), F.lit(" "), F.lit(""))
    leads = sections.select(*_BY_TITLE, "section_no", F.array_join(F.array_sort(F.split(lead, "")), "").alias("lead"))
    if threshold >= 1:  # nothing is a near copy
        return leads.select(*_BY_TITLE, "section_no")
    empty = leads.filter(F.col("lead") == "").select(*_BY_TITLE, "section_no")
    left = cut_lineage(
        leads.filter(F.col("lead") != "").groupBy(*_BY_TITLE, "lead").agg(F.min("section_no").alias("section_no"))
    )
    types = {c: left.schema[c].dataType.simpleString() for c in left.columns}
    schema = f"company_id {types['company_id']}, title string, done {types['section_no']}, more boolean, kept array<{types['section_no']}>, covers array<struct<has:string,size:int>>"
    choose = _uncovered(threshold, block, sections.sparkSession.createDataFrame([], schema).toArrow().schema)
    kept = [empty]
    while True:
        # One row for each title, of at most ``block`` leads; stored, so that a frequent title can be split in the join.
        earliest = first_places(left, _BY_TITLE, "section_no", block).groupBy(*_BY_TITLE).agg(
            F.array_sort(F.collect_list(F.struct("section_no", "lead"))).alias("leads")
        )
        settled = cut_lineage(earliest.select(*_BY_TITLE, "leads.section_no", "leads.lead").mapInArrow(choose, schema))
        kept.append(settled.select(*_BY_TITLE, F.explode("kept").alias("section_no")))
        covers = settled.filter("more").select(*_BY_TITLE, "done", "covers")
        if covers.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        signs = F.split("lead", "")
        covered = F.exists("covers", lambda k: F.size(F.filter(signs, lambda c: F.contains(k["has"], c))) > threshold * F.greatest(F.length("lead"), k["size"]))
        left = cut_lineage(
            left.join(covers, _BY_TITLE).filter((F.col("section_no") > F.col("done")) & ~covered).select(*_BY_TITLE, "lead", "section_no")
        )


_BY_TITLE = ["company_id", "title"]


def _uncovered(threshold: float, block: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Greedy choice over the leads of each title in order, many titles in a batch; ``more`` where a title may go on."""

    def choose(leads: list[str]) -> list[tuple[int, set[str], int]]:
        chosen: list[tuple[int, set[str], int]] = []
        for i, lead in enumerate(leads):
            counts = Counter(lead)
            if not any(sum(n for c, n in counts.items() if c in has) > threshold * max(len(lead), size) for _, has, size in chosen):
                chosen.append((i, set(counts), len(lead)))
        return chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, more, kept, covers = [], [], [], []
            for numbers, leads in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                last = len(leads) < block
                chosen = choose(leads) if len(leads) > 1 or not last else None
                done.append(numbers[-1])
                more.append(not last)
                kept.append(numbers if chosen is None else [numbers[i] for i, _, _ in chosen])
                covers.append([] if last else [{"has": "".join(has), "size": size} for _, has, size in chosen])
            rest = [pa.array(values, schema.field(i + 2).type) for i, values in enumerate((done, more, kept, covers))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), batch.column(1).cast(schema.field(1).type), *rest], schema=schema)

    return run


def chart_rows(charts: DataFrame) -> DataFrame:
    """Chart points as a long table; charts without points stay (charts: company_id, period, id, title, y_axis, ...)."""
    exact = F.when(F.coalesce("estimated", F.lit(True)), "Uppskattade värden").otherwise("Exakta värden")
    axis = F.when(F.coalesce("y_axis", F.lit("")) != "", F.col("y_axis"))
    flat = charts.select(
        "company_id", "period", "id", F.coalesce("title", F.lit("Graf")).alias("title"),
        F.concat_ws(" | ", "period", axis, exact).alias("caption"),
        F.posexplode_outer("data_points").alias("point_no", "point"),
    )
    return flat.select("*", F.coalesce("point.label", F.lit("")).alias("label"), "point.value").drop("point")


def latest_notes(notes: DataFrame) -> DataFrame:
    """Newest version of every note with the title it had first (notes: company_id, number, title, period_no, body)."""
    return notes.groupBy("company_id", "number").agg(
        F.min_by("title", "period_no").alias("title"), F.max_by("body", "period_no").alias("body"),
        F.max("period_no").alias("period_no"),
    )


def sheet_plan(
    periods: DataFrame, tables: DataFrame, financial: DataFrame, charts: DataFrame, texts: DataFrame,
    name_limit: int | None = None,
) -> DataFrame:
    """Sheets of every company's databook (company_id, block, spot, tie, sheet), in order of block, spot and tie.

    Number sheets by table type where the company has tables, else legacy statement sheets; then charts; then
    one text sheet per kept section (texts: company_id, section_no, title, page), first title wins a name clash. Tables
    of a type without a sheet of its own are on ``Övrigt``. Names
    are whole unless ``name_limit`` cuts them, as a spreadsheet does at 31 characters; a cut makes more names clash.
    Every source is reduced to flags per period in one pass; the flags of all sources meet in one aggregate.
    """
    kind = mapped_table_type(F.col("table_type"), F.col("title"))
    kinds = [k for k, _ in SHEET_ORDER]
    legacy = [k for k, _ in LEGACY_SHEETS]
    flags = ["has_tables", "has_charts", *kinds, *legacy]

    def flagged(df: DataFrame, found: dict[str, Column]) -> DataFrame:
        return df.groupBy("period_id").agg(*[
            F.max(F.coalesce(found[f], F.lit(False))).alias(f) if f in found else F.lit(False).alias(f) for f in flags
        ])

    typed = tables.select("period_id", kind.alias("kind"))
    sources = [
        flagged(typed, {"has_tables": F.lit(True), **{k: F.col("kind") == k for k in kinds}, "other": (F.col("kind") == "other") | ~F.col("kind").isin(kinds)}),
        flagged(charts, {"has_charts": F.lit(True)}),
        flagged(financial, {k: F.col("statement_type") == k for k in legacy}),
    ]
    owner = periods.select(F.col("id").alias("period_id"), "company_id")
    company = (
        reduce(DataFrame.unionByName, sources).join(owner, "period_id").groupBy("company_id")
        .agg(*[F.max(f).alias(f) for f in flags])
    )

    def sheet(when: Column, spot: int, name: str) -> Column:
        return F.when(when, F.struct(
            F.lit(0).alias("block"), F.lit(spot).cast("bigint").alias("spot"), F.lit(0).cast("bigint").alias("tie"),
            F.lit(name).alias("sheet"),
        ))

    modern = F.col("has_tables")
    # A company counts as legacy by its first two statements only.
    old = ~modern & (F.col(legacy[0]) | F.col(legacy[1]))
    planned = F.filter(F.array(
        sheet(modern, 0, NUMBERS_SEPARATOR),
        *[sheet(modern & F.col(k), i + 1, name) for i, (k, name) in enumerate(SHEET_ORDER)],
        sheet(modern & F.col("has_charts"), 100, CHART_SHEET),
        sheet(old, 0, LEGACY_SEPARATOR),
        *[sheet(old & F.col(k), i + 1, name) for i, (k, name) in enumerate(LEGACY_SHEETS)],
    ), lambda x: x.isNotNull())
    known = company.select("company_id", "has_tables", planned.alias("planned"))
    numbers = known.select("company_id", F.explode("planned").alias("s")).select("company_id", "s.*")

    cleaned = texts.withColumn("sheet", sheet_name(F.col("title"), name_limit))
    named = first_per_key(
        cleaned.select("company_id", "sheet", "page", "section_no"), ["company_id", "sheet"], ["page", "section_no"]
    ).join(known.filter("has_tables"), "company_id")
    free = ~F.array_contains(F.transform("planned", lambda s: s["sheet"]), F.col("sheet")) & (
        F.col("sheet") != TEXT_SEPARATOR
    )
    words = named.filter(free).select(
        "company_id", F.lit(1).alias("block"), F.col("page").cast("bigint").alias("spot"),
        F.col("section_no").cast("bigint").alias("tie"), "sheet",
    )
    heads = named.select("company_id").distinct().select(
        "company_id", F.lit(1).alias("block"), F.lit(-1).cast("bigint").alias("spot"), F.lit(0).cast("bigint").alias("tie"),
        F.lit(TEXT_SEPARATOR).alias("sheet"),
    )
    return numbers.unionByName(heads).unionByName(words)
