"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom import vocabulary as words
from reportloom.functions import naming, periods as period_functions
from reportloom.operators import lookup, normalise
from reportloom.plans.catalog import double, query
from reportloom.plans.views import Views


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(_quoted(x) for x in values) + "]"


def _sql_hits(text: str, values: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_quoted(w)}) AS INT)" for w in values) + ")"


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), (number % len(values)).cast("int"))


def _sql_pick(values: list[str], number: str) -> str:
    return f"{_sql_list(values)}[CAST({number} AS BIGINT) % {len(values)} + 1]"


@query("""
SELECT row_key, row_class, label_ok, canonical, count(*) AS n FROM (
  SELECT lower(label) AS row_key, CASE WHEN row_type = 'total' THEN 'total' ELSE 'data' END AS row_class,
         label <> 'row 1' AS label_ok, coalesce(s.canonical, lower(coalesce(label_en, ''))) AS canonical
  FROM {table_cells} LEFT JOIN {label_synonyms} s ON s.synonym = lower(coalesce(label_en, ''))) GROUP BY ALL""")
def normalise_labels(v: Views) -> DataFrame:
    rows = normalise.normalise_labels(lookup.table_rows(v["report_tables"]), v["label_synonyms"])
    return rows.groupBy("row_key", "row_class", "label_ok", "canonical").agg(F.count("*").alias("n"))


def _header_tables(v: Views) -> DataFrame:
    """One table per company and year whose first row holds period labels, some of them spoilt.

    Grouped by quarter of one company and year, so a list holds four values at most.
    """
    label = F.when((F.col("quarter") == 2) & (F.col("company_id") % 2 == 1), "andra").when(
        (F.col("quarter") == 3) & (F.col("company_id") % 3 == 1), "tredje"
    ).otherwise(F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), (F.col("year") + 25).cast("string")))
    listed = v["periods"].groupBy("company_id", "year").agg(
        F.array_sort(F.collect_list(F.struct("quarter", label.alias("x")))).alias("x")
    )
    values = F.transform("x", lambda s: s["x"])
    row = F.struct(F.lit("NOKm").alias("label"), values.alias("values"))
    second = F.struct(F.lit("Revenues").alias("label"), F.transform("x", lambda s: s["quarter"].cast("string")).alias("values"))
    return listed.select(
        (F.col("company_id") * 10000 + F.col("year")).alias("id"), F.col("company_id").alias("period_id"),
        F.array(F.lit("Income statement")).alias("columns"), F.array(row, second).alias("rows"),
    )


_FIRST_ROW = """
  SELECT company_id * 10000 + year AS id, company_id, quarter,
         CASE WHEN quarter = 2 AND company_id % 2 = 1 THEN 'andra' WHEN quarter = 3 AND company_id % 3 = 1 THEN 'tredje'
              ELSE 'Q' || quarter || ' ' || (year + 25) END AS header,
         CASE WHEN quarter = 2 AND company_id % 2 = 1 OR quarter = 3 AND company_id % 3 = 1 THEN 0 ELSE year + 25 END AS y
  FROM {periods}"""


@query(f"""
WITH h AS ({_FIRST_ROW}),
     p AS (SELECT id, count(*) FILTER (WHERE y > 0) >= least(3, count(*) // 2 + 1) AS promoted FROM h GROUP BY id)
SELECT id, promoted, CAST(0 AS INT) AS column_no, CASE WHEN promoted THEN 'NOKm' ELSE 'Income statement' END AS header,
       0 AS header_year, FALSE AS is_period, CAST(NULL AS INT) AS quarter, CAST(NULL AS INT) AS year FROM p
UNION ALL
SELECT h.id, TRUE, CAST(row_number() OVER (PARTITION BY h.id ORDER BY h.quarter) AS INT), h.header,
       CASE WHEN h.y BETWEEN 2020 AND 2039 THEN h.y ELSE 0 END, h.y > 0, CASE WHEN h.y > 0 THEN h.quarter END,
       CASE WHEN h.y > 0 THEN h.y END
FROM h JOIN p ON p.id = h.id WHERE p.promoted""".replace("WITH h AS", "SELECT * FROM (WITH h AS", 1) + ")")
def normalise_headers(v: Views) -> DataFrame:
    return normalise.normalise_headers(_header_tables(v)).drop("period_id")


@query("""
SELECT company_id, CAST(coalesce(max(CASE WHEN ok AND year + 25 BETWEEN 2020 AND 2039
       AND NOT (quarter = 2 AND company_id % 2 = 1 OR quarter = 3 AND company_id % 3 = 1) THEN year + 25 END), 2025) AS INT)
       AS current_year
FROM (SELECT *, count(*) FILTER (WHERE NOT (quarter = 2 AND company_id % 2 = 1 OR quarter = 3 AND company_id % 3 = 1))
                  OVER (PARTITION BY company_id, year) >= least(3, count(*) OVER (PARTITION BY company_id, year) // 2 + 1) AS ok
      FROM {periods}) GROUP BY company_id""")
def current_year(v: Views) -> DataFrame:
    headers = normalise.normalise_headers(_header_tables(v)).withColumnRenamed("period_id", "company_id")
    return normalise.current_year(headers)


# Titles put together from keywords of two types by the id, so that scores and ties occur.
_ALL_WORDS = [w for kind in words.TABLE_TYPE_KEYWORDS.values() for w in kind] + ["rubrik"]
_SCORES = {kind: _sql_hits("txt", ws) for kind, ws in words.TABLE_TYPE_KEYWORDS.items()}
_BEST = "greatest(" + ", ".join(_SCORES) + ")"
_TYPE_CASE = "CASE WHEN " + _BEST + " = 0 THEN 'other' " + " ".join(
    f"WHEN {kind} = {_BEST} THEN '{kind}'" for kind in _SCORES
) + " END"
_TITLE_SQL = f"upper({_sql_pick(_ALL_WORDS, 'o_orderkey')}) || ' / ' || {_sql_pick(_ALL_WORDS, 'o_orderkey // 7')}"


@query(f"""
SELECT id, mapped_type, {_TYPE_CASE} AS keyword_type FROM (
  SELECT id, mapped_type, {', '.join(f'{sql} AS {kind}' for kind, sql in _SCORES.items())} FROM (
    SELECT o_orderkey AS id, lower({_TITLE_SQL} || ' 2024 ' || {_sql_pick(_ALL_WORDS, 'o_orderkey // 3')}) AS txt,
           CASE WHEN o_orderstatus <> 'F' THEN 'note'
                WHEN contains(lower(title), 'resultat') OR contains(lower(title), 'income') THEN 'income_statement'
                WHEN contains(lower(title), 'balans') OR contains(lower(title), 'ställning') OR contains(lower(title), 'balance')
                  THEN 'balance_sheet'
                WHEN contains(lower(title), 'kassaflöde') OR contains(lower(title), 'cash') THEN 'cash_flow'
                WHEN contains(lower(title), 'nyckeltal') OR contains(lower(title), 'kpi') THEN 'kpi'
                WHEN contains(lower(title), 'segment') THEN 'segment' ELSE 'other' END AS mapped_type
    FROM (SELECT *, {_TITLE_SQL} AS title FROM {{orders}})))""")
def type_tables(v: Views) -> DataFrame:
    number = F.col("o_orderkey")
    title = F.concat(F.upper(_pick(_ALL_WORDS, number)), F.lit(" / "), _pick(_ALL_WORDS, F.floor(number / 7)))
    tables = v["orders"].select(
        number.alias("id"), title.alias("title"), F.array(F.lit("2024"), F.lit(None).cast("string")).alias("columns"),
        F.when(F.col("o_orderstatus") == "F", "quarterly").otherwise("note").alias("table_type"),
        F.array(F.struct(_pick(_ALL_WORDS, F.floor(number / 3)).alias("label"))).alias("rows"),
    )
    return normalise.type_tables(tables).select("id", "mapped_type", "keyword_type")


_SECTION_WORDS = [w for kind in words.SECTION_TYPE_KEYWORDS.values() for w in kind] + ["rubrik"] * 9
_SECTION_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(txt, {_quoted(w)})" for w in ws) + f" THEN '{kind}'"
    for kind, ws in words.SECTION_TYPE_KEYWORDS.items()
) + " ELSE 'other' END"


@query(f"""
SELECT id, {_SECTION_CASE} AS keyword_type FROM (
  SELECT id, lower({_sql_pick(_SECTION_WORDS, 'id')} || ' ' || substring(content, 1, 500)) AS txt FROM {{sections}})""")
def type_sections(v: Views) -> DataFrame:
    titled = v["sections"].withColumn("title", _pick(_SECTION_WORDS, F.col("id")))
    return normalise.type_sections(titled).select("id", "keyword_type")


@query("""
SELECT period_id, statement_type, row_order, CASE form WHEN 1 THEN -v WHEN 2 THEN -v WHEN 3 THEN NULL WHEN 4 THEN NULL
       WHEN 7 THEN NULL ELSE v END AS value,
       CASE form WHEN 3 THEN 'empty' WHEN 4 THEN 'empty' WHEN 7 THEN 'unreadable' END AS reject_reason
FROM (SELECT period_id, statement_type, row_order, CAST(value AS DOUBLE) AS v,
             (period_id + row_order + CASE statement_type WHEN 'balansrakning' THEN 1 ELSE 0 END) % 8 AS form
      FROM {financial_data})""")
def parse_cells(v: Views) -> DataFrame:
    """Statement values written in the styles of three languages and read back."""
    data = v["financial_data"]
    form = (F.col("period_id") + F.col("row_order") + F.when(F.col("statement_type") == "balansrakning", 1).otherwise(0)) % 8
    language = F.when(F.col("company_id") % 3 == 0, "sv").when(F.col("company_id") % 3 == 1, "no").otherwise("en")
    digits = F.col("value").cast("string")
    grouped = F.regexp_replace(digits, r"([0-9])(?=([0-9]{3})+\.)", F.when(language == "en", "$1,").otherwise("$1 "))
    written = F.when(language == "en", grouped).otherwise(F.replace(grouped, F.lit("."), F.lit(",")))
    cell = (
        F.when(form == 1, F.concat(F.lit("("), written, F.lit(")"))).when(form == 2, F.concat(written, F.lit("-")))
        .when(form == 3, "–").when(form == 4, "N/A").when(form == 5, F.concat(written, F.lit("%")))
        .when(form == 7, F.concat(written, F.lit("x"))).otherwise(written)
    )
    rows = data.select(
        "period_id", F.col("statement_type").alias("table_id"), F.col("row_order").alias("row_no"),
        F.col("row_name").alias("label"), language.alias("language"), F.array(F.lit("MSEK"), F.lit("Q1 2024")).alias("columns"),
        F.array(F.lit(None).cast("string"), cell).alias("values"),
    )
    return normalise.parse_cells(rows).select(
        "period_id", F.col("table_id").alias("statement_type"), F.col("row_no").alias("row_order"), double("value"), "reject_reason"
    )


_LANGUAGE_WORDS = words.SWEDISH_WORDS + words.NORWEGIAN_WORDS + words.ENGLISH_WORDS + ["rapport"] * 11
_LANGUAGE_SQL = f"""
  SELECT id, CASE WHEN strong >= 2 OR en > greatest(sv, no) THEN 'en'
                  WHEN (sv > 0 OR no > 0) AND (only_no > only_sv OR (only_no = only_sv AND no > sv)) THEN 'no' ELSE 'sv' END
           AS language
  FROM (SELECT id, {', '.join(f"{_sql_hits('txt', ws)} AS {name}" for name, ws in (
      ('sv', words.SWEDISH_WORDS), ('no', words.NORWEGIAN_WORDS), ('en', words.ENGLISH_WORDS),
      ('strong', words.STRONG_ENGLISH_WORDS), ('only_no', words.ONLY_NORWEGIAN_WORDS), ('only_sv', words.ONLY_SWEDISH_WORDS)))}
        FROM (SELECT doc_id AS id, lower({_sql_pick(_LANGUAGE_WORDS, 'doc_id')} || ' ' || {_sql_pick(_LANGUAGE_WORDS, 'doc_id // 5')}
                     || ' ' || {_sql_pick(_LANGUAGE_WORDS, 'doc_id * 3')} || ' ' || text) AS txt FROM {{documents}}))"""


@query(f"SELECT id, language FROM ({_LANGUAGE_SQL})")
def report_language(v: Views) -> DataFrame:
    """Language of whole texts behind three words picked by the id."""
    number = F.col("doc_id")
    text = F.concat_ws(
        " ", _pick(_LANGUAGE_WORDS, number), _pick(_LANGUAGE_WORDS, F.floor(number / 5)), _pick(_LANGUAGE_WORDS, number * 3), "text"
    )
    return v["documents"].select(number.alias("id"), naming.language(text).alias("language"))


@query("""
SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'åhl-' ELSE 'a-b-' END || c_custkey
       AS name_slug
FROM {customer}""")
def company_slugs(v: Views) -> DataFrame:
    made = F.when(F.col("c_custkey") % 2 == 0, F.lit(" Åhl & ")).otherwise(F.lit("A__b -"))
    return v["customer"].select(
        F.col("c_custkey").alias("id"), naming.slug(F.col("c_name")).alias("slug"),
        naming.slug(F.concat(made, F.col("c_custkey").cast("string"))).alias("name_slug"),
    )


FILE_PLAN = """
SELECT folder, name, CASE form WHEN 0 THEN 'keep' WHEN 1 THEN CASE WHEN year < 2000 THEN 'failed' ELSE 'rename' END
                     WHEN 2 THEN CASE WHEN year < 2000 THEN 'failed' ELSE 'collision' END ELSE 'failed' END AS action,
       CASE WHEN form IN (1, 2) AND year >= 2000 THEN 'bolag-' || company_id || '-' || year || '-q' || quarter || '-sv.pdf' END AS new_name
FROM (SELECT company_id AS folder, company_id, year, quarter, form,
             CASE form WHEN 0 THEN 'bolag-' || company_id || '-' || year || '-q' || quarter || '-en.pdf'
                       WHEN 1 THEN 'Bolag ' || company_id || '_' || year || ' Q' || quarter || '.pdf'
                       WHEN 2 THEN 'Bolag ' || company_id || '-q' || quarter || '-' || year || s.s || '.pdf'
                       ELSE '0' || id || '.pdf' END AS name
      FROM (SELECT *, (id + company_id) % 4 AS form FROM {periods}) p
      JOIN (VALUES (''), (' copy')) s(s) ON p.form = 2 OR s.s = '') WHERE form <> 0
UNION ALL
SELECT company_id, 'bolag-' || company_id || '-' || year || '-q' || quarter || '-en.pdf', 'keep', NULL
FROM {periods} WHERE (id + company_id) % 4 = 0"""


def report_files(v: Views) -> DataFrame:
    """Report files of four naming styles; the third has a copy, so it collides."""
    form = (F.col("id") + F.col("company_id")) % 4
    c, y, q = (F.col(n).cast("string") for n in ("company_id", "year", "quarter"))
    name = (
        F.when(form == 0, F.concat(F.lit("bolag-"), c, F.lit("-"), y, F.lit("-q"), q, F.lit("-en.pdf")))
        .when(form == 1, F.concat(F.lit("Bolag "), c, F.lit("_"), y, F.lit(" Q"), q, F.lit(".pdf")))
        .when(form == 2, F.concat(F.lit("Bolag "), c, F.lit("-q"), q, F.lit("-"), y, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("0"), F.col("id").cast("string"), F.lit(".pdf")))
    )
    files = v["periods"].select(F.col("company_id").alias("folder"), name.alias("name"), F.lit("").alias("text"), form.alias("form"))
    copies = files.filter("form = 2").withColumn("name", F.regexp_replace("name", r"\.pdf$", " copy.pdf"))
    return files.unionByName(copies).drop("form")


@query(FILE_PLAN)
def file_plan(v: Views) -> DataFrame:
    """Rename plan of the report files."""
    return normalise.file_plan(report_files(v)).select("folder", "name", "action", "new_name")


@query("""
SELECT id, kind, count(*) AS n FROM (
  SELECT id, CASE WHEN regexp_matches(line, '^[•*–-] ') OR (length(line) > 2 AND regexp_matches(line, '^[0-9][.):]')) THEN 'bullet'
                  WHEN length(line) <= 50 AND len(string_split_regex(line, '\\s+')) <= 6 AND NOT regexp_matches(line, '[.,]$')
                  THEN 'subheader' ELSE 'text' END AS kind
  FROM (SELECT id, regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM {sections})
  WHERE line <> '') GROUP BY id, kind""")
def text_lines(v: Views) -> DataFrame:
    return normalise.text_lines(v["sections"]).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT id, md5(CASE WHEN pos = 0 THEN substring(content, 1, 200) || '...'
                    ELSE '...' || substring(content, greatest(1, pos - 100), least(length(content), pos + 103)
                                            - greatest(1, pos - 100) + 1) || '...' END) AS excerpt
FROM (SELECT id, content, strpos(lower(content), 'tion') AS pos FROM {sections})""")
def excerpts(v: Views) -> DataFrame:
    return normalise.excerpts(v["sections"], "TION").select("id", F.md5("excerpt").alias("excerpt"))


@query("""
SELECT id, quarter, year, quarter AS file_quarter, year AS file_year FROM {periods}""")
def file_periods(v: Views) -> DataFrame:
    """Periods read back from labels and from stored file names."""
    label = period_functions.period_label(F.col("quarter"), F.col("year"))
    stored = v["periods"].select("id", label.alias("label"), period_functions.file_period(F.col("source_file")).alias("p"))
    return stored.select(
        "id", period_functions.label_quarter(F.col("label")).alias("quarter"), period_functions.label_year(F.col("label")).alias("year"),
        F.col("p.quarter").alias("file_quarter"), F.col("p.year").alias("file_year"),
    )
