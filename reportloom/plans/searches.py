"""Search and knowledge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import knowledge, search
from reportloom.operators.search import Query
from reportloom.plans.catalog import query
from reportloom.plans.views import Views

_TEXTS = ["en", "tion of the", "ou", "que la ation", "zzz"]


def _queries(v: Views) -> list[Query]:
    """Five searches: the vectors of the first five entries, as a request would bring them."""
    rows = v["embeddings"].filter("vec_id < 5").select("vec_id", "embedding").orderBy("vec_id").collect()
    return [Query(r["vec_id"], _TEXTS[i % len(_TEXTS)], list(r["embedding"])) for i, r in enumerate(rows)]


_SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"""
SELECT query_id, id, place, round(similarity, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.id, {_SIM} AS similarity,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.id) AS INT) AS place
  FROM {{knowledge}} e JOIN {{embeddings}} q ON q.vec_id < 5) WHERE place <= 5""")
def search_knowledge(v: Views) -> DataFrame:
    hits = search.search_knowledge(v["knowledge"], _queries(v))
    return hits.select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT query_id, id, place, round(similarity, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.id, {_SIM} AS similarity,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.id) AS INT) AS place
  FROM {{knowledge}} e JOIN {{embeddings}} q ON q.vec_id < 5
  WHERE e.domain = 'bransch' AND e.category = 'c2') WHERE place <= 3""")
def search_knowledge_filtered(v: Views) -> DataFrame:
    hits = search.search_knowledge(v["knowledge"], _queries(v), 3, "bransch", "c2")
    return hits.select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT id, title FROM {knowledge} WHERE domain = 'redovisning' AND (title ILIKE '%entry%' OR content ILIKE '%entry%'
  OR title ILIKE '%7%' OR content ILIKE '%7%' OR title ILIKE '%zzz%' OR content ILIKE '%zzz%') ORDER BY id LIMIT 20""")
def search_knowledge_text(v: Views) -> DataFrame:
    """The first three terms."""
    hits = search.search_knowledge_text(v["knowledge"], "entry/7 zzz more", 20, "redovisning", max_terms=3)
    return hits.select("id", "title")


@query("""
SELECT id, title FROM {knowledge} WHERE title ILIKE '%zzz%' OR content ILIKE '%zzz%' OR title ILIKE '%17%' OR content ILIKE '%17%'
  OR title ILIKE '%xyz%' OR content ILIKE '%xyz%' OR title ILIKE '%48%' OR content ILIKE '%48%' ORDER BY id LIMIT 20""")
def search_knowledge_all_terms(v: Views) -> DataFrame:
    return search.search_knowledge_text(v["knowledge"], "zzz 17/xyz 48", 20).select("id", "title")


@query(f"""
SELECT query_id, id, place, round(similarity, 6) AS score FROM (
  SELECT q.vec_id AS query_id, e.id, {_SIM} AS similarity,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.id) AS INT) AS place
  FROM {{section_vectors}} e JOIN {{embeddings}} q ON q.vec_id < 5 WHERE e.embedding IS NOT NULL) WHERE place <= 10""")
def semantic_sections(v: Views) -> DataFrame:
    return search.vector_top_k(v["section_vectors"], _queries(v), 10).select(
        "query_id", "id", "place", F.round("score", 6).alias("score")
    )


_QUERY_WORDS = "CASE q.vec_id " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END"
_TEXT_SCORE = (
    f"len(list_filter(list_distinct(string_split({_QUERY_WORDS}, ' ')), lambda w: list_contains(e.words, w)))"
    f" / CAST(len(list_distinct(string_split({_QUERY_WORDS}, ' '))) AS DOUBLE)"
)


@query(f"""
SELECT query_id, id, place, round(score, 6) AS score FROM (
  SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM (
    SELECT q.vec_id AS query_id, e.id, 0.3 * ({_TEXT_SCORE}) + 0.7 * {_SIM} AS score
    FROM (SELECT id, embedding, string_split_regex(lower(content), '[^\\pL\\pN\\pM_]+') AS words
          FROM {{section_vectors}} WHERE embedding IS NOT NULL) e JOIN {{embeddings}} q ON q.vec_id < 5)) WHERE place <= 10
""")
def hybrid_sections(v: Views) -> DataFrame:
    return search.hybrid_top_k(v["section_vectors"], _queries(v), 10).select(
        "query_id", "id", "place", F.round("score", 6).alias("score")
    )


@query(f"""
SELECT query_id, id, place, md5(CASE WHEN pos = 0 THEN substring(content, 1, 200) || '...'
       ELSE '...' || substring(content, greatest(1, pos - 100), least(length(content), pos + length(term) + 99)
                                - greatest(1, pos - 100) + 1) || '...' END) AS excerpt
FROM (SELECT q.vec_id AS query_id, {_QUERY_WORDS} AS term, e.id, e.content, strpos(lower(e.content), {_QUERY_WORDS}) AS pos,
             CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY e.id) AS INT) AS place
      FROM {{sections}} e JOIN {{embeddings}} q ON q.vec_id < 5 AND e.content ILIKE '%' || {_QUERY_WORDS} || '%') WHERE place <= 10""")
def text_hits(v: Views) -> DataFrame:
    return search.text_hits(v["sections"], _queries(v)).select("query_id", "id", "place", F.md5("excerpt").alias("excerpt"))


@query(f"""
SELECT query_id, search_type, id, place, round(score, 3) AS score FROM (
  SELECT q.vec_id AS query_id, 'semantic' AS search_type, e.id, {_SIM} AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.id) AS INT) AS place
  FROM {{section_vectors}} e JOIN {{embeddings}} q ON q.vec_id IN (0, 1) WHERE e.embedding IS NOT NULL
  UNION ALL
  SELECT q.vec_id, 'text', e.id, NULL, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY e.id) AS INT)
  FROM {{section_vectors}} e JOIN {{embeddings}} q ON q.vec_id IN (2, 3, 4) AND e.content ILIKE '%' || {_QUERY_WORDS} || '%')
WHERE place <= 10""")
def search_sections(v: Views) -> DataFrame:
    """Two queries have a vector and stay with the semantic stage, the others fall through to text."""
    queries = [Query(q.query_id, q.text, q.vector if q.query_id < 2 else None) for q in _queries(v)]
    hits = search.search_sections(v["section_vectors"], queries, 10, use_hybrid=False)
    return hits.select("query_id", "search_type", "id", "place", "score")


@query(f"""
SELECT query_id, search_type, id, place, round(score, 3) AS score FROM (
  SELECT query_id, 'hybrid' AS search_type, id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM (
    SELECT q.vec_id AS query_id, e.id, 0.3 * ({_TEXT_SCORE}) + 0.7 * {_SIM} AS score
    FROM (SELECT id, embedding, string_split_regex(lower(content), '[^\\pL\\pN\\pM_]+') AS words
          FROM {{section_vectors}} WHERE embedding IS NOT NULL) e JOIN {{embeddings}} q ON q.vec_id < 5 AND q.vec_id <> 2)
  UNION ALL
  SELECT q.vec_id, 'text', e.id, NULL, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY e.id) AS INT)
  FROM {{section_vectors}} e JOIN {{embeddings}} q ON q.vec_id = 2 AND e.content ILIKE '%' || {_QUERY_WORDS} || '%')
WHERE place <= 10""")
def search_sections_hybrid(v: Views) -> DataFrame:
    """All stages: queries with a vector stay with the hybrid stage, the one without falls through to text."""
    queries = [Query(q.query_id, q.text, q.vector if q.query_id != 2 else None) for q in _queries(v)]
    return search.search_sections(v["section_vectors"], queries, 10).select("query_id", "search_type", "id", "place", "score")


_NEAR = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))"
_OWN = "(q.company_slug IS NULL OR q.company_slug = e.slug)"
_SHARED = (
    "len(list_filter(list_distinct(list_filter(string_split_regex(lower(q.words), '\\s+'), lambda w: w <> '')),"
    " lambda w: list_contains(e.tokens, w))) / CAST(greatest(1, len(list_distinct(list_filter("
    "string_split_regex(lower(q.words), '\\s+'), lambda w: w <> '')))) AS DOUBLE)"
)
_TOKENS = "(SELECT *, string_split_regex(lower(content), '[^\\pL\\pN\\pM_]+') AS tokens FROM {searchable_sections})"
_HELD = "e.content ILIKE '%' || q.term || '%' ESCAPE '\\'"
_SHOWN = (
    "CASE WHEN strpos(lower(e.content), lower(q.term)) = 0 THEN substring(e.content, 1, 200) || '...' ELSE '...' ||"
    " substring(e.content, greatest(1, strpos(lower(e.content), lower(q.term)) - 100),"
    " least(length(e.content), strpos(lower(e.content), lower(q.term)) + length(q.term) + 99)"
    " - greatest(1, strpos(lower(e.content), lower(q.term)) - 100) + 1) || '...' END"
)


def _searches(v: Views, text: str) -> DataFrame:
    """Every twentieth entry as a search of its own."""
    return v["searches"].select("query_id", F.col(text).alias("text"), "vector", "company_slug", "domain", "category")


@query(f"""
SELECT query_id, id, place, round(similarity, 6) AS similarity FROM (
  SELECT q.query_id, e.id, {_NEAR} AS similarity,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY {_NEAR} DESC, e.id) AS INT) AS place
  FROM {{knowledge}} e JOIN {{searches}} q ON q.vector IS NOT NULL AND (q.domain IS NULL OR q.domain = e.domain)
   AND (q.category IS NULL OR q.category = e.category)) WHERE place <= 5""")
def search_knowledge_table(v: Views) -> DataFrame:
    """Searches as a table, each with its own domain and category."""
    hits = search.search_knowledge(v["knowledge"], _searches(v, "words"), 5)
    return hits.select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT query_id, id, place, round(score, 6) AS score FROM (
  SELECT q.query_id, e.id, {_NEAR} AS score,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY {_NEAR} DESC, e.id) AS INT) AS place
  FROM {{searchable_sections}} e JOIN {{searches}} q ON {_OWN} AND e.embedding IS NOT NULL AND q.vector IS NOT NULL)
WHERE place <= 10""")
def semantic_sections_table(v: Views) -> DataFrame:
    hits = search.vector_top_k(v["searchable_sections"], _searches(v, "words"), 10)
    return hits.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(f"""
SELECT query_id, id, place, round(score, 6) AS score FROM (
  SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM (
    SELECT q.query_id, e.id, 0.3 * ({_SHARED}) + 0.7 * {_NEAR} AS score
    FROM {_TOKENS} e JOIN {{searches}} q ON {_OWN} AND e.embedding IS NOT NULL AND q.vector IS NOT NULL)) WHERE place <= 10""")
def hybrid_sections_table(v: Views) -> DataFrame:
    hits = search.hybrid_top_k(v["searchable_sections"], _searches(v, "words"), 10)
    return hits.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(f"""
SELECT query_id, id, place, md5(excerpt) AS excerpt FROM (
  SELECT q.query_id, e.id, {_SHOWN} AS excerpt,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY e.id) AS INT) AS place
  FROM {{searchable_sections}} e JOIN {{searches}} q ON {_OWN} AND {_HELD}) WHERE place <= 10""")
def text_hits_table(v: Views) -> DataFrame:
    hits = search.text_hits(v["searchable_sections"], _searches(v, "term"), 10)
    return hits.select("query_id", "id", "place", F.md5("excerpt").alias("excerpt"))


@query(f"""
SELECT query_id, id, title FROM (
  SELECT q.query_id, e.id, e.title, row_number() OVER (PARTITION BY q.query_id ORDER BY e.id) AS place
  FROM {{knowledge}} e JOIN (SELECT *, list_filter(string_split_regex(replace(entry_text, '/', ' '), '\\s+'), lambda w: w <> '') AS terms
                            FROM {{searches}}) q
    ON (q.domain IS NULL OR q.domain = e.domain) AND (q.category IS NULL OR q.category = e.category)
   AND len(list_filter(CASE WHEN len(q.terms) > 1 THEN q.terms ELSE [q.entry_text] END, lambda t:
        e.title ILIKE '%' || t || '%' ESCAPE '\\' OR e.content ILIKE '%' || t || '%' ESCAPE '\\')) > 0) WHERE place <= 20""")
def search_knowledge_texts(v: Views) -> DataFrame:
    hits = search.search_knowledge_texts(v["knowledge"], _searches(v, "entry_text"), 20)
    return hits.select("query_id", "id", "title")


@query(f"""
SELECT * FROM (WITH scored AS (
  SELECT q.query_id, e.id, e.content, 0.3 * ({_SHARED}) + 0.7 * {_NEAR} AS score
  FROM {_TOKENS} e JOIN (SELECT *, term AS words FROM (SELECT * EXCLUDE words FROM {{searches}})) q
    ON {_OWN} AND e.embedding IS NOT NULL AND q.vector IS NOT NULL
), texts AS (
  SELECT q.query_id, e.id, {_SHOWN} AS excerpt FROM {{searchable_sections}} e JOIN {{searches}} q ON {_OWN} AND {_HELD}
  WHERE q.query_id NOT IN (SELECT query_id FROM scored)
)
SELECT query_id, search_type, id, place, round(score, 3) AS score, md5(excerpt) AS excerpt FROM (
  SELECT query_id, 'hybrid' AS search_type, id, score, CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END AS excerpt,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM scored
  UNION ALL
  SELECT query_id, 'text', id, NULL, excerpt, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) FROM texts)
WHERE place <= 10)""")
def search_sections_table(v: Views) -> DataFrame:
    """The whole chain; searches without a vector go on to the texts."""
    hits = search.search_sections(v["searchable_sections"], _searches(v, "term"), 10)
    return hits.select("query_id", "search_type", "id", "place", "score", F.md5("excerpt").alias("excerpt"))


@query("""
SELECT id, length(title) + 2 + length(content) AS chars, (length(title) + 2 + length(content)) // 4 AS token_estimate
FROM {section_vectors} WHERE embedding IS NULL""")
def missing_vectors(v: Views) -> DataFrame:
    due = search.missing_vectors(v["section_vectors"])
    return due.select("id", F.length("text").cast("bigint").alias("chars"), "token_estimate")


@query("""
SELECT period_id, count(*) AS sections, count(*) FILTER (WHERE embedding IS NOT NULL OR id % 2 = 0) AS with_vector
FROM {section_vectors} GROUP BY period_id""")
def fill_vectors(v: Views) -> DataFrame:
    supplied = v["sections"].filter("id % 2 = 0").select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    filled = search.fill_vectors(v["section_vectors"], supplied)
    return filled.groupBy("period_id").agg(F.count("*").alias("sections"), F.count("embedding").alias("with_vector"))


def _tagged(v: Views) -> DataFrame:
    number = F.col("id")
    return v["knowledge"].withColumns({
        "tags": F.array("category", "domain", F.concat(F.lit("t"), (number % 3).cast("string"))),
        "related_metrics": F.array(F.concat(F.lit("m"), (number % 4).cast("string"))),
        "source": F.lit("x"),
    })


@query("SELECT id FROM {knowledge} WHERE category = 'c3' OR id % 3 = 1")
def with_any_tag(v: Views) -> DataFrame:
    return search.with_any_tag(_tagged(v), ["c3", "t1"]).select("id")


@query("SELECT id FROM {knowledge} WHERE id % 4 = 2")
def with_metric(v: Views) -> DataFrame:
    return search.with_metric(_tagged(v), "m2").select("id")


@query("""
SELECT id, CASE WHEN id % 3 = 0 THEN 'ny ' || id ELSE title END AS title, CASE WHEN id % 5 = 0 THEN 'bytt' ELSE category END AS category,
       embedding IS NOT NULL AND id % 3 <> 0 AS has_vector FROM {knowledge}""")
def update_knowledge(v: Views) -> DataFrame:
    entries = _tagged(v)
    number = F.col("id")
    none = F.lit(None).cast("string")
    patches = entries.filter("id % 3 = 0 OR id % 5 = 0").select(
        "id", F.when(number % 3 == 0, F.concat(F.lit("ny "), number.cast("string"))).alias("title"), none.alias("content"),
        F.when(number % 5 == 0, "bytt").alias("category"), F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("array<string>").alias("related_metrics"), none.alias("source"),
    )
    out = knowledge.update_entries(entries, patches)
    return out.select("id", "title", "category", F.col("embedding").isNotNull().alias("has_vector"))


@query("SELECT id FROM {knowledge} WHERE id % 10 <> 4")
def delete_knowledge(v: Views) -> DataFrame:
    gone = v["embeddings"].filter("vec_id % 10 = 4").select(F.col("vec_id").alias("id"))
    return knowledge.delete_entries(v["knowledge"], gone).select("id")


@query("SELECT doc_id AS id FROM {documents} WHERE doc_id NOT IN (SELECT id FROM {knowledge})")
def unknown_knowledge_ids(v: Views) -> DataFrame:
    return knowledge.unknown_ids(v["documents"].select(F.col("doc_id").alias("id")), v["knowledge"])


@query("""
SELECT id, domain IN ('nyckeltal', 'redovisning', 'bransch', 'värdering', 'kvalitativ') AS accepted FROM (
  SELECT vec_id AS id, CASE WHEN label % 3 = 0 THEN 'annat' WHEN label % 3 = 1 THEN 'bransch' ELSE 'värdering' END AS domain
  FROM {embeddings})""")
def knowledge_domains(v: Views) -> DataFrame:
    kind = F.col("label") % 3
    items = v["embeddings"].select(
        F.col("vec_id").alias("id"), F.when(kind == 0, "annat").when(kind == 1, "bransch").otherwise("värdering").alias("domain")
    )
    accepted, rejected = knowledge.split_by_domain(items)
    return accepted.select("id", F.lit(True).alias("accepted")).unionByName(rejected.select("id", F.lit(False).alias("accepted")))
