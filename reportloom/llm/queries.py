"""The queries of the operators and their SQL twins, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.llm import (
    bpe, compression, exact_dedup, html_text, importance, language_id, mixing, near_dedup, quality, sharding, url_filter,
    vector_search, whitening,
)
from reportloom.llm.common import read

SHARDS = 40
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read(spark, folder, "documents"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.tokenize(read(spark, folder, "documents"), tokenizer_path())


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


def op4_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_inner_products(read(spark, folder, "embeddings"), every=50, k=5, scale=256)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows a language may be learned from: crc32 of the id as text is not 2 modulo 4."""
    return docs.filter(~held_out())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    parsers = language_id.fit(learnable(docs))
    return language_id.predict(docs, parsers).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.into_shards(read(spark, folder, "documents"), SHARDS, seed=7).select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents"), percent=85)


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages"), url_filter.rules_table(spark, URL_RULES)).drop("component")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read(spark, folder, "documents"), power=0.5, seed=10).select(
        "doc_id", "source", "copy", "copies", "order_key", "text"
    )


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return compression.judge(read(spark, folder, "documents"))


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(
        read(spark, folder, "documents"), read(spark, folder, "benchmark"), percent=10, max_run=1, buckets=10_000
    ).drop("n_words")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"), components=4, scale=256)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_html": op3_html,
    "op4_vector_search": op4_vector_search,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op4_vector_search": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS z FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.z) = len(c.z)
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_url_filter": r"""
        WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        tags AS (
            SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
                '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'
        ), links AS (
            SELECT DISTINCT url, replace(target, '&amp;', '&') AS target FROM (
                SELECT url, regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM tags
                WHERE regexp_matches(tag, '(?is)^<link\b[^>]*\srel\s*=\s*(?:canonical\b|["''][^"'']*\bcanonical\b)')
                UNION ALL
                SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags
                WHERE regexp_matches(tag, '(?is)^<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b')
            ) WHERE contains(target, '://')
        ), urls AS (
            SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT url FROM pages WHERE url LIKE '%://%' UNION SELECT target FROM links)
        ), nodes AS (
            SELECT u.*, CASE WHEN u.host <> '' THEN regexp_replace(u.host, '^www\.', '') || regexp_replace(u.path, '/$', '')
                     || regexp_extract(u.url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) END AS address,
                   (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path))
                    FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS best
            FROM urls u
        ), edges AS (
            SELECT a.address AS a, b.address AS b FROM links l JOIN nodes a ON a.url = l.url JOIN nodes b ON b.url = l.target
        ), reach AS (
            SELECT DISTINCT address AS a, address AS b FROM nodes WHERE address IS NOT NULL
            UNION
            SELECT r.a, CASE WHEN e.a = r.b THEN e.b ELSE e.a END FROM reach r JOIN edges e ON r.b IN (e.a, e.b)
        ), blocked AS (
            SELECT DISTINCT r.a FROM reach r JOIN nodes n ON n.address = r.b WHERE n.best.verdict = 'block'
        )
        SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.best.rule AS rule,
               CASE WHEN n.best.verdict IS NOT NULL THEN n.best.verdict
                    WHEN n.address IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
        FROM pages p LEFT JOIN nodes n ON n.url = p.url""",
    "op10_mixing": """
        WITH sizes AS (
            SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
        ), rates AS (
            SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size AS rate FROM sizes
        ), means AS (
            SELECT source, greatest(1, ceil(rate / 16.0))::BIGINT AS draws, rate / greatest(1, ceil(rate / 16.0)) AS mean
            FROM rates
        ), below AS (
            SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
            FROM means, range(0, 100) t(k) WHERE mean > 0
        ), draws AS (
            SELECT d.doc_id, d.source, d.text, draw,
                   ('0x' || substr(md5('10|' || d.doc_id || '|' || draw), 1, 13))::UBIGINT / 4503599627370496.0 AS u
            FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, range(1, m.draws + 1) t(draw)
        ), counts AS (
            SELECT doc_id, draws.source, text, sum((SELECT count(*) FROM below b
                WHERE b.source IS NOT DISTINCT FROM draws.source AND b.below <= u))::BIGINT AS copies
            FROM draws GROUP BY doc_id, draws.source, text
        )
        SELECT doc_id, source, copy, copies, md5('order 10|' || doc_id || '|' || copy) AS order_key, text
        FROM counts, range(1, copies + 1) t(copy)""",
    "op12_importance": r"""
        WITH table_of_bytes AS (
            SELECT list(list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
            FROM (SELECT unnest(range(0, 256))::BIGINT AS b)
        ), texts AS (
            SELECT 0 AS side, row_number() OVER () AS n, doc_id, text FROM documents
            UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
        ), words AS (
            SELECT side, n, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
        ), counted AS (
            SELECT side, n, word, count(*) AS times FROM words GROUP BY ALL
        ), hashed AS (
            SELECT word, xor(list_reduce(
                [4294967295::BIGINT] || [('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT FOR i IN range(0, octet_length(encode(word)))],
                lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM counted), table_of_bytes
        ), buckets AS (
            SELECT bucket, coalesce(sum(times) FILTER (WHERE side = 0), 0)::DOUBLE AS s,
                   coalesce(sum(times) FILTER (WHERE side = 1), 0)::DOUBLE AS t
            FROM counted JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)
                                           / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets
        ), weighed AS (
            SELECT n, sum(times)::BIGINT AS n_features, floor(sum(times * gain)::DOUBLE / sum(times))::BIGINT AS weight
            FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY n
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM texts LEFT JOIN weighed USING (n) WHERE side = 0
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                     count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM scored)""",
}
