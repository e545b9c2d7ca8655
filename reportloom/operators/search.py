"""Search over sections and knowledge for a table of queries: vector, text, hybrid, and the chain of them.

Rows and queries meet as blocks of a matrix product, in which every task keeps the best rows of each query. The queries
travel with the tasks while they are few; a larger table is cut into blocks that meet parts of the rows by a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.text import cut, excerpt
from reportloom.operators.text_search import first_matches
from reportloom.session import cut_lineage

Vector = Sequence[float]

_CELLS = 1 << 20  # scores computed at once, 4 MB and as much for each step between
_TILE = 512  # queries of them
_SPARSE = 256  # a word that a larger part of the pairs share is counted by a product
_QUERY_BYTES = 1 << 25  # queries that travel with the tasks
_ROW_BYTES = 1 << 26  # rows that one task holds against a block of queries
_SENT = 1 << 22  # rows that the tasks of a scoring pass may send together
_WAVES = 4  # tasks a core that a scoring pass has in any case
_HITS = 1 << 20  # hits whose ids travel to the sections, 8 MB


@dataclass(frozen=True)
class Query:
    """One search: text, optionally its vector, optionally one company."""

    query_id: int
    text: str = ""
    vector: Vector | None = None
    company_slug: str | None = None


def query_table(rows: DataFrame, queries: list[Query] | DataFrame) -> DataFrame:
    """Queries as a table (query_id, text, vector, company_slug); one that is given as a table stays as it is."""
    if isinstance(queries, DataFrame):
        return queries
    values = [(q.query_id, q.text, None if q.vector is None else [float(x) for x in q.vector], q.company_slug) for q in queries]
    return rows.sparkSession.createDataFrame(values, "query_id bigint, text string, vector array<double>, company_slug string")


def _words(content: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(content, F.lit(""))), r"(?U)[^\w]+"))


def _wanted_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of each length; a zero vector, one with a null or no finite component is left out."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        unit = _unit_rows(_matrix(vectors.take(pa.array(at))))
        finite = np.isfinite(unit).all(axis=1)
        found[int(n)] = (at, unit) if finite.all() else (at[finite], unit[finite])
    return found


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _longest(unit: np.ndarray) -> float:
    """At least 1: unit vectors of very small numbers may be longer."""
    return max(1.0, float(np.sqrt((unit * unit).sum(axis=1).max(initial=0))))


class _Best:
    """The best ``k`` rows of each query so far: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = max(1, k)
        self._scores, self._ids = np.empty((queries, 0)), np.empty((queries, 0), dtype=object)

    def floor(self, queries: np.ndarray) -> np.ndarray:
        """The score that a row needs at least."""
        return self._scores[queries, -1] if self._scores.shape[1] == self.k else np.full(len(queries), -np.inf)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs of a query and a row; what is not a finite number is no hit. Only the queries of these pairs are sorted anew."""
        floor = self.floor(queries)
        hit = np.isfinite(scores) & (scores >= floor)
        level = np.flatnonzero(hit & (scores == floor))
        hit[level] = ids[level] < self._ids[queries[level], -1] if len(level) else False
        if not hit.any():
            return
        touched, at = np.unique(queries[hit], return_inverse=True)
        if ids.dtype != self._ids.dtype:
            self._ids = self._ids.astype(object if self._ids.shape[1] else ids.dtype)
        old = self._scores[touched]
        held = np.isfinite(old)
        query = np.concatenate([np.nonzero(held)[0], at])
        score = np.concatenate([old[held], scores[hit]])
        ids = np.concatenate([self._ids[touched][held], ids[hit]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        start = np.append(True, query[1:] != query[:-1])
        place = np.arange(len(query)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        stays = place < self.k
        query, score, ids, place = query[stays], score[stays], ids[stays], place[stays]
        more = int(place.max()) + 1 - self._scores.shape[1]
        if more > 0:
            self._scores = np.pad(self._scores, ((0, 0), (0, more)), constant_values=-np.inf)
            self._ids = np.pad(self._ids, ((0, 0), (0, more)))
        self._scores[touched] = -np.inf
        self._scores[touched[query], place] = score
        self._ids[touched[query], place] = ids

    @property
    def query(self) -> np.ndarray:
        return np.nonzero(np.isfinite(self._scores))[0]

    @property
    def score(self) -> np.ndarray:
        return self._scores[np.isfinite(self._scores)]

    @property
    def id(self) -> np.ndarray:
        return self._ids[np.isfinite(self._scores)]


class _Words:
    """Which of some owners hold which words, word by word."""

    def __init__(self, code: np.ndarray, owner: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        self.owner = owner[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.bounds = np.append(first, len(code))

    def shared(self, rows: _Words, height: int, width: int) -> np.ndarray | None:
        """How many words each of ``height`` owners shares with each of ``width`` rows; None where nobody shares any.

        Words of many pairs are a product of two matrices of zeros and ones, of the others each pair is counted on its own.
        """
        if not len(self.codes) or not len(rows.codes):
            return None
        mine, theirs = _both(rows.codes, self.codes)[1], _both(self.codes, rows.codes)[1]
        if not len(mine):
            return None
        at, own = self.bounds[mine], self.bounds[mine + 1] - self.bounds[mine]
        row_at, held = rows.bounds[theirs], rows.bounds[theirs + 1] - rows.bounds[theirs]
        many = own * held * _SPARSE > height * width
        number = int(many.sum())
        if number:
            left, right = np.zeros((height, number), dtype=np.float32), np.zeros((number, width), dtype=np.float32)
            left[self.owner[_spans(at[many], own[many])], np.repeat(np.arange(number), own[many])] = 1
            right[np.repeat(np.arange(number), held[many]), rows.owner[_spans(row_at[many], held[many])]] = 1
            counts = left @ right
        else:
            counts = np.zeros((height, width), dtype=np.float32)
        at, own, row_at, held = at[~many], own[~many], row_at[~many], held[~many]
        ends, first = np.cumsum(own * held), 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CELLS, "right")))
            part = slice(first, last)
            sizes = np.repeat(held[part], own[part])
            owner = np.repeat(self.owner[_spans(at[part], own[part])], sizes)
            row = rows.owner[_spans(np.repeat(row_at[part], own[part]), sizes)]
            np.add.at(counts.reshape(-1), owner * width + row, np.float32(1))
            first = last
        return counts


class _Part:
    """Some queries under the same filters, with vectors of one length."""

    def __init__(self, at: np.ndarray, unit: np.ndarray, weight: float, words: _Words | None) -> None:
        self.at, self.unit, self.words = at, unit, words
        self.single, self.longest = (unit * weight).astype(np.float32), _longest(unit)


class _Queries:
    """A block of queries, prepared for blocks of rows."""

    def __init__(self, table: pa.Table, filters: list[str], weights: tuple[float, float] | None) -> None:
        table = table.combine_chunks()
        columns = {name: table[name].combine_chunks() for name in table.column_names}
        self.ids, self.filters, self.weights = columns["query_id"], filters, weights
        groups: dict[tuple[int, ...], dict[tuple, list[int]]] = {}
        given = list(zip(*[columns[f].to_pylist() for f in filters])) if filters else [()] * len(table)
        for i, values in enumerate(given):
            pattern = tuple(j for j, v in enumerate(values) if v is not None)
            groups.setdefault(pattern, {}).setdefault(tuple(values[j] for j in pattern), []).append(i)
        if weights is not None:
            words = columns["words"]
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            self.counts = np.maximum(1, sizes)
            flat = words.flatten().dictionary_encode()
            self.vocabulary, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
        self.groups: dict[tuple[int, ...], dict[tuple, dict[int, list[_Part]]]] = {}
        vectors = _by_length(columns["vector"])
        for pattern, by_key in groups.items():
            for key, own in by_key.items():
                parts = self.groups.setdefault(pattern, {}).setdefault(key, {})
                for n, (with_vector, unit) in vectors.items():
                    at, spot = _both(np.array(own), with_vector)
                    for start in range(0, len(at), _TILE):
                        some, held = at[start : start + _TILE], None
                        if weights is not None:
                            held = _Words(codes[_spans(first[some], sizes[some])], np.repeat(np.arange(len(some)), sizes[some]))
                        part = _Part(some, unit[spot[start : start + _TILE]], weights[1] if weights else 1.0, held)
                        parts.setdefault(n, []).append(part)

    def __len__(self) -> int:
        return len(self.ids)

    def meet(self, batch: pa.RecordBatch | pa.Table, best: _Best) -> None:
        """Scores of all rows of a batch (id, v, words, filters) go into ``best``, a block of rows at a time."""
        height = max(1, _CELLS // max(1, min(_TILE, len(self))))
        for start in range(0, batch.num_rows, height):
            part = batch.slice(start, height)
            columns = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in zip(part.schema.names, part.columns)}
            ids = columns["id"]
            if pa.types.is_integer(ids.type) and not ids.null_count:
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                ids = np.array([*ids.to_pylist(), None], dtype=object)[:-1]
            if self.weights is not None:
                sizes = columns["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                code = pc.index_in(columns["words"].flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                first = np.cumsum(sizes) - sizes
            rows_of = _by_length(columns["v"])
            given = [columns[f].to_pylist() for f in self.filters]
            for pattern, by_key in self.groups.items():
                for key, rows in _grouped(given, pattern, by_key, len(ids)):
                    for n, (at, unit) in rows_of.items():
                        r, spot = (at, slice(None)) if rows is None else _both(rows, at)
                        parts = by_key[key].get(n, [])
                        if not len(r) or not parts:
                            continue
                        held = None
                        if self.weights is not None:
                            own = code[_spans(first[r], sizes[r])].astype(np.int64)
                            held = _Words(own[own >= 0], np.repeat(np.arange(len(r)), sizes[r])[own >= 0])
                        self._score(parts, unit[spot], held, ids[r], best)

    def _score(self, parts: list[_Part], unit: np.ndarray, held: _Words | None, ids: np.ndarray, best: _Best) -> None:
        """Single precision finds the pairs that may be among the best, with room for its errors; these are scored in double.

        A pair's score is a sum over its own two vectors, so equal vectors score the same wherever they stand.
        """
        text, cosine = self.weights or (0.0, 1.0)
        (rows, n), single, longest = unit.shape, unit.astype(np.float32), _longest(unit)
        for part in parts:
            near = part.single @ single.T
            shared = part.words.shared(held, len(part.at), rows) if held is not None else None
            if shared is not None:
                near += shared * (text / self.counts[part.at]).astype(np.float32)[:, None]
            # Twice the bound of rounding in a sum of n products, which is n / 2 ulps of the lengths.
            room = (n + 16) * 2.0**-23 * (abs(cosine) * part.longest * longest + abs(text))
            floor = best.floor(part.at)
            low = (floor - room).astype(np.float32)
            open_ = np.flatnonzero(np.isneginf(floor))
            if len(open_) and rows > best.k:
                low[open_] = np.partition(near[open_], rows - best.k, axis=1)[:, rows - best.k] - np.float32(2 * room)
            pairs = np.flatnonzero(near >= low[:, None])
            q, r = np.divmod(pairs, rows)
            scores, step = np.empty(len(pairs)), max(1, _CELLS // n)
            for start in range(0, len(pairs), step):
                some = slice(start, start + step)
                scores[some] = (part.unit[q[some]] * unit[r[some]]).sum(axis=1)
            if self.weights is not None:
                common = 0 if shared is None else shared.reshape(-1)[pairs].astype(np.float64)
                scores = text * (common / self.counts[part.at[q]]) + cosine * scores
            best.add(part.at[q], ids[r], scores)

    def result(self, best: _Best, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(best.query)), pa.array(best.id.tolist(), schema.field("id").type), pa.array(best.score)],
            schema=schema,
        )


def _both(wanted: np.ndarray, sorted_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``wanted`` that occur in ``sorted_at``, and where."""
    if not len(sorted_at):
        return wanted[:0], np.empty(0, dtype=np.int64)
    spot = np.minimum(np.searchsorted(sorted_at, wanted), len(sorted_at) - 1)
    found = sorted_at[spot] == wanted
    return wanted[found], spot[found]


def _grouped(
    given: list[list], pattern: tuple[int, ...], by_key: dict[tuple, np.ndarray], rows: int
) -> Iterator[tuple[tuple, np.ndarray | None]]:
    """Each wanted key that occurs in the rows, and its rows; the empty pattern takes all."""
    if not pattern:
        yield (), None
        return
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[given[j] for j in pattern])):
        if key in by_key:
            found.setdefault(key, []).append(i)
    for key, at in found.items():
        yield key, np.array(at)


def _scores(
    rows: DataFrame, queries: DataFrame, k: int, vector: str, filters: dict[str, str], weights: tuple[float, float] | None,
    query_bytes: int, row_bytes: int,
) -> DataFrame:
    """``query_id``, ``id``, ``score`` of rows that a task finds among the best ``k`` of a query."""
    names = [f"f{i}" for i in range(len(filters))]
    asked = queries.filter(F.col("vector").isNotNull()).select(
        "query_id", F.col("vector").cast("array<double>").alias("vector"),
        *[F.col(column).cast("string").alias(n) for n, column in zip(names, filters)],
        *([_wanted_words(F.col("text")).alias("words")] if weights else []),
    )
    usable = rows.filter(F.col(vector).isNotNull()).select(
        "id", F.col(vector).alias("v"), *[F.col(column).cast("string").alias(n) for n, column in zip(names, filters.values())],
        *([_words(F.col("content")).alias("words")] if weights else []),
    )
    id_type, query_type = usable.schema["id"].dataType, asked.schema["query_id"].dataType
    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def best_of(block: _Queries, parts: Iterator[pa.RecordBatch | pa.Table]) -> pa.RecordBatch:
        best = _Best(len(block), k)
        for part in parts:
            block.meet(part, best)
        return block.result(best, arrow)

    text_bytes = F.octet_length(F.coalesce("text", F.lit(""))) if weights else F.lit(0)
    total = queries.filter(F.col("vector").isNotNull()).agg(
        F.sum(F.size("vector") * 8 + 64 + 2 * text_bytes).alias("n"), F.count("*").alias("queries")
    ).first()
    size = total["n"] or 0
    if size <= query_bytes:
        # A task sends k rows of each query, and learns what is good enough anew: the more queries, the fewer and longer tasks.
        cores = rows.sparkSession.sparkContext.defaultParallelism
        usable = usable.coalesce(max(_WAVES * cores, _SENT // max(1, total["queries"] * k)))
        sink = pa.BufferOutputStream()
        table = asked.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        shared = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield best_of(_Queries(pa.ipc.open_stream(shared.value).read_all(), names, weights), batches)

        return usable.mapInArrow(run, schema)

    blocks = -(-size // query_bytes)
    row_size = F.size("v") * 8 + 64 + (F.size("words") * 12 if weights else F.lit(0))
    parts = -(-(usable.agg(F.sum(row_size).alias("n")).first()["n"] or 1) // row_bytes)
    # Hashed apart from the ids' own order, so copies of a row spread as other rows do.
    cut_rows = usable.withColumns({
        "part": F.pmod(F.xxhash64("id"), F.lit(parts)), "block": F.explode(_numbers(blocks)),
    })
    cut_queries = asked.withColumns({
        "block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "part": F.explode(_numbers(parts)),
    })

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], arrow)
        return pa.Table.from_batches([best_of(_Queries(right, names, weights), iter([left]))])

    return cut_rows.groupBy("block", "part").cogroup(cut_queries.groupBy("block", "part")).applyInArrow(pair, schema)


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def top_k(
    rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", filters: dict[str, str] | None = None,
    weights: tuple[float, float] | None = None, query_bytes: int = _QUERY_BYTES, row_bytes: int = _ROW_BYTES,
) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``place`` of the best ``k`` rows of each query; ties go to the smaller id.

    ``queries``: query_id (distinct), vector, text. The score is the cosine, or with ``weights`` (text, vector) the
    weighted share of the query's words among those of ``content`` plus the weighted cosine. A row or query without a
    vector, with a null or no finite component, with a zero vector, or of another length than its counterpart scores
    nothing. ``filters`` maps a column of the queries to one of the rows: where the query's value is not null, only equal
    rows count. Queries of up to ``query_bytes`` travel with the tasks, one pass over the rows; beyond, blocks of that
    size meet parts of the rows of ``row_bytes``. Every task sends at most ``k`` rows a query. Runs a job.
    """
    scored = _scores(rows, queries, k, vector, filters or {}, weights, query_bytes, row_bytes)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _company_filter(rows: DataFrame, queries: DataFrame) -> dict[str, str]:
    return {"company_slug": "slug"} if "slug" in rows.columns and "company_slug" in queries.columns else {}


def vector_top_k(df: DataFrame, queries: list[Query] | DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Nearest rows by cosine similarity for each query, whole; rows without a vector are skipped."""
    asked = query_table(df, queries)
    return df.join(top_k(df, asked, k, vector, _company_filter(df, asked)), "id")


def search_knowledge(
    knowledge: DataFrame, queries: list[Query] | DataFrame, k: int = 5, domain: str | None = None, category: str | None = None
) -> DataFrame:
    """Nearest knowledge entries within an optional domain and category.

    These may be given for all queries, or by columns ``domain`` and ``category`` of the table of queries (null: any).
    """
    wanted = knowledge
    if domain is not None:
        wanted = wanted.filter(F.col("domain") == domain)
    if category is not None:
        wanted = wanted.filter(F.col("category") == category)
    asked = query_table(knowledge, queries)
    own = {c: c for c in ("domain", "category") if c in asked.columns}
    return wanted.join(top_k(wanted, asked, k, filters=own), "id").withColumnRenamed("score", "similarity")


def search_knowledge_text(
    knowledge: DataFrame, query: str, k: int = 5, domain: str | None = None, category: str | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Entries with one of the terms in title or content; a single term is used as it is.

    An empty query matches every entry. ``max_terms`` takes the first terms only.
    """
    wanted = knowledge
    if domain is not None:
        wanted = wanted.filter(F.col("domain") == domain)
    if category is not None:
        wanted = wanted.filter(F.col("category") == category)
    terms = query.replace("/", " ").split()
    used = terms[:max_terms] if len(terms) > 1 else [query]
    hit = F.lit(False)
    for term in used:
        pattern = F.lit(f"%{term}%")
        hit = hit | F.ilike(F.col("title"), pattern) | F.ilike(F.col("content"), pattern)
    return wanted.filter(hit).orderBy("id").limit(k)


def knowledge_texts(knowledge: DataFrame) -> DataFrame:
    """Titles and contents as texts to search or to post (id, part, text, domain, category)."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.col("title").alias("text")), F.struct(F.lit(1).alias("part"), F.col("content").alias("text"))
    )
    return knowledge.select("id", "domain", "category", F.explode(both).alias("t")).select("id", "t.part", "t.text", "domain", "category")


def search_knowledge_texts(
    knowledge: DataFrame, queries: DataFrame, k: int = 5, max_terms: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """``search_knowledge_text`` for a table of queries (query_id, text, domain, category; null: any), with ``place``.

    ``index`` holds stored posting lists of ``knowledge_texts``. Runs jobs.
    """
    words = F.filter(F.split(F.replace("text", F.lit("/"), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    used = words if max_terms is None else F.slice(words, 1, max_terms)
    terms = queries.select(
        "query_id", "domain", "category", F.explode(F.when(F.size(words) > 1, used).otherwise(F.array("text"))).alias("term")
    )
    own = {"domain": "domain", "category": "category"}
    return knowledge.join(first_matches(knowledge_texts(knowledge), terms, k, index, own, ids=knowledge.select("id")), "id")


def hybrid_top_k(
    sections: DataFrame, queries: list[Query] | DataFrame, k: int = 10, text_weight: float = 0.3, semantic_weight: float = 0.7
) -> DataFrame:
    """Sections with a vector by weighted text and vector score, whole."""
    asked = query_table(sections, queries)
    return sections.join(top_k(sections, asked, k, filters=_company_filter(sections, asked), weights=(text_weight, semantic_weight)), "id")


def section_texts(sections: DataFrame) -> DataFrame:
    """Contents as texts to search or to post (id, part, text, and slug where there is one)."""
    own = ["slug"] if "slug" in sections.columns else []
    return sections.select("id", F.lit(0).alias("part"), F.col("content").alias("text"), *own)


def _text_places(sections: DataFrame, asked: DataFrame, k: int, index: DataFrame | None) -> DataFrame:
    """``query_id``, ``id``, ``place`` of the first sections whose content contains the text of the query."""
    own = _company_filter(sections, asked)
    terms = asked.select("query_id", F.col("text").alias("term"), *own)
    return first_matches(section_texts(sections), terms, k, index, own)


def text_hits(
    sections: DataFrame, queries: list[Query] | DataFrame, k: int = 10, index: DataFrame | None = None
) -> DataFrame:
    """First ``k`` sections for each query whose content contains the query in any case, whole, with an excerpt.

    ``index`` holds stored posting lists of ``section_texts``. Runs jobs.
    """
    asked = query_table(sections, queries)
    places = _text_places(sections, asked, k, index)
    whole = sections.join(places, "id").join(asked.select("query_id", F.col("text").alias("_asked")), "query_id")
    return whole.select(
        *sections.columns, "query_id", "place", F.lit(0.0).alias("score"), excerpt(F.col("content"), F.col("_asked")).alias("excerpt")
    )


def search_sections(
    sections: DataFrame, queries: list[Query] | DataFrame, k: int = 10, use_hybrid: bool = True, use_vector: bool = True,
    index: DataFrame | None = None, lead: int | None = 300,
) -> DataFrame:
    """Hybrid search, or vector search without ``use_hybrid``; a query without a hit goes to text search.

    Hybrid and vector search score the same sections, so what finds nothing in the first finds nothing in the second
    and is not searched for again. ``sections`` carry ``slug`` when queries name a company. The hits of all stages meet
    as narrow rows, stored, and are joined with the sections once; ``lead`` cuts the excerpt of a scored section (None: whole).
    Runs jobs.
    """
    # Stored: every stage asks again, and the table may come from texts as long as the sections.
    asked = cut_lineage(query_table(sections, queries))
    scored = sections.limit(0).select(F.lit(0).cast(asked.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    if use_hybrid or use_vector:
        weights = (0.3, 0.7) if use_hybrid else None
        scored = cut_lineage(top_k(sections, asked, k, filters=_company_filter(sections, asked), weights=weights))
    rest = asked.join(scored.select("query_id").distinct(), "query_id", "left_anti")
    texts = _text_places(sections, rest, k, index)
    narrow = cut_lineage(scored.withColumn("search_type", F.lit("hybrid" if use_hybrid else "semantic")).unionByName(
        texts.select("query_id", "id", F.lit(None).cast("double").alias("score"), "place", F.lit("text").alias("search_type"))
    ))
    # A million ids travel to the sections, so that texts without a hit are not dealt out.
    shown_only = sections.join(F.broadcast(narrow.select("id")), "id", "left_semi") if narrow.count() <= _HITS else sections
    whole = shown_only.join(narrow, "id").join(asked.select("query_id", F.col("text").alias("_asked")), "query_id")
    head = F.col("content") if lead is None else cut(F.col("content"), lead)
    shown = F.when(F.col("search_type") == "text", excerpt(F.col("content"), F.col("_asked"))).otherwise(head)
    return whole.select(
        "query_id", "search_type", "place", "id", "period_id", "title", "section_type", "page_number", shown.alias("excerpt"),
        F.round("score", 3).alias("score"),
    )


def with_any_tag(knowledge: DataFrame, tags: list[str]) -> DataFrame:
    return knowledge.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def with_metric(knowledge: DataFrame, metric: str) -> DataFrame:
    return knowledge.filter(F.array_contains("related_metrics", metric))


def missing_vectors(rows: DataFrame) -> DataFrame:
    """Rows without a vector, the text to encode and an estimate of its tokens."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return rows.filter(F.col("embedding").isNull()).select(
        "id", text.alias("text"), F.floor(F.length(text) / 4).alias("token_estimate")
    )


def fill_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with missing vectors filled from (id, vector); a vector that is there stays."""
    new = vectors.select("id", F.col("vector").cast("array<float>").alias("_v"))
    return rows.join(new, "id", "left").select(*[
        F.coalesce("embedding", "_v").alias("embedding") if c == "embedding" else F.col(c) for c in rows.columns
    ])


def encode(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], batch: int = 10) -> DataFrame:
    """Vectors from a caller's encoder, in batches (id, vector, error).

    The rows of a batch that fails have no vector but the error, so they stay due.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    vectors, error = list(encoder(list(part["text"]))), None
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as failure:  # any fault of the caller's encoder is a result of these rows
                    vectors, error = [None] * len(part), f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({"id": part["id"].values, "vector": vectors, "error": [error] * len(part)})

    return texts.select("id", "text").mapInPandas(run, f"id {id_type}, vector array<float>, error string")
