"""Texts that contain a term in any case, for a table of terms: posting lists of character runs, then the whole text.

Every text is posted under each run of one, two and three characters it holds. A term needs all of its own runs, so the
lists of its rarest ones, intersected rarest first, leave few texts to look into. ``postings`` can be stored once and
used by many searches; the work of a search then falls with the rarity of its terms. ``first_matches`` wants few hits of
each query only: it reads the texts in ranges of ids, and a query that has its hits is not looked for any further.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.session import cut_lineage

_RUN = 3
_PIECE = 1 << 20  # characters of a text taken at once
_PASSED_ON = 1 << 20  # wanted runs that travel with the tasks, 8 MB; more are joined
_EVERY = 0  # the run of the empty term, posted for every text
_BUCKETS = 256
_TERM_BYTES = 1 << 25  # searches that travel with the tasks
_FIRST = 1 << 12  # texts of the first range of ids
_GROWTH = 32  # times as many texts in the next one
_SLOTS = 1 << 18  # marks of the runs in question
_STEP = 1 << 17  # bytes looked at together


def _runs(text: str, shorter: bool) -> np.ndarray:
    """Distinct runs of the text, three characters of 21 bits in a number; with ``shorter`` those of two and one too."""
    found = [np.array([_EVERY], dtype=np.int64)] if shorter else []
    for start in range(0, len(text), _PIECE):
        piece = text[start : start + _PIECE + _RUN - 1]
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        parts = [(c[:-2] << 42) | (c[1:-1] << 21) | c[2:]]
        if shorter:
            parts += [(c[:-1] << 21) | c[1:], c]
        found.append(np.unique(np.concatenate(parts)))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def _needed(piece: str) -> np.ndarray:
    """Runs a text must hold to contain ``piece``."""
    if len(piece) >= _RUN:
        return _runs(piece, shorter=False)
    code = 0
    for c in piece:
        code = (code << 21) | (ord(c) + 1)
    return np.array([code], dtype=np.int64)


def postings(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``gram``, ``id``, ``part`` for each distinct run of every text (texts: id, part, text; null texts have none).

    ``wanted`` (gram) keeps the lists of these runs only; it is counted, which runs a job, and passed on with the tasks
    while it is small, else joined.
    """
    some: np.ndarray | None = None
    if wanted is not None:
        wanted = cut_lineage(wanted.select("gram").distinct())
        if wanted.count() <= _PASSED_ON:
            some = np.sort(np.array([r["gram"] for r in wanted.collect()], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            grams, rows, size = [], [], 0
            for i, text in enumerate(batch.column(2)):
                found = _runs(text.as_py(), shorter=True)
                if some is not None:
                    found = np.intersect1d(found, some, assume_unique=True)
                grams.append(found)
                rows.append(np.full(len(found), i, dtype=np.int64))
                size += len(found)
                if size >= _PIECE or i == batch.num_rows - 1:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(grams)), ids.take(at), parts.take(at)], ["gram", "id", "part"]
                    )
                    grams, rows, size = [], [], 0

    id_type = texts.schema["id"].dataType.simpleString()
    lower = texts.filter(F.col("text").isNotNull()).select("id", F.col("part").cast("int"), F.lower("text").alias("text"))
    lists = lower.mapInArrow(run, f"gram bigint, id {id_type}, part int")
    return lists.join(wanted, "gram", "left_semi") if wanted is not None and some is None else lists


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(_BUCKETS)).alias("bucket")


def store_postings(lists: DataFrame, folder: str) -> None:
    """Posting lists as Parquet in folders of a bucket; a list that most texts are on is cut into ranges of ids."""
    cut = lists.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "id")
    cut.sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def stored_postings(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lists of ``wanted`` (gram) among the stored ones, from their buckets only."""
    keys = wanted.select("gram").distinct().select("gram", _bucket(F.col("gram")))
    return lists.join(keys, ["bucket", "gram"], "left_semi").select("gram", "id", "part")


def _pattern(term: Column) -> Column:
    """Of neighbouring ``%`` one is left: matching tries all ways to part a text among them."""
    return F.regexp_replace(F.concat(F.lit("%"), F.lower(term), F.lit("%")), r"(?s)((?:[^%\\]|\\.)*+)%+", r"$1%")


def term_runs(terms: DataFrame) -> DataFrame:
    """``query_id``, ``term``, ``gram``: runs that every text with the term holds.

    ``%`` and ``_`` in a term stand for any text and any character, a backslash takes the next character as it is; the
    runs are those of the plain pieces between.
    """
    plain = r"(?s)((?:\\.|[^%_\\])+)"
    pieces = F.transform(
        F.regexp_extract_all(_pattern(F.col("term")), F.lit(plain)), lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1")
    )
    cut = terms.select("query_id", "term", F.explode_outer(pieces).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_needed(p.as_py() or "") for p in batch.column(2)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            grams = pa.array(np.concatenate([*found, np.empty(0, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), grams], ["query_id", "term", "gram"])

    id_type = terms.schema["query_id"].dataType.simpleString()
    return cut.mapInArrow(run, f"query_id {id_type}, term string, gram bigint").distinct()


def contains_term(text: Column, term: Column) -> Column:
    """Whether the text contains the term in any case, as ``ILIKE '%term%'`` says."""
    plain = ~term.rlike(r"[%_\\]")
    return F.when(plain, F.contains(F.lower(text), F.lower(term))).otherwise(F.call_function("like", F.lower(text), _pattern(term)))


def matches(
    texts: DataFrame, terms: DataFrame, index: DataFrame | None = None, rounds: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``query_id``, ``id`` and ``carry`` of each text that contains a term of the query; once, however many terms and parts hit.

    ``texts``: id, part, text and the columns of ``carry``, which follow from the id. ``terms``: query_id, term (null terms
    have no hit, the empty one hits every text). ``index`` holds stored posting lists; without one the lists of the runs
    in question are made in one pass over the texts. The lists of the ``rounds`` rarest runs of a term are intersected,
    rarest first, then whole texts decide. Runs jobs.
    """
    given = terms.filter(F.col("term").isNotNull()).select("query_id", "term").distinct()
    needed = cut_lineage(term_runs(given))
    lists = stored_postings(index, needed) if index is not None else cut_lineage(postings(texts, needed))
    sizes = lists.groupBy("gram").agg(F.count("*").alias("texts"))
    own = F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")))
    # Bounded by the length of a term; a run without a list means that no text holds the term.
    rarest = cut_lineage(
        needed.join(sizes, "gram", "left").groupBy("query_id", "term").agg(own.alias("own"))
        .filter(F.get("own", F.lit(0))["texts"] > 0)
        .select("query_id", "term", F.slice(F.transform("own", lambda g: g["gram"]), 1, rounds).alias("grams"))
    )
    used = lists.join(rarest.select(F.explode("grams").alias("gram")).distinct(), "gram", "left_semi")
    found = rarest.select("*", F.get("grams", F.lit(0)).alias("gram")).join(used, "gram").drop("gram")
    held = used.withColumn("_held", F.lit(True))
    for i in range(1, rounds):
        step = found.withColumn("gram", F.get("grams", F.lit(i))).join(held, ["gram", "id", "part"], "left")
        found = step.filter(F.col("gram").isNull() | F.col("_held")).drop("gram", "_held")
    whole = texts.filter(F.col("text").isNotNull()).select("id", F.col("part").cast("int").alias("part"), "text", *carry)
    hits = found.select("query_id", "term", "id", "part").join(whole, ["id", "part"])
    return hits.filter(contains_term(F.col("text"), F.col("term"))).select("query_id", "id", *carry).distinct()


def _as_regex(term: str) -> re.Pattern[str]:
    """The term with ``%`` and ``_`` as ``contains_term`` reads it, matched from the start of a text.

    Each plain piece is taken where it stands first and not tried again, so the time is linear in the text.
    """
    pieces = [""]
    for sign in re.findall(r"(?s)\\.|.", f"%{term}%"):
        if sign == "%":
            pieces.append("")
        else:
            pieces[-1] += "." if sign == "_" else re.escape(sign[-1])
    end = rf".*{pieces[-1]}\Z" if pieces[-1] else ""
    return re.compile("".join(f"(?>.*?{p})" for p in pieces[:-1] if p) + end, re.DOTALL)


class _Searches:
    """Searches of a task: who asks for which terms under which values of the filters, and where texts hold these terms."""

    def __init__(self, table: pa.Table, anchors: dict[str, int], filters: list[str]) -> None:
        columns = {name: table[name].to_pylist() for name in table.column_names}
        given = list(zip(*[columns[f] for f in filters])) if filters else [()] * len(table)
        self.askers: dict[tuple[int, ...], dict[tuple, dict[str, list[int]]]] = {}
        for i, (terms, values) in enumerate(zip(columns["terms"], given)):
            pattern = tuple(j for j, v in enumerate(values) if v is not None)
            own = self.askers.setdefault(pattern, {}).setdefault(tuple(values[j] for j in pattern), {})
            for term in terms:
                own.setdefault(term, []).append(i)
        self.ids, self.anchors = columns["query_id"], anchors
        self.regexes = {t: _as_regex(t) for t in {t for own in columns["terms"] for t in own} if re.search(r"[%_\\]", t)}
        self.groups: set[tuple] | None = None

    def candidates(self, texts: pa.Array, values: list[tuple]) -> Iterator[tuple[int, str, str, list[int]]]:
        """Row, text, term and who asks of each term that a row may hold; terms asked of no row here are not looked for."""
        found = [{k: self.askers[p].get(k) for k in {tuple(v[j] for j in p) for v in values}} for p in self.askers]
        groups = {(p, k) for p, by_key in zip(self.askers, found) for k, own in by_key.items() if own is not None}
        if groups != self.groups:
            terms = sorted({t for p, k in groups for t in self.askers[p][k]})
            self.groups, self.terms = groups, _Terms(terms, self.anchors, self.regexes)
        asked = [[own for p, by_key in zip(self.askers, found) if (own := by_key[tuple(v[j] for j in p)]) is not None] for v in values]
        last, text = -1, ""
        for row, term in self.terms.found_in(texts):
            for own in asked[row]:
                if term in own:
                    if row != last:
                        last, text = row, texts[row].as_py()
                    yield row, text, term, own[term]

    def holds(self, text: str, term: str) -> bool:
        regex = self.regexes.get(term)
        return term in text if regex is None else regex.match(text) is not None


class _Terms:
    """Finds terms in the bytes of many texts at once: each by up to four bytes of its run, then by its first eight."""

    def __init__(self, terms: list[str], anchors: dict[str, int], regexes: dict[str, re.Pattern[str]]) -> None:
        self.terms = terms
        self.always = [i for i, t in enumerate(terms) if anchors[t] == _EVERY]
        under: dict[bytes, list[int]] = {}
        self.back, self.size = np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        self.head, self.mask = np.zeros(len(terms), dtype=np.uint64), np.zeros(len(terms), dtype=np.uint64)
        for i, term in enumerate(terms):
            if anchors[term] == _EVERY:
                continue
            window = _as_text(anchors[term]).encode("utf-8", "surrogatepass")[:4]
            under.setdefault(window, []).append(i)
            whole = term.encode("utf-8", "surrogatepass")
            if term not in regexes and window in whole:
                self.back[i], self.size[i] = whole.index(window), len(whole)
                self.head[i] = int.from_bytes(whole[:8], "little")
                self.mask[i] = (1 << 8 * min(8, len(whole))) - 1
        # Windows of one to four bytes, in order, with marks of the slots they fall into and the terms under each.
        self.kinds = {}
        for n in range(1, 5):
            own = sorted((int.from_bytes(w, "little"), at) for w, at in under.items() if len(w) == n)
            if own:
                codes, marks = np.array([c for c, _ in own], dtype=np.uint32), np.zeros(_SLOTS, dtype=bool)
                marks[_slots(codes)] = True
                sizes = np.array([len(at) for _, at in own])
                self.kinds[n] = codes, marks, np.array([i for _, at in own for i in at]), np.cumsum(sizes) - sizes, sizes

    def found_in(self, texts: pa.Array) -> Iterator[tuple[int, str]]:
        """Row and term of each term that a row may hold, rows in order."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _PIECE, "right")) - 1)
            low, high = int(bounds[first]), int(bounds[last])
            padded = np.zeros(high - low + 8, dtype=np.uint8)
            if high > low:
                padded[: high - low] = np.frombuffer(data, dtype=np.uint8, count=high - low, offset=low)
            pairs = self._pairs(padded, bounds[first : last + 1] - low)
            if self.always:
                every = np.arange(last - first)[:, None] * len(self.terms) + np.array(self.always)
                pairs = np.union1d(pairs, every.reshape(-1))
            for pair in pairs.tolist():
                yield first + pair // len(self.terms), self.terms[pair % len(self.terms)]
            first = last

    def _pairs(self, padded: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Row times number of terms plus term, in order; ``padded`` has eight bytes more than the rows."""
        length = len(padded) - 8
        eights = np.ndarray((length + 1,), dtype="<u8", buffer=padded, strides=(1,))
        found = [np.empty(0, dtype=np.int64)]
        for start in range(0, length, _STEP):
            signs = padded[start : min(start + _STEP, length) + 3].astype(np.uint32)
            windows = np.zeros(len(signs) - 3, dtype=np.uint32)
            for n in range(1, 5):
                windows |= signs[n - 1 : n - 1 + len(windows)] << 8 * (n - 1)
                if n not in self.kinds:
                    continue
                codes, marks, under, first, sizes = self.kinds[n]
                at = np.flatnonzero(marks.take(_slots(windows), mode="wrap"))
                code = np.minimum(np.searchsorted(codes, windows[at]), len(codes) - 1)
                own = codes[code] == windows[at]
                at, code = at[own] + start, code[own]
                ends, done = np.cumsum(sizes[code]), 0
                while done < len(at):
                    stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _PIECE, "right")))
                    some = sizes[code[done:stop]]
                    spans = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
                    term = under[np.repeat(first[code[done:stop]], some) + spans]
                    where = np.repeat(at[done:stop], some)
                    row = np.searchsorted(bounds, where, "right") - 1
                    begin = where - self.back[term]
                    inside = (begin >= bounds[row]) & (begin + self.size[term] <= bounds[row + 1])
                    row, term, begin = row[inside], term[inside], begin[inside]
                    same = (eights[begin] & self.mask[term]) == self.head[term]
                    found.append(np.unique(row[same] * len(self.terms) + term[same]))
                    done = stop
        return np.unique(np.concatenate(found))


def _as_text(run: int) -> str:
    text = ""
    while run:
        text, run = chr((run & ((1 << 21) - 1)) - 1) + text, run >> 21
    return text


def _slots(windows: np.ndarray) -> np.ndarray:
    return (windows * np.uint32(0x9E3779B1)) >> np.uint32(14)


def _ranges(ids: DataFrame, first: int, growth: int) -> Iterator[Column]:
    """Conditions that cut the ids into ranges in order, the next one about ``growth`` times as long.

    Only where the cuts lie comes from a sample; the ranges hold every id.
    """
    low, every = None, 1
    while True:
        sample = ids if every == 1 else ids.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
        end = sample.orderBy("id").limit(first).agg(F.max("id").alias("high"), F.count("*").alias("n")).first()
        last = end["n"] < first
        above = F.col("id").isNotNull() if low is None else F.col("id") > F.lit(low)
        if last or low is None or end["high"] > low:
            yield above if last else above & (F.col("id") <= F.lit(end["high"]))
            low = end["high"]
        if last:
            return
        every *= growth


def first_matches(
    texts: DataFrame, terms: DataFrame, k: int, index: DataFrame | None = None, filters: dict[str, str] | None = None,
    term_bytes: int = _TERM_BYTES, first: int = _FIRST, growth: int = _GROWTH, ids: DataFrame | None = None,
) -> DataFrame:
    """``query_id``, ``id``, ``place`` of the first ``k`` ids by order whose texts contain a term of the query.

    ``texts`` and ``terms`` as in ``matches``; ``filters`` maps a column of the terms, the same in all terms of a query, to
    one of the texts: where it is not null, only equal rows count. Queries that ask the same are one. The texts are read
    in ranges of ids, each ``growth`` times as long as the one before, and a query with ``k`` hits is not asked in the
    next, so what is left is the rarer the more texts there are to read. A text is looked into for the terms whose
    rarest run it holds; a task sends at most ``k`` ids of a query. After the first range stored posting lists
    (``index``) serve the rest. Up to ``term_bytes`` of queries travel with the tasks; more are taken in blocks of that
    size, one after the other. ``ids`` (id), where they can be had without the texts, place the cuts of the ranges. Runs jobs.
    """
    filters = filters or {}
    names = [f"f{i}" for i in range(len(filters))]
    given = terms.filter(F.col("term").isNotNull()).select(
        "query_id", F.lower("term").alias("term"), *[F.col(c).cast("string").alias(n) for n, c in zip(names, filters)]
    )
    queries = cut_lineage(given.groupBy("query_id", *names).agg(F.array_sort(F.collect_set("term")).alias("terms")))
    distinct = cut_lineage(queries.groupBy("terms", *names).agg(F.min("query_id").alias("query_id")))
    own = texts.filter(F.col("text").isNotNull()).select(
        "id", F.col("part").cast("int").alias("part"), F.col("text"), *[F.col(c).cast("string").alias(n) for n, c in zip(names, filters.values())]
    )
    size = distinct.agg(F.sum(F.aggregate("terms", F.lit(64).cast("bigint"), lambda n, t: n + 64 + F.octet_length(t))).alias("n")).first()["n"] or 0
    ranges, blocks = list(_ranges((texts if ids is None else ids).select("id"), first, growth)) if size else [], max(1, -(-size // term_bytes))
    parts = []
    if ranges:
        # Few bytes but every query is asked here: dealt out to all cores, or one task would look for all of them.
        cores = texts.sparkSession.sparkContext.defaultParallelism
        head = cut_lineage(own.filter(ranges[0]).repartition(cores, "id"))
    for block in range(blocks if ranges else 0):
        some = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        parts += _first_of_block(own, head, some, k, ranges, index, names)
    if not parts:
        return queries.limit(0).crossJoin(texts.limit(0)).select("query_id", "id", F.lit(0).alias("place"))
    found = first_hits(reduce(DataFrame.unionByName, parts), k).withColumnRenamed("query_id", "_as")
    same = [queries[n].eqNullSafe(distinct[n]) for n in names]
    asked = queries.join(distinct.withColumnRenamed("query_id", "_as"), reduce(Column.__and__, same, queries["terms"] == distinct["terms"]))
    return asked.select("query_id", "_as").join(found, "_as").select("query_id", "id", "place")


def _first_of_block(
    texts: DataFrame, head: DataFrame, asked: DataFrame, k: int, ranges: list[Column], index: DataFrame | None, names: list[str]
) -> list[DataFrame]:
    """Hits of each range (query_id, id), up to ``k`` of a query; ``head`` holds the texts of the first range."""
    table, found = asked.toArrow(), []
    terms = sorted({t for own in table["terms"].to_pylist() for t in own})
    if not terms:
        return []
    anchors = _rarest_runs(head, terms)
    for i, inside in enumerate(ranges):
        if i == 1 and index is not None:
            left = texts.sparkSession.createDataFrame(table) if len(table) else asked.limit(0)
            found.append(_indexed(texts, left, index, names, ~ranges[0]))
            break
        hits = cut_lineage(first_hits(_look(texts.filter(inside) if i else head, table, anchors, k, names), k).drop("place"))
        found.append(hits)
        if i == len(ranges) - 1:
            break
        done = reduce(DataFrame.unionByName, found).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        full = done.select("query_id").toArrow()["query_id"]
        table = table.filter(pc.invert(pc.is_in(table["query_id"], value_set=full)))
        if not len(table):
            break
    return found


def _indexed(texts: DataFrame, asked: DataFrame, index: DataFrame, names: list[str], inside: Column) -> DataFrame:
    """All hits of the queries by stored posting lists."""
    hits = matches(texts.filter(inside), asked.select("query_id", F.explode("terms").alias("term")), index, carry=tuple(names))
    wanted = asked.select("query_id", *[F.col(n).alias(f"_{n}") for n in names])
    fits = [F.col(f"_{n}").isNull() | (F.col(f"_{n}") == F.col(n)) for n in names]
    return hits.join(wanted, "query_id").filter(reduce(Column.__and__, fits, F.lit(True))).select("query_id", "id")


def _rarest_runs(sample: DataFrame, terms: list[str]) -> dict[str, int]:
    """For each term the run of it that the fewest texts of the sample hold; only the speed follows from the sample."""
    spark = sample.sparkSession
    numbered = spark.createDataFrame(pa.table({"query_id": pa.array(range(len(terms)), pa.int64()), "term": terms}))
    needed = cut_lineage(term_runs(numbered).select("query_id", "gram"))
    uses = postings(sample, needed).groupBy("gram").agg(F.count("*").alias("n"))
    ranked = needed.join(uses, "gram", "left").groupBy("query_id").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), -F.col("gram"))).alias("gram")
    ).toArrow()
    return {terms[i]: gram for i, gram in zip(ranked["query_id"].to_pylist(), ranked["gram"].to_pylist())}


def _look(texts: DataFrame, table: pa.Table, anchors: dict[str, int], k: int, names: list[str]) -> DataFrame:
    """``query_id`` and ``id`` of hits, of each task the first ``k`` of a query."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    kept = {t: anchors[t] for own in table["terms"].to_pylist() for t in own}
    shared = texts.sparkSession.sparkContext.broadcast((sink.getvalue().to_pybytes(), kept))
    id_type = texts.schema["id"].dataType
    schema = f"query_id {texts.sparkSession.createDataFrame(table.slice(0, 0)).schema['query_id'].dataType.simpleString()}, id {id_type.simpleString()}"
    arrow = texts.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, runs = shared.value
        searches = _Searches(pa.ipc.open_stream(data).read_all(), runs, names)
        best: dict[int, list] = {}
        for batch in batches:
            ids, texts_of = batch.column(0).to_pylist(), batch.column(1)
            values = list(zip(*[batch.column(2 + j).to_pylist() for j in range(len(names))])) if names else [()] * len(ids)
            for i, text, term, asking in searches.candidates(texts_of, values):
                own_id = ids[i]
                open_for = [q for q in asking if len(best.get(q, ())) < k or own_id < best[q][-1]]
                if not open_for or not searches.holds(text, term):
                    continue
                for q in open_for:
                    own = best.setdefault(q, [])
                    if own_id not in own:
                        insort(own, own_id)
                        del own[k:]
        at, found = [q for q, own in best.items() for _ in own], [x for own in best.values() for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([searches.ids[q] for q in at], arrow.field("query_id").type), pa.array(found, arrow.field("id").type)], schema=arrow)

    return texts.select("id", F.lower("text").alias("text"), *names).mapInArrow(run, schema).distinct()


def first_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each query by id, numbered in ``place``."""
    order = Window.partitionBy("query_id").orderBy("id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
