"""Near duplicates on word shingles: fast similarity sketches, banding, exact verification, connected components.

1. Every text becomes its shingle set, a signature of the set and a sketch of one byte per coordinate.
2. Texts with one set are one class; only the class with its smallest id goes on.
3. Bands of the sketch put classes into buckets. The pivot of a bucket is its most central class, the one that meets most
   others over all buckets. Every class is linked to the pivot it shares most bands with and to its most central one, if
   the full sets confirm it. Most groups are one component after that.
4. Buckets that still hold several components compare their sketches block by block across components; pairs above the
   estimate are confirmed on the full sets. Pairs inside a component need no test, so nothing is lost. Their components
   are then the nodes that are linked on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import attach, told_apart, without_rows
from reportloom.llm.components import components
from reportloom.llm.shingles import shared, shingle_sets
from reportloom.llm.sketch import agreement, short_sketch
from reportloom.session import cut_lineage

_BLOCK = 1024
_LEFT = 64  # rows of a block compared at a time
_BROADCAST_IDS = 2_000_000
_MISSED = 1e-6
_DEVIATIONS = 5


def rows_per_band(percent: int, size: int) -> int:
    """Most rows of a band with which a pair at the threshold shares no band once in a million times or less."""
    p = percent / 100
    fits = [r for r in range(1, size + 1) if (1 - p**r) ** (size // r) <= _MISSED]
    return max(fits, default=1)


def least_estimate(percent: int, size: int) -> float:
    """Five deviations of a sketch below the threshold."""
    p = percent / 100
    return p - _DEVIATIONS * (p * (1 - p) / size) ** 0.5


def _features(docs: DataFrame, width: int, size: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.iloc[start:start + 1024]
                sets = shingle_sets(batch["text"].tolist(), width)
                yield pd.DataFrame({
                    "id": batch["id"], "n": [s.size for s in sets],
                    "signature": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "sketch": [short_sketch(s, size) if s.size else b"" for s in sets],
                })

    return docs.mapInPandas(run, f"id {kind}, n bigint, signature binary, sketch binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets reach the threshold, all columns as they were. Runs jobs.

    Only the texts that a pair names leave their place: up to two million ids are broadcast to find them, more are joined.
    """
    pairs = cut_lineage(pairs)
    wanted = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    if wanted.count() <= _BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "id", "left_semi")
    columns, schema = pairs.columns, pairs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start:start + 512]
                place: dict[str, int] = {}  # a text of several pairs is cut once
                sides = [[place.setdefault(t, len(place)) for t in batch[c]] for c in ("text_a", "text_b")]
                sets = shingle_sets(list(place), width)
                linked = []
                for i, j in zip(*sides):
                    a, b = sets[i], sets[j]
                    both = shared(a, b)
                    linked.append(100 * both >= percent * (a.size + b.size - both) and both > 0)
                yield batch.loc[linked, columns]

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut_lineage(both.select(*columns, "text_a", "text_b").mapInPandas(run, schema))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal keys of a sorted partition, across batches."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        columns = {c: batch[c].to_numpy() for c in batch}
        change = np.zeros(len(batch), bool)
        for key in keys:
            change[1:] |= columns[key][1:] != columns[key][:-1]
        starts = np.append(0, np.flatnonzero(change))
        for a, b in zip(starts, starts[1:]):
            yield {c: v[a:b] for c, v in columns.items()}
        held = batch.iloc[starts[-1]:]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in held}


def _across(members: DataFrame, size: int, rows: int, estimate: float) -> DataFrame:
    """Pairs of one bucket and different components whose sketches agree enough; each in its first common band only.

    Gives ``a`` and ``b``, the lesser id first, with their components ``of_a`` and ``of_b``.
    ``members`` has ``key``, ``band``, ``id``, ``component``, ``n`` (rows of the bucket) and ``sketch``. A bucket is dealt
    into blocks of about 1024 rows, a task group is two blocks at most.
    """
    kind = members.schema["id"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / F.lit(_BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("key", "band", "id", "component", "sketch", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    bands = size // rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["key", "i", "j"]):
            if g["component"].min() == g["component"].max():
                continue
            sketches = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g["id"]), size)
            left = np.flatnonzero(g["own"] == g["i"])
            right = left if g["i"][0] == g["j"][0] else np.flatnonzero(g["own"] == g["j"])
            if not left.size or not right.size:
                continue
            for start in range(0, left.size, _LEFT):
                some = left[start:start + _LEFT]
                near = agreement(sketches[some], sketches[right]) >= estimate
                near &= g["component"][some][:, None] != g["component"][right][None]
                x, y = np.nonzero(near)
                x, y = some[x], right[y]
                if right is left:
                    x, y = x[x < y], y[x < y]
                if not x.size:
                    continue
                same = (sketches[x] == sketches[y])[:, : bands * rows].reshape(-1, bands, rows).all(axis=2)
                first = same.argmax(axis=1) == g["band"][0]
                x, y = x[first], y[first]
                lesser = g["id"][x] <= g["id"][y]
                a, b = np.where(lesser, x, y), np.where(lesser, y, x)
                yield pd.DataFrame({"a": g["id"][a], "b": g["id"][b], "of_a": g["component"][a], "of_b": g["component"][b]})

    schema = ", ".join(f"{c} {kind}" for c in ("a", "b", "of_a", "of_b"))
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, schema)


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 5, size: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; the set of a text has its distinct runs of
    ``width`` words, or the whole text as one run if it has fewer. Two rows are linked if 100 * intersection >=
    ``percent`` * union of their full sets; ``component_id`` is the smallest id a row reaches through links. A null or
    wordless text is linked with nothing. Rows that share an id are one document with all their texts; a row with a null
    id is linked with nothing and kept. A link is missed if its pair shares no band (less than once in a million at the
    threshold, less above) or its sketches err by five deviations. Runs jobs.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows_per_band(percent, size)
    features = cut_lineage(_features(plain, width, size))
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = cut_lineage(
        features.filter(linkable).groupBy("signature").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    )
    band = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(size // rows - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * rows + 1, F.lit(rows)))
    ))
    keys = classes.select("id", band.alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(attach(keys, buckets, ["key"]))
    central = members.groupBy("id").agg(F.sum("n").alias("met"))
    met = cut_lineage(members.join(central, "id"))
    rank = F.struct("met", -F.col("id"))
    pivots = met.groupBy("key").agg(F.max_by("id", rank).alias("pivot"), F.max("met").alias("pivot_met"))
    stars = attach(met.select("key", "id"), pivots, ["key"]).filter("id <> pivot")
    stars = stars.groupBy("id", "pivot").agg(F.count("*").alias("bands"), F.max("pivot_met").alias("met"))
    best = stars.groupBy("id").agg(
        F.max_by("pivot", F.struct("bands", "met", -F.col("pivot"))).alias("closest"),
        F.max_by("pivot", F.struct("met", -F.col("pivot"))).alias("hub"),
    ).select("id", F.explode(F.array_distinct(F.array("closest", "hub"))).alias("pivot"))
    links = _confirmed(best.select(F.col("pivot").alias("a"), F.col("id").alias("b")), plain, percent, width)
    found = components(links)

    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut_lineage(placed.select("key", "band", "id", "component"))
    open_buckets = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
    open_members = attach(placed, open_buckets.filter("least <> most").select("key", "n"), ["key"])
    sketched = open_members.join(classes.select("id", "sketch"), "id")
    pairs = _across(sketched, size, rows, least_estimate(percent, size)).distinct()
    across = _confirmed(pairs, plain, percent, width)
    merged = components(across.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).toDF("component", "whole")

    labels = classes.select("signature", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    labels = attach(labels.select("signature", F.coalesce("component", "id").alias("component")), merged, ["component"], "left")
    labels = labels.select("signature", F.coalesce("whole", "component").alias("component"))
    linked = attach(features.filter(linkable).drop("sketch"), labels, ["signature"])
    alone = features.filter(~linkable | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return linked.select("id", "n", "component").union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def without_near_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: of the smallest id, a null id coming last.

    Rows that share an id, or have none, are documents of their own. Rows without a word all stay. Runs jobs.
    """
    rows, key = told_apart(docs, id_col, nulls_first=False)
    decided = near_duplicates(rows, percent, width, id_col=key, text_col=text_col)
    return without_rows(rows, key, decided.filter("not kept").select(key), docs.columns)
