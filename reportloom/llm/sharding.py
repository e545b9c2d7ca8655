"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix, in DataFrame functions only.

Every partition learns how many of its rows go to every shard: the matrix has the distribution of a uniform shuffle
with fixed shard sizes, drawn level by level over a binary tree of partitions. Rows are permuted inside their partition,
dealt by the matrix, exchanged, and permuted again inside their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.text import let
from reportloom.session import cut_lineage

_LOCAL = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the lower 33 bits
_MATRIX_BYTES = 16 << 20
_SPREAD_AT = 6


def _uniform(*parts: Column | int) -> Column:
    """Uniform double in (0, 1) from a 64-bit hash."""
    hashed = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` of ``total`` items, by inversion of ``u``.

    Counts are listed from the mode upwards, then downwards, with weights from the ratio of neighbours; those more than
    twelve deviations off weigh less than one double of the sum and are left out.
    """
    low, high = F.greatest(F.lit(0), drawn + marked - total), F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (marked + 1) / (total + 2)).cast("bigint")))
    share = marked / F.greatest(total, F.lit(1))
    reach = F.ceil(12 * F.sqrt(drawn * share * (1 - share))).cast("bigint") + 40
    up = F.least(high, mode + reach) - mode
    down = mode - F.greatest(low, mode - reach)
    rest = total - marked - drawn

    def upwards(k: Column) -> Column:
        return (marked - k) * (drawn - k) / ((k + 1.0) * (rest + k + 1))

    def downwards(k: Column) -> Column:
        return k * (rest + k) / ((marked - k + 1.0) * (drawn - k + 1))

    def steps(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))

    def weight(count: Column, ratio, move: int) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), mode.alias("k"))

        def step(acc: Column, _: Column) -> Column:
            w = acc["w"] * ratio(acc["k"])
            return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), (acc["k"] + move).alias("k"))

        return F.aggregate(steps(count), start, step, lambda acc: acc["sum"])

    def walk(count: Column, ratio, move: int, target: Column) -> Column:
        """Count at which the weights passed so far exceed the target; ``left`` is what is still to pass."""
        start = F.struct(F.lit(1.0).alias("w"), target.alias("left"), mode.alias("k"))

        def step(acc: Column, _: Column) -> Column:
            w = acc["w"] * ratio(acc["k"])
            on = acc["left"] > 0
            return F.struct(
                F.when(on, w).otherwise(acc["w"]).alias("w"),
                F.when(on, acc["left"] - w).otherwise(acc["left"]).alias("left"),
                F.when(on, acc["k"] + move).otherwise(acc["k"]).alias("k"),
            )

        return F.aggregate(steps(count), start, step, lambda acc: acc["k"])

    def choose(above: Column, below: Column) -> Column:
        return let(u * (1.0 + above + below), lambda target: F.when(
            target <= 1.0 + above, walk(up, upwards, 1, target - 1.0)
        ).otherwise(walk(down, downwards, -1, target - 1.0 - above)))

    return let(weight(up, upwards, 1), lambda above: let(weight(down, downwards, -1), lambda below: choose(above, below)))


def _split(capacity: Column, left: Column, seed: Column) -> Column:
    """How many of ``left`` rows go to each shard, given what every shard still takes."""
    start = F.struct(
        F.array().cast("array<bigint>").alias("out"), left.alias("rows"),
        F.aggregate(capacity, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("room"),
    )

    def step(acc: Column, marked: Column) -> Column:
        draw = hypergeometric(acc["room"], marked, acc["rows"], _uniform(seed, F.size(acc["out"])))
        return let(draw, lambda drawn: F.struct(
            F.concat(acc["out"], F.array(drawn)).alias("out"), (acc["rows"] - drawn).alias("rows"),
            (acc["room"] - marked).alias("room"),
        ))

    return F.aggregate(capacity, start, step, lambda acc: acc["out"])


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``part`` and ``ends``: for every partition the running totals of its rows over the shards.

    ``counts`` has ``part`` (from 0, gaps allowed) and ``n``. Shards differ by one row at most. Only the row counts of
    the partitions meet in one array; a node of the tree carries those of its own partitions.
    """
    spark = counts.sparkSession
    totals = counts.agg(F.max("part").alias("last"), F.sum("n").alias("rows")).first()
    if totals["rows"] is None:
        return spark.createDataFrame([], "part bigint, ends array<bigint>")
    parts, rows = totals["last"] + 1, totals["rows"]
    filled = spark.range(parts).select(F.col("id").alias("part")).join(counts, "part", "left")
    sizes = F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).alias("n"))))
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = filled.agg(F.transform(sizes, lambda x: x["n"]).alias("sizes")).select(
        F.lit(0).cast("bigint").alias("node"), F.array(*[F.lit(x).cast("bigint") for x in room]).alias("room"), "sizes"
    )
    depth = (parts - 1).bit_length()
    for level in range(depth):
        half = 1 << (depth - level - 1)
        first, second = F.slice("sizes", 1, half), F.slice("sizes", half + 1, half)
        left = F.aggregate(first, F.lit(0).cast("bigint"), lambda a, x: a + x)
        drawn = nodes.withColumn("taken", _split(F.col("room"), left, F.xxhash64(F.lit(seed), F.lit(level), F.col("node"))))
        rest = F.zip_with("room", "taken", lambda a, b: a - b)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("room"), first.alias("sizes")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("room"), second.alias("sizes")),
        )
        nodes = drawn.select(F.inline(halves)).filter(F.size("sizes") > 0)
        if level == _SPREAD_AT:  # from here on the nodes are many enough to share the work
            nodes = nodes.repartition(2 << level, "node")
    return nodes.select(F.col("node").alias("part"), _running("room").alias("ends"))


def _running(column: str) -> Column:
    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(column, start, step, lambda acc: acc["out"])


def into_shards(rows: DataFrame, shards: int, seed: int = 0, rows_per_run: int = 1 << 16) -> DataFrame:
    """``rows`` in uniformly random order over ``shards``: adds ``shard`` and ``slot`` (from 0, without gaps).

    Every row counts, repeated ones too; no column decides where a row goes. Sizes differ by one row at most. Columns
    of the same names are replaced. Runs jobs: the locally permuted rows are stored once, so that a task that runs again
    deals the same rows. A shard is put in order in runs of about ``rows_per_run`` rows, so it needs no single task.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    marked = rows.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("uid"))
    permuted = marked.withColumn("order", F.xxhash64(F.lit(seed), F.lit("local"), "uid")).sortWithinPartitions("order", "uid")
    dealt = cut_lineage(permuted.select("row", F.monotonically_increasing_id().alias("at"))).select(
        "row", "at", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(_LOCAL)).alias("rank")
    )
    counts = cut_lineage(dealt.groupBy("part").agg(F.count("*").alias("n")))
    matrix = cut_lineage(communication_matrix(counts, shards, seed))
    if matrix.count() * shards * 8 <= _MATRIX_BYTES:
        matrix = F.broadcast(matrix)
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    runs = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // (shards * rows_per_run)))
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "at")
    exchanged = dealt.join(matrix, "part").select(
        "row", "at", shard.alias("shard"), key.alias("key"), F.pmod(F.xxhash64(F.lit(seed), F.lit("run"), "at"), F.lit(runs)).alias("run")
    )
    lengths = exchanged.groupBy("shard", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("shard", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "at"))
    return (
        exchanged.withColumn("within", within).join(starts, ["shard", "run"])
        .select("row.*", "shard", (F.col("start") + F.col("within") - 1).cast("bigint").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order within every file. Runs a job."""
    (
        sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
