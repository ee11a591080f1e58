"""Shards of near equal size by a k-d tree over document metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendgrid.llm.common import keep

DIMENSIONS = ("length", "source", "lang")
FINE = 12  # low bits of a key: the chunk of a very large group
TEXT_BITS = 32  # then bits of the text's hash, so that equal texts are neighbours in every dimension
STEP = 1024  # bins per node and pass in the search for a median


def _of_string(name: str) -> Column:
    """Order-preserving number of the first six bytes; null is lowest."""
    head = F.rpad(F.substring(F.hex(F.encode(F.coalesce(name, F.lit("")), "UTF-8")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _units(docs: DataFrame, shards: int, whole_share: float) -> tuple[DataFrame, DataFrame]:
    """(rows, units). A unit is what no cut divides: all rows of one text, or one chunk of a text whose
    rows weigh more than ``whole_share`` of a shard. At most shards / whole_share texts can be that
    heavy, which bounds the list that is broadcast."""
    text = F.coalesce("text", F.lit(""))
    columns = {c.lower() for c in docs.columns}
    tag = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    rows = keep(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            tag("source").alias("source"),
            tag("lang").alias("lang"),
        ),
        "sized",
    )
    per_text = rows.groupBy("text_hash").agg(F.sum("size").alias("weight"))
    total = per_text.agg(F.sum("weight")).first()[0] or 0
    limit = max(1.0, whole_share * total / shards)
    heavy = per_text.where(F.col("weight") > limit).select(
        "text_hash", F.least(F.lit(1 << FINE), F.ceil(F.col("weight") / limit)).cast("long").alias("chunks")
    )
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks")))
    rows = rows.join(F.broadcast(heavy), "text_hash", "left").withColumn("chunk", chunk.cast("long")).drop("chunks")
    first = rows.groupBy("text_hash", "chunk").agg(
        F.sum("size").alias("weight"),
        F.log2(F.max("size").cast("double")).alias("length"),
        F.min(_of_string("source")).alias("source"),
        F.min(_of_string("lang")).alias("lang"),
    )
    return rows, first


def _keys(units: DataFrame) -> DataFrame:
    """One whole-number key per dimension: 16 bits of the scaled value, then text hash, then chunk."""
    span = units.agg(*[f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    tail = F.shiftleft(F.shiftrightunsigned("text_hash", 64 - TEXT_BITS), FINE) + F.col("chunk")

    def key(d: str) -> Column:
        low, high = span[f"{d}_min"] or 0.0, span[f"{d}_max"] or 0.0
        scaled = F.lit(0.0) if high <= low else (F.col(d) - low) / (high - low) * 65535
        return F.shiftleft(F.floor(scaled).cast("long"), TEXT_BITS + FINE) + tail

    return units.select("text_hash", "chunk", "weight", *[key(d).alias(d) for d in DIMENSIONS])


def _cuts(units: DataFrame, node: Column, goals: dict[int, tuple[str, float, int, int]], slack: float) -> dict[int, int]:
    """For each node the key whose left side weighs closest to the goal. goals: node -> (dimension, weight
    wanted on the left, lowest key, highest key). Every pass bins each node's open interval by ``STEP``;
    the driver sees at most that many sums a node."""
    open_, done, below = dict(goals), {}, dict.fromkeys(goals, 0.0)
    while open_:
        width = {n: max(1, -(-(high - low + 1) // STEP)) for n, (_, _, low, high) in open_.items()}
        pick = lambda f: F.coalesce(*[F.when(node == n, f(n)) for n in open_])
        bins = (
            units.withColumn("node", node)
            .where(F.col("node").isin(list(open_)))
            .withColumn("key", F.coalesce(*[F.when(F.col("node") == n, F.col(open_[n][0])) for n in open_]))
            .where(reduce(lambda a, b: a | b, [(F.col("node") == n) & F.col("key").between(v[2], v[3]) for n, v in open_.items()]))
            .groupBy("node", F.floor((F.col("key") - pick(lambda n: F.lit(open_[n][2]))) / pick(lambda n: F.lit(width[n]))).alias("bin"))
            .agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        for n in list(open_):
            d, goal, low, high = open_[n]
            at = below[n]
            best = (abs(goal - at), low)
            inner = None
            for b in sorted((b for b in bins if b["node"] == n), key=lambda b: b["bin"]):
                if at <= goal < at + b["weight"]:
                    inner = (at, b["low"], b["high"])
                at += b["weight"]
                best = min(best, (abs(goal - at), b["high"] + 1))
            if inner is None or best[0] <= slack or inner[1] == inner[2]:
                done[n] = best[1]
                del open_[n]
            else:
                below[n] = inner[0]
                open_[n] = (d, goal, inner[1], inner[2])
    return done


def kd_tree(units: DataFrame, shards: int) -> Column:
    """The shard of a unit, as an expression over its keys. Nodes are cut level by level where their
    weight divides by the leaves on either side, along the dimension with the widest spread."""
    units = keep(_keys(units), "units")
    total = float(units.agg(F.sum("weight")).first()[0] or 0)
    slack = 0.001 * total / shards
    # A node is the range of shards it will hold; its number is its first shard.
    nodes, expression = {0: shards}, F.lit(0)
    while any(n > 1 for n in nodes.values()):
        parents = {first: n for first, n in nodes.items() if n > 1}
        seen = units.groupBy(expression.alias("node")).agg(
            F.sum("weight").alias("weight"), *[f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]
        )
        goals = {}
        for row in seen.collect():
            if row["node"] in parents:
                n = parents[row["node"]]
                d = max(DIMENSIONS, key=lambda d: (row[f"{d}_max"] >> (TEXT_BITS + FINE)) - (row[f"{d}_min"] >> (TEXT_BITS + FINE)))
                goals[row["node"]] = (d, row["weight"] * (n // 2) / n, row[f"{d}_min"], row[f"{d}_max"])
        cuts = _cuts(units, expression, goals, slack)
        branches = [(first, goals[first][0], cuts[first], first + n // 2) for first, n in parents.items() if first in cuts]
        before = expression
        for first, d, cut, right in branches:
            expression = F.when((before == first) & (F.col(d) >= cut), right).otherwise(expression)
        nodes = {k: v for first, n in nodes.items() for k, v in ([(first, n)] if n == 1 else [(first, n // 2), (first + n // 2, n - n // 2)])}
        # The level is stored, so that the next expression starts from a plain column.
        units = keep(units.withColumn("node", expression), "tree")
        expression = F.col("node")
    return units.select("text_hash", "chunk", F.col("node").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 24, whole_share: float = 0.02, rows_per_bin: int = 500) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, optional source and lang) to one of ``shards`` shards
    whose bytes are near equal: ``doc_id, size, text_crc32, shard, slot``.

    Rows with equal texts share a shard, unless a cut meets a text whose rows weigh more than
    ``whole_share`` of a shard. ``slot`` counts the rows of a shard from 0 without gaps; it's ranked in
    bins of about ``rows_per_bin`` rows, so no task ranks a whole shard. Null text counts as empty, null
    doc_id, source and lang are ordinary values, repeated rows are separate rows of one text, other
    columns are not read, and an empty table gives an empty result.
    """
    rows, units = _units(docs, shards, whole_share)
    placed = keep(
        rows.join(kd_tree(units, shards), ["text_hash", "chunk"]).select("doc_id", "size", "text_crc32", "shard"), "placed"
    )
    bins = max(1, round(placed.count() / shards / rows_per_bin))
    placed = placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(bins)))
    starts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "bin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["shard", "bin"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    )
