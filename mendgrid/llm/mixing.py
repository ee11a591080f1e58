"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendgrid.llm.common import keep, word_count

# The golden ratio's fraction in units of 2**-64: its multiples modulo 2**64 spread evenly at any length.
GOLDEN = 0x9E3779B97F4A7C15
CHUNK = 1 << 14  # slots that one task step maps at a time
SOURCES = 100_000  # more distinct sources than this are refused: their weights are held by every task


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float, most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last. The weights repeat along that order; together the
    targets are ``share`` of all sizes. One above ``most`` times its source's size stops there, and the
    excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {i: weights[i % len(weights)] for i in range(len(order))}
    total = share * sum(n for _, n in order)
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in weight if i not in fixed]
        left = total - sum(fixed.values())
        scale = left / sum(weight[i] for i in free) if free else 0.0
        above = [i for i in free if weight[i] * scale > most * order[i][1]]
        if not above:
            return [(s, n, fixed.get(i, weight[i] * scale)) for i, (s, n) in enumerate(order)]
        fixed |= {i: most * float(order[i][1]) for i in above}


def slot_sources(slots: np.ndarray, cumulative: np.ndarray) -> np.ndarray:
    """The source of each slot: where its point, a multiple of the golden ratio modulo 1, falls in the
    cumulative shares."""
    points = (slots.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(np.searchsorted(cumulative, points, side="right"), len(cumulative) - 1)


SLOTS = "chunk long, slot long, source_no int, chunk_rank long"


def _slots(cumulative: list[float], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(cumulative)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slots = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, total))
                source = slot_sources(slots, bounds)
                by = np.argsort(source, kind="stable")
                first = np.searchsorted(source[by], source[by], side="left")
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by)) - first
                arrays = [pa.array(np.full(len(slots), chunk)), pa.array(slots), pa.array(source.astype(np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "slot", "source_no", "chunk_rank"])

    return run


def _running(df: DataFrame, keys: list[str], order: list[str], what: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(w), F.lit(0))


def schedule(spark, plan: list[tuple[str | None, int, float]], block: int) -> DataFrame:
    """``slot, source_no, rank``: which block number of its source each slot of the mix takes. Slots are
    mapped in chunks; ranks are counted in a chunk and offset by the chunks before it. The points give a
    source a few slots more or less than its target; what is missing is appended, so all targets are met."""
    total = sum(t for _, _, t in plan)
    slots = int(-(-total // block))
    cumulative = (np.cumsum([t for _, _, t in plan]) / total).tolist() if total else []
    chunks = spark.range(-(-slots // CHUNK))
    points = chunks.mapInArrow(_slots(cumulative, slots), SLOTS)
    counts = keep(points.groupBy("source_no", "chunk").agg(F.count("*").alias("n")), "slot_counts")
    have = np.zeros(len(plan), np.int64)
    for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        have[r["source_no"]] = r["n"]
    before = counts.withColumn("before", _running(counts, ["source_no"], ["chunk"], "n")).drop("n")
    # Both sides grow with the mix, which the planner can't see behind Arrow: no broadcast.
    drawn = points.join(before.hint("merge"), ["source_no", "chunk"]).select("slot", "source_no", (F.col("before") + F.col("chunk_rank")).alias("rank"))
    missing = spark.createDataFrame(_missing(plan, have, slots, block), "slot long, source_no int, rank long")
    return drawn.unionByName(missing)


def _missing(plan: list[tuple[str | None, int, float]], have: np.ndarray, slots: int, block: int) -> list[tuple[int, int, int]]:
    """(slot, source_no, rank) of the blocks that a source's target holds beyond its ``have`` slots. They
    follow the last slot, a block of each short source in turn."""
    need = np.array([-(-int(t) // block) for _, _, t in plan], np.int64)
    short = np.maximum(need - have, 0)
    source = np.repeat(np.arange(len(plan)), short)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(short) - short, short)
    by = np.lexsort((source, nth))
    return list(zip(range(slots, slots + len(by)), source[by].tolist(), (have[source] + nth)[by].tolist(), strict=True))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, rows_per_bin: int = 500) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: ``doc_id, source, size, source_size, target, start`` for every row,
    where ``start`` is its place in its source's shuffled stream of words. pieces: ``slot, doc_id, row_key,
    pass, from_word, words``, what each slot of the mix takes, in schedule order.

    A source's documents are shuffled by hash and its stream is cut into equal blocks of ``block`` words;
    the stream repeats after its end, so block r covers words r * block to (r + 1) * block of the repeated
    stream. The schedule gives slot by slot the next block of a source. A source reaches its target, cut
    to the word, and a target is at most ``most`` times its size, so no word is taken more often.

    Sizes are words; null text has none and an empty document takes part without words. Null source is
    a source. Rows that repeat doc_id and text are separate documents. Other columns are not read. An
    empty table gives empty results. Reruns give the same mix: the shuffle is a hash of doc_id and text.
    """
    spark = docs.sparkSession
    rows = keep(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text", F.lit(7)).alias("shuffle_key"),
        ),
        "sizes",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(SOURCES + 1).collect()
    if len(per_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    plan = targets([(r["source"], r["n"]) for r in per_source], list(weights), share, most)
    rows_of = {r["source"]: r["rows"] for r in per_source}
    numbers = spark.createDataFrame(
        [(i, s, n, float(t), max(1, rows_of[s] // rows_per_bin)) for i, (s, n, t) in enumerate(plan)],
        "source_no int, source string, source_size long, target double, bins long",
    )
    placed = rows.join(numbers, rows["source"].eqNullSafe(numbers["source"])).drop(numbers["source"])
    # Bins of the hash, so that no task lines up a whole source.
    spread = F.shiftrightunsigned("shuffle_key", 33)
    placed = placed.withColumn("bin", F.floor(spread * F.col("bins") / F.lit(float(1 << 31))).cast("long"))
    bins = placed.groupBy("source_no", "bin").agg(F.sum("size").alias("n"))
    bins = bins.withColumn("base", _running(bins, ["source_no"], ["bin"], "n")).drop("n")
    inner = _running(placed, ["source_no", "bin"], ["shuffle_key", "doc_id"], "size")
    documents = keep(
        placed.withColumn("inner", inner).join(bins, ["source_no", "bin"])
        .select("doc_id", "source", "size", "source_no", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"), "shuffle_key"),
        "placed",
    )
    # A document meets block r where they overlap, in each pass of the repeated stream.
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.lit(most)).cast("int") - 1)).alias("pass")
    spans = documents.where("size > 0").select("doc_id", "shuffle_key", "source_no", "source_size", "target", "size", "start", passes)
    spans = spans.withColumn("low", F.col("pass") * F.col("source_size") + F.col("start"))
    spans = spans.withColumn("high", F.least(F.col("low") + F.col("size"), F.floor("target"))).where("low < high")
    blocks = F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))
    parts = spans.withColumn("rank", F.explode(blocks)).withColumn("from", F.greatest("low", F.col("rank") * block))
    parts = parts.withColumn("words", F.least("high", (F.col("rank") + 1) * block) - F.col("from"))
    pieces = parts.join(schedule(spark, plan, block).hint("merge"), ["source_no", "rank"]).select(
        "slot", "doc_id", "shuffle_key", "pass", (F.col("from") - F.col("low")).alias("from_word"), "words"
    )
    return documents, pieces


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document: the words that the mix takes of it,
    repeats counted."""
    # Rows that repeat doc_id and text share a key; their pieces are shared out evenly.
    keyed = pieces.groupBy(F.col("doc_id").alias("p_id"), F.col("shuffle_key").alias("p_key")).agg(F.sum("words").alias("words"))
    on = documents["doc_id"].eqNullSafe(keyed["p_id"]) & (documents["shuffle_key"] == keyed["p_key"])
    same = Window.partitionBy("doc_id", "shuffle_key").orderBy("start")
    copies = F.count("*").over(Window.partitionBy("doc_id", "shuffle_key"))
    words = F.coalesce("words", F.lit(0))
    part = F.floor(words / copies) + F.when(F.row_number().over(same) <= words % copies, 1).otherwise(0)
    return documents.join(keyed, on, "left").select("doc_id", "size", "source_size", "target", part.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass that takes words of a
    document, its whole text, or its first words where the target cuts it (at most one document a source
    and pass). Documents without words stay as they are: they add nothing to a source."""
    _, pieces = mix(docs, weights, share, most)
    passes = pieces.groupBy("doc_id", "shuffle_key", "pass").agg(F.sum("words").alias("words"))
    passes = passes.select(F.col("doc_id").alias("__id"), F.col("shuffle_key").alias("__key"), F.col("words").alias("__words"))
    keyed = docs.withColumn("__own", F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(7))).withColumn("__size", word_count(F.col("text")))
    joined = keyed.join(passes, keyed["doc_id"].eqNullSafe(passes["__id"]) & (keyed["__own"] == passes["__key"]), "left")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.col("__words").cast("int")), " ")
    taken_rows = joined.where("__size = 0 or __words is not null")
    text = F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col("text"))
    return taken_rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
