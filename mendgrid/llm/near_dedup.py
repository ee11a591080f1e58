"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendgrid.llm.common import keep, texts
from mendgrid.llm.graph import components
from mendgrid.llm.shingles import batches, mix, shingle_sets

BINS, ROWS_PER_BAND = 256, 6
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _STEP  # of the rounds


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketching: a row of ``BINS`` values per set (sets without elements stay unset).

    In round i of the first BINS rounds every element is hashed to one bin and a value; a bin keeps the
    least value of the first round that reaches it. In the rounds after that, each element goes to bin
    i - BINS, so every bin of a set with elements is filled. Rounds end for a set when its bins are full,
    for a set of n elements after about BINS log BINS / n rounds. Two sets agree in a bin with the
    probability of their Jaccard similarity, and closer to it than by independent minima.
    """
    out = np.full((len(sets), BINS), _UNSET, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate([np.empty(0, np.uint64), *sets])
    for i in range(BINS):
        if not len(element):
            return out
        x = mix(element + _SEEDS[i])
        at = owner * BINS + (x >> np.uint64(56)).astype(np.int64)
        open_ = flat[at] == _UNSET
        at, value = at[open_], (x[open_] << np.uint64(8)) >> np.uint64(9)
        fresh = np.unique(at) if i else None  # bins that this round fills
        np.minimum.at(flat, at, value)
        if i:
            flat[fresh] = mix(flat[fresh] + np.uint64(i)) >> np.uint64(1)
        wanting = (out == _UNSET).any(axis=1)
        still = wanting[owner]
        owner, element = owner[still], element[still]
    for k in np.unique(owner):
        own = element[owner == k]
        for b in np.flatnonzero(out[k] == _UNSET):
            out[k, b] = mix(own + _SEEDS[BINS + b]).min() >> np.uint64(1)
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """One hash per ``ROWS_PER_BAND`` neighbouring bins. At similarity 0.8 two sets share none of the 42
    bands with a probability of about 3e-6; at 0.3 they share one with 3 percent."""
    parts = sketches[:, : BINS // ROWS_PER_BAND * ROWS_PER_BAND].reshape(len(sketches), -1, ROWS_PER_BAND)
    x = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(parts), 1), np.uint64)
    for j in range(ROWS_PER_BAND):
        x = mix(x * _STEP + parts[:, :, j])
    return x.view(np.int64)


SKETCHES = "doc_id long, text_key long, n_shingles long, class binary, bands array<long>"


def _sketch(words: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, keys = batch.column(0), batch.column(1)
            for first, data in batches(batch.column(2).to_pylist()):
                sets = shingle_sets(data, words)
                found = bands(sketch(sets))
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                offsets = np.arange(len(sets) + 1, dtype=np.int32) * found.shape[1]
                arrays = [
                    ids.slice(first, len(sets)), keys.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, found.reshape(-1)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "class", "bands"])

    return run


def _shingles(words: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, data in batches(batch.column(1).to_pylist()):
                sets = shingle_sets(data, words)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(offsets, flat)], ["class", "shingles"]
                )

    return run


def _size_class(n: Column) -> Column:
    """Sizes in steps of four percent."""
    return F.floor(F.log(n.cast("double")) * 25)


def _rare_shingle_pairs(open_: DataFrame, whole: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different parts that can reach ``percent``, by exact filters.

    All shingles have one order, rarest first. If the first shingle that two sets share is the i-th of one
    and the j-th of the other, they share at most 1 + min(n_a - i, n_b - j), and must share
    percent * (n_a + n_b) / (100 + percent). Classes meet under shingles early enough for that, and by sizes:
    a class stands under each shingle once for every size class of partners that could still reach the
    bound from there. So texts that have much in common, but not enough, stand under few common keys.
    Under one key the largest part is joined with the others only, never with itself.
    """
    held = open_.select("class", "part", "n").distinct()
    words_of = whole.join(held.select("class"), "class").select("class", "text").mapInArrow(_shingles(words), "class binary, shingles array<long>")
    each = keep(words_of.select("class", F.explode("shingles").alias("shingle")), "shingles")
    # Shingles of one class only can't bring two together, but they fill its front: they rank as 1.
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(common, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "shingle"))
    n, rest = F.col("n"), F.col("n") - F.col("place") + 1  # shingles from this one on
    smallest, largest = F.ceil(n * percent / 100), F.floor(n * 100 / percent)
    least_size = F.greatest(smallest, F.ceil(F.exp(F.col("want") / 25.0) * (1 - 1e-9)))
    front = ranked.withColumn("place", place).join(held, "class").where("df > 1").where(rest >= smallest)
    front = (
        front.withColumn("rest", rest).withColumn("own", _size_class(n))
        .withColumn("want", F.explode(F.sequence(_size_class(smallest), _size_class(largest))))
        .where(F.col("rest") * (100 + percent) >= (n + least_size) * percent)
        .select("shingle", F.least("own", "want").alias("low"), F.greatest("own", "want").alias("high"), "own", "class", "part", "n", "rest")
    )
    front = keep(front, "front")
    key = ["shingle", "low", "high"]
    sizes = front.groupBy(*key, "part").agg(F.count("*").alias("m"))
    major = sizes.groupBy(key).agg(F.max_by("part", F.struct("m", "part")).alias("major"), F.count("*").alias("parts"))
    front = front.join(major.where("parts > 1").drop("parts"), key).withColumn("want", F.col("low") + F.col("high") - F.col("own"))
    left = front.select("shingle", "own", "want", F.col("class").alias("a"), "part", "n", "rest", "major")
    right = front.where("part <> major").select(
        "shingle", F.col("want").alias("own"), F.col("own").alias("want"),
        F.col("class").alias("b"), F.col("part").alias("p_part"), F.col("n").alias("p_n"), F.col("rest").alias("p_rest"),
    )
    once = (F.col("part") == F.col("major")) | (F.col("a") < F.col("b"))
    enough = F.least("rest", "p_rest") * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent
    return left.join(right, ["shingle", "own", "want"]).where(once & (F.col("part") != F.col("p_part")) & enough).select("a", "b")


JUDGED = "a binary, b binary, shared long, total long"


def _judge(words: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in rows:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a_text, b_text = batch.column(2), batch.column(3)
            shared, total = [], []
            for i in range(len(a)):
                if b[i] != last:  # rows come sorted by b
                    last, last_set = b[i], shingle_sets([b_text[i].as_py().encode("utf-8", "surrogatepass")], words)[0]
                own = shingle_sets([a_text[i].as_py().encode("utf-8", "surrogatepass")], words)[0]
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                shared.append(both)
                total.append(len(own) + len(last_set) - both)
            arrays = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "shared", "total"])

    return run


def near_groups(docs: DataFrame, words: int = 2, percent: int = 80, pivot_rounds: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row. Two documents are linked if their sets of
    ``words``-word shingles share at least ``percent`` percent of their union; a component is what links
    reach, named by its smallest doc_id, which is kept.

    Documents with equal sets are one class. Classes that share a band are candidates, and every link is
    confirmed on the whole sets. No bucket is expanded into pairs: in each round a bucket's members that
    aren't yet connected to a pivot of it are compared with that pivot only, and the pivot leaves the
    bucket. Classes that are still open after ``pivot_rounds`` rounds meet under their rare shingles, which
    loses no link among them. Members that are connected already need no comparison, so the components
    are those of all links.

    Null text counts as empty; without words a document has no shingles and no link. A null doc_id is
    never the name of a component unless it's alone. Rows that repeat doc_id and text carry the same
    values. Other columns are not read; an empty table gives no rows.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketched = keep(rows.mapInArrow(_sketch(words), SKETCHES), "sketches")
    classes = (
        sketched.where("n_shingles > 0").groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    buckets = classes.select("class", "n", "first.doc_id", "first.text_key", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.count("*").alias("members")).where("members > 1").drop("members")
    members = keep(buckets.join(shared, ["band", "hash"]).withColumn("bucket", F.xxhash64("band", "hash")), "members")
    involved = members.select("class", F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).distinct()
    on = rows["doc_id"].eqNullSafe(involved["c_id"]) & (rows["text_key"] == involved["c_key"])
    whole = keep(rows.join(involved, on).groupBy("class").agg(F.first("text").alias("text")), "whole")
    members = members.select("bucket", "class", "n")

    def judge(pairs: DataFrame) -> DataFrame:
        a = whole.select(F.col("class").alias("a"), F.col("text").alias("a_text")).hint("merge")
        b = whole.select(F.col("class").alias("b"), F.col("text").alias("b_text")).hint("merge")
        joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text")
        return keep(joined.mapInArrow(_judge(words), JUDGED), "judged")

    parts = None  # of the links so far
    state = members.withColumn("part", F.col("class"))
    size_ok = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    for turn in range(pivot_rounds + 1):
        mixed = state.groupBy("bucket").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("bucket")
        open_ = keep(state.join(mixed, "bucket"), "open")
        if open_.isEmpty():
            break
        if turn < pivot_rounds:
            order = F.struct(F.xxhash64("class", F.lit(turn)) if turn else F.lit(0), "class", "part", "n")
            pivot = open_.groupBy("bucket").agg(F.min(order).alias("p")).select(
                "bucket", F.col("p.class").alias("pivot"), F.col("p.part").alias("p_part"), F.col("p.n").alias("p_n")
            )
            near = open_.join(pivot, "bucket")
            pairs = near.where((F.col("part") != F.col("p_part")) & size_ok).select(F.col("class").alias("a"), F.col("pivot").alias("b"))
        else:
            pairs = _rare_shingle_pairs(open_, whole, words, percent)
        judged = judge(pairs.distinct())
        found = judged.where(F.col("shared") * 100 >= F.col("total") * percent).select("a", "b")
        grown = not found.isEmpty()
        if grown:
            # A component stands in for its links: later rounds add to it.
            parts = components(found if parts is None else parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
        if turn == pivot_rounds:
            break
        # The pivot has been compared with every member that isn't connected to it: it leaves the bucket.
        state = near.where(F.col("class") != F.col("pivot")).select("bucket", "class", "n", "part")
        if grown:
            state = state.drop("part").join(parts, F.col("class") == F.col("node"), "left")
            state = state.select("bucket", "class", "n", F.coalesce("component", "class").alias("part"))
            state = keep(state, "state")
    named = sketched.select("doc_id", "n_shingles", "class")
    if parts is None:
        placed = named.withColumn("part", F.col("class"))
    else:
        placed = named.join(parts, named["class"] == parts["node"], "left").select("doc_id", "n_shingles", "class", F.coalesce("component", "class").alias("part"))
    least = placed.where("n_shingles > 0").groupBy("part").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "part", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("doc_id").eqNullSafe(F.col("least"))).otherwise(True).alias("kept"),
    )


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is kept, all columns as they are."""
    kept = near_groups(docs.select("doc_id", "text"), words, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
