"""Near-duplicate vectors: an exact metric range join on pivot cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.common import keep
from mendgrid.llm.graph import components

CELL, MOST_PIVOTS = 2048, 2048
TILE = 1024
_SLACK = 1e-9  # rounding of distances; pairs are judged on their cosine itself

CLASSES = "vec_id long, label string, dim int, class binary, vector binary"


def _classes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for vec_id, vector, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            usable = label is not None and vector and None not in vector
            v = np.array(vector, np.float64) if usable else np.empty(0)
            if not len(v) or not np.isfinite(v).all() or not v.any():
                out.append((vec_id, label, 0, None, None))
            else:
                name = hashlib.blake2b((v + 0.0).tobytes() + label.encode(), digest_size=16).digest()
                out.append((vec_id, label, len(v), name, v.tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["vec_id", "label", "dim", "class", "vector"])


def _unit(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


PLACED = "class binary, label string, dim int, cell int, native boolean, copies long, vector binary"


def _place(pivots: dict[tuple[str, int], np.ndarray], radius: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            names, labels, dims, copies, vectors = (batch.column(i).to_pylist() for i in range(5))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for (label, dim), of in groups.items():
                p = pivots.get((label, dim))
                if p is None:
                    at, cell, home = np.arange(len(of)), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                else:
                    u = _unit([vectors[i] for i in of])
                    square = np.maximum(0, 2 - 2 * u @ p.T)
                    far = np.sqrt(square)
                    home = far.argmin(axis=1)
                    mine = far[np.arange(len(of)), home][:, None]
                    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                    # A link reaches cell j only if neither the triangle inequality nor the distance to the
                    # plane between both pivots is against it. Of two cells, the lower one sees the pair.
                    reach = (far - mine <= 2 * radius + _SLACK) & (square - mine**2 <= 2 * radius * between + _SLACK)
                    reach &= np.arange(len(p))[None, :] < home[:, None]
                    reach[np.arange(len(of)), home] = True
                    at, cell = np.nonzero(reach)
                back = [of[i] for i in at.tolist()]
                arrays = [
                    pa.array([names[i] for i in back], pa.binary()), pa.array([label] * len(back), pa.string()), pa.array([dim] * len(back), pa.int32()),
                    pa.array(cell.astype(np.int32)), pa.array(cell == home[at]), pa.array([copies[i] for i in back], pa.int64()), pa.array([vectors[i] for i in back], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["class", "label", "dim", "cell", "native", "copies", "vector"])

    return run


LINKS = "class binary, links long, reaches binary"


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        left = table.filter(table["side"].to_numpy() != 1)
        right = table.filter(table["side"].to_numpy() != 0)
        names = [left["class"].to_pylist(), right["class"].to_pylist()]
        copies = [left["copies"].to_numpy(), right["copies"].to_numpy()]
        out = []
        if left.num_rows and right.num_rows:
            raw = [np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (left, right)]
            unit = [_unit(t["vector"].to_pylist()) for t in (left, right)]
            same = bool((table["side"].to_numpy() == 2).all())
            s = unit[0] @ unit[1].T
            linked = s >= cosine
            for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-12), strict=True):  # by the definition
                a, b = raw[0][i], raw[1][j]
                linked[i, j] = np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= cosine
            if same:
                np.fill_diagonal(linked, False)
            sides = [(0, linked @ copies[1])] if same else [(0, linked @ copies[1]), (1, linked.T @ copies[0])]
            # Smallest member of each component of the tile, by spreading minima over its links.
            name = [np.arange(left.num_rows), np.arange(right.num_rows) + (0 if same else left.num_rows)]
            big = left.num_rows + right.num_rows
            while True:
                a = np.minimum(name[0], np.where(linked, name[1][None, :], big).min(axis=1))
                b = np.minimum(name[1], np.where(linked, a[:, None], big).min(axis=0))
                b = np.minimum(a, b) if same else b
                if (b == name[1]).all() and (a == name[0]).all():
                    break
                name = [b, b] if same else [a, b]
            every = names[0] if same else names[0] + names[1]
            for side, sums in sides:
                for i in np.flatnonzero(sums).tolist():
                    out.append((names[side][i], int(sums[i]), every[int(name[side][i])]))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["class", "links", "reaches"])

    return run


def vector_groups(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label). Two
    vectors are linked if their labels are equal and not null and their cosine is at least ``cosine``.

    Equal vectors of a label are one class with a number of copies. Labels with more than a cell's worth of
    classes get pivots (at most ``MOST_PIVOTS`` in all, which bounds what tasks hold); a class belongs to
    the cell of its nearest pivot and is replicated to each lower cell that a link could reach. A cell is
    compared in tiles of about ``TILE`` classes, so a dense one is spread over tasks; a tile returns link
    counts and one edge per linked class, never the pairs.

    Vectors that are null, empty, zero, or hold a null or non-finite component have no link, as do those
    with null label; vectors of different lengths are never compared. A null vec_id names a component only
    alone; repeated rows count as copies. Other columns are not read, and an empty table gives no rows.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = keep(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string")).mapInArrow(_classes, CLASSES), "vectors")
    classes = keep(rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    total = classes.count()
    cell = max(CELL, -(-total // MOST_PIVOTS))
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()
    pivots = {}
    for r in large:  # at most total / cell
        wanted = r["n"] // cell
        chosen = classes.where((F.col("label") == r["label"]) & (F.col("dim") == r["dim"]))
        picked = chosen.select("class", "vector").orderBy("class").limit(wanted).collect()
        pivots[r["label"], r["dim"]] = _unit([p["vector"] for p in picked])
    placed = keep(classes.select("class", "label", "dim", "copies", "vector").mapInArrow(_place(pivots, radius), PLACED), "cells")
    where = ["label", "dim", "cell"]
    counts = placed.groupBy(*where).agg(F.count_if("native").alias("natives"), F.count_if(~F.col("native")).alias("replicas"))
    counts = counts.select(*where, F.ceil(F.col("natives") / TILE).cast("int").alias("own"), F.ceil(F.col("replicas") / TILE).cast("int").alias("others"))
    tiled = placed.join(counts, where).withColumn("tile", F.pmod(F.xxhash64("class"), F.when(F.col("native"), F.col("own")).otherwise(F.col("others"))).cast("int"))
    task = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    t, zero = F.col("tile"), F.lit(0)
    upto = lambda n: F.filter(F.sequence(zero, F.greatest(n, zero)), lambda i: i < n)
    native = F.concat(
        F.transform(upto(F.col("own")), lambda i: task(0, F.least(i, t), F.greatest(i, t), F.when(i == t, 2).when(i > t, 0).otherwise(1))),
        F.transform(upto(F.col("others")), lambda i: task(1, t, i, zero)),
    )
    replica = F.transform(upto(F.col("own")), lambda i: task(1, i, t, F.lit(1)))
    tasks = tiled.withColumn("task", F.explode(F.when(F.col("native"), native).otherwise(replica))).select(*where, "task.*", "class", "copies", "vector")
    found = keep(tasks.groupBy(*where, "kind", "a", "b").applyInArrow(_compare(cosine), LINKS), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class").alias("a"), F.col("reaches").alias("b")))
    sized = classes.select("class", "copies").join(links, "class", "left").join(parts, F.col("class") == F.col("node"), "left")
    sized = sized.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("part"))
    named = rows.select("vec_id", "class").join(sized, "class", "left")
    least = named.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("least"))
    return named.join(least, "part", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
        F.when(F.col("part").isNull(), True).otherwise(F.col("vec_id").eqNullSafe(F.col("least"))).alias("kept"),
    )
