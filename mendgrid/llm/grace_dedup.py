"""Exact deduplication by Grace hashing with complete content comparison."""

from __future__ import annotations

import marshal
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.common import keep, texts

Record = tuple[bytes, bytes, int | None, int]  # digest, content, largest doc_id, rows

FAN_OUT = 16


class OpenTable:
    """Open addressing with linear probing; a hit needs equal content, not only an equal hash."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.records: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (i := self.slots[at]) >= 0 and not (self.records[i][0] == digest and self.records[i][1] == content):
            at = (at + 1) & mask
        return at

    def absorb(self, record: Record, room: bool) -> bool:
        """Add to the content's entry; a new one only if there is ``room``."""
        digest, content, doc_id, rows = record
        at = self._slot(digest, content)
        if self.slots[at] >= 0:
            entry = self.records[self.slots[at]]
            if doc_id is not None and (entry[2] is None or doc_id > entry[2]):
                entry[2] = doc_id
            entry[3] += rows
            return True
        if not room:
            return False
        self.slots[at] = len(self.records)
        self.records.append([digest, content, doc_id, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.records) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, (digest, content, *_) in enumerate(self.records):
                self.slots[self._slot(digest, content)] = i
        return True


def _spilled(path: Path) -> Iterator[Record]:
    with path.open("rb") as f:
        while True:
            try:
                yield marshal.load(f)
            except EOFError:
                return


def grace(records: Iterable[Record], memory: int, level: int = 0) -> Iterator[list]:
    """One entry per distinct content. What finds no room beside ``memory`` bytes of entries goes to
    spill files by the next four bits of its digest, and each file is treated the same way; every pass
    settles at least ``memory`` bytes of distinct content, so it ends for any mixture of copies."""
    table, files = OpenTable(), {}
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for record in records:
            if not table.absorb(record, table.bytes < memory):
                part = (record[0][-1 - level // 2] >> (4 * (level % 2))) % FAN_OUT
                if part not in files:
                    files[part] = Path(folder, str(part)).open("wb")
                marshal.dump(record, files[part])
        yield from table.records
        del table
        for f in files.values():
            f.close()
        for part in files:
            yield from grace(_spilled(Path(folder, str(part))), memory, level + 1)


CLASSES = "digest binary, content binary, keep_id long, group_size long"


def _combine(memory: int, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        def batch(rows: list[list]) -> pa.RecordBatch:
            digest, content, ids, counts = zip(*rows, strict=True)
            content = pa.array(content if with_content else [None] * len(rows), pa.binary())
            arrays = [pa.array(digest, pa.binary()), content, pa.array(ids, pa.int64()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["digest", "content", "keep_id", "group_size"])

        held, weight = [], 0
        for entry in grace(records(), memory):
            held.append(entry)
            weight += len(entry[1]) + 100
            if weight > 8 << 20:
                yield batch(held)
                held, weight = [], 0
        if held:
            yield batch(held)

    return run


def exact_groups(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row: rows with identical texts form a
    group, and the one with the largest doc_id stays.

    Each scan task first merges its own copies, so a group of any size reaches the shuffle as one record
    per task; then the records of a hash partition are merged by Grace hashing (see ``grace``).
    Null text counts as empty. A null doc_id is below every other. Rows that repeat doc_id and text are
    one document and carry the same values. Other columns are not read; an empty table gives no rows.
    """
    rows = texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.encode("text", "UTF-8").alias("content"))
    local = rows.select("digest", "content", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_combine(memory, True), CLASSES)
    merged = local.repartition("digest").mapInArrow(_combine(memory, False), CLASSES)
    classes = keep(merged.select("digest", "keep_id", "group_size"), "classes")
    return (
        rows.select("doc_id", "digest")
        .join(classes, "digest")
        .select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of equal texts the largest doc_id, once."""
    kept = exact_groups(docs.select("doc_id", "text"), memory).where("kept").select("doc_id", "text_sha256").distinct()
    marked = docs.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    on = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked["__digest"] == kept["text_sha256"])
    return marked.join(kept, on, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")
