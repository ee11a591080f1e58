"""Token ids in patched frame-of-reference blocks: written in doc_id order, indexed, read back.

The file format (version 1) is one binary segment per row of a Parquet table, so that Spark writes and
reads it on any store. All integers are little-endian.

    segment  = "PFR1", u32 documents, u32 blocks, u64 ids,
               documents * u32 ids of each document,
               blocks * u32 block start (from the segment's first byte), blocks
    block    = u32 minimum, u16 ids, u8 width, u16 exceptions,
               exceptions * u16 position, exceptions * u32 full offset,
               ids packed at that width, lowest bit first, filled up to a byte

A block subtracts its minimum and packs the differences at the width that covers the given percentile
of them, if that is smaller with its exceptions than the full width; the larger ones go to the list.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendgrid.llm.common import keep, texts
from mendgrid.llm.token_cache import encoder

MAGIC = b"PFR1"


def _width(offsets: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(offsets.astype(np.float64))[1].astype(np.uint8)


def _packed(offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of offsets, each row packed at ``width`` bits."""
    bits = np.unpackbits(offsets.astype("<u4").view(np.uint8).reshape(*offsets.shape, 4), axis=2, count=width, bitorder="little")
    return np.packbits(bits.reshape(len(offsets), -1), axis=1, bitorder="little")


def _pack_blocks(rows: np.ndarray, percentile: float) -> list[bytes]:
    """Blocks of equal length; those that share a width are packed together."""
    n = rows.shape[1]
    low = rows.min(axis=1)
    offsets = rows - low[:, None]
    widths = _width(offsets)
    full = widths.max(axis=1)
    narrow = np.partition(widths, (at := min(n - 1, int(n * percentile / 100))), axis=1)[:, at]
    cost = (widths > narrow[:, None]).sum(axis=1) * 48 + n * narrow.astype(np.int64)
    width = np.where(cost < n * full.astype(np.int64), narrow, full)
    over = widths > width[:, None]
    rest = np.where(over, 0, offsets)
    out: list[bytes] = [b""] * len(rows)
    many = over.sum(axis=1)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        body = _packed(rest[of], int(w))
        for k, b in zip(of.tolist(), body, strict=True):
            at = np.flatnonzero(over[k]) if many[k] else many[:0]
            listed = at.astype("<u2").tobytes() + offsets[k][at].astype("<u4").tobytes() if many[k] else b""
            out[k] = struct.pack("<IHBH", low[k], n, w, many[k]) + listed + b.tobytes()
    return out


def pack_segment(ids: np.ndarray, lengths: list[int], block: int = 128, percentile: float = 90) -> bytes:
    whole = len(ids) // block * block
    blocks = _pack_blocks(ids[:whole].reshape(-1, block), percentile) if whole else []
    blocks += _pack_blocks(ids[whole:].reshape(1, -1), percentile) if len(ids) > whole else []
    head = MAGIC + struct.pack("<IIQ", len(lengths), len(blocks), len(ids)) + np.array(lengths, "<u4").tobytes()
    starts = len(head) + 4 * len(blocks) + np.cumsum([0, *map(len, blocks)][:-1] if blocks else [])
    return head + starts.astype("<u4").tobytes() + b"".join(blocks)


def unpack_segment(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the documents, ids of blocks ``first`` to ``last``, all by default)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    documents, blocks, _ = struct.unpack_from("<IIQ", data, 4)
    lengths = np.frombuffer(data, "<u4", documents, 20)
    starts = np.frombuffer(data, "<u4", blocks, 20 + 4 * documents)[first:last].tolist()
    heads = [struct.unpack_from("<IHBH", data, s) for s in starts]
    ends = np.cumsum([0, *(h[1] for h in heads)]).tolist()
    out = np.empty(ends[-1], np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, width, _) in enumerate(heads):
        alike.setdefault((n, width), []).append(k)
    for (n, width), of in alike.items():
        size = -(-n * width // 8)
        body = b"".join(data[(a := starts[k] + 9 + 6 * heads[k][3]) : a + size] for k in of) + bytes(8)
        # The eight bytes from each byte on: a number begins in the first of them and takes 39 bits at most.
        eight = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))
        at = np.arange(n) * width
        places = (np.arange(len(of)) * size)[:, None] + (at >> 3)
        values = ((eight[places] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        for k, row in zip(of, values, strict=True):
            low, _, _, over = heads[k]
            if over:
                where = np.frombuffer(data, "<u2", over, starts[k] + 9)
                row[where] = np.frombuffer(data, "<u4", over, starts[k] + 9 + 2 * over)
            out[ends[k] : ends[k + 1]] = row + np.uint32(low)
    return lengths, out


SEGMENTS = "part int, segment int, before long, doc_ids array<long>, tokens long, data binary"


def _encode(path: str, end_id: int, block: int, percentile: float, fill: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0
        encode, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()

        def row() -> pa.RecordBatch:
            data = pack_segment(np.frombuffer(b"".join(parts), "<u4"), [len(p) // 4 for p in parts], block, percentile)
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "before", "doc_ids", "tokens", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
                if held >= fill:
                    yield row()
                    number, before, doc_ids, parts, held = number + 1, before + held, [], [], 0
        if doc_ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, target: str | None = None, block: int = 128, percentile: float = 90, fill: int = 1 << 16) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending doc_id order; returns the table
    of segments. A segment closes at ``fill`` ids and holds whole documents. ``target``: a folder of the
    caller's; the shared work folder by default.

    Null text counts as empty: such a document has the end id alone. A null doc_id comes first. Repeated
    rows are documents of their own, ties in doc_id are in the order of their texts. Other columns are
    not read, and an empty table gives no segment.
    """
    rows = texts(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = rows.mapInArrow(_encode(path, end_id, block, percentile, fill), SEGMENTS)
    if target is None:
        return keep(segments, "tokens")
    segments.write.parquet(target)
    return docs.sparkSession.read.schema(segments.schema).parquet(target)


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, doc_ids, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            lengths, ids = unpack_segment(data.as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            flat = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            starts = start.as_py() + ends - lengths
            arrays = [pa.array(doc_ids.as_py(), pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the segments alone. ``start`` is the
    number of ids of all documents before it: a segment knows those of its part, and parts are summed in order."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task that wrote; the segments stay where they are.
    parts = segments.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("n"))
    parts = F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    starts = segments.join(parts, "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "data")
    return starts.mapInArrow(_decode, ROWS)
