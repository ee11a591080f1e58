"""Fixed-length training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mendgrid.llm.common import texts
from mendgrid.llm.token_cache import encoder


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items (by index) of each of ``windows`` windows with near equal sums.

    Every item starts as a partition of its own: one filled window, the others empty. The two partitions
    with the largest imbalance (largest less smallest window) are merged, the fullest window of one with
    the emptiest of the other, until one is left. Empty windows are not stored, and a window's items are
    a tree of the windows merged into it, which is read off at the end.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    tree: list[tuple[int, int] | int] = list(range(len(sizes)))

    def imbalance(sums: np.ndarray) -> int:
        return int(sums[0] - (sums[-1] if len(sums) == windows else 0))

    heap = []
    for i, size in enumerate(sizes):
        sums = np.array([size], np.int64)
        heap.append((-imbalance(sums), i, sums, np.array([i])))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        clash = max(0, len(a) + len(b) - windows)  # the emptiest of a meet the fullest of b, the rest meet empty windows
        sums = np.concatenate([a[: len(a) - clash], a[len(a) - clash :] + b[clash - 1 :: -1] if clash else a[:0], b[clash:]])
        nodes = np.concatenate([at[: len(a) - clash], np.arange(len(tree), len(tree) + clash), bt[clash:]])
        tree.extend(zip(at[len(a) - clash :].tolist(), bt[clash - 1 :: -1].tolist(), strict=True) if clash else ())
        rank = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (-imbalance(sums[rank]), order, sums[rank], nodes[rank]))
        order += 1
    found = []
    for node in heap[0][3].tolist():
        stack, items = [node], []
        while stack:
            if isinstance(n := tree[stack.pop()], tuple):
                stack.extend(n)
            else:
                items.append(n)
        found.append(items)
    return found + [[] for _ in range(windows - len(found))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items (each at most ``capacity``) in as few windows as differencing manages; the number
    rises by one as long as a window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        windows += 1


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) without padding, cut where needed.

    Whole capacities are cut off long items. The rest is differenced into windows; a window above the
    capacity gives its excess to those below. What remains of the last window is laid out in powers of
    two, which need no padding either.
    """
    done, rest = [], []
    for i, size in enumerate(sizes):
        full = size // capacity
        done += [[(i, k * capacity, capacity)] for k in range(full)]
        if size % capacity:
            rest.append((i, full * capacity, size % capacity))
    total = sum(n for _, _, n in rest)
    if not total:
        return done
    windows = difference([n for _, _, n in rest], -(-total // capacity))
    filled, spare = [], []
    weights = [sum(rest[i][2] for i in w) for w in windows]
    for w in sorted(range(len(windows)), key=lambda w: -weights[w]):
        pieces, left = [], capacity
        for i in sorted(windows[w], key=lambda i: rest[i][2]):
            item, start, n = rest[i]
            take = min(n, left)
            if take:
                pieces.append((item, start, take))
            if take < n:
                spare.append((item, start + take, n - take))
            left -= take
        filled.append((left, pieces))
    open_ = [x for x in filled if x[0]]
    done += [pieces for left, pieces in filled if not left]
    last = open_.pop() if open_ else (capacity, [])  # the emptiest gives way if the others can't be filled
    for left, pieces in open_:
        while left:
            source = spare or last[1]
            item, start, n = source.pop()
            take = min(n, left)
            pieces.append((item, start, take))
            if take < n:
                source.append((item, start + take, n - take))
            left -= take
        done.append(pieces)
    tail = last[1] + spare
    remaining = sum(n for _, _, n in tail)
    while remaining:
        size = min(capacity, 1 << (remaining.bit_length() - 1))
        pieces, left = [], size
        while left:
            item, start, n = tail.pop()
            take = min(n, left)
            pieces.append((item, start, take))
            if take < n:
                tail.append((item, start + take, n - take))
            left -= take
        done.append(pieces)
        remaining -= size
    return done


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40

        def rows(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces in pack([len(ids) // 4 for _, ids in held], capacity):
                offset = 0
                for i, start, n in pieces:
                    doc_id, ids = held[i]
                    out.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset))
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        held, tokens = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= group:
                    yield rows(held)
                    held, tokens = [], 0
        if held:
            yield rows(held)

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, group: int = 1 << 20) -> DataFrame:
    """Sequences of at most ``capacity`` tokens over all documents, one row per piece: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset``.

    A scan task packs what it reads in groups of about ``group`` tokens, so nothing is shuffled, no group
    grows with the input, and a lost task packs the same rows again. ``pack`` says how; every sequence is
    ``capacity`` long but the last few of a group, whose lengths are smaller powers of two. Null text counts
    as empty: such a document is its end id. Repeated rows and null doc_ids are documents of their own.
    Other columns are not read; an empty table gives no rows.
    """
    return texts(docs).mapInArrow(_pack(path, end_id, capacity, group), PIECES)
