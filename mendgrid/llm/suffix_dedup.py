"""Removal of repeated byte strings by a distributed merge sort of suffixes that keeps common prefixes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.common import keep, texts
from mendgrid.llm.shingles import mix

WINDOW = 128  # starts of strings that share one anchor at most
BATCH = 2 << 20
HOT = 256  # a context that more anchors share is settled string by string
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

Item = tuple[bytes, bytes, bytes, int, int, int]  # suffix, text before it reversed, key, anchor, first and last start


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, hash of the common context) of a text. Each string of ``length``
    bytes has one anchor among its first WINDOW bytes: where the next eight bytes hash least, the leftmost
    such. So equal strings have equal anchors, and agree from there for at least length - WINDOW + 1 bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    out = []
    step = BATCH
    for low in range(0, n, step):  # starts low to high; long texts go in parts
        high = min(n, low + step)
        b = np.frombuffer(data, np.uint8, high - low + length - 1, low)
        size = high - low + WINDOW - 1
        eight = np.zeros(size, np.uint64)
        for j in range(8):
            eight |= b[j : j + size].astype(np.uint64) << np.uint64(8 * j)
        least = (mix(eight) >> np.uint64(24) << np.uint64(24)) | np.arange(size, dtype=np.uint64)
        w = 1
        while w < WINDOW:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        at = (least[: high - low] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        powers = np.ones(len(b), np.uint64)
        np.multiply.accumulate(np.full(len(b) - 1, _BASE), out=powers[1:])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers)])
        back = np.ones(len(b), np.uint64)
        np.multiply.accumulate(np.full(len(b) - 1, _INVERSE), out=back[1:])
        a = at[first]
        context = mix((sums[a + length - WINDOW + 1] - sums[a]) * back[a])
        out.append((a + low, first + low, last + low, context))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(items: list[Item]) -> bytes:
    """A sorted run: of each suffix the length it shares with the one before, and the rest."""
    out, last = [], b""
    for suffix, before, key, anchor, first, end in items:
        shared = common(last, suffix)
        out.append(struct.pack("<HHH16sqHH", shared, len(suffix) - shared, len(before), key, anchor, anchor - first, anchor - end))
        out.append(suffix[shared:] + before)
        last = suffix
    return zlib.compress(b"".join(out), 1)


def read_run(blob: bytes) -> Iterator[tuple[int, Item]]:
    data, at, last = zlib.decompress(blob), 0, b""
    while at < len(data):
        shared, rest, left, key, anchor, low, high = struct.unpack_from("<HHH16sqHH", data, at)
        at += 34
        last = last[:shared] + data[at : at + rest]
        yield shared, (last, data[at + rest : at + rest + left], key, anchor, anchor - low, anchor - high)
        at += rest + left


def merge(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """All items in order with the prefix each shares with the one before, by a loser tree. Every waiting item
    knows the prefix it shares with the last winner: the longer prefix wins unread, and only equal ones are
    compared, from there on; the loser then knows what it shares with the winner."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[list | None] = [None] * k
    for r, run in enumerate(runs):
        got = next(run, None)
        heads[r] = got and [0, got[1]]

    def play(x: int, y: int) -> tuple[int, int]:
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if a[0] != b[0]:
            return (x, y) if a[0] > b[0] else (y, x)
        s, t = a[1][0], b[1][0]
        n = common(s, t, a[0])
        if s[n : n + 1] <= t[n : n + 1]:
            b[0] = n
            return x, y
        a[0] = n
        return y, x

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        shared, item = heads[top]
        yield shared, item
        got = next(runs[top], None) if top < len(runs) else None
        heads[top] = got and [got[0], got[1]]
        i = (top + k) // 2
        while i:
            top, losers[i] = play(top, losers[i])
            i //= 2


def repeated(group: list[tuple[int, Item]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(key, first start, last start) of strings that also start elsewhere, from neighbours in order that
    agree on the context. Of two anchors that share R bytes onward and L bytes back, the strings that
    start length - R to L bytes before the anchor are equal."""
    for i, (_, (_, before, key, anchor, first, last)) in enumerate(group):
        open_ = [(anchor - last, anchor - first)]  # distances from start to anchor that aren't settled
        for step in (1, -1):
            onward, j = length, i
            while open_ and 0 <= j + step < len(group):
                j += step
                onward = min(onward, group[j if step == 1 else j + 1][0])
                if length - onward > open_[-1][1]:
                    break
                other = group[j][1]
                if other[2] == key and other[3] == anchor:
                    continue
                low, high = length - onward, common(before, other[1])
                left = []
                for a, z in open_:
                    s, e = max(a, low), min(z, high)
                    if s > e:
                        left.append((a, z))
                        continue
                    yield key, anchor - e, anchor - s
                    left += [x for x in ((a, s - 1), (e + 1, z)) if x[0] <= x[1]]
                open_ = left


def _contexts(length: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hashes, counts = [], []
            for text in batch.column(1):
                found, n = np.unique(anchors(text.as_py(), length)[3], return_counts=True)
                hashes.append(found.view(np.int64))
                counts.append(n.astype(np.int32))
            ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
            arrays = [batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *hashes])), pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *counts]))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "contexts", "counts"])

    return run


RUNS = "bucket int, run binary, key binary, start int, digest binary"


def _runs(length: int, buckets: int, room: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

        def batch(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "run", "key", "start", "digest"])

        def sorted_runs(held: dict[int, set[Item]]) -> pa.RecordBatch:
            blobs = [front_code(sorted(items)) for items in held.values()]
            none = [None] * len(blobs)
            return batch([list(held), blobs, none, none, none])

        held: dict[int, set[Item]] = {}
        size = 0
        for got in rows:
            for key, text, contexts, hot in zip(*(got.column(i) for i in range(4)), strict=True):
                key, data = key.as_py(), text.as_py()
                marks = np.array(contexts.values if contexts.is_valid else [], np.int64).view(np.uint64)
                hots = np.array(hot.values.to_numpy(zero_copy_only=False) if hot.is_valid else [], bool)
                a, first, last, context = anchors(data, length)
                order = np.argsort(marks)
                where = np.searchsorted(marks, context, sorter=order).clip(max=len(marks) - 1)
                mine = order[where]
                chosen = np.flatnonzero(marks[mine] == context)
                starts, digests = [], []
                for i in chosen.tolist():
                    at, s, e = int(a[i]), int(first[i]), int(last[i])
                    if hots[mine[i]]:
                        for g in range(s, e + 1):
                            starts.append(g)
                            digests.append(hashlib.blake2b(data[g : g + length], digest_size=16).digest())
                        continue
                    item = (data[at : at + length], data[s:at][::-1], key, at, s, e)
                    held.setdefault(int(context[i] % np.uint64(buckets)), set()).add(item)
                    size += len(item[0]) + 300
                if starts:
                    yield batch([[None] * len(starts), [None] * len(starts), [key] * len(starts), starts, digests])
                if size > room:
                    yield sorted_runs(held)
                    held, size = {}, 0
        if held:
            yield sorted_runs(held)

    return run


SPANS = "key binary, first int, last int"


def _spans(length: int):
    def run(table: pa.Table) -> pa.Table:
        out: set[tuple[bytes, int, int]] = set()
        group: list[tuple[int, Item]] = []
        for shared, item in merge([read_run(b) for b in table["run"].to_pylist()]):
            if group and shared < length - WINDOW + 1:
                if len(group) > 1:
                    out.update(repeated(group, length))
                group = []
            if not (group and group[-1][1] == item):
                group.append((shared, item))
        if len(group) > 1:
            out.update(repeated(group, length))
        columns = list(zip(*sorted(out), strict=True)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["key", "first", "last"])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(length: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, copies, spans in zip(*(batch.column(i) for i in range(1, 4)), strict=True):
                data, ranges = text.as_py(), []
                n = len(data)
                if copies.as_py() > 1 and n >= length:
                    ranges = [(0, n)]
                elif spans.is_valid:
                    for s in sorted((x["first"], x["last"] + length) for x in spans.as_py()):
                        if ranges and s[0] <= ranges[-1][1]:
                            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], s[1]))
                        else:
                            ranges.append(s)
                rest, at = [], 0
                for s, e in [*ranges, (n, n)]:
                    rest.append(data[at:s])
                    at = e
                out.append((n, sum(e - s for s, e in ranges), len(ranges), hashlib.sha256(b"".join(rest)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RESULT.split(", ")])

    return run


def removed_repeats(docs: DataFrame, length: int = 400, bucket_bytes: int = 16 << 20, room: int = 96 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: each byte goes that is covered by a
    string of ``length`` bytes (over 2 * WINDOW) that also starts elsewhere, in the same text or another.

    Suffixes are taken at anchors (see ``anchors``), and of those only the ones whose context occurs twice.
    Scan tasks sort them, drop what repeats, and exchange front-coded runs by context; a task merges the
    runs of its bucket by a loser tree and reads off equal strings from neighbours. A context shared by more
    than ``HOT`` anchors would grow with its group, so its strings are counted by 128-bit digests instead,
    pre-aggregated. Texts are known by 128 bits of their SHA-256; identical ones repeat each other whole.

    Null text counts as empty; texts shorter than ``length`` lose nothing. Null doc_ids and repeated rows are
    ordinary rows, other columns aren't read, and an empty table gives no rows.
    """
    rows = texts(docs).select("doc_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"), F.encode("text", "UTF-8").alias("text"))
    seen = keep(rows.select("key", "text").mapInArrow(_contexts(length), "key binary, contexts array<long>, counts array<int>"), "contexts")
    each = seen.select("key", F.explode(F.arrays_zip("contexts", "counts")).alias("x")).select("key", F.col("x.contexts").alias("context"), F.col("x.counts").alias("n"))
    twice = each.groupBy("context").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("n").alias("most"), F.sum("n").alias("n")).where("a <> b or most > 1")
    twice = keep(twice.select("context", "n"), "twice")
    marks = each.select("key", "context").join(twice, "context").groupBy("key").agg(F.collect_set(F.struct("context", (F.col("n") > HOT).alias("hot"))).alias("m"))
    marks = keep(marks.select("key", F.col("m.context").alias("contexts"), F.col("m.hot").alias("hot")), "marks")
    weight = twice.where(F.col("n") <= HOT).agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight * (length + WINDOW) // bucket_bytes))
    marked = rows.select("key", "text").join(marks.hint("merge"), "key").select("key", "text", "contexts", "hot")
    sent = keep(marked.mapInArrow(_runs(length, buckets, room), RUNS), "runs")
    cold = sent.where("run is not null").select("bucket", "run").groupBy("bucket").applyInArrow(_spans(length), SPANS)
    strings = sent.where("run is null").select("key", "start", "digest")
    place = F.struct("key", "start")
    again = strings.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("digest")
    warm = strings.join(again.hint("merge"), "digest").select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = cold.unionByName(warm).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    settled = keep(copies.join(spans, "key", "left"), "spans")
    return rows.join(settled.hint("merge"), "key").select("doc_id", "text", "copies", "spans").mapInArrow(_remove(length), RESULT)
