"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; the bits before it in the byte name a node, the bytes before it its context.
Every node of every depth keeps a Krichevsky-Trofimov estimate of its bit, and the tree mixes the estimates of
all depths by weights that the training texts earn. The tree is a table: counts go up from depth to depth by groupings, mixed
estimates come down again by joins, and nothing of it is held whole in a task or the driver.

Texts are scored in blocks of about 40 MB. A block asks once for each of its different byte strings
(context and byte) and words; its answers come sorted before its texts, which are read one Arrow batch
after the other. A string that no training text holds is
a node without counts, so every string finds its exact place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendgrid.llm.common import keep

DEPTH = 5  # bytes of context; with the byte itself they have to fit 56 bits
BLOCK_BYTES = 40 << 20
EDGE = 0xFF  # stands before the first byte and for the end; never part of UTF-8
_CHUNK = 1 << 19
_PORTION = 8 << 20  # bytes of text taken together
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``EDGE`` after each and ``depth`` of it before, and the place after each text's end."""
    gap = bytes([EDGE]) * (depth + 1)
    data = np.frombuffer(gap.join([b"", *texts, b""])[1 : -depth or None], np.uint8)
    ends = np.cumsum([len(t) + depth + 1 for t in texts])
    return data, ends


def _strings(data: np.ndarray, low: int, high: int, depth: int) -> np.ndarray:
    """The byte at each place of [low, high) after the ``depth`` bytes before it, as one number."""
    out = np.zeros(high - low, np.int64)
    for j in range(depth, -1, -1):
        out = (out << 8) | data[low - j : high - j]
    return out


def _is_scored(ends: np.ndarray, low: int, high: int, depth: int) -> np.ndarray:
    """Which places hold a byte or an end; the others are the edges before a text."""
    ok = np.ones(high - low, bool)
    for j in range(depth):
        at = ends + j
        at = at[(at >= low) & (at < high)]
        ok[at - low] = False
    return ok


def _counted(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of the texts and how often each occurs."""
    parts = []
    if texts:
        data, ends = _stream(texts, depth)
        for low in range(depth, len(data), 4 * _CHUNK):
            high = min(len(data), low + 4 * _CHUNK)
            found = _strings(data, low, high, depth)[_is_scored(ends, low, high, depth)]
            parts.append(np.unique(found, return_counts=True))
    return _joined(parts)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several parts added up."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    different, place = np.unique(keys, return_inverse=True)
    return different, np.bincount(place, np.concatenate([n for _, n in parts]), len(different)).astype(np.int64)


class _Answers:
    """Values by string, in an open-addressing table of arrays; every string looked up has to be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.last = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one gets it
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            rest = ~placed
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[missed]
        while len(missed):
            slot = (slot + 1) & self.last
            hit = self.keys[slot] == keys[missed]
            out[missed[hit]] = self.values[slot[hit]]
            missed, slot = missed[~hit], slot[~hit]
        return out


def _portions(column: pa.Array | pa.ChunkedArray) -> Iterator[list[bytes]]:
    """The texts, A-Z lower-cased, a few MB at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py().translate(_LOWER))
        size += len(held[-1])
        if size >= _PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


_ASKED = pa.schema([("block", pa.int32()), ("string", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


class _Wanted:
    """What one block asks for: its different strings and words with their numbers in training texts."""

    def __init__(self, number: int):
        self.number, self.ends = number, 0
        self.learnt: list[tuple[np.ndarray, np.ndarray]] = []
        self.scored: list[np.ndarray] = []
        self.words: Counter[bytes] = Counter()
        self.unknown: set[bytes] = set()

    def add(self, part: pa.RecordBatch, depth: int) -> None:
        is_held_out = part.column("held_out")
        learnt = part.filter(pc.invert(is_held_out)).column("text")
        self.ends += len(learnt)
        for texts in _portions(learnt):
            self.learnt.append(_counted(texts, depth))
            for value in texts:
                self.words.update(value.split())
        for texts in _portions(part.filter(is_held_out).column("text")):
            self.scored.append(_counted(texts, depth)[0])
            for value in texts:
                self.unknown.update(value.split())
        if len(self.learnt) >= 8:
            self.learnt = [_joined(self.learnt)]
        if len(self.scored) >= 8:
            self.scored = [np.unique(np.concatenate(self.scored))]

    def rows(self) -> pa.RecordBatch:
        self.words[b""] = self.ends  # no word is empty
        self.unknown.difference_update(self.words)
        keys, counts = _joined(self.learnt)
        more = np.setdiff1d(np.concatenate([keys[:0], *self.scored]), keys)
        held = [*self.words, *self.unknown]
        n, m = len(keys) + len(more), len(held)
        numbers = [counts, np.zeros(len(more), np.int64), np.fromiter(self.words.values(), np.int64), np.zeros(len(self.unknown), np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + m, self.number, np.int32)),
                pa.concat_arrays([pa.array(np.concatenate([keys, more])), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(held, pa.binary())]),
                pa.array(np.concatenate(numbers)),
            ],
            schema=_ASKED,
        )


def _asked(depth: int):
    """What the blocks ask for, from texts sorted by block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            place = batch.column("block").to_numpy()
            cuts = (np.flatnonzero(np.diff(place)) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if low == high:
                    continue
                if block is None or block.number != place[low]:
                    if block is not None:
                        yield from _slices(block.rows())
                    block = _Wanted(int(place[low]))
                block.add(batch.slice(low, high - low), depth)
        if block is not None:
            yield from _slices(block.rows())

    return ask


def _slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    return (batch.slice(low, rows) for low in range(0, len(batch), rows))


def _log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0 by Stirling's series at x + 8."""
    y = x + 8
    square = y * y
    series = F.lit(1 / 1188)
    for term in (-1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = F.lit(term) + series / square
    series = series / y
    product = x
    for j in range(1, 8):
        product = product * (x + j)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def _estimate(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    known = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - F.lit(math.log(math.pi)) - _log_gamma(n0 + n1 + 1.0)
    return F.when(n0 + n1 == 0, F.lit(0.0)).otherwise(known)


def _bits(strings: DataFrame) -> DataFrame:
    """Counts of the bits at the nodes of the greatest depth: ``context``, ``node`` (the byte's bits so far after a 1)."""
    byte = F.col("string").bitwiseAND(255)
    each = strings.select(
        F.shiftright("string", 8).alias("context"),
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.shiftright(byte + 256, 8 - i).cast("int").alias("node"),
                        F.shiftright(byte, 7 - i).bitwiseAND(1).alias("bit"),
                    )
                    for i in range(8)
                ]
            )
        ).alias("b"),
    )
    one = F.when(F.col("b.bit") == 1, F.col("n")).otherwise(0)
    return each.groupBy("context", F.col("b.node").alias("node")).agg(
        F.sum(F.col("n") - one).alias("n0"), F.sum(one).alias("n1")
    )


def _weighed(nodes: DataFrame, is_leaf: bool) -> DataFrame:
    """With ``own``, the weight of the node's own estimate, and ``weighted``, ln of its mixture's probability."""
    own = nodes.withColumn("estimate", _estimate(F.col("n0"), F.col("n1")))
    if is_leaf:
        return own.select("context", "node", "n0", "n1", F.lit(1.0).alias("own"), F.col("estimate").alias("weighted"))
    apart = F.col("below") - F.col("estimate")
    # ln(e^estimate + e^below) without leaving the range of doubles.
    both = F.greatest("estimate", "below") + F.log1p(F.exp(-F.abs(apart)))
    return own.select(
        "context", "node", "n0", "n1", (1 / (1 + F.exp(F.least(apart, F.lit(700.0))))).alias("own"),
        (both - math.log(2)).alias("weighted"),
    )


def string_scores(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """log10 of the tree's probability of the last byte of every row of ``strings`` (string, n: times learnt)
    after the others."""
    levels = [keep(_weighed(_bits(strings), True), "contexts")]
    for d in range(depth - 1, -1, -1):
        up = levels[0].groupBy(
            F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context"), "node"
        ).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        levels.insert(0, keep(_weighed(up, False), "contexts"))
    mixed = None
    for d, level in enumerate(levels):
        mine = F.col("own") * (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
        if mixed is None:
            mixed = level.select("context", "node", mine.alias("one"), (1 - F.col("own")).alias("rest"))
            continue
        shorter = mixed.select(F.col("context").alias("shorter"), F.col("node").alias("same"), "one", "rest")
        joined = level.join(
            shorter,
            (F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1) == F.col("shorter")) & (F.col("node") == F.col("same")),
        )
        mixed = joined.select(
            "context", "node", (F.col("one") + F.col("rest") * mine).alias("one"), (F.col("rest") * (1 - F.col("own"))).alias("rest")
        )
    # A context has at most 255 nodes.
    of_context = mixed.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("node", "one"))).alias("ones"))
    byte = F.col("string").bitwiseAND(255)
    bits = []
    for i in range(8):
        one = F.col("ones")[F.shiftright(byte + 256, 8 - i).cast("int")]
        bits.append(F.log10(F.when(F.shiftright(byte, 7 - i).bitwiseAND(1) == 1, one).otherwise(1 - one)))
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return (
        strings.select("string", F.shiftright("string", 8).alias("context"))
        .join(of_context, "context")
        .select("string", total.alias("log10_p"))
    )


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def _total(texts: list[bytes], strings: _Answers, depth: int) -> np.ndarray:
    """Sum of the answers to each text's strings."""
    data, ends = _stream(texts, depth)
    total = np.zeros(len(texts))
    for low in range(depth, len(data), _CHUNK):
        high = min(len(data), low + _CHUNK)
        value = np.zeros(high - low)
        ok = _is_scored(ends, low, high, depth)
        value[ok] = strings.of(_strings(data, low, high, depth)[ok])
        first, last = np.searchsorted(ends, [low, high - 1], "right").tolist()
        edges = np.concatenate([[low], ends[first:last]]) - low
        total[first : last + 1] += np.add.reduceat(value, edges)[: len(total) - first]
    return total


class _Block:
    """The answers of one block: values by string, log10 probabilities by word."""

    def __init__(self, number: int, tokens: int, kinds: int):
        self.number, self.held, self.strings = number, [], None
        self.scale = math.log10(tokens + 0.5 * (kinds + 1))
        self.absent = math.log10(0.5) - self.scale
        self.worth: dict[bytes, float] = {}

    def add(self, part: pa.RecordBatch) -> None:
        of_string = part.filter(part.column("string").is_valid())
        self.held.append((of_string.column("string").to_numpy(), of_string.column("value").to_numpy()))
        of_word = part.filter(part.column("word").is_valid())
        counts = np.log10(of_word.column("value").to_numpy() + 0.5) - self.scale
        self.worth.update(zip(of_word.column("word").to_pylist(), counts.tolist(), strict=True))

    def scored(self, part: pa.RecordBatch, depth: int) -> pa.RecordBatch:
        if self.strings is None:
            self.strings = _Answers(*(np.concatenate([h[i] for h in self.held]) for i in (0, 1)))
            self.held = []
        worth, absent = self.worth, self.absent
        n_tokens, n_known, base, n_bytes, totals = [], [], [], [], []
        for texts in _portions(part.column("text")):
            for value in texts:
                words = value.split()
                # No log10 probability is 0.
                found = list(filter(None, map(worth.get, words)))
                n_tokens.append(len(words) + 1)
                n_known.append(len(found) + (b"" in worth))
                base.append(math.fsum(found) + (len(words) - len(found)) * absent + worth.get(b"", absent))
                n_bytes.append(len(value))
            totals.append(_total(texts, self.strings, depth))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("held_out"), pa.array(n_bytes, pa.int64()),
                pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                pa.array(np.concatenate(totals)),
            ],
            schema=_SCORES,
        )


def _scored(depth: int, tokens: int, kinds: int):
    """Scores of texts from rows sorted by block, a block's answers before its texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            place = 2 * batch.column("block").to_numpy().astype(np.int64) + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(place)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if low == high:
                    continue
                part, number, kind = batch.slice(low, high - low), int(place[low]) // 2, int(place[low]) % 2
                if block is None or block.number != number:
                    block = _Block(number, tokens, kinds)
                if kind:
                    yield block.scored(part, depth)
                else:
                    block.add(part)

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_bytes``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed counts of words), ``score`` (log10 probability of the lower-cased text and its end
    by the context tree) and ``bits_per_byte`` (code length, the end's included, per byte and end).

    The tree and the word counts learn from every document that isn't held out; one without id is learnt
    from. Null and empty texts are an end alone. Repeated rows count and are scored each;
    other columns are left unread. Without training texts every bit costs one bit. Depth is at most 6.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth is 0 to 6 bytes")
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    placed = whole.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id",
        held_out(F.col("doc_id")).alias("held_out"), "text",
    )
    asked = keep(
        placed.repartition("block").sortWithinPartitions("block")
        .mapInArrow(_asked(depth), "block int, string long, word binary, n long"),
        "asked",
    )
    words = asked.where("word is not null").select("block", "word", F.sum("n").over(Window.partitionBy("word")).alias("c"))
    words = keep(words.where("c > 0"), "words")
    tokens = asked.where("word is not null").agg(F.sum("n")).first()[0] or 0
    kinds = words.select("word").distinct().count()
    strings = asked.where("string is not null")
    scores = string_scores(keep(strings.groupBy("string").agg(F.sum("n").alias("n")), "strings"), depth)
    # A string's value is its probability, a word's its number; both are exact in a double.
    answers = (
        strings.select("block", "string").join(scores, "string")
        .select("block", "string", F.lit(None).cast("binary").alias("word"), F.col("log10_p").alias("value"))
        .unionByName(
            words.select("block", F.lit(None).cast("long").alias("string"), "word", F.col("c").cast("double").alias("value"))
        )
    )
    nothing = {"doc_id": "long", "held_out": "boolean", "text": "binary", "string": "long", "word": "binary", "value": "double"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(
            "block", F.lit(kind).alias("kind"),
            *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
        )

    found = (
        rows(answers, 0).unionByName(rows(placed, 1))
        .repartition("block").sortWithinPartitions("block", "kind")
        .mapInArrow(
            _scored(depth, tokens, kinds),
            "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return found.select(
        "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
