"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF over all their terms, from a
block-max inverted index that is stored as a table and read by the workers."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.common import keep, texts, work_folder
from mendgrid.llm.shingles import batches, mix, shingle_sets

_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
BLOCK = 64  # consecutive examples that share one maximum per term
SHARD = 16_000_000  # postings that a worker holds at once
WORDS_HELD = 40_000  # words that a task remembers at once
PAIRS_HELD = 250_000  # of an example and a word
CELLS = 16_000_000  # of the matrix that holds the most frequent terms of a shard
COUNTED = 1000  # the largest count that a term of the matrix has; from its single precision a count is found again
GROUP = 256  # queries that are multiplied with it at once
PAYS = 5  # postings a block has on average, from which its maximum is worth a look
EXACTLY = 256  # examples whose cosines are told exactly at once
CHARACTERS = 250_000  # of texts whose words are looked up at once
LOOKED_UP = 10_000  # terms that are looked up at once
FILES = 32  # of a shard, from 32 to 63
STRETCH = 1024  # terms whose sums travel together

_BASE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def terms_of(word: str) -> list[str]:
    """A word is its own term, and its beginnings are terms too: they hold the stem of inflected words."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _digest(text: str) -> bytes:
    return blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def _ranges(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from start[i] to start[i + 1] for each i, in a row, and how many each has."""
    sizes = start[of + 1] - start[of]
    ends = np.cumsum(sizes)
    places = np.repeat(start[of] - ends + sizes, sizes)
    places += np.arange(len(places))
    return places, sizes


def _table(path: str, columns: list[str]) -> pa.Table:
    """A table that Spark stored, read by a worker from the shared folder."""
    place, folder = FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return pq.read_table(folder, columns=columns, filesystem=place, partitioning=None, use_threads=False)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points words are made of."""
    of = np.zeros(0x110000, bool)
    # All of them as strings at once would take 100 MB.
    for first in range(0, len(of), 4096):
        for run in _WORDS.finditer("".join(map(chr, range(first, first + 4096)))):
            of[first + run.start() : first + run.end()] = True
    return of


class _Strings:
    """Strings that lie one after the other as code points, to hash whole or up to a place: 64 bits of each."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.begins = np.cumsum(lengths) - lengths
        powers = np.full(int(lengths.max(initial=1)), _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        place = np.arange(len(points)) - np.repeat(self.begins, lengths)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers[place], out=self.sums[1:])

    def hashes(self, of: np.ndarray | slice, until: np.ndarray, begun: bool = False) -> np.ndarray:
        """Hashes of the first ``until`` characters, as whole words or as beginnings of words."""
        at = self.begins[of]
        return mix(self.sums[at + until] - self.sums[at] + (2 * until + begun).astype(np.uint64) * _LENGTH)


def _term_hashes(terms: pa.StringArray) -> np.ndarray:
    """What a term hashes to: a word, or a beginning that ends with a star."""
    lengths = pc.utf8_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    begun = pc.ends_with(terms, "*").to_numpy(zero_copy_only=False).astype(bool)
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, np.int32)[terms.offset : terms.offset + len(terms) + 1]
    text = data[ends[0] : ends[-1]].to_pybytes().decode()
    found = _Strings(np.frombuffer(text.encode("utf-32-le"), "<u4"), lengths)
    return np.where(begun, found.hashes(slice(None), lengths - begun, True), found.hashes(slice(None), lengths))


class Vocabulary:
    """Terms in order and their weights, once known: idf times the weight by class. Texts are cut into words, and
    words looked up, by arrays of the hashes of all words of a stretch of texts."""

    def __init__(self, path: str, weighed: bool = True):
        known = _table(path, ["term", "gain"][: 1 + weighed]).sort_by("term").combine_chunks()
        self.names, self.gain = known["term"].combine_chunks(), known["gain"].to_numpy() if weighed else np.empty(0)
        hashes = np.concatenate([np.empty(0, np.uint64), *(_term_hashes(self.names.slice(at, LOOKED_UP)) for at in range(0, len(self.names), LOOKED_UP))])
        number = np.argsort(hashes)
        # One more that no term has, where a search ends.
        self.hashes = np.append(hashes[number], np.uint64(2**64 - 1))
        self.number = np.append(number, -1).astype(np.int32)
        bits = max(1, len(number).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange(2**bits, dtype=np.uint64)).astype(np.int32)
        del known
        pa.default_memory_pool().release_unused()

    @cached_property
    def terms(self) -> dict[str, int]:
        """The number of each term, to look at it; scoring has no use for so many strings."""
        return {t: i for i, t in enumerate(self.names.to_pylist())}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The terms with these hashes, -1 for none."""
        at = self.begins[hashes >> self.shift]
        before = np.flatnonzero(self.hashes[at] < hashes)
        while len(before):
            at[before] += 1
            before = before[self.hashes[at[before]] < hashes[before]]
        return np.where(self.hashes[at] == hashes, self.number[at], np.int32(-1))

    def found(self, batch: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches of texts, from one to before another: which text has which term, in order, and how often."""
        at = 0
        while at < len(batch):
            first, part, size = at, [], 0
            while at < len(batch) and (not part or size < CHARACTERS):
                part.append(batch[at].lower())
                size += len(part[-1]) + 1
                at += 1
            yield first, at, *self._found(part)

    def _found(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = _letters()[points]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts = edges[0::2]
        words = _Strings(points[inside], edges[1::2] - starts)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), starts, side="right")
        hashes = words.hashes(slice(None), words.lengths)
        by = np.argsort(hashes)
        new = np.diff(hashes[by], prepend=~hashes[by[:1]]) != 0
        first, word = by[new], np.empty(len(by), np.intp)
        word[by] = np.cumsum(new) - 1
        lengths = words.lengths[first]
        ids = np.full((len(first), 1 + len(PREFIXES)), -1, np.int32)
        # Beginnings of a term are terms too: where one is unknown, longer ones and the word needn't be looked up.
        open_ = np.ones(len(first), bool)
        for k, n in enumerate(PREFIXES, 1):
            long = np.flatnonzero(open_ & (lengths >= n))
            ids[long, k] = self.numbers(words.hashes(first[long], np.full(len(long), n), True))
            open_[long] = ids[long, k] >= 0
        ids[open_, 0] = self.numbers(hashes[first[open_]])
        of = ids[word]
        known = of >= 0
        terms = max(1, len(self.names))
        pairs, times = np.unique(np.repeat(text * terms, known.sum(axis=1)) + of[known], return_counts=True)
        text = pairs // terms
        return text, pairs - text * terms, times

    def counted_texts(self, batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The terms of each text, and how often it has them."""
        for low, high, text, term, times in self.found(batch):
            cuts = np.searchsorted(text, np.arange(high - low + 1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield term[a:b], times[a:b].astype(float)

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.counted_texts([text]))

    def weighted(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.gain[ids]
        return ids, w / np.sqrt((w * w).sum())


def _files(path: str, columns: list[str]) -> Iterator[pa.Table]:
    """The files of a shard, one after the other: terms are in order within a file and from file to file."""
    place, folder = FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    for f in sorted(pq.ParquetDataset(folder, filesystem=place, partitioning=None).files):
        yield pq.read_table(f, columns=columns, filesystem=place, partitioning=None, use_threads=False).combine_chunks()


def _small(values: np.ndarray, most: int) -> np.ndarray:
    """Numbers up to ``most``, in the fewest bytes."""
    return values.astype(np.min_scalar_type(most))


class Shard:
    """Postings of the examples ``low`` to ``high``, by term and then block of ``BLOCK`` examples, with the
    largest weight of each term in each of its blocks. The most frequent terms, which one in twenty examples
    and at least four blocks of them have, lie in a matrix of at most ``CELLS`` numbers instead, as almost every block has them.
    It is in single precision, with a bound of its error: what it tells is who may be near, never a cosine."""

    def __init__(self, path: str, vocabulary: Vocabulary, norm: np.ndarray, low: int, high: int):
        self.low, self.size = low, high - low
        self.blocks = -(-self.size // BLOCK)
        terms = len(vocabulary.names)
        self.gain, self.inverse = vocabulary.gain, 1 / norm[low:high]
        held, highest, entries = (np.zeros(terms, np.int32) for _ in range(3))
        for rows in _files(path, ["number", "n", "highest"]):
            term = rows["number"].to_numpy()
            np.add.at(held, term, rows["n"].to_numpy())
            np.add.at(entries, term, 1)
            np.maximum.at(highest, term, rows["highest"].to_numpy())
        most = max(1, int(highest.max(initial=0)))
        self.times = 1 + np.log(np.maximum(1, np.arange(most + 1)))  # by count
        self.times[0] = 0
        frequent = np.flatnonzero((held >= max(4 * BLOCK, self.size / 20)) & (highest <= COUNTED))
        frequent = np.sort(frequent[np.argsort(-held[frequent], kind="stable")[: CELLS // self.size]])
        self.row = np.full(terms, -1, np.int32)  # of the matrix, by term
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((self.size, len(frequent)), np.float32)
        held[frequent] = entries[frequent] = 0
        self.most = np.zeros(terms)
        self.entry = np.append(0, np.cumsum(entries))  # blocks of a term
        self.postings = np.append(0, np.cumsum(held))  # of a term
        # A posting takes three or four bytes: its example and its count.
        self.example, self.place = (np.empty(self.postings[-1], np.min_scalar_type(x)) for x in (self.size, most))
        self.block = np.empty(self.entry[-1], np.min_scalar_type(self.blocks))
        self.block_most = np.empty(self.entry[-1], np.float32)  # rounded up
        self.start = np.zeros(self.entry[-1] + 1, np.int32)  # postings of a block
        del held, highest, entries
        at = to = 0
        for rows in _files(path, ["number", "block", "most", "n", "examples", "counts"]):
            term, block, block_most, sizes = (rows[c].to_numpy() for c in ("number", "block", "most", "n"))
            example = rows["examples"].combine_chunks().flatten().to_numpy() - low
            place = rows["counts"].combine_chunks().flatten().to_numpy()
            own = self.row[term] < 0
            rare = np.repeat(own, sizes)
            self.matrix[example[~rare], np.repeat(self.row[term[~own]], sizes[~own])] = self.times[place[~rare]]
            np.maximum.at(self.most, term[own], block_most[own])
            n, m = int(own.sum()), int(rare.sum())
            self.block[at : at + n] = block[own]
            self.block_most[at : at + n] = np.nextafter(block_most[own].astype(np.float32), np.float32(np.inf))
            self.start[at + 1 : at + n + 1] = to + np.cumsum(sizes[own])
            self.example[to : to + m], self.place[to : to + m] = example[rare], place[rare]
            at, to = at + n, to + m
        # Most postings have a count of 1; for those with more, what is above 1 is added from a list of their own.
        again = np.flatnonzero(self.place > 1)
        self.again, self.more = self.example[again], self.place[again]
        self.repeats = np.searchsorted(again, self.postings)  # of a term
        self.read = 0  # blocks of terms read by the last search
        pa.default_memory_pool().release_unused()

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Example, term and weight of all postings, to look at them."""
        row, column = np.nonzero(self.matrix)
        example = np.concatenate([self.example.astype(np.int64), row])
        term = np.concatenate([np.repeat(np.arange(len(self.row)), np.diff(self.postings)), np.flatnonzero(self.row >= 0)[column]])
        times = np.concatenate([self.times[self.place], self._exact(self.matrix[row, column])])
        return example + self.low, term, times * self.gain[term] * self.inverse[example]

    def _exact(self, cells: np.ndarray) -> np.ndarray:
        """Cells of the matrix in double precision, by the counts that they stand for."""
        return self.times[np.rint(np.exp(cells - 1)).astype(np.intp)]

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the most frequent terms of each query add to each example, before its norm, in single precision."""
        heavy = np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        for q, (ids, w) in enumerate(queries):
            row = self.row[ids]
            own = row >= 0
            heavy[q, row[own]] = (w * self.gain[ids])[own]
        return heavy @ self.matrix.T

    def _least(self, scores: np.ndarray, wanted: int) -> float:
        """What the last of the nearest examples scores at least."""
        return max(0.0, np.partition(scores, -wanted)[-wanted]) if len(scores) > wanted else 0.0

    def _sums(self, ids: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """What all postings of terms add to each example, before its norm."""
        self.read += int((self.entry[ids + 1] - self.entry[ids]).sum())
        places, sizes = _ranges(self.postings, ids)
        sums = np.bincount(self.example[places], np.repeat(heavy, sizes), self.size)
        places, sizes = _ranges(self.repeats, ids)
        more = self.times[self.more[places]]
        more -= 1
        more *= np.repeat(heavy, sizes)
        return sums + np.bincount(self.again[places], more, self.size)

    def nearest(self, ids: np.ndarray, w: np.ndarray, wanted: int, skip: list[int], found: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``wanted`` examples with the largest cosine, to twelve digits; ties go to the lower number.
        ``found``: what ``frequent`` gives for the query.

        The other terms are added by the most they can add, until an example without any of those left
        can't be near. These are read by blocks of examples, in the order of what the maxima of these terms leave
        possible in a block, and blocks that can't reach the last of the nearest are never read. Where blocks hold
        few postings each, to read them all costs less than to look at their maxima.

        Weights are never negative, so a sum of single precision is off by a share of itself: at most one
        rounding for each of its terms and a few more. Whoever is near within that is summed in double precision."""
        found = self.frequent([(ids, w)])[0] if found is None else found
        row, heavy = self.row[ids], w * self.gain[ids]
        common, rare = row >= 0, row < 0
        row, often = row[common], heavy[common]
        ids, w, heavy = ids[rare], w[rare], heavy[rare]
        off = (len(row) + 8) * 2.0**-23
        never = [i - self.low for i in skip if 0 <= i - self.low < self.size]
        sums = np.zeros(self.size)

        def scored() -> np.ndarray:
            scores = (found + sums) * self.inverse
            scores[never] = -np.inf
            return scores

        self.read, whole = 0, None
        if (self.postings[ids + 1] - self.postings[ids]).sum() <= PAYS * (self.entry[ids + 1] - self.entry[ids]).sum():
            sums += self._sums(ids, heavy)
        else:
            bounds = w * self.most[ids]
            by = np.argsort(-bounds, kind="stable")
            rest = np.concatenate([np.cumsum(bounds[by][::-1])[::-1], [0.0]])
            at, step, last = 0, 16, self._least(scored(), wanted)
            while at < len(by) and last <= 2 * rest[at]:
                part = by[at : at + step]
                at, step = at + len(part), 2 * step
                sums += self._sums(ids[part], heavy[part])
                last = self._least(scored(), wanted)
            if at < len(by):
                whole = np.zeros(self.blocks, bool)
                entries, sizes = _ranges(self.entry, ids[by[at:]])
                block, most = self.block[entries], np.repeat(w[by[at:]], sizes) * self.block_most[entries]
                heavy = np.repeat(heavy[by[at:]], sizes)
                bound = np.maximum.reduceat(scored(), np.arange(0, self.size, BLOCK)) + np.bincount(block, most, self.blocks)
                order, at, step = np.argsort(-bound, kind="stable"), 0, 8
                while at < len(order) and bound[order[at]] >= last * (1 - 2 * off) - 1e-9:
                    part = order[at : at + step]
                    part = part[bound[part] >= last * (1 - 2 * off) - 1e-9]
                    at, step = at + len(part), 2 * step
                    whole[part] = True
                    now = np.zeros(self.blocks, bool)
                    now[part] = True
                    now = now[block]
                    places, sizes = _ranges(self.start, entries[now])
                    sums += np.bincount(self.example[places], self.times[self.place[places]] * np.repeat(heavy[now], sizes), self.size)
                    self.read += int(now.sum())
                    last = self._least(scored(), wanted)
        scores = scored()
        left = np.flatnonzero((scores >= self._least(scores, wanted) * (1 - 2 * off) - 1e-11) & (scores > 0))
        if whole is not None:
            left = left[whole[left // BLOCK]]
        exact = sums[left]
        for at in range(0, len(left), EXACTLY):
            exact[at : at + EXACTLY] += (self._exact(self.matrix[left[at : at + EXACTLY]].take(row, axis=1)) * often).sum(axis=1)
        scores = np.round(exact * self.inverse[left], 12)
        order = np.lexsort((left, -scores))[:wanted]
        return [(s, i + self.low) for s, i in zip(scores[order].tolist(), left[order].tolist(), strict=True) if s > 0]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    _names.cache_clear()  # whoever scores has no use for it any more
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _names(path: str) -> Vocabulary:
    return Vocabulary(path, weighed=False)


@lru_cache(maxsize=1)
def _shard(path: str, terms: str, norm: bytes, low: int, high: int) -> Shard:
    """The last shard read stays with the worker; an index of one shard is read once."""
    return Shard(path, _vocabulary(terms), np.frombuffer(norm), low, high)


@dataclass
class Index:
    """Where the tables of terms and blocks lie, and the numbers kept per example."""

    terms_path: str
    blocks_path: str
    cuts: list[int]  # the examples of shard i are cuts[i] to cuts[i + 1]
    norm: bytes  # doubles, by example
    doc_ids: np.ndarray
    toxic: np.ndarray
    same: dict[bytes, list[int]]  # examples by the digest of their text
    neighbours: int
    steps: np.ndarray  # votes at which the calibrated score rises
    scores: np.ndarray
    alone: float  # score without any neighbour

    @property
    def vocabulary(self) -> Vocabulary:
        return _vocabulary(self.terms_path)

    @property
    def terms(self) -> dict[str, int]:
        return self.vocabulary.terms

    def shards(self) -> Iterator[Shard]:
        for i, (low, high) in enumerate(zip(self.cuts, self.cuts[1:])):  # noqa: B905
            yield _shard(f"{self.blocks_path}/shard={i}", self.terms_path, self.norm, low, high)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(sorted(counts), np.int64)
        return self.vocabulary.weighted(ids, np.array([counts[i] for i in ids.tolist()], float))

    def best(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        return sorted(found, key=lambda f: (-f[0], f[1]))[: self.neighbours]

    def nearest(self, ids: np.ndarray, w: np.ndarray, skip: list[int] | None = None) -> list[tuple[float, int]]:
        return self.best([f for s in self.shards() for f in s.nearest(ids, w, self.neighbours, skip or [])])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Votes weighted by 1 / (distance + 0.1), with distance 1 - cosine."""
        weight = [1 / (1.1 - s) for s, _ in near]
        return sum(w * self.toxic[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight)

    def near(self, batch: list[str]) -> list[list[tuple[float, int]]]:
        """The nearest examples of each text. An example of the same text has no vote on it: no text is
        judged by its own label."""
        queries: list[tuple[int, np.ndarray, np.ndarray, list[int]]] = []
        near: list[list[tuple[float, int]]] = [[] for _ in batch]
        if len(self.cuts) < 2:
            return near
        for k, (ids, counts) in enumerate(self.vocabulary.counted_texts(batch)):
            if len(ids):
                queries.append((k, *self.vocabulary.weighted(ids, counts), self.same.get(_digest(batch[k]), [])))
        for shard in self.shards():
            for at in range(0, len(queries), GROUP):
                part = queries[at : at + GROUP]
                for (k, ids, w, skip), found in zip(part, shard.frequent([(ids, w) for _, ids, w, _ in part]), strict=True):
                    near[k] += shard.nearest(ids, w, self.neighbours, skip, found)
        return [self.best(n) for n in near] if len(self.cuts) > 2 else near

    def calibrated(self, near: list[tuple[float, int]]) -> float:
        return float(self.scores[np.searchsorted(self.steps, self.vote(near), side="right")]) if near else self.alone

    @cached_property
    def _own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of the examples one after the other, to look at them: starts, terms, weights."""
        example, term, weight = (np.concatenate(x) for x in zip(*(s.own() for s in self.shards()), strict=True))
        by = np.lexsort((term, example))
        return np.searchsorted(example[by], np.arange(len(self.doc_ids) + 1)), term[by], weight[by]

    @property
    def own_start(self) -> np.ndarray:
        return self._own[0]

    @property
    def own_term(self) -> np.ndarray:
        return self._own[1]

    @property
    def own_weight(self) -> np.ndarray:
        return self._own[2]


def _postings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of examples by term, and how many of them are toxic, as far as a task remembers words."""
    known: dict[str, int] = {}
    parts: list[tuple[int, int, list[int], list[int]]] = []  # example, label, words and how often
    pairs = 0

    def listed() -> pa.RecordBatch:
        number: dict[str, int] = {}
        of = [[number.setdefault(t, len(number)) for t in terms_of(word)] for word in known]
        start = np.append(0, np.cumsum([len(t) for t in of]))
        terms = np.array([t for ts in of for t in ts], np.int64)
        places, sizes = _ranges(start, np.concatenate([np.array(p[2], np.int64) for p in parts]))
        lengths = [len(p[2]) for p in parts]
        row = np.repeat(np.repeat(np.arange(len(parts)), lengths), sizes)
        of_term, back = np.unique(terms[places] * len(parts) + row, return_inverse=True)
        counts = np.bincount(back, np.repeat(np.concatenate([p[3] for p in parts]), sizes)).astype(np.int32)
        term, row = of_term // len(parts), of_term % len(parts)
        ends = np.searchsorted(term, np.arange(len(number) + 1)).astype(np.int32)
        example, label = (np.array([p[i] for p in parts], np.int32)[row] for i in (0, 1))
        toxic = np.bincount(term, label != 0, len(number)).astype(np.int64)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (example, counts)]
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(toxic), *lists], ["term", "toxic", "examples", "counts"])

    for batch in rows:
        for example, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Counter(_WORDS.findall(text.lower()))
            parts.append((example, label, [known.setdefault(w, len(known)) for w in found], list(found.values())))
            pairs += len(found)
            if len(known) > WORDS_HELD or pairs > PAIRS_HELD:
                yield listed()
                known.clear()
                parts.clear()
                pairs = 0
    if known:
        yield listed()


def _held(path: str):
    """How many texts hold each of the terms at ``path``: a task's sums, ``STRETCH`` terms a row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _names(path)
        terms = len(vocabulary.names)
        held = np.zeros(terms, np.int64)
        for batch in _parts(rows):
            for *_, term, _ in vocabulary.found(batch.column(0).to_pylist()):
                held += np.bincount(term, minlength=terms)
        starts = np.append(np.arange(0, terms, STRETCH), terms)
        sums = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts) - 1, dtype=np.int32)), sums], ["stretch", "held"])

    return run


def _held_in_all(path: str):
    """``term, number, held`` over all tasks, from the rows of whole stretches. Terms are numbered in order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = _names(path).names, {}
        for batch in rows:
            for stretch, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = held.values.to_numpy()
                sums[stretch] = sums[stretch] + held if stretch in sums else held
        for stretch, held in sums.items():
            first = stretch * STRETCH
            columns = [names.slice(first, len(held)), pa.array(np.arange(first, first + len(held), dtype=np.int32)), pa.array(held)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "number", "held"])

    return run


def _squares(examples: int):
    """The sum of the squared weights of each example, and how many terms it has. The sum is in whole numbers,
    2^-16 and 2^-60, so that it doesn't depend on the order of the rows and an index comes out the same again."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, terms = (np.zeros(examples, np.int64) for _ in range(3))
        _names.cache_clear()
        for batch in rows:
            of, w = _gains(batch)
            scaled = w * w * 2.0**16
            whole = np.floor(scaled)
            np.add.at(high, of, whole.astype(np.int64))
            np.add.at(low, of, ((scaled - whole) * 2.0**44).astype(np.int64))
            terms += np.bincount(of, minlength=examples)
        held = np.flatnonzero(terms)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(high[held]), pa.array(low[held]), pa.array(terms[held])], ["example", "high", "low", "terms"])

    return run


def _gains(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The postings of the rows ``gain, examples, counts`` one after the other: example, weight before the norm."""
    gain, lists, counts = (batch.column(c) for c in ("gain", "examples", "counts"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), (1 + np.log(counts.flatten().to_numpy())) * np.repeat(gain.to_numpy(), sizes)


def _cut(norm: bytes, cuts: list[int]):
    """Rows of blocks: the postings of a term among ``BLOCK`` consecutive examples of a shard, with their maximum."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms, low = np.frombuffer(norm), np.array(cuts)
        for batch in rows:
            of, w = _gains(batch)
            if not len(of):
                continue
            sizes = pc.list_value_length(batch.column("examples")).to_numpy(zero_copy_only=False)
            row, counts = np.repeat(np.arange(len(batch)), sizes), batch.column("counts").flatten().to_numpy()
            by = np.lexsort((of, row))
            of, w, row, counts = of[by], w[by] / norms[of[by]], row[by], counts[by]
            shard = np.searchsorted(low, of, side="right") - 1
            block = (of - low[shard]) // BLOCK
            first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(shard) != 0) | (np.diff(block) != 0)]))
            ends = pa.array(np.append(first, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (of, counts)]
            columns = [batch.column("number").take(pa.array(row[first])), pa.array(shard[first].astype(np.int32)), pa.array(block[first].astype(np.int32)), pa.array(np.maximum.reduceat(w, first)), pa.array(np.diff(np.append(first, len(of))).astype(np.int32)), pa.array(np.maximum.reduceat(counts, first).astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["number", "shard", "block", "most", "n", "highest", "examples", "counts"])

    return run


def _votes(index: Index):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            votes = [index.vote(n) if n else None for n in index.near(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], ["toxic", "vote"])
        # Spark may give what follows to other workers, while this one waits with the index.
        _shard.cache_clear()
        _vocabulary.cache_clear()

    return run


def _least_shingle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A worker that scored by an earlier index lets go of it.
    _shard.cache_clear()
    _vocabulary.cache_clear()
    _names.cache_clear()
    pa.default_memory_pool().release_unused()
    for batch in rows:
        least = [int(s[0].view(np.int64)) if len(s) else 0 for _, data in batches(batch.column(0).to_pylist()) for s in shingle_sets(data, 5)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "sketch"])


def _not_near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text shares less than 0.8 of the five-word shingles of both with the text beside it."""
    for batch in rows:
        sets = [[s for _, data in batches([t or "" for t in batch.column(c).to_pylist()]) for s in shingle_sets(data, 5)] for c in (0, 1)]
        far = []
        for a, b, first in zip(*sets, batch.column(1).to_pylist(), strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True)) if first is not None else 0
            far.append(both == 0 or 100 * both < 80 * (len(a) + len(b) - both))
        yield batch.filter(pa.array(far, pa.bool_())).drop_columns(["first"])


def rising(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, scores): the non-decreasing step function of the vote closest to the labels, with half an
    example of either kind added to each step."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # first vote, toxic weight, weight
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist(), strict=True):
        pools.append([v, y * w, w])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    unit = float(weights.mean()) if len(weights) else 1.0
    steps = np.array([p[0] for p in pools[1:]])
    scores = np.maximum.accumulate(np.array([(p[1] + unit / 2) / (p[2] + unit) for p in pools] or [0.5]))
    return steps, scores


def examples(docs: DataFrame, train: DataFrame, per_class: int) -> DataFrame:
    """``text, toxic, doc_id`` of the first ``per_class`` examples of either class in hash order, without
    those that repeat an earlier one's text or are verified near copies of the first with their least hash."""
    order = F.xxhash64("l_id", F.lit(8))
    taken = per_class + per_class // 4
    while True:
        # Later rows never decide about earlier ones, so the start of the order is enough if it holds enough.
        picked = [train.where(F.col("toxic") == y).orderBy(order, "l_id").limit(taken) for y in (0, 1)]
        picked = keep(picked[0].unionByName(picked[1]), "picked")
        more = {r["toxic"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["n"] >= taken}
        rows = texts(docs).join(picked, F.col("doc_id") == F.col("l_id")).select("text", "toxic", F.struct(order.alias("h"), "doc_id").alias("at"))
        kind = "at struct<h: long, doc_id: long>"
        once = rows.groupBy("text", "toxic").agg(F.min("at").alias("at")).select("text", "toxic", "at")
        once = keep(once.mapInArrow(_least_shingle, f"text string, toxic int, {kind}, sketch long"), "labelled")
        first = once.groupBy("sketch", "toxic").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1").drop("n")
        first = first.join(once, ["sketch", "toxic"]).where("at = first_at").select("sketch", "toxic", "first_at", F.col("text").alias("first"))
        beside = once.join(first, ["sketch", "toxic"], "left")
        beside = beside.select("text", F.when(F.col("at") != F.col("first_at"), F.col("first")).alias("first"), "toxic", "at")
        apart = keep(beside.mapInArrow(_not_near, f"text string, toxic int, {kind}"), "apart")
        n = {r["toxic"]: r["n"] for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if all(n.get(y, 0) >= per_class for y in more):
            break
        taken *= 4
    best = [apart.where(F.col("toxic") == y).orderBy("at").limit(per_class) for y in (0, 1)]
    return keep(best[0].unionByName(best[1]).select("text", "toxic", F.col("at.doc_id").alias("doc_id")), "examples")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, sure: float = 3.0, neighbours: int = 15, shard: int = SHARD) -> Index:
    """An index of at most ``per_class`` labelled examples of either class, taken in hash order from the
    rows that aren't held out, after copies and verified near copies.

    Every term of the examples counts. Its idf is over all documents, and its weight rises with the odds
    ratio z between the classes: the log of the ratio times z^2 / (z^2 + sure^2), where z is that log in
    standard errors, and a little for a term that tells nothing. Inputs are texts and labels alone.
    Without examples of both classes, every text scores the share of toxic examples, or 0 without any.

    The driver sees a few numbers of each example. Terms and postings are tables in the shared folder:
    examples are numbered by class and length, postings cut into blocks of them, and blocks into shards
    of about ``shard`` postings, of which a worker holds one at a time.
    """
    spark = docs.sparkSession
    train = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    train = train.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = examples(docs, train, per_class)
    # At most 2 * per_class rows of numbers.
    drawn = sample.select("toxic", F.length("text").alias("n"), "doc_id", F.xxhash64("text").alias("h")).toArrow()
    drawn = drawn.sort_by([("toxic", "ascending"), ("n", "ascending"), ("doc_id", "ascending"), ("h", "ascending")])
    toxic = drawn["toxic"].to_numpy().astype(float)
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    scale = {0: sizes.get(0, 0) / max(1, n0), 1: sizes.get(1, 0) / max(1, n1)}
    index = Index("", "", [], b"", drawn["doc_id"].to_numpy(), toxic, {}, neighbours, np.empty(0), np.zeros(1), float(bool(n1 and not n0)))
    if not (n0 and n1):
        return index
    number = {k: i for i, k in enumerate(zip(*(drawn[c].to_pylist() for c in ("toxic", "doc_id", "h")), strict=True))}
    numbers = spark.createDataFrame([(*k, i) for k, i in number.items()], "toxic int, doc_id long, h long, example int")
    sample = sample.withColumn("h", F.xxhash64("text")).join(numbers, ["toxic", "doc_id", "h"]).select("example", "toxic", "text")
    sample = keep(sample.repartition(32, "example"), "numbered")
    for r in sample.mapInArrow(_digests, "example int, digest binary").collect():
        index.same.setdefault(bytes(r["digest"]), []).append(r["example"])

    parts = sample.mapInArrow(_postings, "term string, toxic long, examples array<int>, counts array<int>")
    own = parts.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.collect_list(F.struct("examples", "counts")).alias("p"))
    own = own.select("term", "a", F.flatten("p.examples").alias("examples"), F.flatten("p.counts").alias("counts"))
    own = own.withColumn("b", F.size("examples") - F.col("a"))
    own_path = f"{work_folder(spark)}/own-{uuid.uuid4().hex}"
    own.write.option("compression", "zstd").parquet(own_path)
    own = spark.read.schema(own.schema).parquet(own_path)
    every = texts(docs).select("text").mapInArrow(_held(own_path), "stretch int, held array<long>")
    every = every.repartition("stretch").mapInArrow(_held_in_all(own_path), "term string, number int, held long")
    a, b = F.col("a"), F.col("b")
    odds = F.abs(F.log((a + 0.5) * (n0 - b + 0.5) / ((b + 0.5) * (n1 - a + 0.5))))
    square = F.pow(odds, 2) / (1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
    idf = F.log((docs.count() + 1) / (F.col("held") + 1)) + 1
    known = own.join(every, "term").select("term", "number", (idf * (odds * square / (square + sure**2) + 0.01)).alias("gain"), "examples", "counts")
    index.terms_path = f"{work_folder(spark)}/terms-{uuid.uuid4().hex}"
    known.write.option("compression", "zstd").parquet(index.terms_path)
    known = spark.read.schema(known.schema).parquet(index.terms_path)
    sums = known.mapInArrow(_squares(len(toxic)), "example long, high long, low long, terms long").groupBy("example")
    norm, terms = np.ones(len(toxic)), np.zeros(len(toxic), np.int64)
    for r in sums.agg(*(F.sum(c).alias(c) for c in ("high", "low", "terms"))).collect():
        norm[r["example"]], terms[r["example"]] = np.sqrt((r["high"] + r["low"] * 2.0**-44) * 2.0**-16), r["terms"]
    index.norm = norm.tobytes()
    if terms.any():
        index.cuts, held = [0], 0
        for i, n in enumerate(terms.tolist()):
            if held and n and held + n > shard:
                index.cuts.append(i)
                held = 0
            held += n
        index.cuts.append(len(toxic))
        index.blocks_path = f"{work_folder(spark)}/blocks-{uuid.uuid4().hex}"
        blocks = known.mapInArrow(_cut(index.norm, index.cuts), "number int, shard int, block int, most double, n int, highest int, examples array<int>, counts array<int>")
        # A worker reads one file after the other, in order, and never holds or sorts all rows. Names of files have equally many digits.
        stretch = (F.lit(FILES) + F.floor(F.col("number") * F.lit(FILES) / known.count())).cast("int")
        blocks = blocks.withColumn("stretch", stretch).repartition("stretch").sortWithinPartitions("shard", "stretch", "number", "block")
        blocks.write.option("compression", "zstd").partitionBy("shard", "stretch").parquet(index.blocks_path)

    # Calibration on the examples themselves, each without its own vote and weighed by the size of its class.
    votes, ys, ws, alone = [], [], [], [0.0, 0.0]
    # They are sorted here: Spark would take all votes twice, to find out their ranges first.
    cast = [(r["vote"], r["toxic"]) for r in sample.select("toxic", "text").mapInArrow(_votes(index), "toxic int, vote double").collect()]
    for _, y in (r for r in cast if r[0] is None):
        alone[y] += scale[y]
    for vote, y in sorted(r for r in cast if r[0] is not None):
        votes.append(vote)
        ys.append(y)
        ws.append(scale[y])
    index.steps, index.scores = rising(np.array(votes), np.array(ys, float), np.array(ws))
    index.alone = alone[1] / sum(alone) if sum(alone) else 0.0
    return index


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        digests = [_digest(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["example", "digest"])


SCORES = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double>>"
PART = GROUP  # texts whose nearest examples are held at once


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, len(batch), PART):
            yield batch.slice(at, PART)


def _score(index: Index, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows if len(index.cuts) > 2 else _parts(rows):
            found = index.near(batch.column(1).to_pylist())
            scores = [index.calibrated(near) for near in found]
            beside = [n for near in found for n in near]
            ids, cosines = index.doc_ids[np.array([i for _, i in beside], np.intp)], np.array([c for c, _ in beside], float)
            evidence = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(cosines)], ["doc_id", "cosine"]))
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), evidence]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "evidence"])

    return run


def score(docs: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted, evidence`` of every row: the calibrated vote of the nearest examples of
    the whole text, and those examples with their cosines. A text without any term of the index, an empty
    or null text included, has no neighbour and scores what such examples do. Equal texts score alike.
    Null doc_ids and repeated rows are scored like any other, other columns aren't read, and an empty
    table gives no rows."""
    return texts(docs).mapInArrow(_score(index, threshold), SCORES)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they are, in one pass. A null text is
    judged as an empty one, repeated rows alike, and an empty table stays empty."""
    text = [c.lower() for c in docs.columns].index("text")
    return docs.mapInArrow(_clean(fit(docs, labels), threshold, text), docs.schema)


def _clean(index: Index, threshold: float, text: int):
    """The rows whose column ``text`` is judged clean. It goes to the worker and back once, as a batch takes memory on both sides."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows if len(index.cuts) > 2 else _parts(rows):
            near = index.near([t or "" for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array([index.calibrated(n) < threshold for n in near], pa.bool_()))

    return run
