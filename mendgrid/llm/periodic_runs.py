"""Periodic runs of words, found in grammar-compressed texts.

Each text's word ids are compressed by Re-Pair: a round replaces the pairs that are more frequent than their
neighbours, and rounds go on until no pair of a text occurs twice. A run lies across the boundary
of exactly one lowest node of the derivation, so the runs of a nonterminal are computed once, across the
boundary of its two parts, at one of its places. A balanced binary tree over the symbols that are left serves as the
start rule. The runs found are moved to every place where the nonterminal is derived, and intervals of one period
that overlap are merged.

All texts of an Arrow batch are compressed and searched together, as arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.shingles import mix

LEAST = 24  # words in a run
TIMES = 3  # periods in a run
_GRAM = 4  # words that a run's overhang over its period has at least, on its longer side
_CHUNK = 1 << 21  # candidates looked at together
_BATCH_WORDS = 1 << 20


@dataclass
class Grammar:
    """Rules in order of their making: ``left[i]``, ``right[i]`` are the parts of symbol ``first + i``.

    ``place`` is one position where the rule's text begins. Ids below ``first`` are words."""

    first: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of every symbol, words included
    place: np.ndarray
    rounds: list[tuple[int, int]] = field(default_factory=list)  # range of rule numbers made in a round
    symbols: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # what is left of the texts
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # their word positions


def _chosen(same: np.ndarray, count: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places whose pair is replaced: the pairs that beat both overlapping neighbours by count, then by a hash
    of the pair, so that equally frequent ones fall in few rounds.

    ``same`` tells where a pair equals the one before it (a run of one symbol): every second place of
    such a run counts, from its start."""
    n = len(rank)
    begin = np.flatnonzero(~same)
    inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    ok = (count >= 2) & (inside % 2 == 0)
    beats = np.ones(n, bool)
    # An equal neighbour is settled by the parity.
    ahead = (count[:-1] > count[1:]) | ((count[:-1] == count[1:]) & (rank[:-1] <= rank[1:]))
    behind = (count[1:] > count[:-1]) | ((count[1:] == count[:-1]) & (rank[1:] <= rank[:-1]))
    beats[:-1] &= ahead
    beats[1:] &= behind
    return ok & beats


def repair(words: np.ndarray, text: np.ndarray) -> Grammar:
    """Compress word ids; ids of different texts differ, so no pair or rule crosses or joins texts.

    ``text`` is the number of each word's text. Ends when no pair occurs twice without overlapping, or,
    as each round replaces a pair at two places at least, after finitely many rounds."""
    first = int(words.max()) + 1 if len(words) else 0
    s, at = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
    lengths = [np.ones(first, np.int64)]
    left, right, place, rounds = [], [], [], []
    made = 0
    joined = text[:-1] == text[1:] if len(text) else np.empty(0, bool)
    live = np.ones(max(0, len(s) - 1), bool)  # pairs that may occur twice
    while True:
        where = np.flatnonzero(live & joined)
        code = (s[where] << 32) | s[where + 1]
        _, place_of, count = np.unique(code, return_inverse=True, return_counts=True)
        count = count[place_of]
        again = count >= 2
        where, code, count = where[again], code[again], count[again]
        if not len(where):
            break
        # Pairs of neighbouring places overlap; a gap between them counts as an end.
        gap = np.diff(where) > 1
        neighbour = np.zeros(len(where), bool)
        neighbour[1:] = ~gap & (code[1:] == code[:-1])
        cut = np.flatnonzero(gap) + 1
        # Put a losing place into each gap, so places apart don't compete.
        spread = np.insert(mix(code.view(np.uint64)), cut, 0), np.insert(count, cut, 0), np.insert(neighbour, cut, False)
        chosen = np.delete(_chosen(spread[2], spread[1], spread[0]), cut + np.arange(len(cut)))
        where, code = where[chosen], code[chosen]
        pairs, first_at, rule, used = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        useful = used >= 2
        if not useful.any():
            # No pair beats its neighbours twice: take the most frequent pair alone.
            where, code = _most_frequent(s, live & joined)
            if not len(where):
                break
            pairs, first_at, rule, used = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            useful = used >= 2
        number = np.cumsum(useful) - 1
        taken = useful[rule]
        where, rule = where[taken], number[rule[taken]]
        pairs, first_at = pairs[useful], first_at[useful]
        size = np.concatenate(lengths)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        left.append(a)
        right.append(b)
        lengths.append(size[a] + size[b])
        spot = np.empty(len(pairs), np.int64)
        spot[rule[::-1]] = at[where[::-1]]
        place.append(spot)
        rounds.append((made, made + len(pairs)))
        s[where] = first + made + rule
        made += len(pairs)
        gone = np.zeros(len(s), bool)
        gone[where + 1] = True
        fresh = np.zeros(len(s), bool)
        fresh[where] = True
        # The place of the right part goes; its link to what follows is the pair's now.
        joined = np.append(joined, False)
        joined[where] = joined[where + 1]
        # Pairs that didn't occur twice can't begin to; those with a new symbol may.
        was = np.append(live, False)
        stay = ~gone
        s, at, joined, fresh, was = s[stay], at[stay], joined[stay][:-1], fresh[stay], was[stay][:-1]
        live = was | fresh[:-1] | fresh[1:]
    nothing = np.empty(0, np.int64)
    return Grammar(
        first,
        np.concatenate(left) if left else nothing,
        np.concatenate(right) if right else nothing,
        np.concatenate(lengths),
        np.concatenate(place) if place else nothing,
        rounds,
        s,
        at,
    )


def _most_frequent(s: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-overlapping places of the most frequent pair, if it has two."""
    where = np.flatnonzero(live)
    code = (s[where] << 32) | s[where + 1]
    begin = np.concatenate([[True], (np.diff(where) > 1) | (np.diff(code) != 0)]) if len(code) else np.empty(0, bool)
    start = np.flatnonzero(begin)
    inside = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    where, code = where[inside % 2 == 0], code[inside % 2 == 0]
    pairs, count = np.unique(code, return_counts=True)
    if not len(pairs) or count.max() < 2:
        return where[:0], code[:0]
    best = code == pairs[count.argmax()]
    return where[best], code[best]


def _tree(grammar: Grammar, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, middle, end) of the nodes of a balanced binary tree over each text's remaining symbols."""
    at = grammar.starts
    own = text[at]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(at) else np.empty(0, np.int64)
    ends = np.append(at, n)
    out = []
    low, high = edge, np.append(edge[1:], len(at))
    while len(low):
        big = (high - low > 1) & (ends[high] - ends[low] >= LEAST)
        low, high = low[big], high[big]
        mid = (low + high) // 2
        out.append(np.stack([ends[low], ends[mid], ends[high]]))
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, np.int64),) * 3


def _grams(w: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for the ``_GRAM`` words at each place, equal for equal ones; -1 where a text ends first."""
    n = len(w) - _GRAM + 1
    if n <= 0:
        return np.full(len(w), -1, np.int64)
    ids = w.astype(np.int64)
    for step in (1, 2):  # pairs, then pairs of pairs
        whole = np.full(len(w), -1, np.int64)
        keys = (ids[:-step] << 32) | ids[step:]
        fits = (ids[:-step] >= 0) & (ids[step:] >= 0) & (text[:-step] == text[step:])
        whole[:-step][fits] = np.unique(keys[fits], return_inverse=True)[1]
        ids = whole
    return ids


def _same_until(w: np.ndarray, i: int, j: int, limit: int) -> int:
    """Number of equal words from places i and j on, at most ``limit``."""
    done, step = 0, 32
    while done < limit:
        m = min(step, limit - done)
        differ = w[i + done : i + done + m] != w[j + done : j + done + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, step * 2
    return limit


def _same_before(w: np.ndarray, i: int, j: int, limit: int) -> int:
    """Number of equal words before places i and j, at most ``limit``."""
    done, step = 0, 32
    while done < limit:
        m = min(step, limit - done)
        differ = (w[i - done - m : i - done] != w[j - done - m : j - done])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, step * 2
    return limit


def _smallest(w: np.ndarray, begin: int, period: int) -> bool:
    """Whether no shorter period generates the stretch; one would divide ``period``."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            shorter = period // prime
            if _same_until(w, begin, begin + shorter, 2 * period - shorter) == 2 * period - shorter:
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _crossing(
    w: np.ndarray, gram: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray
) -> list[tuple[int, int, int, int]]:
    """(node, begin, end, period) of the runs inside each node that cross its middle.

    A run of three periods reaches one and a half of them to one side of the middle, so the ``_GRAM`` words
    there come again one period on: those places are the candidates. They are compared word by word."""
    order = np.lexsort((np.arange(len(gram)), gram))
    rank = np.empty(len(gram), np.int64)
    rank[order] = np.arange(len(gram))
    wide = len(gram) + 1
    keyed = gram[order] * wide + order
    span = (end - begin) // TIMES
    found: list[tuple[int, int, int, int]] = []
    for forward in (True, False):
        if forward:
            anchor = middle
            limit = np.minimum(span, (end - middle) * 2 // 3)
        else:
            anchor = middle - _GRAM
            limit = np.minimum(span, (middle - begin) * 2 // 3)
        usable = np.flatnonzero((limit >= 1) & (anchor >= 0))
        usable = usable[gram[anchor[usable]] >= 0]
        a = anchor[usable]
        if forward:
            low = rank[a] + 1
            high = np.searchsorted(keyed, gram[a] * wide + a + limit[usable], "right")
        else:
            high = rank[a]
            low = np.searchsorted(keyed, gram[a] * wide + a - limit[usable], "left")
        number = np.maximum(high - low, 0)
        usable, a, low, number = usable[number > 0], a[number > 0], low[number > 0], number[number > 0]
        edge = np.append(0, np.cumsum(number))
        i = 0
        while i < len(usable):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + _CHUNK, "right")) - 1)
            reps = number[i:j]
            node = np.repeat(usable[i:j], reps)
            inside = np.arange(edge[j] - edge[i]) - np.repeat(edge[i:j] - edge[i], reps)
            other = order[np.repeat(low[i:j], reps) + inside]
            period = np.abs(other - np.repeat(a[i:j], reps))
            _verify(w, begin, middle, end, node, period, forward, found)
            i = j
    return found


def _verify(w, begin, middle, end, node, period, forward, found) -> None:
    """Add the candidates that hold three periods to ``found``."""
    # On its longer side a run goes on for half a period, and for 12 words in all, beyond its first period.
    over = np.maximum((period + 1) // 2, LEAST // 2 - period)
    for part in (1.0, 0.5, 0.75, 0.25):
        at = np.maximum((over * part).astype(np.int64), 1)
        m = middle[node]
        if forward:
            x, y = m + at - 1, m + at - 1 + period
            fits = y < end[node]
        else:
            x, y = m - at, m - at - period
            fits = y >= begin[node]
        ok = fits & (w[np.where(fits, x, 0)] == w[np.where(fits, y, 0)])
        node, period, over = node[ok], period[ok], over[ok]
    by = np.lexsort((period, node))
    last, known = -1, []
    for k, q in zip(node[by].tolist(), period[by].tolist(), strict=True):
        if k != last:
            last, known = k, []
        # A multiple of a period that holds throughout makes no run of its own.
        if any(q % p == 0 and q <= size for p, size in known):
            continue
        b, m, e = int(begin[k]), int(middle[k]), int(end[k])
        if forward:
            right = q + _same_until(w, m, m + q, e - m - q)
            left = _same_before(w, m, m + q, m - b)
        else:
            left = q + _same_before(w, m - q, m, m - q - b)
            right = _same_until(w, m - q, m, e - m)
        if left + right >= max(LEAST, TIMES * q) and _smallest(w, m - left, q):
            known.append((q, left + right))
            found.append((k, m - left, m + right, q))


def runs_of(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) of all maximal runs, by place; places count over all texts.

    ``words`` holds ids that texts don't share, ``text`` the rising number of each word's text."""
    n = len(words)
    if n < LEAST:
        return np.empty((0, 3), np.int64)
    grammar = repair(words, text)
    rules = len(grammar.left)
    size = grammar.length[grammar.first :]
    gram = _grams(words, text)
    # Nonterminals at one of their places, then the nodes of the start rule.
    large = np.flatnonzero(size >= LEAST)
    split = grammar.place[large] + grammar.length[grammar.left[large]]
    tree = _tree(grammar, text, n)
    begin = np.concatenate([grammar.place[large], tree[0]])
    middle = np.concatenate([split, tree[1]])
    end = np.concatenate([grammar.place[large] + size[large], tree[2]])
    out: list[tuple[int, int, int]] = []
    of_rule: dict[int, list[tuple[int, int, int]]] = {}
    for k, b, e, q in dict.fromkeys(_crossing(words, gram, begin, middle, end)):
        if k < len(large):
            rule = int(large[k])
            of_rule.setdefault(rule, []).append((b - int(grammar.place[rule]), e - int(grammar.place[rule]), q))
        else:
            out.append((b, e, q))
    if of_rule:
        out.extend(_moved(grammar, rules, of_rule))
    return _merged(out)


def _moved(grammar: Grammar, rules: int, of_rule: dict[int, list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int]]:
    """The runs of the nonterminals at every place where they are derived."""
    first = grammar.first
    holds = np.zeros(first + rules, bool)
    holds[first + np.array(list(of_rule))] = True
    for low, high in grammar.rounds:
        own = np.arange(low, high)
        holds[first + own] |= holds[grammar.left[own]] | holds[grammar.right[own]]
    symbol, place = grammar.symbols[holds[grammar.symbols]], grammar.starts[holds[grammar.symbols]]
    for low, high in reversed(grammar.rounds):
        here = symbol >= first + low
        rule, at = symbol[here] - first, place[here]
        for r, p in zip(rule.tolist(), at.tolist(), strict=True):
            for b, e, q in of_rule.get(r, ()):
                yield p + b, p + e, q
        left, right = grammar.left[rule], grammar.right[rule]
        beside = at + grammar.length[left]
        symbol = np.concatenate([symbol[~here], left[holds[left]], right[holds[right]]])
        place = np.concatenate([place[~here], at[holds[left]], beside[holds[right]]])


def _merged(found: list[tuple[int, int, int]]) -> np.ndarray:
    """Maximal intervals: pieces of one period that share a period's length are parts of one run."""
    out: list[list[int]] = []
    for q, b, e in sorted({(q, b, e) for b, e, q in found}):
        if out and out[-1][2] == q and b <= out[-1][1] - q:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e, q])
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def spliced(n: int, doc_id: int | None) -> np.ndarray | None:
    """Numbers of the original words of a text of ``n`` words after the contract's repetition, or None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Columns of one text from its (start, length, period)."""
    ordered = sorted(runs, key=lambda r: (r[0], r[2]))
    best = max(ordered, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if ordered:
        keep = np.ones(len(words), bool)
        for s, length, q in ordered:
            keep[s + q : s + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return (
        len(ordered),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        _digest("".join(f"{s},{length},{q}\n" for s, length, q in ordered)),
        _digest(b" ".join(words)),
        [{"start": s, "length": length, "period": q} for s, length, q in ordered],
    )


def _batch_rows(ids: list[int | None], texts: list[bytes | None], repeat: bool) -> list[tuple]:
    held, numbers, base = [], [], 0
    for doc_id, value in zip(ids, texts, strict=True):
        # bytes.split() parts at space, tab, line feed, vertical tab, form feed and carriage return.
        words = (value or b"").split()
        taken = spliced(len(words), doc_id) if repeat else None
        if taken is not None:
            words = [words[i] for i in taken.tolist()]
        own: dict[bytes, int] = {}
        codes = np.fromiter((own.setdefault(x, len(own)) for x in words), np.int64, len(words))
        held.append(words)
        numbers.append(codes + base)
        base += len(own)
    size = np.array([len(x) for x in held])
    start = np.append(0, np.cumsum(size))
    text = np.repeat(np.arange(len(held)), size)
    found = runs_of(np.concatenate(numbers) if numbers else np.empty(0, np.int64), text)
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for b, e, q in found.tolist():
        k = int(text[b])
        by_text.setdefault(k, []).append((b - int(start[k]), e - b, q))
    return [(doc_id, *_report(words, by_text.get(k, []))) for k, (doc_id, words) in enumerate(zip(ids, held, strict=True))]


_COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ]
)


def periodic_runs(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """One row per document: ``n_runs``, the run of most periods (``start``, ``length``, ``period``,
    ``exponent_milli``; null without a run), digests of all runs and of the text without the repetitions, and
    ``runs`` themselves.

    Words are told apart as they stand, case included. With ``repeat`` texts are first changed as ``spliced`` says; a document
    without id is left as it is. Null and empty texts have no runs and the digest of the empty string.
    Repeated rows keep a row each; other columns are left unread. Texts of an Arrow batch are taken together up to
    about a million words, a longer one alone; nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            held_ids: list[int | None] = []
            held: list[bytes | None] = []
            size = 0
            for k, doc_id in enumerate(ids):
                value = column[k].as_py()
                held_ids.append(doc_id)
                held.append(value)
                size += len(value or b"") // 6
                if size >= _BATCH_WORDS or k == len(ids) - 1:
                    made = _batch_rows(held_ids, held, repeat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS
                    )
                    held_ids, held, size = [], [], 0

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(
        rows,
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>",
    )
