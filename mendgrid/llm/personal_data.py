"""Personal data: fixed patterns, and more spans by a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendgrid.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, in forms that never read a stretch twice: a run of digits is entered at its start only.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_CARD = 37  # characters of 19 digits with a mark between any two

_TRIGGER = re.compile(r"[0-9@]")
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[ \t][^\s0-9@]*+[0-9@]\S*+)*+")
_SHAPE = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^A-Za-z0-9À-ɏ]")
MOST_WORDS, MOST_CHARS = 4, 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and then start."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:  # the run before an @, as far as no @ or earlier address ends it, and the domain after it
        start = at - _LOCAL.match(text[free:at][::-1]).end()
        free = at + 1
        if start < at and (m := EMAIL.match(text, start)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", free)
    if not _TRIGGER.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= MOST_CARD and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


class Covered:
    """The fixed spans of a text as stretches that don't overlap, to be asked what touches them."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int, whole: bool = False) -> bool:
        """If a stretch overlaps start to end, or holds it ``whole``."""
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and (self.starts[i] <= start and self.ends[i] >= end if whole else self.starts[i] < end)


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring words that hold a digit or an @, as (start, end) without the marks around them. Only
    segments of an island can be entities; all other words are outside."""
    if not _TRIGGER.search(text):
        return
    for m in _ISLAND.finditer(text):
        words = []
        for w in re.finditer(r"\S+", m[0]):
            start, end = m.start() + w.start(), m.start() + w.end()
            while start < end and text[start] in "\"'<>[]{},;:!?":
                start += 1
            while end > start and text[end - 1] in "\"'<>[]{},;:!?.":
                end -= 1
            if start < end:
                words.append((start, end))
        if words:
            yield words


def features(segment: str) -> list[str]:
    """Of a whole candidate segment."""
    digits = re.sub("[^0-9]", "", segment)
    shape = "".join(f"9{len(p)}" if p[0].isdigit() else "a" if p[0].isalpha() else p for p in _SHAPE.findall(segment)[:24])
    parts = segment.split(".")
    numbers = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    return [
        "bias", f"shape {shape}", f"kinds {re.sub('9[0-9]*', '9', shape)}", f"digits {min(20, len(digits))}", f"words {segment.count(' ')}",
        f"at {min(2, segment.count('@'))} dotted {'.' in segment.rpartition('@')[2]}", f"plus {segment[0] == '+'} {8 <= len(digits) <= 15}",
        f"luhn {13 <= len(digits) <= 19 and luhn(digits)} {len(digits) >= 16}", f"octets {numbers}", f"letters {any(c.isalpha() for c in segment)}", f"marks {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', segment))))[:8]}",
    ]


Weights = dict[str, dict[str, float]]  # feature -> kind -> weight


def _segments(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
    """For each word the segments that end with it: (first word, features)."""
    out = []
    for j, (_, end) in enumerate(words):
        own = []
        for i in range(j, max(-1, j - MOST_WORDS), -1):
            if end - words[i][0] > MOST_CHARS:
                break
            own.append((i, features(text[words[i][0] : end])))
        out.append(own)
    return out


def _score(weights: Weights, found: list[str], kind: str) -> float:
    return sum(weights[f].get(kind, 0.0) for f in found if f in weights)


def decode(weights: Weights, text: str, words: list[tuple[int, int]]) -> list[Span]:
    """The best segmentation: boundaries and kinds are chosen together; a word outside scores nothing."""
    best: list[float] = [0.0]
    back: list[tuple[int, str] | None] = [None]
    for j, own in enumerate(_segments(text, words)):
        top, how = best[j], None
        for i, found in own:
            for kind in KINDS:
                s = best[i] + _score(weights, found, kind)
                if s > top:
                    top, how = s, (i, kind)
        best.append(top)
        back.append(how)
    spans, j = [], len(words)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            spans.append((kind, words[i][0], words[j - 1][1]))
            j = i
    return spans


def train(examples: list[tuple[str, list[tuple[int, int]], list[Span]]], epochs: int = 4, rate: float = 0.5, shrink: float = 1e-3) -> Weights:
    """Weights by stochastic gradient on the conditional likelihood of the segmentations: observed less
    expected features, with expectations from the forward and backward sums over all segmentations. Examples
    are trained in other forms of their spans too."""
    weights: Weights = defaultdict(lambda: dict.fromkeys(KINDS, 0.0))
    examples = [v for e in examples for v in _variants(*e)]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for text, words, gold in examples:
            n = len(words)
            lattice = [(i, j, found, k, math.exp(min(30.0, _score(weights, found, k)))) for j, own in enumerate(_segments(text, words)) for i, found in own for k in KINDS]
            ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            by_end, by_start = defaultdict(list), defaultdict(list)
            for i, j, _, _, e in lattice:
                by_end[j].append((i, e))
                by_start[i].append((j, e))
            for j in range(n):
                ahead[j + 1] = ahead[j] + sum(ahead[i] * e for i, e in by_end[j])
            for i in range(n - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[j + 1] * e for j, e in by_start[i])
            observed = set(gold)
            for i, j, found, k, e in lattice:
                change = ((k, words[i][0], words[j][1]) in observed) - ahead[i] * e * behind[j + 1] / ahead[n]
                if abs(change) > 1e-6:
                    for f in found:
                        weights[f][k] += step * (change / len(found) * 3 - shrink * weights[f][k])
    return {f: w for f, w in weights.items()}


def _variants(text: str, words: list[tuple[int, int]], gold: list[Span]) -> Iterator[tuple[str, list[tuple[int, int]], list[Span]]]:
    """The island as it is, and its fixed spans in forms that the patterns don't know: phone numbers without
    the country code, with points or dashes; cards with points, bars or slashes; addresses in brackets."""
    yield text, words, gold
    for kind, start, end in gold:
        whole, forms = text[start:end], []
        if kind == "phone" and (m := re.fullmatch(r"\+\d{1,3} ?\(?(\d{3})\)?[ -](\d{3})-(\d{4})", whole)):
            forms = [f"({m[1]}) {m[2]}-{m[3]}", f"{m[1]}-{m[2]}-{m[3]}", f"{m[1]}.{m[2]}.{m[3]}"]
        elif kind == "card" and len(d := re.sub("[ -]", "", whole)) == 16:
            forms = [mark.join(d[i : i + 4] for i in range(0, 16, 4)) for mark in "._/"]
        elif kind == "ip":
            forms = [whole.replace(".", "[.]"), whole.replace(".", "(.)")]
        elif kind == "email":
            forms = [whole.replace("@", "[@]"), "[.]".join(whole.rsplit(".", 1)), whole.replace("@", "(@)")]
        for form in forms:
            own = next(islands(form))
            yield form, own, [(kind, own[0][0], own[-1][1])]


def fit(docs: DataFrame, most: int = 3000, quota: int = 4000) -> Weights:
    """A field trained on the distinct islands of at most ``most`` documents, the first in hash order of those with
    a digit or an @; their fixed spans are the labels. Of the islands that hold a span of a kind first, and of
    those without span, at most ``quota`` each are taken, in hash order. Islands of more than ``LONG``
    characters are cut between words, outside of fixed spans. An empty table gives no weights, hence no spans."""
    marked = texts(docs).where(F.col("text").rlike("[0-9@]"))
    picked = marked.select(F.xxhash64("doc_id", "text", F.lit(10)).alias("h"), "doc_id").orderBy("h", "doc_id").limit(most)
    rows = texts(docs).withColumn("h", F.xxhash64("doc_id", "text", F.lit(10))).join(picked.select("h").distinct(), "h")
    kept = rows.select("text").mapInArrow(_training, "island string, starts array<int>, ends array<int>, kinds array<string>, s array<int>, e array<int>")
    each = Window.partitionBy(F.coalesce(F.get("kinds", F.lit(0)), F.lit(""))).orderBy(F.xxhash64("island", F.lit(11)), "island")
    found = kept.distinct().withColumn("place", F.row_number().over(each)).where(F.col("place") <= quota).orderBy("island").collect()
    return train([(r["island"], list(zip(r["starts"], r["ends"], strict=True)), list(zip(r["kinds"], r["s"], r["e"], strict=True))) for r in found])


LONG = 300


def _pieces(words: list[tuple[int, int]], covered: Covered) -> Iterator[list[tuple[int, int]]]:
    """The island in pieces of about ``LONG`` characters; no fixed span lies in two pieces."""
    first = 0
    for i in range(1, len(words)):
        if words[i][1] - words[first][0] > LONG and not covered.touches(words[i - 1][1] - 1, words[i][0] + 1, whole=True):
            yield words[first:i]
            first = i
    yield words[first:]


def _training(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for text in batch.column(0).to_pylist():
            base = sorted(base_spans(text), key=lambda b: b[1])
            begins, covered = [b[1] for b in base], Covered(base)
            for words in (piece for island in islands(text) for piece in _pieces(island, covered)):
                first, last = words[0][0], words[-1][1]
                near = base[bisect_right(begins, first - 1) : bisect_right(begins, last)]
                own = [(k, s - first, e - first) for k, s, e in near if e <= last]
                starts, ends = {w[0] - first for w in words}, {w[1] - first for w in words}
                if all(s in starts and e in ends for _, s, e in own):
                    out.append((text[first:last], [w[0] - first for w in words], [w[1] - first for w in words], *([list(c) for c in zip(*own, strict=True)] or [[], [], []])))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
        kinds = [pa.string(), ints, ints, strings, ints, ints]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["island", "starts", "ends", "kinds", "s", "e"])


def all_spans(weights: Weights, text: str) -> tuple[list[Span], list[Span]]:
    """(fixed spans, all spans), each by kind and then start. The field's spans are added where they don't
    touch a fixed one."""
    base = base_spans(text)
    covered, added = Covered(base), []
    for words in islands(text) if weights else ():
        if not all(covered.touches(*w) for w in words):
            added += [s for s in decode(weights, text, words) if not covered.touches(s[1], s[2])]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(weights: Weights):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for batch in rows:
            out = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(weights, text)
                kinds = [b[0] for b in base]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(every), len(every) - len(base)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in FOUND.split(", ")])

    return run


def find(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row. The counts and
    the digest are of the fixed patterns' spans, ``spans`` holds all. Offsets count code points. A text that
    is null, empty or without digit and @ has no span. Null doc_ids and repeated rows are treated like any
    other, other columns aren't read, and an empty table gives no rows."""
    return texts(docs).mapInArrow(_find(weights), FOUND)
