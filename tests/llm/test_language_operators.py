"""Context-tree scores, whitening and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendgrid.llm import context_tree, periodic_runs, personal_data, queries, whitening

PROSE = "the quick brown fox jumps over the lazy dog and the Quick dog sleeps"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, 1, "n", None) for i, t in rows], "doc_id long, text string, block int, word string, score double"
    )


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = PROSE.split() + ["é", "日本", "x" * 40, "\tTab", "two\n\nlines"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "ÿ\x00\x7f"), (n + 4, rows[0][1]), (n + 5, "zebra " * 900)]


# ------------------------------------------------------------------ context tree


def kt(a: int, b: int) -> float:
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) if a + b else 0.0


def brute_tree(learnt: list[bytes], scored: list[bytes], depth: int) -> list[float]:
    """log10 probabilities by walking the whole tree, context by context."""
    edge = bytes([0xFF])
    counts: dict[tuple[bytes, int], list[int]] = defaultdict(lambda: [0, 0])
    children: dict[tuple[bytes, int], set[bytes]] = defaultdict(set)
    for text in learnt:
        data = edge * depth + text + edge
        for i in range(depth, len(data)):
            node = 1
            for bit in map(int, f"{data[i]:08b}"):
                for d in range(depth + 1):
                    context = data[i - d : i]
                    counts[context, node][bit] += 1
                    if d < depth:
                        children[context, node].add(data[i - d - 1 : i])
                node = 2 * node + bit
    weights: dict[tuple[bytes, int], float] = {}

    def weighted(context: bytes, node: int) -> float:
        own = kt(*counts[context, node])
        if len(context) == depth:
            weights[context, node] = 1.0
            return own
        below = sum(weighted(c, node) for c in sorted(children[context, node]))
        weights[context, node] = 1 / (1 + math.exp(min(700, below - own)))
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    for node in range(1, 256):
        if (b"", node) in counts:
            weighted(b"", node)
    out = []
    for text in scored:
        data, total = edge * depth + text + edge, 0.0
        for i in range(depth, len(data)):
            node = 1
            for bit in map(int, f"{data[i]:08b}"):
                one, rest = 0.0, 1.0
                for d in range(depth + 1):
                    context = data[i - d : i]
                    if (context, node) not in weights:
                        one += rest / 2
                        break
                    a, b = counts[context, node]
                    one += rest * weights[context, node] * (b + 0.5) / (a + b + 1)
                    rest *= 1 - weights[context, node]
                total += math.log10(one if bit else 1 - one)
                node = 2 * node + bit
        out.append(total)
    return out


def lowered(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.mark.parametrize(("depth", "block"), [(0, 1 << 20), (2, 1 << 20), (5, 600)])
def test_context_tree_equals_the_whole_tree(spark, monkeypatch, depth, block):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", block)
    rows = texts(1, 60)
    got = {r.doc_id: r for r in context_tree.score(documents(spark, rows).repartition(3), depth).collect()}
    assert len(got) == len(rows)
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    assert any(out.values())
    learnt = [lowered(t) for i, t in rows if not out[i]]
    counts = Counter(w for t in learnt for w in [*t.split(), None])
    tokens, kinds = sum(counts.values()), len(counts)
    wanted = brute_tree(learnt, [lowered(t) for _, t in rows], depth)
    for (i, t), score in zip(rows, wanted, strict=True):
        words = [*lowered(t).split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (tokens + 0.5 * (kinds + 1))) for w in words)
        row = got[i]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (out[i], len(words), tokens)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert row.base_score == pytest.approx(base, rel=1e-12)
        assert row.score == pytest.approx(score, rel=1e-9)
        assert row.bits_per_byte == pytest.approx(-score * math.log2(10) / (len(lowered(t)) + 1), rel=1e-9)


def test_context_tree_is_a_probability(spark):
    """Over all single bytes that can follow, and the end, the probabilities add up to one."""
    strings = spark.createDataFrame([((65 << 16) | (66 << 8) | b, n) for b, n in [*[(b, 0) for b in range(256)]][:256]], "string long, n long")
    learnt = spark.createDataFrame([((65 << 16) | (66 << 8) | 67, 5), ((1 << 16) | (66 << 8) | 68, 2)], "string long, n long")
    both = strings.unionByName(learnt).groupBy("string").agg(F.sum("n").alias("n"))
    rows = context_tree.string_scores(both, 2).where("string >> 8 = 16706").collect()
    assert len(rows) == 256 and sum(10**r.log10_p for r in rows) == pytest.approx(1, abs=1e-12)


def test_context_tree_without_training_or_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = context_tree.score(documents(spark, [(i, "ab c") for i in held])).collect()
    assert [(r.n_known, r.train_tokens, round(r.bits_per_byte, 9)) for r in rows] == [(0, 0, 8.0)] * 3
    assert context_tree.score(documents(spark, [])).collect() == []
    one = context_tree.score(documents(spark, [(None, "a b"), (None, "a b")])).collect()
    assert [(r.held_out, r.n_known) for r in one] == [(False, 3)] * 2


def test_context_tree_prefers_the_language_it_learnt(spark):
    rows = [(i, PROSE) for i in range(40)] + [(100, PROSE[::-1])]
    got = {r.doc_id: r.score for r in context_tree.score(documents(spark, rows)).collect()}
    assert got[0] > got[100] + 20


# ------------------------------------------------------------------ whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1.5) for i, v in rows], "vec_id long, embedding array<float>, component int, x double")


def brute_whitening(rows, k):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    apart = x - s / n
    values, found = np.linalg.eigh(apart.T @ apart / n)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    total = np.trace(apart.T @ apart / n)
    return n, ((n * x - s) ** 2).sum(axis=1), apart @ found / np.sqrt(values), values / total


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    spread = np.linspace(3, 0.5, 40)
    rows = [(i, (rng.standard_normal(40) * spread).tolist()) for i in range(300)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 40), (903, [None] * 40), (904, [float("inf")] + [0.0] * 39), (905, [1.0, 2.0])]
    again = [*rows, rows[0], (None, rows[1][1])]
    got = whitening.whitened_components(vectors(spark, [*again, *bad]).repartition(4), 8).collect()
    n, deviation, white, share = brute_whitening(again, 8)
    assert len(got) == 8 * len(again)
    first = {}
    for r in got:
        first.setdefault((r.vec_id, r.component), r)
    for j in range(8):
        mine = np.array([first[i, j + 1].whitened for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ white[:300, j]) - white[:300, j]).max() < 1e-9
        r = first[0, j + 1]
        assert r.n == n and r.explained == pytest.approx(share[j], rel=1e-10)
        assert r.identity_error < 1e-9 and r.residual <= 1e-12
    assert [int(first[i, 1].deviation) for i, _ in rows] == deviation[:300].tolist()


def test_whitening_of_few_dimensions_and_none(spark):
    flat = [(i, [1.0, float(i), float(2 * i)]) for i in range(6)]
    got = whitening.whitened_components(vectors(spark, flat), 8).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert whitening.whitened_components(vectors(spark, [(1, [2.0, 3.0])] * 3), 8).collect() == []
    empty = whitening.whitened_components(vectors(spark, []), 8)
    assert empty.collect() == [] and empty.columns == whitening.whitened_components(vectors(spark, flat), 8).columns


def test_subspace_certifies_against_close_values():
    """Eigenvalues that lie close together make the block grow instead of never ending."""
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.concatenate([np.linspace(1.001, 1.0, 60), np.linspace(0.9, 0.1, 30)])
    a = (q * values) @ q.T
    passes = []
    found, vectors_, residuals = whitening.subspace(lambda b: (passes.append(b.shape[1]), a @ b)[1], 90, 4)
    assert np.abs(found - values[:4]).max() < 1e-12 and residuals.max() < 1e-12
    assert np.abs(a @ vectors_ - vectors_ * found).max() < 1e-11
    assert max(passes) > 16


def test_filter_is_the_chebyshev_polynomial():
    points = np.array([0.0, 0.3, 0.7, 1.0, 1.5, 2.0])
    a = np.diag(points)
    q = np.ones((6, 1))
    got = whitening.filtered(lambda b: a @ b, q, a @ q, 2.0, 1.0, 5)[:, 0]
    chebyshev = np.polynomial.chebyshev.Chebyshev([0] * 5 + [1])
    assert np.allclose(got, chebyshev(2 * points - 1) / chebyshev(3.0))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(2.0**40 * (i % 2)), 0.0]) for i in range(64)]
    got = whitening.whitened_components(vectors(spark, rows), 1).collect()
    assert int(got[0].deviation) == (64 * 100000 - (64 * 100000 + 32 * 2**50)) ** 2
    with pytest.raises(Exception, match="out of range"):
        whitening.whitened_components(vectors(spark, [(1, [2.0**50, 1.0]), (2, [0.0, 1.0])]), 1).collect()


# ------------------------------------------------------------------ periodic runs


def brute_runs(words) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing every word with the one each period on."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(24, 3 * q):
                if not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def patchwork(rng: random.Random) -> list[int]:
    kinds, out = rng.choice([1, 2, 3, 5, 40]), []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
        size = rng.randint(1, 120)
        out += [unit[i % len(unit)] for i in range(size)] if rng.random() < 0.6 else [rng.randrange(kinds) for _ in range(size // 2)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    some = 0
    for _ in range(150):
        docs = [patchwork(rng) for _ in range(rng.randint(1, 5))]
        words = np.array([40 * k + w for k, d in enumerate(docs) for w in d])
        text = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        starts = np.cumsum([0, *[len(d) for d in docs]])
        got = sorted((b - starts[text[b]], e - b, q, text[b]) for b, e, q in periodic_runs.runs_of(words, text))
        wanted = sorted((s, size, q, k) for k, d in enumerate(docs) for s, size, q in brute_runs(d))
        assert [tuple(map(int, r)) for r in got] == wanted
        some += len(wanted)
    assert some > 100


def test_grammar_derives_the_text():
    rng = random.Random(4)
    for _ in range(40):
        words = np.array(patchwork(rng))
        g = periodic_runs.repair(words, np.zeros(len(words), np.int64))
        out = g.symbols.tolist()
        for i in range(len(g.left) - 1, -1, -1):
            out = [x for s in out for x in ((int(g.left[i]), int(g.right[i])) if s == g.first + i else (s,))]
        assert out == words.tolist()
        pairs = Counter()
        last = None
        for i, p in enumerate(zip(g.symbols.tolist(), g.symbols.tolist()[1:])):
            if last != (p, i - 1):
                pairs[p] += 1
                last = (p, i)
        assert not pairs or max(pairs.values()) == 1


def test_long_texts_take_near_linear_time():
    """Hundreds of thousands of words of one symbol, of one long period and of two symbols by chance."""
    n = 300_000
    for words, period in ((np.zeros(n, np.int64), 1), (np.arange(n) % 777, 777), (np.random.default_rng(1).integers(0, 2, n), None)):
        runs = periodic_runs.runs_of(words, np.zeros(n, np.int64))
        if period:
            assert runs.tolist() == [[0, n, period]]
        for b, e, q in runs:
            assert (words[b : e - q] == words[b + q : e]).all() and e - b >= max(24, 3 * q)


def test_periodic_runs_of_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "  \n\t "), (63, "na " * 24), (64, "na " * 23), (65, "A a " * 30), (65, "A a " * 30), (None, "b " * 40)]
    rows += [(66, " ".join(f"u{i % 700}" for i in range(6000)))]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    got = periodic_runs.periodic_runs(documents(spark, rows).coalesce(1), repeat=True).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got, strict=True):
        words = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words) if n < 1000 or h % 10 == 0 else [(0, n, 700)]
        dropped = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert r.doc_id == i and r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
    assert periodic_runs.periodic_runs(documents(spark, [])).collect() == []


def test_registered_queries_return_the_contracts_columns(spark):
    wanted = {
        "op11_context_tree": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op12_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
        "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    }
    for name, columns in wanted.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert columns <= set(df.columns) and df.count() > 0


def test_addresses_with_thousands_of_zeros():
    """The length of a part doesn't matter, only its value."""
    zeros = "x " + "0" * 5000 + ".1.1.1"
    assert personal_data.base_spans(zeros) == [("ip", 2, len(zeros))]
    assert personal_data.base_spans("x " + "0" * 5000 + "256.1.1.1") == []
