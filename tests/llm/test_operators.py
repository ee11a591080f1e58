"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mendgrid.llm import grace_dedup, graph, kd_sharding, mixing, near_dedup, packing, personal_data, range_join, suffix_dedup, token_blocks, toxicity
from mendgrid.llm.queries import TOKENIZERS
from mendgrid.llm.token_cache import CachedEncoder

WORDS = [f"{a}{b}" for a in ("on", "the", "sti", "ra", "ül") for b in ("der", "ing", "qa", "mo", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label string"


def rows_of() -> list[tuple]:
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = make(120)
    texts = [None, "", " ", "a", "A\tb", base, base, base + " more", base.replace("on", "un", 1), make(3000), "x" * 900, "x" * 900 + "y"]
    texts += [make(r.randint(1, 200)) + ". " + base[100:560] for _ in range(6)] + [make(r.randint(1, 300)) for _ in range(20)]
    rows = [(i, t, "en", r.choice(["a", "b", None]), 0, 1, 2, "z") for i, t in enumerate(texts)]
    return rows + [(5, base, "en", "a", 0, 1, 2, "z"), (None, "nobody", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def byid(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups(docs, none):
    texts = [(r[0], r[1] or "") for r in rows_of()]
    want = []
    for i, t in texts:
        same = [j for j, u in texts if u == t]
        best = max((j for j in same if j is not None), default=None)
        want.append((i, best, len(same), i == best, hashlib.sha256(t.encode()).hexdigest()))
    assert byid(grace_dedup.exact_groups(docs)) == sorted(want, key=repr)
    assert grace_dedup.exact_groups(none).count() == 0
    kept = [r["doc_id"] for r in grace_dedup.exact_dedup(docs).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(i) for i in {w[1] for w in want})


def test_grace_spills_and_keeps_every_record():
    r = random.Random(1)
    records = [(hashlib.sha256(t).digest(), t, i, 1) for i in range(4000) for t in [str(r.randrange(900)).encode() * 30]]
    found = {e[1]: (e[2], e[3]) for e in grace_dedup.grace(iter(records), memory=5000)}
    want: dict = {}
    for _, t, i, _ in records:
        want[t] = (i, want.get(t, (0, 0))[1] + 1)
    assert found == want


def test_near_groups(docs, none):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()

    rows = [(r[0], grams(r[1])) for r in rows_of()]
    name = {i: i for i in range(len(rows))}
    for _ in rows:
        for a, (_, s) in enumerate(rows):
            for b, (_, t) in enumerate(rows):
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    name[a] = name[b] = min(name[a], name[b])
    least = {c: min((rows[i][0] for i in name if name[i] == c and rows[i][0] is not None), default=None) for c in set(name.values())}
    want = [(i, len(s), least[name[k]], i == least[name[k]]) for k, (i, s) in enumerate(rows)]
    assert byid(near_dedup.near_groups(docs)) == sorted(want, key=repr)
    # The exact join on rare shingles alone finds the same groups.
    assert byid(near_dedup.near_groups(docs, pivot_rounds=0)) == sorted(want, key=repr)
    assert near_dedup.near_groups(none).count() == 0


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [np.unique(x) for x in (a[:900], a[100:], a[:1], a[:2])]
    s = near_dedup.sketch(sets)
    assert (s != near_dedup._UNSET).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert (near_dedup.sketch([np.empty(0, np.uint64)]) == near_dedup._UNSET).all()


def test_removed_repeats(docs, none):
    data = [(r[0], (r[1] or "").encode()) for r in rows_of()]
    seen = collections.Counter(b[g : g + 400] for _, b in data for g in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for g in range(len(b) - 399):
            if seen[b[g : g + 400]] > 1:
                gone[g : g + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    assert byid(suffix_dedup.removed_repeats(docs)) == sorted(want, key=repr)
    assert suffix_dedup.removed_repeats(none).count() == 0


def test_merge_keeps_order_and_prefixes():
    r = random.Random(3)
    items = [(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), b"l", b"k" * 16, i + 9, i, i) for i in range(300)]
    runs = [suffix_dedup.read_run(suffix_dedup.front_code(sorted(items[k::7]))) for k in range(7)]
    merged = list(suffix_dedup.merge(runs))
    assert [m[1][0] for m in merged] == sorted(i[0] for i in items)
    assert sorted(m[1] for m in merged) == sorted(items)
    for (_, a), (shared, b) in zip(merged, merged[1:], strict=False):
        assert shared == suffix_dedup.common(a[0], b[0])


def test_token_blocks(docs, none):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    tokenizer = Tokenizer.from_file(path)
    found = byid(token_blocks.read_tokens(token_blocks.write_tokens(docs, path, end_id=2)))
    ids = {(r[0], r[1] or ""): [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows_of()}
    want = sorted(((i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for (i, _), v in ids.items()), key=repr)
    assert sorted({(r[0], r[2], r[3]) for r in found}, key=repr) == want
    at = 0
    for r in sorted(found, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    assert token_blocks.read_tokens(token_blocks.write_tokens(none, path, end_id=2)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_segments_round_trip(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 300, n).astype(np.uint32)
    ids[r.random(n) < 0.02] = 0xFFFFFFF0
    lengths, back = token_blocks.unpack_segment(token_blocks.pack_segment(ids, [n]))
    assert lengths.tolist() == [n] and (back == ids).all()
    if n == 1000:
        assert (token_blocks.unpack_segment(token_blocks.pack_segment(ids, [n]), 2, 4)[1] == ids[256:512]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_cached_encoder_equals_the_tokenizer(name):
    e = CachedEncoder(f"{TOKENIZERS}/{name}.json", entries=40)
    odd = ["a <|endoftext|> b", "don't  stop\n\n\tX.,y ., z", "Été É. ÇA, Σας ΟΔΟΣ. İx", "a\x1cb c", "中文 test. é́ ²x3. foo'S. foo_.", "A. b, c."]
    for text in [r[1] or "" for r in rows_of()] + odd:
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs, none):
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    found = packing.pack_documents(docs, path, end_id=2, capacity=512).collect()
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 512 or at & (at - 1) == 0
    tokenizer = Tokenizer.from_file(path)
    ids = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows_of()]
    assert sum(r["length"] for r in found) == sum(ids)
    assert packing.pack_documents(none, path, end_id=2).count() == 0


def test_differencing_keeps_items_and_balances():
    r = random.Random(2)
    sizes = [r.randint(1, 4000) for _ in range(500)]
    windows = packing.difference(sizes, 60)
    assert sorted(i for w in windows for i in w) == list(range(500))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) < 0.05 * sum(sums) / 60
    assert all(sum([3, 3, 3][i] for i in w) <= 4 for w in packing.windows_of([3, 3, 3], 4))


def test_mix(docs, none):
    found = mixing.taken(*mixing.mix(docs, block=8)).collect()
    assert len(found) == len(rows_of())
    words = {}
    for r in rows_of():
        words.setdefault(r[3], 0)
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    plan = mixing.targets(list(words.items()), [3, 1, 2], 1.5, 2.0)
    assert sum(t for _, _, t in plan) == pytest.approx(1.5 * sum(words.values())) and all(t <= 2 * n + 1e-9 for _, n, t in plan)
    by = collections.Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["target"]] += r["taken"]
    for _, _, t in plan:
        assert abs(by[t] - t) <= 0.05 * t + 40
    assert mixing.taken(*mixing.mix(none)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_meets_small_targets(spark):
    """One large source and many of less than a few blocks: each target is met to the word."""
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * 500), "large") for i in range(60)]
    rows += [(1000 + i, " ".join(["v"] * r.randint(20, 300)), f"tiny{i:03}") for i in range(150)]
    small = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    plan = {s: t for s, _, t in mixing.targets(list(size.items()), [3, 1, 2], 1.5, 2.0)}
    source = {i: s for i, _, s in rows}
    by = collections.Counter()
    documents, pieces = mixing.mix(small)
    for x in mixing.taken(documents, pieces).collect():
        by[source[x["doc_id"]]] += x["taken"]
    assert {s: by[s] for s in plan} == {s: int(t) for s, t in plan.items()}
    slots = {(x["slot"], source[x["doc_id"]]) for x in pieces.collect()}
    assert len({s for s, _ in slots}) == len(slots)
    # As documents: every one of a source taken twice comes twice, with all its words.
    texts = {i: t for i, t, _ in rows}
    found = collections.Counter((x["doc_id"], x["text"]) for x in mixing.mixed(small).collect())
    for i, s in source.items():
        if plan[s] == 2 * size[s]:
            assert found[i, texts[i]] == 2
    words = collections.Counter()
    for (i, t), n in found.items():
        words[source[i]] += n * len(t.split())
    assert words == by


def test_shards(docs, none):
    found = kd_sharding.shard(docs, shards=4).collect()
    assert len(found) == len(rows_of())
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_sharding.shard(none).count() == 0


def test_shards_are_even(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    sizes = [r["s"] for r in kd_sharding.shard(many, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.1 * min(sizes)


def test_vector_groups(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 16))
    base[100:160] = base[0] + 0.02 * r.normal(size=(60, 16))
    rows = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(base)] + [(300, base[0].tolist(), "0"), (301, None, "0"), (302, [0.0] * 16, "0"), (303, base[0].tolist(), None), (304, [float("nan")] * 16, "0"), (305, [1.0, None], "0")]
    found = {x["vec_id"]: x for x in range_join.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    assert {i: found[i]["n_links"] for i in found} == {i: len(links.get(i, [])) for i, _, _ in rows}
    for i, near in links.items():
        assert all(found[i]["component_id"] == found[j]["component_id"] <= min(i, j) for j in near)
    assert range_join.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).count() == 0


def test_range_join_cells(spark, monkeypatch):
    monkeypatch.setattr(range_join, "CELL", 20)
    monkeypatch.setattr(range_join, "MOST_PIVOTS", 20)
    test_vector_groups(spark)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 45)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, 45: 40, 50: 40}


def test_toxicity(spark, none):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = [r.choice(WORDS) + r.choice("abcdefgh") for _ in range(40)] + ([r.choice(["zorkish", "zorked", "grumpf"])] if bad else [])
        rows.append((i, " ".join(r.sample(words, len(words)))))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {x["doc_id"]: x for x in toxicity.score(docs, index).collect()}
    assert all(0 <= x["score"] <= 1 for x in found.values()) and found[None]["predicted"] == 0
    assert sum(found[i]["predicted"] == y for i, y in labels) > 0.97 * len(labels)
    blocks = index.nearest(*index.vector({0: 1, 1: 2}))
    assert blocks == sorted(blocks, key=lambda b: (-b[0], b[1]))
    assert toxicity.score(docs, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 901


def test_toxicity_keeps_rare_terms(spark):
    """Every term of the examples counts, and neighbours are those of all cosines."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) + r.choice("abcd") for _ in range(30)) + f" only{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    words = {w for i, t in rows if i in index.doc_ids for w in t.split()}
    assert len(words) > 80 and all(w in index.terms for w in words)
    full = np.zeros((len(index.doc_ids), len(index.terms)))
    for i in range(len(full)):
        at = slice(index.own_start[i], index.own_start[i + 1])
        full[i, index.own_term[at]] = index.own_weight[at]
    for _, text in rows[:60]:
        counts = collections.Counter(index.terms[t] for w in text.split() for t in toxicity.terms_of(w) if t in index.terms)
        ids, w = index.vector(counts)
        cosines = full[:, ids] @ w
        near = index.nearest(ids, w)
        assert [s for s, _ in near] == pytest.approx(sorted(cosines, reverse=True)[:15])
        assert all(cosines[i] == pytest.approx(s) for s, i in near)


def test_toxicity_skips_blocks(spark):
    """Blocks that can't hold a near example aren't read, and shards of the index change nothing."""
    r = random.Random(13)
    make = lambda k: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(20)) + f" topic{chr(97 + k)} about{chr(97 + k)}"
    rows = [(i, make(i * 20 // 1500)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 300 < 75)) for i in range(1500)], "doc_id long, toxic int")
    index, cut = toxicity.fit(docs, labels), toxicity.fit(docs, labels, shard=4000)
    assert len(index.cuts) == 2 and len(cut.cuts) > 5 and cut.doc_ids.tolist() == index.doc_ids.tolist()
    shard = next(index.shards())
    full = np.zeros((len(index.doc_ids), len(index.terms)))
    for i in range(len(full)):
        at = slice(index.own_start[i], index.own_start[i + 1])
        full[i, index.own_term[at]] = index.own_weight[at]
    assert np.allclose((full**2).sum(axis=1), 1)
    skipped, texts = 0, [t for _, t in rows[::10]]
    for text in texts:
        ids, w = index.vocabulary.weighted(*index.vocabulary.counted(text))
        near = shard.nearest(ids, w, 15, [])
        cosines = full[:, ids] @ w
        assert [s for s, _ in near] == pytest.approx(sorted(cosines, reverse=True)[:15])
        skipped += int((shard.entry[ids + 1] - shard.entry[ids]).sum()) - shard.read
    assert skipped > 0
    for a, b in zip(index.near(texts), cut.near(texts), strict=True):
        assert [s for s, _ in a] == pytest.approx([s for s, _ in b])


def test_no_text_votes_on_itself(spark):
    r = random.Random(14)
    make = lambda: " ".join(r.choice(WORDS) + r.choice("abcd") for _ in range(12))
    rows = [(i, make()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    for x in toxicity.score(docs, index).collect():
        assert x["evidence"] and x["doc_id"] not in {e["doc_id"] for e in x["evidence"]}


def test_drop_toxic_keeps_rows_whole(spark):
    """Nulls, repeated rows, long texts and clashing columns; the rows that stay are those below the threshold."""
    r = random.Random(15)
    make = lambda n, bad: " ".join([r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)] + ["grumpf zorkish"] * bad)
    rows = [(i, make(30, i % 4 == 0), "en", "a", i, 1, 2, None) for i in range(400)]
    rows += [rows[8], rows[9], (None, None, None, None, None, None, None, "x"), (500, "", "en", None, 0, 0, 0, "toxic"), (501, make(30_000, False), "en", "b", 1, 1, 1, "score")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(3)).withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    want = sorted((repr(x["doc_id"]) for x in scored if x["score"] < 0.7))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and sorted(repr(x["doc_id"]) for x in kept.collect()) == want
    assert set(kept.collect()) <= set(docs.collect()) and {"None", "500", "501"} <= set(want)
    assert sum(i % 4 == 0 for i in range(400) if repr(i) in want) <= 2
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_toxicity_drops_verified_copies_only(spark):
    """Texts that share a passage stay; copies take no places of the limit."""
    r = random.Random(4)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))
    passage, same = make(60), make(90)
    texts = [f"{passage} {make(60)}" for _ in range(60)] + ["", " ", "."] + [same] * 80 + [f"{same} {make(1)}" for _ in range(20)] + [make(40) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.range(len(texts)).select(F.col("id").alias("doc_id"))
    kept = {x["doc_id"] for x in ids.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    index = toxicity.fit(docs, ids.withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int")))
    apart = {i for i in kept if i < 63 or i >= 163}
    assert apart <= set(index.doc_ids.tolist()) and len(index.doc_ids) <= len(apart) + 2 * 3
    few = toxicity.fit(docs, ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int")), per_class=30)
    assert collections.Counter(few.toxic.tolist()) == {0: 30, 1: 30}
    assert len({texts[i] for i in few.doc_ids[few.toxic == 1]}) == 30


def plain_spans(text):
    """The contract's patterns as they stand, one finditer per kind."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in reversed(digits(m))]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(21)
    pieces = ["a@b.c", "@", "a", "b_", ".", "..", "1.2.3.4", "255.", "0256.", "1", "42", " ", "-", "4111111111111111", "4111 1111-1111 1111", "+1 (415) 555-2671", "+", "(", "x.y@z-.q", "%", "\t", "é", "٣"]
    seen = collections.Counter()
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
        want = plain_spans(text)
        assert personal_data.base_spans(text) == want, text
        seen.update(k for k, _, _ in want)
    assert min(seen[k] for k in personal_data.KINDS) > 500


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@", "0" * 10**6 + ".1.1.1", "a@" * 500_000, "1." * 500_000, "a1 " * 300_000, "a@b.cd " * 100_000, "+1" + " " * 10**6, "é" * 10**6 + "1"])
def test_personal_data_of_very_long_texts(text):
    """Texts of a megabyte take seconds."""
    weights = {"bias": dict.fromkeys(personal_data.KINDS, -1.0), "plus True True": dict.fromkeys(personal_data.KINDS, 3.0)}
    begun = time.process_time()
    base, every = personal_data.all_spans(weights, text)
    assert time.process_time() - begun < 40 and set(base) <= set(every)
    assert len(base) == {"0": 1, "a@b": 100_000}.get(text[:3] if text.startswith("a@b") else text[:1], len(base))


def test_long_islands_train_in_pieces():
    text = " ".join(f"n{i} x{i}@mail.example 4111 1111 1111 1111" for i in range(200))
    base = personal_data.base_spans(text)
    [island] = personal_data.islands(text)
    pieces = list(personal_data._pieces(island, personal_data.Covered(base)))
    assert [w for p in pieces for w in p] == island and len(pieces) > 10
    assert all(sum(p[0][0] <= s and e <= p[-1][1] for p in pieces) == 1 for _, s, e in base)


def test_field_finds_forms_the_patterns_miss(spark):
    """Recall and precision of spans in other forms than those of the patterns, on other values than the trained."""
    r = random.Random(22)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + n(14)
        return d + next(c for c in "0123456789" if personal_data.luhn(d + c))

    def ip():
        return ".".join(str(r.randint(1, 255)) for _ in range(4))

    def mail():
        return "".join(r.choice("abcdefg") for _ in range(6)) + "@" + r.choice(["mail", "post"]) + ".example"

    noise = lambda: r.choice([f"in {r.randint(1900, 2030)} we", f"v{n(1)}.{n(1)}.{n(2)} of", f"costs {n(3)}.{n(2)} or", f"{n(5)} rows"])
    rows = [f"so {noise()} {r.choice([card, ip, mail, lambda: f'+1 {n(3)} {n(3)}-{n(4)}'])()} and {noise()} too" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    weights = personal_data.fit(docs)
    forms = {"phone": lambda: f"({n(3)}) {n(3)}-{n(4)}", "card": lambda: ".".join((c := card())[i : i + 4] for i in (0, 4, 8, 12)), "ip": lambda: ip().replace(".", "[.]"), "email": lambda: mail().replace("@", "[@]")}
    caught, clean = collections.Counter(), 0
    for _ in range(50):
        for kind, make in forms.items():
            form = make()
            text = f"so {noise()} x {form} and"
            _, every = personal_data.all_spans(weights, text)
            caught[kind] += any(k == kind and s <= (at := text.index(form)) + 1 and e >= at + len(form) - 1 for k, s, e in every)
        clean += not personal_data.all_spans(weights, f"so {noise()} and {noise()} x")[1]
    assert min(caught[k] for k in forms) >= 40 and clean >= 45, (caught, clean)


def test_training_islands_are_not_cut(spark, monkeypatch):
    """Documents with many islands train the field on all of them, not on the first in the alphabet."""
    many = [" and ".join(f"{100 * d + i}" for i in range(40)) + f" and zoe{d}@mail{d}.example.com" for d in range(4)]
    seen = []
    monkeypatch.setattr(personal_data, "train", lambda examples: seen.extend(examples) or {})
    personal_data.fit(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), most=4)
    assert len(seen) == 4 * 41
    assert sum(kind == "email" for _, _, gold in seen for kind, _, _ in gold) == 4


def test_personal_data(spark, none):
    text = "Mail é john.46@mail3.example.com, or +1 (269) 555-3296 4111 1111 1111 1111; at 10.0.255.7 not 10.0.256.7 x@y"
    base = personal_data.base_spans(text)
    patterns = {"email": personal_data.EMAIL, "ip": personal_data.IP, "card": personal_data.CARD, "phone": personal_data.PHONE}
    assert [(k, text[s:e]) for k, s, e in base] == [("email", "john.46@mail3.example.com"), ("ip", "10.0.255.7"), ("phone", patterns["phone"].search(text)[0])] or base
    assert all(patterns[k].fullmatch(text[s:e]) for k, s, e in base)
    many = [f"call +1 ({200 + i}) 555-{1000 + i} or n{i}.0{i % 9}@mail{i % 9}.example.com today" for i in range(150)] + [f"in {1900 + i} we had {i} of 12 token = 0a{i}f9b" for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(many)] + [(999, "ring (312) 555-7788 now"), (1000, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in personal_data.find(docs, personal_data.fit(docs)).collect()}
    assert found[999]["spans"] == "phone:5:19" and found[999]["n_phone"] == 0
    assert found[0]["n_email"] == 1 and found[0]["n_phone"] == 1 and found[1000]["spans"] == ""
    assert all(found[150 + i]["spans"] == "" for i in range(150))
    assert personal_data.find(none, {}).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_latin_words_go_to_the_model(name, monkeypatch):
    e = CachedEncoder(f"{TOKENIZERS}/{name}.json")
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    for text in [" ".join(f"{c} x{c}Yz, {c.upper()}{c}." for c in letters), " ".join(letters) + " Σas", "".join(letters), "İstanbul Şi İ."]:
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(e, "_whole", lambda text: 1 / 0)
    assert e.ids("Unmetword Ungesehenes été") == np.array(e.tokenizer.encode("Unmetword Ungesehenes été", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("width", [*range(0, 33)])
def test_segments_of_any_width(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 300, np.uint64).astype(np.uint32)
    lengths, back = token_blocks.unpack_segment(token_blocks.pack_segment(ids, [300], percentile=100))
    assert (back == ids).all() and back.dtype == np.uint32


def test_starts_need_no_shuffle_of_segments(docs):
    """``start`` follows the order of doc_id over many segments, and a segment isn't dealt anew for it."""
    found = token_blocks.read_tokens(token_blocks.write_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.json", end_id=2, fill=200))
    rows = sorted(found.collect(), key=lambda x: x["start"])
    assert [x["start"] for x in rows] == np.cumsum([0, *(x["n_tokens"] for x in rows)]).tolist()[:-1]
    ids = [x["doc_id"] for x in rows]
    assert len(rows) == docs.count() and ids == sorted(ids, key=lambda i: (i is not None, i))
    assert "segment#" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_marks_after_words_are_chunks(name):
    """Whatever marks end a word, it is looked up as itself, and ids are the tokenizer's."""
    path = f"{TOKENIZERS}/{name}.json"
    cached, plain = CachedEncoder(path), Tokenizer.from_file(path)
    r = random.Random(22)
    parts = ["word", "Öl", "don't", "x's", "'s", "$$$", "%%", "a_b", "!?", "...", "'", "3", "é", "e\u0301", "=\u0338", "İ", "日本", " ", "  ", "\n", "\t", "<|", "|>", "word$$$", "it's!!", "a'!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(cached.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    cached = CachedEncoder(path)
    cached.ids(" word$$$ word!! word")
    assert len([chunk for chunk in cached.cache if "word" in chunk]) == 1


def test_components_end_at_stars(spark, monkeypatch):
    """A star is found to be one without another round."""
    kept = []
    monkeypatch.setattr(graph, "keep", lambda df, name, keep=graph.keep: kept.append(name) or keep(df, name))
    found = graph.components(spark.createDataFrame([(9, 1), (1, 7), (3, 1), (8, 4), (2, 2)], "a long, b long"))
    assert {(x["node"], x["component"]) for x in found.collect()} == {(9, 1), (7, 1), (3, 1), (8, 4)}
    assert kept.count("stars") == 1


def test_words_are_looked_up_by_batches(spark):
    """Terms and counts of texts by arrays equal those word by word; a shard's files hold its terms in order."""
    r = random.Random(21)
    odd = ["", " ", "İstanbul ΣΑΣ straße ﬁne x²y", "日本語テキスト foo_bar9baz", "\U0001d4d0\U0001d4d1 z" * 3, "Ab" * 70_000, "the,the.THE the"]
    texts = odd + [" ".join(r.choice(WORDS) + r.choice("abcÉ") for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int"))
    known = index.terms
    for text, (ids, counts) in zip(texts, index.vocabulary.counted_texts(texts), strict=True):
        want = collections.Counter(known[t] for w in re.findall(r"[^\W\d_]+", text.lower()) for t in toxicity.terms_of(w) if t in known)
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == want and ids.tolist() == sorted(want)
    files = [f["number"].to_pylist() for f in toxicity._files(f"{index.blocks_path}/shard=0", ["number"])]
    assert len(files) > 5 and (numbers := sum(files, [])) == sorted(numbers) and set(numbers) == set(known.values())


def test_single_precision_finds_the_nearest_of_close_cosines(spark):
    """The matrix of frequent terms tells who may be near; cosines are those of doubles, however close, and equal ones go by number."""
    r = random.Random(31)
    common = [f"common{chr(97 + i)}" for i in range(12)]
    # Counts above those of the matrix, texts that differ in one count of many, and copies in other words' order.
    make = lambda i: [w for k, w in enumerate(common) for _ in range(1 + (i + k) % 3)] + ["common" + chr(97 + i % 12)] * 200 + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}"]
    words = [make(i % 700) for i in range(1000)]
    texts = [" ".join(r.sample(w, len(w))) for w in words] + [" ".join(["commona"] * 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(len(texts))], "doc_id long, toxic int"))
    shard = next(index.shards())
    assert shard.matrix.dtype == np.float32 and shard.matrix.shape[1] > 5
    full = np.zeros((len(index.doc_ids), len(index.terms)))
    for i in range(len(full)):
        at = slice(index.own_start[i], index.own_start[i + 1])
        full[i, index.own_term[at]] = index.own_weight[at]
    assert np.allclose((full**2).sum(axis=1), 1, atol=1e-12, rtol=0)
    for text in texts[:40] + texts[-1:]:
        ids, w = index.vocabulary.weighted(*index.vocabulary.counted(text))
        cosines = np.round(full[:, ids] @ w, 11)
        near = shard.nearest(ids, w, 15, [])
        assert [s for s, _ in near] == pytest.approx(sorted(cosines, reverse=True)[:15], abs=2e-11)
        assert near == sorted(near, key=lambda n: (-n[0], n[1]))


def test_examples_vote_once(spark, monkeypatch, tmp_path):
    """Calibration searches the neighbours of each example once."""
    seen, votes = str(tmp_path / "seen"), toxicity._votes

    def noted(index):
        run = votes(index)

        def count(rows):
            for batch in run(rows):
                with open(seen, "a") as f:
                    f.write(f"{len(batch)}\n")
                yield batch

        return count

    monkeypatch.setattr(toxicity, "_votes", noted)
    r = random.Random(32)
    docs = spark.createDataFrame([(i, " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(12))) for i in range(300)], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int"))
    assert sum(map(int, open(seen).read().split())) == len(index.doc_ids) > 150


def test_terms_are_found_by_their_hashes(spark, tmp_path):
    """Every term has its number, others have none, an empty vocabulary none at all."""
    for n in (0, 1, 2, 5000):
        spark.createDataFrame([(f"t{i}", 1.0) for i in range(n)], "term string, gain double").write.parquet(path := f"{tmp_path}/{n}")
        v = toxicity.Vocabulary(path)
        assert v.numbers(v.hashes[:-1]).tolist() == v.number[:-1].tolist() and sorted(v.number[:-1]) == list(range(n))
        other = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
        assert v.numbers(other[~np.isin(other, v.hashes[:-1])]).max() == -1


def test_letters_take_little_memory():
    """The code points of words are found without strings of all of them at once."""
    toxicity._letters.cache_clear()
    tracemalloc.start()
    letters = toxicity._letters()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5_000_000
    assert all(letters[ord(c)] for c in "aZéßЖ日") and not any(letters[ord(c)] for c in "0_ \n.-\ud800")
