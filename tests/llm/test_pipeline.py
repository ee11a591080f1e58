"""The pipeline on small tables: every stage against brute force on what the stage before it kept."""

from __future__ import annotations

import collections
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mendgrid.llm import toxicity
from mendgrid.llm.common import keep
from mendgrid.llm.queries import TOKENIZERS
from tests.llm.test_operators import WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = "grumpf zorkish zorked"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of() -> list[tuple]:
    r = random.Random(31)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))
    texts = [make(40) + (" " + BAD if i % 5 == 0 else "") for i in range(300)]
    base, long = make(120), make(5000)
    texts += [base, base, base, base + " more", base.replace(" ", "  ", 1), long, long, long + " end", None, None, "", " ", "one two"]
    sources = ["b", "a", "b", None, "b", "ü", "b"]
    return [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one, the last one's from ``run``."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(BAD in (t or ""))) for i, t, *_ in rows_of()]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, folder), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        out.append((name, docs.collect()))
    scored = toxicity.score(before_all := spark.read.parquet(f"{folder}/documents.parquet"), toxicity.fit(before_all, spark.read.parquet(f"{folder}/labels.parquet")))
    return dict(out), corpus_pipeline.run(spark, folder).collect(), scored.collect()


def test_toxicity_stage(stages):
    """The rows predicted clean stay whole: most toxic ones go, and hardly any clean one does."""
    found, _, scored = stages
    gone = {x["doc_id"] for x in scored if x["predicted"]}
    assert sorted(found["toxicity"], key=repr) == sorted((x for x in found["documents"] if x["doc_id"] not in gone), key=repr)
    toxic = {x["doc_id"] for x in found["documents"] if BAD in (x["text"] or "")}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3


def test_exact_stage(stages):
    found, _, _ = stages
    best = {}
    for x in found["toxicity"]:
        best[x["text"] or ""] = max(best.get(x["text"] or "", -1), x["doc_id"])
    assert sorted(x["doc_id"] for x in found["exact_dedup"]) == sorted(best.values())
    assert set(found["exact_dedup"]) <= set(found["toxicity"])


def test_near_stage(stages):
    found, _, _ = stages
    rows = found["exact_dedup"]
    sets = {}
    for x in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), v) for v in words(x["text"])]
        sets[x["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert links and sorted(x["doc_id"] for x in found["near_dedup"]) == sorted(i for i in sets if least[i] == i)
    assert set(found["near_dedup"]) <= set(rows)


def test_mix_stage(stages):
    """Each source's words reach its target; a document has at most two rows, whole or cut at the end."""
    found, _, _ = stages
    before = {x["doc_id"]: x for x in found["near_dedup"]}
    sizes = collections.Counter()
    for x in before.values():
        sizes[x["source"]] += len(words(x["text"]))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    taken, times = collections.Counter(), collections.Counter()
    for x in found["mix"]:
        whole = before[x["doc_id"]]
        assert x["source"] == whole["source"] and words(x["text"]) == words(whole["text"])[: len(words(x["text"]))]
        taken[x["source"]] += len(words(x["text"]))
        times[x["doc_id"]] += 1
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= 1 for s in order), (taken, target)
    assert all(times[i] == 1 for i, x in before.items() if not words(x["text"]))


def test_pack_stage(stages):
    """``run`` packs every id of every row once, in gapless sequences of at most 4096."""
    found, packed, _ = stages
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    want = collections.Counter()
    for x in found["mix"]:
        want[x["doc_id"]] += len(tokenizer.encode(x["text"] or "", add_special_tokens=False).ids) + 1
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for x in packed:
        got[x["doc_id"]] += x["length"]
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
