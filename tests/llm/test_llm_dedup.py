"""Near copies and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import murmur.llm.near_dedup as near
import murmur.llm.substring_dedup as substring
from murmur.llm.arrow import noting_staged
from murmur.llm.links import components
from murmur.llm.near_dedup import keep_first, near_dedup
from murmur.llm.queries import ORACLE, QUERIES
from murmur.llm.substring_dedup import substring_dedup, without_repeats
from murmur.llm.words import column_words
from oracle_check import compare, connect

TYPES = "doc_id long, text string"


def split(text):
    return (text or "").encode().split()


def test_words_hash_alike_only_if_equal():
    texts = ["The cat", "", None, " a\x0bb\tc \n", "the CAT sat", "é É", "x" * 700_000 + " y", "cat\x1cdog"]
    hashes, counts = column_words(pa.array(texts), lower=True)
    every = [w for t in texts for w in split((t or "").translate({c: c + 32 for c in range(65, 91)}))]
    assert counts.tolist() == [len(split(t)) for t in texts]
    seen = {}
    for word, value in zip(every, hashes.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_groups(rows, n, percent):
    sets = []
    for _, text in rows:
        w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        if not sets[i]:
            out.append((doc, 0, doc, True))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc, len(sets[i]), least, doc == least if doc is not None and least is not None else least is None))
    return out


def near_copies(seed=5, groups=6, size=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1000, 4])
def test_near_dedup(spark, monkeypatch, block):
    """Also with clusters that are cut into blocks."""
    monkeypatch.setattr(near, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near, "PIVOTS", 1)
    rows = near_copies()
    rows += [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "ONE two"), (905, rows[0][1]), (905, rows[0][1])]
    rows += [(None, rows[1][1]), (None, "stands quite alone here")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TYPES + ", rep string, key int")
    got = near_dedup(frame, words=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_groups(rows, 4, 80), key=str)


def test_near_dedup_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], TYPES)).count() == 0


def test_keep_first(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (4, ""), (5, "q"), (5, "q"), (None, "alone"), (None, "q")]
    docs = spark.createDataFrame(rows, TYPES)
    kept = keep_first(docs, near_dedup(docs)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, rows[0][1]), (2, None), (4, ""), (5, "q"), (None, "alone"), (None, "q")], key=str)


def brute_cut(rows, n):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - n + 1) if doc is not None else ():
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = {j for i in range(len(w) - n + 1) if doc is not None and first[tuple(w[i : i + n])] < doc for j in range(i, i + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=8):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 25, 60, 12)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) + str(doc) for _ in range(rng.randint(0, 20))]
            text += rng.choice(shared)[rng.randint(0, 3) :]
        rows.append((doc, " ".join(text)))
    return rows


@pytest.mark.parametrize("batch", [1 << 24, 400])
def test_substring_dedup(spark, monkeypatch, batch):
    """Also with batches so small that most repeats are found between them."""
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    rows = passages()
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1]), (104, "a a a " * 20), (105, "a a a " * 9), (None, rows[5][1])]
    rows += [(106, rows[7][1]), (106, "new " + rows[9][1])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], TYPES + ", keys int").repartition(3)
    got = substring_dedup(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_cut(rows, 13), key=str)


def test_substring_dedup_keeps_clean_texts_of_a_cut_document(spark):
    """Texts with and without a repeat, a copy and an empty text under one doc_id."""
    rng = random.Random(4)
    first, second, clean = (" ".join(f"{side}{rng.randint(0, 999)}" for _ in range(30)) for side in "fsc")
    rows = [(1, first), (2, second), (7, clean), (7, "new " + first + " end"), (7, "short one"), (7, second), (7, ""), (7, None), (8, clean), (8, clean)]
    got = substring_dedup(spark.createDataFrame(rows, TYPES).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_cut(rows, 13), key=str)


def test_substring_dedup_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], TYPES)).count() == 0


def test_without_repeats(spark):
    rng = random.Random(2)
    passage = "  ".join(f"p{rng.randint(0, 999)}" for _ in range(55))
    short = " ".join(f"s{rng.randint(0, 999)}" for _ in range(49))
    rows = [
        (1, f"Start\n{passage} end", "src", 1), (2, f"Other  {passage}\n\nkept  tail {short}", None, 1),
        (3, f"clean {short}\t", "x", 1), (4, passage, "x", 1), (5, None, "x", None), (6, "", "x", 0), (None, passage, "x", 1),
    ]
    docs = spark.createDataFrame(rows, TYPES + ", source string, n_chars long")
    got = {r[0]: tuple(r) for r in without_repeats(docs).collect()}
    assert got[1] == rows[0] and got[3] == rows[2] and got[5] == rows[4] and got[6] == rows[5] and got[None] == rows[6]
    assert got[2] == (2, f"Other\n\nkept  tail {short}", None, len(f"Other\n\nkept  tail {short}"))
    assert got[4] == (4, "", "x", 0)


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op3_substring_dedup"])
def test_against_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


def test_signatures_keep_all_pairs_within_the_distance():
    """Any two signatures that differ in 15 slots of 40 share a chunk with one error at most."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        wrong = np.zeros(near.CHUNKS * near.SLOTS, int)
        wrong[rng.choice(len(wrong), 15, replace=False)] = 1
        assert wrong.reshape(near.CHUNKS, near.SLOTS).sum(axis=1).min() <= 1


def test_components_in_any_order(spark):
    """Chains that follow or cross the nodes' order, a hub and hubs of hubs; rounds don't grow with a chain."""
    chain = [(i, i + 1) for i in range(400)]
    mixed = [(1000 + (i * 37) % 401, 1000 + ((i + 1) * 37) % 401) for i in range(400)]
    hubs = [(2000 + i // 20, 2000 + i) for i in range(1, 900)]
    frame = spark.createDataFrame(chain + mixed + hubs, "a long, b long").repartition(3)
    with noting_staged() as noted:
        got = {r["node"]: r["component"] for r in components(frame, "a", "b").collect()}
    want = {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(401)} | {2000 + i: 2000 for i in range(900)}
    assert got == want and len(noted) < 40


def test_rounds_of_components_are_short(spark):
    """What a round exchanges is most of the time on many partitions; all rounds of this graph were 60 stages before."""
    frame = spark.createDataFrame([(i // 20, i) for i in range(1, 900)], "a long, b long").repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "components")
    try:
        assert {r["component"] for r in components(frame, "a", "b").collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) < 50
