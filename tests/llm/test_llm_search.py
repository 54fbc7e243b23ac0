"""Ranked search, training strings and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import murmur.llm.chat as chat
import murmur.llm.lexical as lexical
from murmur.llm.chat import chat_windows, escaped, read_back, unescaped
from murmur.llm.lexical import lexical_search
from murmur.llm.periodic import find_runs, periodic_runs
from murmur.llm.queries import CONTROL_TEXT, ORACLE, QUERIES
from murmur.llm.words import mix
from oracle_check import compare, connect

# Ranked search


def brute_search(docs, items, k=10):
    def terms(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def mixed_texts(rng, n, words):
    # words by rank, so that some are in nearly all texts
    return [" ".join(words[min(len(words) - 1, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.choice([3, 20, 80]))) for _ in range(n)]


SEARCH_ODD = [(None, "Alpha beta"), (901, None), (902, ""), (903, "... ,;"), (904, "é, Éé-alpha\x00BETA"), (7, "alpha beta"), (7, "alpha beta"), (None, "alpha")]


@pytest.mark.parametrize(("shard", "items"), [(4096, 2048), (50, 7)])
def test_lexical_search(spark, monkeypatch, shard, items):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    rng = random.Random(3)
    words = ["alpha", "beta"] + ["".join(rng.choice("abcdeé0") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(mixed_texts(rng, 400, words))] + SEARCH_ODD
    asked = [(i, t) for i, t in enumerate(mixed_texts(rng, 20, words))]
    asked += [(20, docs[5][1]), (21, None), (22, ""), (23, "nowhere"), (24, "ALPHA alpha, beta"), (None, "beta 0"), (25, " ".join(words) * 3)]
    frame = spark.createDataFrame([(i, t, 5, 1.0) for i, t in docs], "doc_id long, text string, item_id int, score double").repartition(3)
    ask = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, doc_id int")
    got = Counter(map(tuple, lexical_search(frame, ask).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == brute_search(docs, asked)


def test_lexical_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs.limit(0), items).collect() == []
    assert lexical_search(docs, items.limit(0)).collect() == []
    assert lexical_search(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items).collect() == []


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(5)
    n, vocabulary = 3000, 60
    rows = []
    for doc in range(n):
        topic = doc % 6  # documents of a topic share terms
        terms = np.unique(np.concatenate((rng.choice(np.arange(topic * 9, topic * 9 + 9), 5), rng.integers(54, 60, 2))))
        rows.append((terms, rng.integers(1, 1000, len(terms)) * (3 if rng.random() < 0.02 else 1)))
    items = lexical.Items([(0, 0), (1, 1)], np.arange(vocabulary, dtype=np.uint64), [np.array([0, 1, 2, 54]), np.array([9, 12, 55, 56])], [np.array([1, 2, 1, 1]), np.ones(4, np.int64)])
    counts = np.array([len(t) for t, _ in rows])
    shard = lexical.build_shard(list(range(n)), counts, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), [np.arange(t, vocabulary) for t in range(vocabulary)])
    # every summary is at least the impact of every document of its block
    for at, t in enumerate(shard.list_terms):
        low, high = shard.list_summary[at : at + 2]
        top = {(b, s): m for b, s, m in zip(shard.summary_blocks[low:high], shard.summary_terms[low:high], shard.summary_most[low:high])}
        for block in range(shard.list_blocks[at], shard.list_blocks[at + 1]):
            for doc in shard.members[shard.block_starts[block] : shard.block_starts[block + 1]]:
                terms, values = rows[doc]
                assert t in terms
                for s, v in zip(terms, values):
                    assert s < t or top[block - shard.list_blocks[at], s] >= v
    search = lexical.Search(items, 10)
    search.add(shard)
    for item in range(2):
        weight = np.zeros(vocabulary, np.int64)
        weight[items.terms[item]] = items.times[item]
        scores = sorted(((-int((weight[t] * v).sum()), doc) for doc, (t, v) in enumerate(rows)))[:10]
        assert [(-s, d) for s, d in zip(search.best[item][0], search.best[item][2])] == scores
    assert search.skipped > 0.3 * search.blocks


def test_lexical_search_against_sql(spark, sf_dir):
    name = "op11_lexical_search"
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


# Training strings


def brute_windows(turns, budget, history, span):
    """(role, text, repeated) lists of the windows of one conversation, by its rules in plain loops."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    size = [len(re.findall(r"[^\W_]+|[^\w\s]|_", t[2])) + 2 for t in turns]
    part = [None if t[0] is None else t[0] // span for t in turns]
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    out, i = [], 0
    while i < len(turns):
        lead = size[system] if system is not None and system < i else 0
        start = i
        for j in range(max(0, i - history), i):
            near = part[j] == part[i] or (part[j] is not None and turns[j][0] + history >= part[i] * span)
            if near and not (system is not None and j <= system < i) and sum(size[j:i]) <= budget // 4 and lead + sum(size[j : i + 1]) <= budget:
                start = j
                break
        end = i + 1
        while end < len(turns) and part[end] == part[i] and lead + sum(size[start : end + 1]) <= budget:
            end += 1
        window = [(*turns[j][1:], j < i) for j in range(start, end)]
        out.append(([(*turns[system][1:], True)] if lead else []) + window)
        i = end
    return out


def some_turns(rng, n):
    bits = ["ok", "[INST]", "[/INST]", "</s>", "\\", "\\\\[OUT]", "\n", "\n</s>", "[ROLE]x", "[", "<", "s>", "é😀", "word " * 9, "", "$1", "[SYS]"]
    out = []
    for i in range(n):
        role = "system" if i == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "user", "assistant", "tool", "a[/ROLE]\n", ""])
        out.append((i, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    return out


@pytest.mark.parametrize(("budget", "span"), [(60, 256), (60, 5), (1024, 256)])
def test_chat_windows(spark, monkeypatch, budget, span):
    monkeypatch.setattr(chat, "SPAN", span)
    rng = random.Random(budget + span)
    conversations = {c: some_turns(rng, rng.randint(1, 25)) for c in range(30)}
    conversations[None] = [(None, "user", "b"), (None, "assistant", "a"), (3, "assistant", "c"), (3, "assistant", "c")]
    rows = [(c, *t, 9, None) for c, turns in conversations.items() for t in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int, window string").repartition(3)
    got = defaultdict(list)
    windows = chat_windows(frame, budget=budget, history=2)
    read = windows.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    for r in sorted(read.collect(), key=lambda r: (r["span"], r["window"])):
        turns = [(t["role"], t["text"], i < r["repeated"]) for i, t in enumerate(r["turns"])]
        assert r["n_turns"] == len(turns) and r["learned"] == [t for role, t, old in turns if role == "assistant" and not old]
        got[r["conv_id"]].append(turns)
    for c, turns in conversations.items():
        assert got[c] == brute_windows(turns, budget, 2, span), c
    assert {c for c in got} == set(conversations)


def test_escaping_is_reversible(spark):
    rng = random.Random(8)
    bits = [*chat.CONTROLS, "\\", "\n", "[", "<", "</", "s>", "INST]", "/", "x", "$1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in frame.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r["t"] == r["u"]
        assert all(re.search(r"(?<!\\)" + re.escape(c), r["e"]) is None for c in chat.CONTROLS)


def test_chat_query(spark, sf_dir):
    held = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        held[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    held[-7] = [(0, "user", CONTROL_TEXT), (1, "assistant", CONTROL_TEXT)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["conv_id"]: r for r in QUERIES["op12_chat_format"](spark, sf_dir).collect()}
    assert set(got) == set(held)
    for c, turns in held.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), sha(learned))
        assert g["formatted_chars"] > sum(len(t) for *_, t in turns)


def test_chat_of_nothing_and_native_plan(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows(empty).collect() == [] and read_back(chat_windows(empty)).collect() == []
    plan = read_back(chat_windows(empty))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "é" * 50_000 + " </s>" * 2000)], empty.schema)
    row = read_back(chat_windows(odd)).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == 60_000


# Periodic runs


def brute_runs(words, least=24):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(least, 3 * q):
                if not any(all(words[x] == words[x + d] for x in range(start, end - d)) for d in range(1, q)):
                    out.append((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, most):
    kinds, out = rng.choice([1, 2, 3, 5, 50, 10_000]), []
    while len(out) < rng.randint(0, most):
        kind = rng.random()
        if kind < 0.4:
            base = [rng.randrange(kinds) for _ in range(rng.randint(1, rng.choice([5, 40, most // 4])))]
            if rng.random() < 0.5 and len(base) > 4:  # runs of a shorter period inside each period
                base = base[: len(base) // 5] * 6
                base[rng.randrange(len(base))] = rng.randrange(kinds)
            out += (base * rng.randint(2, 6))[: -rng.randint(1, len(base))]
        elif kind < 0.6:
            out += [rng.randrange(kinds) for _ in range(rng.randint(1, 100))]
        elif out:
            a = rng.randrange(len(out))
            out += out[a : rng.randint(a, len(out))]
    return out[:most]


@pytest.mark.parametrize(("seed", "most", "texts"), [(1, 300, 200), (2, 1000, 60), (3, 3000, 5)])
def test_runs_against_all_lags(seed, most, texts):
    rng = random.Random(seed)
    docs = [repetitive(rng, most) for _ in range(texts)]
    docs += [[], [1], [1] * 23, [1] * 24, list(range(40)) * 2, list(range(40)) * 3, (list(range(40)) * 3)[:-1]]
    hashes = mix(np.array([w for d in docs for w in d], np.uint64) + np.uint64(5))
    found = find_runs(hashes, np.array([len(d) for d in docs]))
    assert sum(map(len, found)) > 10
    for doc, runs in zip(docs, found):
        assert runs == brute_runs(doc)


def test_a_long_period():
    rng = random.Random(4)
    base = [rng.randrange(2000) for _ in range(50_000)]
    doc = [9999] + base * 3 + [9998]
    assert find_runs(mix(np.array(doc, np.uint64)), np.array([len(doc)])) == [[(1, 150_000, 50_000)]]


def expected_row(doc, words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc, len(runs), *best, milli, *sha)


ROW = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 30), (4, "a " * 30), (None, "x y z " * 20), (5, "A a " * 12), (6, "é\x0bü\x0c" * 40 + "end")]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, runs string, n_runs int")
    got = Counter(map(tuple, periodic_runs(frame).select(*ROW).collect()))
    assert got == Counter(expected_row(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs)
    assert periodic_runs(frame.limit(0)).collect() == []


def test_periodic_runs_query(spark, sf_dir):
    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if n > 3000:
            continue  # all lags of the longest texts take a plain loop too long; they are compared by lags above
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want[expected_row(r["doc_id"], words)] += 1
    got = Counter(map(tuple, QUERIES["op13_periodic_runs"](spark, sf_dir).select(*ROW).collect()))
    assert not want - got and sum(want.values()) > 150
