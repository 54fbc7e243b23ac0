"""The pipeline's stages on planted cases, and the pipeline as a whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from target_rule import targets
from murmur.llm.near_dedup import near_dedup
from murmur.llm.packing import best_fit_packing
from murmur.llm.toxicity import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def planted(seed=4, n=400):
    """Clean documents, toxic ones, exact and near copies, and passages that repeat."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    passage = prose(70)
    rows, labels, toxic, copies, near, repeats = [], [], set(), {}, {}, {}
    for i in range(n):
        text, kind = prose(rng.randint(30, 150)), rng.random()
        if kind < 0.15:
            toxic.add(i)
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grobble", "snarf", "zibber"]))
        elif kind < 0.25 and i > 50:
            first = rng.choice([r for r in rows[:50] if r[0] not in toxic])
            copies[i] = first[0]
            text = first[1].split(" ")
        elif kind < 0.3 and i > 50:
            first = rng.choice([r for r in rows[:50] if r[0] not in toxic and len(r[1].split()) > 100])
            near[i] = first[0]
            text = [*first[1].split(" "), "extra", "words"]
        elif kind < 0.36:
            at = rng.randint(5, len(text) - 5)
            repeats[i] = (text[:at], text[at:])
            text = text[:at] + passage + text[at:]
        if rng.random() < 0.7:
            labels.append((i, 1, int(i in toxic)))
        joined = " ".join(text)
        rows.append((i, joined, "en", rng.choice(["a", "a", "b", "c", None]), len(joined)))
    return rows, labels, toxic, copies, near, repeats


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels, *cases = planted()
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}, cases


def test_stages_catch_what_is_planted(spark, corpus, tmp_path):
    folder, rows, (toxic, copies, near, repeats) = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    seen = []
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted(map(tuple, docs.collect()), key=str))
    clean, single, cut, mixed, packed = seen

    predicted = {r["doc_id"] for r in toxicity(spark.read.parquet(f"{folder}/documents.parquet"), marks).where("predicted = 1").collect()}
    assert {r[0] for r in clean} == set(rows) - predicted
    assert len(predicted & toxic) >= 0.95 * len(toxic) and len(predicted - toxic) <= 0.02 * len(rows)

    kept = {r[0] for r in single}
    expected = {r["doc_id"] for r in near_dedup(spark.read.parquet(f"{tmp_path}/toxicity")).where("kept").collect()}
    assert kept == expected and kept <= {r[0] for r in clean}
    gone = {r[0] for r in clean} - kept
    assert gone == {i for i in [*copies, *near] if i not in predicted}

    texts = {r[0]: r[1] for r in cut}
    assert set(texts) == kept
    first = min(i for i in repeats if i in kept)
    for i in kept:
        if i in repeats and i != first:
            assert texts[i] == " ".join(repeats[i][0] + repeats[i][1])
        else:
            assert texts[i] == rows[i][1]
    assert all(r[4] == len(r[1]) for r in cut)

    sizes, taken = {}, {}
    for r in cut:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    for r in mixed:
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    for source, goal in targets(sizes).items():
        assert abs(taken.get(source, 0) - goal) <= 0.02 * goal + 2
    assert set(mixed) <= set(cut) and max(mixed.count(r) for r in mixed) <= 3

    pieces = best_fit_packing(spark.read.parquet(f"{tmp_path}/mixing"), corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert len(packed) == pieces.count() and len({r[0] for r in packed}) == len({r[0] for r in mixed})


def test_run_is_the_stages(spark, sf_dir):
    from murmur.llm.queries import QUERIES

    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows and max(ends.values()) <= 1024
    assert "pipeline" not in QUERIES  # the registry adds it


def test_results_outlive_later_calls(spark, sf_dir):
    """A result that was not read yet, of the last stage or of ``run``, is not deleted by other calls."""
    docs = spark.createDataFrame([(i, f"text {i} of some", "en", "a", 14) for i in range(5)], COLUMNS)
    packed = STAGES["packing"](spark, docs, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert STAGES["substring_dedup"](spark, docs, sf_dir).count() == 5
    assert packed.count() == 5 and whole.count() > 0


def test_stages_chain_unwritten(spark, sf_dir):
    """Each stage may read the result of the one before it as it is; the result is that of ``run``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for work in STAGES.values():
        docs = work(spark, docs, sf_dir)
    cut = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert cut(docs) == cut(corpus_pipeline.run(spark, sf_dir))


@pytest.mark.parametrize("name", ["near_dedup", "substring_dedup", "mixing"])
def test_stages_of_odd_rows(spark, sf_dir, name):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c", "en", "a", 5), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS + ", size int")
    out = STAGES[name](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = out.collect()
    if name == "near_dedup":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "None"]
    elif name == "substring_dedup":
        assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0


def test_near_dedup_stage_looks_at_rows_not_ids(spark, sf_dir):
    """Unlike texts under one doc_id stay; of copies without a doc_id one does."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    texts = [(None, " ".join(base)), (None, " ".join(base)), (None, near), (7, "a quite different text stands here"), (7, "b and one more that is not like it"), (7, "b and one more that is not like it")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], COLUMNS).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in STAGES["near_dedup"](spark, docs, sf_dir).collect()), key=str)
    assert [r for r in got if r[0] == 7] == [texts[3], texts[4]]
    assert len(got) == 3 and got[2] in (texts[0], texts[2])


def test_toxicity_stage_of_odd_rows(spark, corpus):
    folder = corpus[0]
    odd = spark.createDataFrame([(5001, None, "odd", None, None), (None, "grobble snarf zibber", "odd", "a", 1)], COLUMNS)
    docs = spark.read.parquet(f"{folder}/documents.parquet").union(odd)
    kept = STAGES["toxicity"](spark, docs, folder).where("lang = 'odd'").collect()
    assert [r["doc_id"] for r in kept] == [5001]
    assert STAGES["toxicity"](spark, docs.limit(0), folder).count() == 0


def test_last_stage_of_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a", "en", "a", 1)], COLUMNS)
    assert STAGES["packing"](spark, docs.withColumn("offset", F.lit("x")), sf_dir).count() == 2
    assert STAGES["packing"](spark, docs.limit(0), sf_dir).count() == 0
