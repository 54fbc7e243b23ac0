"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, and all but the last return the
columns of ``documents``. Between stages the documents are written to the shared
folder and read back. ``run`` deletes what a stage staged for itself once its
output is written. A stage that is called by itself deletes nothing, as its
result may be read at any time, also by the next stage; its tables, like those
behind the packed sequences, stay as long as the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.arrow import delete_folders, noting_staged, staged
from murmur.llm.mixing import mix, n_words
from murmur.llm.near_dedup import one_of_each
from murmur.llm.packing import best_fit_packing
from murmur.llm.substring_dedup import without_repeats
from murmur.llm.toxicity import keep_clean
from murmur.session import shared_dir

#: SQL cannot express these stages; the tests hold them against brute force.
ORACLE_SQL = None

#: Words of the shortest passage that counts as repeated.
PASSAGE_WORDS = 50


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; those without a doc_id are judged like any other."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; of those without one, one as well."""
    return one_of_each(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with a smaller doc_id hold; every document stays."""
    return without_repeats(docs, min_words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeat is a row, and what is not taken goes."""
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    taken = mix(rows, n_words(F.col("text")), id_col="_row").where("taken > 0")
    times = taken.select(F.col("doc_id").alias("_row"), F.expr("cast(taken div size as int)").alias("_times"))
    rows = rows.join(times, "_row").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
    return rows.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with noting_staged() as folders:
            work(spark, docs, sf_dir).write.parquet(path)
        delete_folders(spark, folders)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
