from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from murmur.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("murmur-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def theta_match():
    """The keyword match as the theta join it stands for."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from murmur.functions.text import is_first_hit_bounded

    def run(posts, universe, post_id):
        rules = universe.select("stock", F.posexplode("keywords").alias("place", "keyword"))
        pairs = posts.join(rules, is_first_hit_bounded(F.col("text"), F.col("keyword")))
        first = F.row_number().over(Window.partitionBy(post_id, "stock").orderBy("place"))
        return pairs.withColumn("first", first).where("first = 1").select(post_id, "stock", "keyword")

    return run
