"""The registry without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
sys.modules["corpus_pipeline"] = None  # importing it fails, as if it were not there
sys.modules["murmur.llm"] = None
import __spark_entry__ as entry
from murmur.plans.queries import QUERIES
assert set(entry.queries()) == set(QUERIES) == set(entry.oracle_sql())
"""


def test_the_rest_works_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for path in (ROOT / "murmur").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "murmur.llm" not in path.read_text(), path


BROKEN = """
import sys
sys.modules["public_tokenizers"] = None  # something that the subpackage needs
try:
    import __spark_entry__
except ModuleNotFoundError as error:
    assert error.name == "public_tokenizers", error
else:
    raise AssertionError("the queries went without a word")
"""


def test_a_broken_subpackage_is_not_passed_over():
    if (ROOT / "corpus_pipeline.py").exists():
        subprocess.run([sys.executable, "-c", BROKEN], cwd=ROOT, check=True)


def test_no_local_work_folder_on_a_cluster():
    import pytest

    from murmur.session import shared_dir

    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default if name == "spark.checkpoint.dir" else "file:/home/me/spark-warehouse"

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
