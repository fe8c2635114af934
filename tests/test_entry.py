"""The entry on copies of the repository that lack optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import REPO

CODE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession

queries, sql = entry.queries(), entry.oracle_sql()
assert len(queries) > 70 and set(sql) <= set(queries)
assert not [q for q in queries if q == "pipeline" or q[:2] == "op" and q[2].isdigit()]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_optional_parts(tmp_path, gone):
    """Without the folders named llm, with or without the pipeline's file, all other queries are there and run."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
