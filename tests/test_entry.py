import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values()) and all(isinstance(s, str) for s in entry.oracle_sql().values())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_part():
    """As if its folder and the pipeline weren't there."""
    code = "import importlib.abc, sys\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == 'corpus_pipeline' or name.startswith('shelfwise.llm'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_queries_can_be_listed_without_spark():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert e.queries() and e.oracle_sql() and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
