import importlib
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_llm(tmp_path, gone):
    """The rest imports and registers its queries where the llm folders are gone, with the pipeline or without."""
    to = tmp_path / "repo"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=to, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 60, out.stderr
