"""The entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(x.startswith('op') for x in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    """Folders of the training-data operators are deleted, with or without the pipeline at the top: all else is there."""
    away = {os.path.join(ROOT, "sylvan", "llm"), os.path.join(ROOT, "tests", "llm"), *([] if pipeline else [os.path.join(ROOT, "corpus_pipeline.py")])}
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__", "spark-warehouse") or os.path.join(folder, n) in away]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    n, has_pipeline, has_operators, sql = said.stdout.split()[-4:]
    assert int(n) > 90 and (has_pipeline, has_operators, sql) == ("False", "False", "True")
