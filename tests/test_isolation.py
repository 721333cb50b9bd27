"""The library without its training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

CODE = """
import sys
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
assert len(queries) > 60 and set(sql) <= set(queries), len(queries)
assert not any(k.startswith("op") or k == "pipeline" for k in queries), sorted(queries)
assert not [m for m in sys.modules if m.startswith("ridelens.llm")]
"""


@pytest.mark.parametrize("leave_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, leave_pipeline):
    leave_out = {"llm", ".git", "__pycache__"} | (set() if leave_pipeline else {"corpus_pipeline.py"})
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: leave_out & set(names))
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
