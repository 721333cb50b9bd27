"""bench.py prints one valid JSON line (tiny scale, one repeat, own process)."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from .conftest import ROOT, SF0001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_REPEAT="1", BENCH_CPUS="2", PYTHONPATH=ROOT)
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        capture_output=True, text=True, timeout=900, env=env, cwd=ROOT,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["metric"] == "total_query_sec" and rec["unit"] == "sec" and rec["sf"] == 0.001
    assert rec["value"] > 0 and "top_destinations_by_band" in rec["queries"]
    assert "suite_cached" in rec["queries"]
