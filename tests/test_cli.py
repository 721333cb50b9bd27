"""``python -m ridelens`` prints every question (run in its own process and JVM)."""

from __future__ import annotations

import os
import subprocess
import sys

from .conftest import ROOT, SF0001


def test_cli_prints_every_question():
    env = dict(os.environ, PYTHONPATH=ROOT)
    out = subprocess.run(
        [sys.executable, "-m", "ridelens", SF0001, "--master", "local[2]", "--rows", "2"],
        capture_output=True, text=True, timeout=600, env=env, cwd=ROOT,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    for name in ("top_destinations_by_band", "usertype_share_by_age", "hourly_usage",
                 "most_used_bikes", "distance_stats", "avg_speed", "duration_ridge"):
        assert f"== {name}" in out.stdout
    assert "(the first 2 of " in out.stdout
    assert "hours = " in out.stdout and "2130 trips" in out.stdout
