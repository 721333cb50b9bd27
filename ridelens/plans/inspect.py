"""Physical-plan inspection through the public ``DataFrame.explain`` output.

Used by tests to pin down plan properties that matter at scale: one scan per
input table, no Python evaluation in the hot path, filters pushed to scans,
columns pruned, no cartesian products.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def physical_section(df: DataFrame) -> str:
    text = plan_text(df, "extended")
    i = text.find("== Physical Plan ==")
    return text[i:] if i >= 0 else text


def count_scans(df: DataFrame, table: str | None = None) -> int:
    """Number of file scans in the formatted plan (optionally of one table path)."""
    text = plan_text(df)
    locs = re.findall(r"^Location: .*?\[(.*?)\]", text, flags=re.M)
    if table is None:
        return len(locs)
    return sum(1 for loc in locs if f"/{table}." in loc or f"/{table}/" in loc)


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"^ReadSchema: (.*)$", plan_text(df), flags=re.M)


def has_python_eval(df: DataFrame) -> bool:
    text = physical_section(df)
    return any(k in text for k in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"))


def has_cartesian(df: DataFrame) -> bool:
    text = physical_section(df)
    return "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text


def count_operator(df: DataFrame, name: str) -> int:
    """Occurrences of a physical operator name (e.g. ``Exchange``, ``SortMergeJoin``)."""
    return len(re.findall(rf"^\(\d+\) {re.escape(name)}\b", plan_text(df), flags=re.M))
