"""Spark session construction and shared-storage locations.

Only the settings that matter for this workload are pinned; anything the cluster
already configured (shuffle partitions, checkpoint directory, broadcast threshold)
is left alone.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

# Settings applied when we build the session ourselves (tests, bench, local runs).
_DEFAULTS = {
    # Adaptive execution: coalesce small shuffle partitions, split skewed join
    # partitions (a hot custkey/orderkey), and turn a shuffle join into a broadcast
    # join when the *measured* side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Parquet is compressed: scale file sizes up when estimating in-memory size so a
    # static broadcast decision errs towards "too big" (AQE still broadcasts on
    # measured shuffle sizes).
    "spark.sql.sources.fileCompressionFactor": "4",
    # Wall-clock timestamps are kept as TIMESTAMP_NTZ; pin the zone anyway so that
    # any TIMESTAMP_LTZ conversion is reproducible.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "ridelens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the engine defaults (reuses an active one)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect exposes no SparkContext
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names storage every executor can reach;
    we never override it, and without it we stop: a folder of one machine would lose data.  Only
    a ``local`` master, where driver and executors are one process, gets a scratch folder.
    """
    sc = _context(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(
                f"set spark.checkpoint.dir to a folder that the driver and all executors of {master or 'the cluster'} share"
            )
        path = tempfile.mkdtemp(prefix="ridelens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # a static setting on some deployments; the context still gets it
            pass
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tail = list(parts)
    if unique:
        tail.append(uuid.uuid4().hex[:12])
    path = "/".join([root, "ridelens", *tail])
    _MADE.append(path)
    return path


#: Folders handed out by ``shared_path`` and not yet removed.
_MADE: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on its own file system (local, HDFS, object storage)."""
    at, fs = _hadoop(spark, path)
    return bool(fs.exists(at))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names right below ``path``: one listing, not of the files further down."""
    at, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file; False if there was none."""
    at, fs = _hadoop(spark, path)
    return bool(fs.delete(at, True))


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Rename on one file system; False if ``path`` is missing or ``to`` exists."""
    at, fs = _hadoop(spark, path)
    there = spark._jvm.org.apache.hadoop.fs.Path(to)
    return not fs.exists(there) and bool(fs.exists(at)) and bool(fs.rename(at, there))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one folder of ``shared_path`` that nothing reads any more."""
    remove(spark, path)
    if path in _MADE:
        _MADE.remove(path)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(file, bytes, time of change)`` of the files at or below ``path``, without hidden ones."""
    at, fs = _hadoop(spark, path)
    if not fs.exists(at):
        return []
    out, files = [], fs.listFiles(at, True)
    root = at.toUri().getPath().rstrip("/")
    while files.hasNext():
        s = files.next()
        below = s.getPath().toUri().getPath()[len(root) :].strip("/")
        if not any(part[:1] in "._" for part in below.split("/") if part):
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def made_once(spark: SparkSession, name: str, sources: list[str], make: Callable[[str], object]) -> str:
    """The folder that ``make(path)`` writes from the files of ``sources``; made once for each state of them.

    The folder's name is a digest of the sources' files (name, size, time of change), so changed sources have another
    one.  It is written aside and renamed when complete: readers and other sessions never see a part
    of it, and of two writers at once one copy stays.  It is kept until ``remove_made`` deletes it.
    """
    state = repr([listing(spark, s) for s in sources])
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/ridelens/made/{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    if not path_exists(spark, path):
        draft = f"{root}/ridelens/made/.{name}-{uuid.uuid4().hex[:12]}"
        try:
            make(draft)
            if not rename(spark, draft, path) and not path_exists(spark, path):
                raise OSError(f"could not put {path} in place")
        finally:
            remove(spark, draft)
    return path


def remove_made(spark: SparkSession) -> bool:
    """Delete all folders of ``made_once`` below the shared checkpoint folder."""
    return remove(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ridelens/made")


def remove_staged(spark: SparkSession) -> int:
    """Delete every folder handed out by ``shared_path`` so far; returns how many.

    DataFrames that still read them can't be used afterwards, so the owner of the results calls this.
    """
    n = 0
    while _MADE:
        at, fs = _hadoop(spark, _MADE.pop())
        n += bool(fs.delete(at, True))
    return n
