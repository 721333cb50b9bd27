"""Trip files in, result extracts out.

Trip files are headered CSV text with every field quoted and times written as
``yyyy-MM-dd HH:mm:ss.SSSS`` (the public bike-share trip format), one directory
per start month.  Reading is one ``DataFrameReader.csv`` call over a list of
paths (no RDD union chain), with an explicit schema (no inference pass) and
PERMISSIVE mode: a malformed line becomes a row with nulls plus its raw text in
``_corrupt_record`` instead of failing the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import CORRUPT_COLUMN, RAW_TIME_FORMAT, TRIP_COLUMNS, TRIP_SCHEMA, with_corrupt_column
from ..session import path_exists, remove, rename
from . import headers as H

MONTH_COLUMN = "month"
MONTH_FORMAT = "yyyyMM"
#: Rows of a trip file that is written here, at most: about 200 MB of text.
MAX_FILE_ROWS = 1_000_000


def write_trip_files(trips: DataFrame, out_dir: str, mode: str = "overwrite", by_month: bool = False) -> str:
    """Write raw trips as monthly CSV directories ``<out_dir>/month=yyyyMM/``, gzipped.

    The ``rebalance`` hint shuffles rows by month once and lets AQE size the
    partitions: small months are coalesced and a hot month (say a third of all
    trips) is split across tasks, so the output is a few right-sized files per
    month instead of one small file per (scan task, month).  ``by_month``: the rows come
    so already (``trips_from_tables``), and are not shuffled again.
    """
    rows = trips.select(*TRIP_COLUMNS).withColumn(MONTH_COLUMN, F.date_format("startTime", MONTH_FORMAT))
    write_trip_csv(rows if by_month else rows.hint("rebalance", MONTH_COLUMN), out_dir, mode, [MONTH_COLUMN])
    return out_dir


def write_trip_csv(rows: DataFrame, path: str, mode: str = "errorifexists", partitions: list[str] | None = None) -> None:
    """Headered, quoted and gzipped CSV text of trips.  A gzipped file is read by one task, so its rows are bounded."""
    (
        rows.write.mode(mode)
        .partitionBy(*partitions or [])
        .option("header", True)
        .option("quoteAll", True)
        .option("timestampNTZFormat", RAW_TIME_FORMAT)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", MAX_FILE_ROWS)
        .csv(path)
    )


def month_paths(root: str, months: list[str]) -> list[str]:
    return [f"{root.rstrip('/')}/{MONTH_COLUMN}={m}" for m in months]


def _reader(spark: SparkSession, schema: T.StructType, rejects: bool, header: bool = True):
    r = (
        spark.read.schema(schema)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("timestampNTZFormat", RAW_TIME_FORMAT)
    )
    if rejects:
        r = r.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    return r


def read_trip_csv(
    spark: SparkSession, paths: str | list[str], rejects: bool = False, header: bool = True
) -> DataFrame:
    """Typed trip rows from one or many CSV files/directories.

    Reading the staging root also yields the ``month`` partition column, so a
    month predicate prunes whole directories.  With ``rejects=True`` the
    ``_corrupt_record`` column holds the text of lines that did not parse.

    Columns go by the names in each file's header (``headers.layout``): files that order or call them
    otherwise are read in their own layout, and files whose header does not name every trip column
    are left out (``headers.file_ledger`` lists them).  ``header=False``: by position.
    """
    schema = with_corrupt_column(TRIP_SCHEMA) if rejects else TRIP_SCHEMA
    if not header:
        return _reader(spark, schema, rejects, False).csv(paths)
    return read_layouts(spark, paths, H.headers(spark, paths), rejects)


def read_layouts(spark: SparkSession, paths: str | list[str], found: list[tuple], rejects: bool = False) -> DataFrame:
    """``read_trip_csv`` of ``paths`` whose files and headers were ``found`` by ``headers.headers``."""
    schema = with_corrupt_column(TRIP_SCHEMA) if rejects else TRIP_SCHEMA
    layouts: dict[tuple, list[str]] = {}
    for file, status, columns, _ in found:
        if status in (H.STANDARD, H.BY_NAME):
            layouts.setdefault(tuple(columns), []).append(file)
    standard = tuple(TRIP_COLUMNS)
    if all(status in (H.STANDARD, H.EMPTY) for _, status, _, _ in found):
        return _reader(spark, schema, rejects).csv(paths)
    types = {f.name: f.dataType for f in TRIP_SCHEMA.fields}
    roots = [paths] if isinstance(paths, str) else paths
    parts = []
    for columns, files in sorted(layouts.items(), key=lambda x: x[0] != standard):
        # Other fields are read as text and dropped.
        fields = [T.StructField(c, types[c]) if c else T.StructField(f"_other{i}", T.StringType()) for i, c in enumerate(columns)]
        own = T.StructType(fields + ([T.StructField(CORRUPT_COLUMN, T.StringType())] if rejects else []))
        reader = _reader(spark, own, rejects)
        if len(roots) == 1 and not files_match(files, roots[0]):
            reader = reader.option("basePath", roots[0])
        rows = reader.csv(files)
        parts.append(rows.select(*schema.names, *[c for c in rows.columns if c not in own.names]))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def files_match(files: list[str], root: str) -> bool:
    """True if ``root`` is itself one of the files, or a pattern, so that it has no folders below it."""
    return any(c in root for c in "*?[{") or any(f.rstrip("/").endswith(root.rstrip("/")) for f in files)


def read_trip_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All 15 fields as text (no parsing in the reader)."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in TRIP_SCHEMA.fields])
    return _reader(spark, schema, False).csv(paths)


def parse_trip_text(text: DataFrame) -> DataFrame:
    """Text fields -> typed trip record; malformed values become null (never fail)."""
    cols = []
    for f in TRIP_SCHEMA.fields:
        raw = C.strip_quotes(F.col(f.name))
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(C.parse_raw_time(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(raw.alias(f.name))
        else:
            cols.append(raw.try_cast(f.dataType).alias(f.name))
    return text.select(*cols)


def reject_summary(rows: DataFrame) -> DataFrame:
    """One row on a ``read_trip_csv(..., rejects=True)`` frame: ``parsedRows``, ``rejectedRows``, and
    for each field ``null_<field>``, the rejected lines in which it is missing or did not parse.

    All 15 fields are read.  The reader converts only the fields that a query uses, and a line is
    rejected only by a field that was converted, so fewer would miss bad lines.
    """
    bad = F.col(CORRUPT_COLUMN).isNotNull()
    return rows.agg(
        F.count_if(~bad).alias("parsedRows"),
        F.count_if(bad).alias("rejectedRows"),
        *[F.count_if(bad & F.col(c).isNull()).alias(f"null_{c}") for c in TRIP_COLUMNS],
    )


def rejected_lines(rows: DataFrame) -> DataFrame:
    """``(line, <field>_ok ...)``: the text of every rejected line, and which fields parsed."""
    return rows.filter(F.col(CORRUPT_COLUMN).isNotNull()).select(
        F.col(CORRUPT_COLUMN).alias("line"), *[F.col(c).isNotNull().alias(f"{c}_ok") for c in TRIP_COLUMNS]
    )


def unread_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines below the headers of files that ``read_layouts`` leaves out, as ``rejected_lines`` gives lines: no field parsed."""
    # One field a line; a line that holds the separator is malformed and kept whole.
    rows = (
        spark.read.schema(f"line string, {CORRUPT_COLUMN} string")
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(files)
    )
    return rows.select(F.coalesce(CORRUPT_COLUMN, "line").alias("line"), *[F.lit(False).alias(f"{c}_ok") for c in TRIP_COLUMNS])


def export_csv(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    single_file: bool = False,
    quote: str | None = None,
) -> str:
    """Headered CSV extract, written aside and published in one step.

    ``mode``: ``errorifexists`` (the default), ``overwrite`` or ``ignore``.  Readers see the old extract until the
    new one is complete; a write that fails or is interrupted leaves the old one as it is (``publish``).

    ``single_file=True`` coalesces to one part file - meant for bounded results
    (top-k lists, per-age tables), never for row-level data.  ``quote="\\u0000"``
    reproduces the original extracts, which disabled quoting.  ``repartition(1)``
    rather than ``coalesce(1)``: coalesce would pull the single-task limit up into
    the stage that computes ``df``; the extra exchange moves only the final rows.
    """
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    recover(spark, path)
    if path_exists(spark, path):
        if mode == "ignore":
            return path
        if mode == "errorifexists":
            raise FileExistsError(f"{path} exists already; pass mode='overwrite' to replace it")
    staged = _beside(path, f"new-{uuid.uuid4().hex[:12]}")
    out = df.repartition(1) if single_file else df
    w = out.write.mode("errorifexists").option("header", True)
    if quote is not None:
        w = w.option("quote", quote)
    try:
        w.csv(staged)
        publish(spark, staged, path, replace=mode == "overwrite")
    finally:
        remove(spark, staged)
    return path


def _beside(path: str, what: str) -> str:
    """A hidden sibling of ``path``: on the same storage, and skipped by readers of the parent folder."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}.{what}" if parent else f".{name}.{what}"


def publish(spark: SparkSession, staged: str, path: str, replace: bool = False) -> None:
    """Put the complete folder ``staged`` in the place of ``path`` by renames.

    The old folder is set aside first and deleted last; should the process die in between, ``recover`` (and so the next
    ``export_csv`` or ``read_extract``) puts it back.
    """
    old = _beside(path, "old")
    if replace and path_exists(spark, path):
        remove(spark, old)
        if not rename(spark, path, old):
            raise OSError(f"could not set {path} aside")
    if not rename(spark, staged, path):
        recover(spark, path)
        raise OSError(f"could not publish {path}")
    remove(spark, old)


def recover(spark: SparkSession, path: str) -> None:
    """Undo or finish a publication of ``path`` that was cut off."""
    old = _beside(path, "old")
    if path_exists(spark, old):
        if path_exists(spark, path):
            remove(spark, old)
        else:
            rename(spark, old, path)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """Read an extract back with inferred types (header row, one inference pass)."""
    recover(spark, path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def column_types(extract: DataFrame) -> DataFrame:
    """``(position, column, type)`` of an extract as it was read back."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(extract.dtypes)]
    return extract.sparkSession.createDataFrame(rows, "position int, column string, type string")
