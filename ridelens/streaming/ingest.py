"""Incremental ingest of monthly trip files with Structured Streaming.

The original analysis re-reads every monthly file on each run.  Here new files in a landing folder
are picked up by the file source, cleaned with the same cohort rule, and added to a
cohort table.  Every micro-batch writes its own ``batch=<number>`` folder below the caller's table
path and overwrites it when the batch is run again, so a restarted job neither skips
nor duplicates a file.  Inside a batch rows are rebalanced by month: few files for each month,
a hot month split.  Lines that do not parse go to the rejects path, as text, and not
into the cohort.

The stream carries the names of new files only; each batch reads its files by the names in their headers, as
``read_trip_csv`` does.  All lines of a file whose header does not name every trip column are rejects.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators.cohort import clean_cohort
from ..operators.models import TRIP_KEY, load_pipeline, tree_inputs
from ..schema import CORRUPT_COLUMN, TRIP_COLUMNS
from ..sources import headers as H
from ..sources.files import MONTH_COLUMN, MONTH_FORMAT, read_layouts, rejected_lines, unread_lines

BATCH_COLUMN = "batch"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the paths of new files; their bytes are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(landing_dir).select("path")


def batch_files(spark: SparkSession, batch: DataFrame) -> list[tuple]:
    """``headers.headers`` of a batch's files, whose names are all that the driver takes."""
    paths = [r.path for r in batch.collect()]
    found = H.headers(spark, paths)
    if len(found) != len(paths):
        raise FileNotFoundError(f"gone, or named like a pattern: {sorted(set(paths) - {f[0] for f in found})[:5]}")
    return found


def batch_rows(spark: SparkSession, found: list[tuple]) -> DataFrame:
    """Trip rows of a batch's files, with the text of lines that did not parse."""
    return read_layouts(spark, [f[0] for f in found], found, rejects=True).select(*TRIP_COLUMNS, CORRUPT_COLUMN)


def start_cohort_ingest(
    spark: SparkSession,
    landing_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    rejects_dir: str,
    as_of_year: int = C.DEFAULT_AS_OF_YEAR,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    ledger_dir: str | None = None,
) -> StreamingQuery:
    """Add cleaned rows to ``table_dir`` (parquet by batch and start month), bad lines to
    ``rejects_dir`` (parquet by batch) and, if given, the files' ``file, status, header`` to ``ledger_dir``.

    ``available_now=True`` processes everything present and stops (batch-style
    catch-up, still incremental across runs; with ``max_files_per_trigger`` the
    catch-up runs as several bounded micro-batches); otherwise the query keeps
    running with the given ``processing_time`` trigger.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = batch_files(spark, batch)
        unread = [file for file, status, _, _ in found if status == H.UNKNOWN]
        # All fields are kept, so that every bad field rejects its line, in both outputs alike.
        rows = batch_rows(spark, found).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = rows.filter(F.col(CORRUPT_COLUMN).isNull()).select(*TRIP_COLUMNS)
            (
                clean_cohort(good, as_of_year)
                .withColumn(MONTH_COLUMN, F.date_format("startTime", MONTH_FORMAT))
                .hint("rebalance", MONTH_COLUMN)
                .write.mode("overwrite")
                .partitionBy(MONTH_COLUMN)
                .parquet(f"{table_dir.rstrip('/')}/{BATCH_COLUMN}={number}")
            )
            bad = rejected_lines(rows)
            if unread:
                bad = bad.unionByName(unread_lines(spark, unread))
            bad.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/{BATCH_COLUMN}={number}")
            if ledger_dir:
                H.ledger(spark, found).write.mode("overwrite").parquet(f"{ledger_dir.rstrip('/')}/{BATCH_COLUMN}={number}")
        finally:
            rows.unpersist()

    stream = file_stream(spark, landing_dir, max_files_per_trigger)
    return _started(stream.writeStream.foreachBatch(write), checkpoint_dir, available_now, processing_time)


def _started(writer, checkpoint_dir: str, available_now: bool, processing_time: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_scoring(
    spark: SparkSession,
    landing_dir: str,
    scored_dir: str,
    checkpoint_dir: str,
    model_dir: str,
    as_of_year: int = C.DEFAULT_AS_OF_YEAR,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Add the cohort rows of new trip files, with the duration that the pipeline stored in ``model_dir``
    predicts, to ``scored_dir`` (parquet by batch, exactly once as in ``start_cohort_ingest``).

    The pipeline is loaded once, when the query starts; a new model takes a restart.  Columns: the
    trip's key, ``label`` (its duration) and ``prediction``.  Lines that do not parse are left to the ingest.
    """
    model = load_pipeline(model_dir)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch_rows(spark, batch_files(spark, batch))
        # Always true; the hash makes the reader convert all fields, so that a bad one of any column rejects its
        # line.  The rows are used once, and are not kept for it.
        read = F.xxhash64(*TRIP_COLUMNS) >= F.lit(-(2**63))
        good = rows.filter(F.col(CORRUPT_COLUMN).isNull() & read).select(*TRIP_COLUMNS)
        scored = model.transform(tree_inputs(clean_cohort(good, as_of_year))).select(*TRIP_KEY, "label", "prediction")
        scored.write.mode("overwrite").parquet(f"{scored_dir.rstrip('/')}/{BATCH_COLUMN}={number}")

    stream = file_stream(spark, landing_dir, max_files_per_trigger)
    return _started(stream.writeStream.foreachBatch(write), checkpoint_dir, available_now, processing_time)
