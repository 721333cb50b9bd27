"""Trip files read by the names in their headers.

Files of different years order or name their columns differently.  Every file's first line is read (one small read a
file, in parallel, as a schema merge does), files are grouped by layout, and each layout is read
with its own column order; what remains is a union of a few scans.  Files whose header doesn't name
every trip column once are not read; the ledger lists them with all others.
"""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..schema import TRIP_COLUMNS
from ..session import _hadoop

#: Header reads at the same time.
READERS = 16

# Other names of the columns in public trip files, without case, blanks and marks.
OTHER_NAMES = {
    "tripduration": "duration",
    "stoptime": "endTime",
    "startstationlatitude": "startStationLat",
    "startstationlongitude": "startStationLong",
    "endstationlatitude": "endStationLat",
    "endstationlongitude": "endStationLong",
}

STANDARD, BY_NAME, UNKNOWN, EMPTY = "standard", "by name", "unknown header", "empty"


def column_of(name: str) -> str | None:
    """The trip column that a header name means, or None."""
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    return OTHER_NAMES.get(plain) or next((c for c in TRIP_COLUMNS if c.lower() == plain), None)


def layout(header: str | None) -> tuple[str, list[str | None]]:
    """``(status, trip column of each field)`` of a header line; None for fields that are no trip column."""
    if header is None or not header.strip():
        return EMPTY, []
    names = next(csv.reader([header.lstrip("﻿")]))
    columns = [column_of(n.strip()) for n in names]
    known = [c for c in columns if c]
    if sorted(known) != sorted(TRIP_COLUMNS):
        return UNKNOWN, columns
    return (STANDARD if columns == TRIP_COLUMNS else BY_NAME), columns


def data_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files below the paths (patterns allowed), without hidden ones."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        at, fs = _hadoop(spark, path)
        for found in fs.globStatus(at) or []:
            if found.isFile():
                out.append(found.getPath().toString())
                continue
            root = found.getPath().toString().rstrip("/")
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                file = files.next().getPath().toString()
                if not any(part[:1] in "._" for part in file[len(root) :].strip("/").split("/")):
                    out.append(file)
    return sorted(out)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, compressed or not."""
    jvm = spark._jvm
    at, fs = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
        plain = codec.createInputStream(stream) if codec is not None else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def headers(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, str, list[str | None], str | None]]:
    """``(file, status, columns, header)`` of every file."""
    files = data_files(spark, paths)
    with ThreadPoolExecutor(max_workers=READERS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    return [(file, *layout(line), line) for file, line in zip(files, lines)]


def file_ledger(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, status, header`` of every file: read as it stands, by name, or not at all."""
    return ledger(spark, headers(spark, paths))


def ledger(spark: SparkSession, found: list[tuple]) -> DataFrame:
    """``file_ledger`` of what ``headers`` found."""
    rows = [(file, status, header) for file, status, _, header in found]
    return spark.createDataFrame(rows, "file string, status string, header string")
