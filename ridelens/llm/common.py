"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than blank and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5

_MULT = 0x9E3779B97F4A7C15  # odd 64-bit multiplier of the word-sequence hash
_MASK = (1 << 64) - 1


BROADCAST_ROWS = 100_000


def checked_broadcast(side: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if a count shows that it has at most ``most_rows`` rows (of
    short values); otherwise as it is, for a shuffled join."""
    return F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library made, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class WordHashes(dict):
    """word -> 64-bit hash, filled on first use and emptied when it holds ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        import xxhash

        super().__init__()
        self._bound, self._hash = bound, xxhash.xxh3_64_intdigest
        self._find = re.compile(WORD).findall

    def __missing__(self, word: str) -> int:
        h = self._hash(word.encode("utf-8", "surrogatepass"))
        if len(self) < self._bound:
            self[word] = h
        return h

    def words(self, text: str | None) -> list[str]:
        return self._find(text) if text else []

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class TextHasher:
    """Hashes of the words of a text, all at once: differences of a running polynomial over its bytes."""

    _P = 0x9E3779B97F4A7C15
    _P_INVERSE = pow(_P, -1, 1 << 64)

    def __init__(self):
        self._powers = self._inverses = np.zeros(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 4096, 2 * len(self._powers))
            for name, base in (("_powers", self._P), ("_inverses", self._P_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        word = (data != 32) & ((data < 9) | (data > 13))
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        if not len(edge):
            return np.zeros(0, np.uint64)
        start, end = edge[::2], edge[1::2]
        self._reach(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self._inverses[start] + (end - start).astype(np.uint64))

    def spans(self, word_hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Signed hashes of the runs of words from ``start`` to before ``end``."""
        self._reach(len(word_hashes))
        sums = np.zeros(len(word_hashes) + 1, np.uint64)
        np.cumsum(mix(word_hashes) * self._powers[: len(word_hashes)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self._inverses[start] + (end - start).astype(np.uint64)).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def runs_hash(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (empty if there are fewer)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * np.uint64(_MULT) + word_hashes[j : j + m]
    return mix(h)


def shingle_set(word_hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a text of 1 to n-1 words has one
    shingle, all its words, and a text without words has none."""
    if len(word_hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(runs_hash(word_hashes, min(n, len(word_hashes))))


def text_blocks(texts: list, bound: int) -> Iterator[range]:
    """Consecutive ranges of ``texts`` of about ``bound`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > bound:
            yield range(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield range(start, len(texts))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column``, one row at least.

    What a worker makes of a slice is small beside the batch; at the end of the task its freed memory goes back to the
    machine, as workers live on for later stages.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Slices of sorted batches in which the ``columns`` (whole numbers) are constant, with their values in front."""
    for batch in batches:
        values = [batch[c].to_numpy() for c in columns]
        turns = np.flatnonzero(np.logical_or.reduce([np.diff(v) != 0 for v in values])) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
            if a < b:
                yield (*(v[a].item() for v in values), batch.slice(a, b - a))


def release_memory() -> None:
    """Give freed memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
