"""Vector code compression: product codes fitted over Hilbert-sorted flat blocks.

Components become integers, vectors are cut into equal parts, and each part position has a codebook,
refined in a fixed number of rounds.  The parts of a position are sorted once along a Hilbert
curve (a range shuffle) and cut into flat blocks of ``BLOCK`` parts, which store the corners of their
bounding box and their sum.  A round never moves the parts again: for each block the least and the largest distance of
every entry from its box leave a shortlist (an entry whose least distance exceeds another one's
largest can't be the nearest of any part), and integer kernels evaluate the parts against the shortlist alone.  A
block with one entry on its list adds its stored sum.  Tasks return sums of at most ``parts * entries``
entries, so a round brings only a codebook's size to the driver, however many rows there are.  Blocks live in a table in
shared storage; a lost executor costs its tasks only.

The curve's cells are cut at quantiles of the seed rows; they decide which parts share a block, never a result.

Defined cases.  Vectors null or with null or non-finite components: dropped.  Vectors of different
lengths, or of one that ``parts`` doesn't divide: filled with zeros to the longest one's part width.  Empty
vectors are kept (all zeros).  Integers beyond ``limit(width)`` (2**28 for parts of 16) count as that limit.  Rows without a vec_id:
kept, last among the seeds.  Rows that repeat a vec_id: a result each; among the seeds ordered by
their vectors.  Fewer rows than entries: a shorter codebook.  No label column: all labels null.  Empty
table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .common import checked_broadcast, delete_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 64
#: Blocks that a kernel call looks at together.
GROUP = 64


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    v = F.col("embedding")
    return rows.filter(v.isNotNull()).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def limit(width: int) -> int:
    """Largest absolute component for which squared distances of parts fit into 63 bits."""
    return math.isqrt(2**62 // max(width, 1)) // 2


def integers(scale: int, most: int):
    """``embedding`` as floor(scale * x), between -most and most."""
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-most))), F.lit(float(most))))
    return F.transform("embedding", lambda x: whole(x).cast("int"))


# --- the curve -------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (values below 2**bits) on the Hilbert curve (Skilling 2004)."""
    x = [np.ascontiguousarray(c) for c in cells.T.astype(np.int64)]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            far = (x[i] & bit) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & below)
            x[i] = x[i] ^ swap
            x[0] = np.where(far, x[0] ^ below, x[0] ^ swap) if i else np.where(far, x[0] ^ below, x[0])
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> level) & 1)
    return key


class Cells:
    """Grid cells of the parts of each position, cut at quantiles of some rows' parts."""

    def __init__(self, sample: np.ndarray):
        self.parts, width = sample.shape[1:]
        self.used = min(width, 62)
        self.bits = min(8, 62 // max(self.used, 1))
        share = np.arange(1, 1 << self.bits) / (1 << self.bits)
        self.cuts = np.quantile(sample, share, axis=0) if len(sample) else np.zeros((len(share), self.parts, width))

    def keys(self, position: int, parts: np.ndarray) -> np.ndarray:
        if not self.used:
            return np.zeros(len(parts), np.int64)
        cells = [np.searchsorted(self.cuts[:, position, j], parts[:, j], "right") for j in range(self.used)]
        return hilbert_keys(np.stack(cells, axis=1), self.bits)


# --- kernels ----------------------------------------------------------------------------


def box_distances(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of every entry from every box, as (boxes, entries)."""
    under, over = low[:, None, :] - book, book - high[:, None, :]
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(np.abs(under), np.abs(over))
    return (least * least).sum(axis=2), (most * most).sum(axis=2)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """True where an entry may be the nearest of a part inside the box."""
    least, most = box_distances(low, high, book)
    return least <= most.min(axis=1, keepdims=True)


def nearest(parts: np.ndarray, book: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest listed entry of every part (ties to the lower one) and its squared distance, exactly."""
    short = book[listed]
    bound = max(int(np.abs(parts).max(initial=0)), int(np.abs(short).max(initial=0)))
    # Sums of products below 2**53 are whole numbers in floating point too, where they are faster.
    dots = (parts.astype(float) @ short.T.astype(float)).astype(np.int64) if 4 * bound * bound * parts.shape[1] < 2**53 else parts @ short.T
    distance = (parts * parts).sum(axis=1)[:, None] - 2 * dots + (short * short).sum(axis=1)
    at = distance.argmin(axis=1)
    return listed[at], distance[np.arange(len(parts)), at]


class Blocks:
    """The block rows of an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        box = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(-1, width).astype(np.int64)
        self.width, self.n = width, batch["n"].to_numpy()
        self.position = batch["position"].to_numpy()
        self.low, self.high, self.total = box("low", np.int32), box("high", np.int32), box("total", np.int64)
        self._members = batch["members"]

    def members(self, i: int) -> np.ndarray:
        return np.frombuffer(self._members[i].as_py(), np.int32).reshape(self.n[i], self.width).astype(np.int64)

    def listed(self, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each block with the entries on its shortlist."""
        for position in range(len(books)):
            own = np.flatnonzero(self.position == position)
            for at in range(0, len(own), GROUP):
                some = own[at : at + GROUP]
                for i, on in zip(some, shortlists(self.low[some], self.high[some], books[position])):
                    yield i, np.flatnonzero(on)


# --- the operator -----------------------------------------------------------------------


def _width(kept: DataFrame, parts: int) -> int:
    """Components of a part."""
    return -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)


def matrix_of(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width), shorter vectors filled with zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.value_lengths())
    out = np.zeros((len(vectors), parts * width), np.int32)
    out[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(vectors), parts, width)


def _write_blocks(kept: DataFrame, cells: Cells, parts: int, width: int, path: str) -> None:
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"position int, place long, row_no long, vec_id {types['vec_id']}, label {types['label']}, part binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = matrix_of(batch["vector"], parts, width)
            n, none = len(matrix), np.ones(len(matrix), bool)
            for p in range(parts):
                own = np.ascontiguousarray(matrix[:, p])
                # The first part alone carries the row's other columns.
                carried = [batch[c] if p == 0 else pa.nulls(n, batch[c].type) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(none * p, pa.int32()), pa.array(cells.keys(p, own)), batch["row_no"], *carried, pa.array([r.tobytes() for r in own], pa.binary())],
                    ["position", "place", "row_no", "vec_id", "label", "part"],
                )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch["position"].to_numpy()
            matrix = np.frombuffer(b"".join(batch["part"].to_pylist()), np.int32).reshape(len(position), width)
            turns = np.flatnonzero(np.diff(position, prepend=-1))
            edges = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(turns, [*turns[1:], len(position)])] + [[len(position)]]))
            starts, ends = edges[:-1].astype(int), edges[1:].astype(int)
            some = [matrix[a:b] for a, b in zip(starts, ends)]
            offsets = pa.array(edges.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch[c]) for c in ("row_no", "vec_id", "label")]
            bytes_of = lambda arrays: pa.array([a.tobytes() for a in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(position[starts], pa.int32()), pa.array((ends - starts).astype(np.int32)), *lists,
                    bytes_of(some), bytes_of([m.min(axis=0) for m in some]), bytes_of([m.max(axis=0) for m in some]),
                    bytes_of([m.sum(axis=0, dtype=np.int64) for m in some]),
                ],
                ["position", "n", "row_no", "vec_id", "label", "members", "low", "high", "total"],
            )

    cut_rows = kept.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", "label", "vector").mapInArrow(cut, schema)
    # Equal vectors share a place on the curve; the hash deals them to several tasks.
    keys = ["position", "place", F.xxhash64("row_no")]
    blocks = (
        cut_rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(
            flatten,
            f"position int, n int, row_no array<long>, vec_id array<{types['vec_id']}>, label array<{types['label']}>, "
            "members binary, low binary, high binary, total binary",
        )
    )
    blocks.write.parquet(path)


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts nearest to them."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            here = Blocks(batch, width)
            for i, listed in here.listed(books):
                p = here.position[i]
                if len(listed) == 1:
                    sums[p, listed[0]] += here.total[i]
                    counts[p, listed[0]] += here.n[i]
                else:
                    members = here.members(i)
                    entry, _ = nearest(members, books[p], listed)
                    np.add.at(sums[p], entry, members)
                    counts[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["position", "entry", "n", "sums"],
        )

    columns = ["position", "n", "members", "low", "high", "total"]
    partial = blocks.select(*columns).mapInArrow(add_up, "position int, entry int, n long, sums array<long>")
    total = partial.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out = books.copy()
    for row in total.collect():  # at most parts * entries rows
        out[row.position, row.entry] = np.array(row.sums, np.int64) // row.n
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(blocks: DataFrame, books: np.ndarray, label_type: str, id_type: str) -> DataFrame:
    """``row_no, vec_id, label, code, error`` of every row."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                here = Blocks(batch, width)
                starts = np.cumsum(here.n) - here.n
                code, error = np.zeros(here.n.sum(), np.int32), np.zeros(here.n.sum(), np.int64)
                for i, listed in here.listed(books):
                    span = slice(starts[i], starts[i] + here.n[i])
                    code[span], error[span] = nearest(here.members(i), books[here.position[i]], listed)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c].flatten() for c in ("row_no", "vec_id", "label")], pa.array(np.repeat(here.position, here.n)), pa.array(code), pa.array(error)],
                    ["row_no", "vec_id", "label", "position", "code", "error"],
                )

    one = blocks.mapInArrow(assign, f"row_no long, vec_id {id_type}, label {label_type}, position int, code int, error long")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("code"))))), 2, "0") for p in range(parts)]
    return one.groupBy("row_no").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*digits).alias("code"), F.sum("error").alias("error")
    )


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` for each row of ``rows(vec_id, embedding[, label])`` and the
    codebooks, as an array (parts, entries, components).

    ``code`` has two hexadecimal digits for each part; ``error`` is the squared distance from the
    decoded vector.  The result reads a table that stays in shared storage (``session.remove_staged``).
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so at most 256 entries")
    spark = rows.sparkSession
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(None).cast("int"))
    kept = usable(rows).select("vec_id", "label", "embedding")
    width = _width(kept, parts)
    kept = kept.select("vec_id", "label", integers(scale, limit(width)).alias("vector"))
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    books = matrix_of(pa.array([r.vector for r in seeds], pa.list_(pa.int32())), parts, width).swapaxes(0, 1).astype(np.int64)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    if not seeds:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), books

    blocks_at, coded_at = shared_path(spark, "codes", "blocks"), shared_path(spark, "codes", "rows")
    _write_blocks(kept, Cells(books.swapaxes(0, 1)), parts, width, blocks_at)
    blocks = spark.read.parquet(blocks_at)
    for _ in range(rounds):
        books = _refined(blocks, books)
    _coded(blocks, books, types["label"], types["vec_id"]).write.parquet(coded_at)
    delete_path(spark, blocks_at)
    return spark.read.parquet(coded_at).drop("row_no"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels (nulls together)."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(checked_broadcast(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes(code, ...)`` with the ``vector`` that each code stands for: the middle of its
    integers' intervals.  A null code has a null vector."""
    parts, entries, _ = books.shape
    table = F.lit([[((e + 0.5) / scale).tolist() for e in book] for book in books.astype(float)])
    pick = [F.element_at(F.element_at(table, p + 1), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1) for p in range(parts)]
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*pick)))
