"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments of ``SEGMENT`` characters (shorter items are one segment),
one every ``STEP`` characters and one at the end, so that every excerpt of ``SEGMENT`` characters holds one with
``STEP - 1`` edits at most, which is within a segment's budget.  A text that holds a segment with at most k
edits shares at least ``m + 1 - q (k + 1)`` of the segment's m - q + 1 q-grams with it, all on k + 1
neighbouring diagonals (place in the text minus place in the segment).  Shared q-grams are counted in
overlapping diagonal bands, each twice as wide as the budget and moved by half its width, so that the
diagonals of any occurrence lie whole inside one band.  Bands that meet the bound are verified
by an alignment restricted to the band; a document that holds a segment within its budget is
contaminated.

Text and items are compared in lower case with white space as blanks.

Defined cases.  Null or empty text: clean.  Items with null text or without a character other
than white space are no evidence and are ignored; so are null item ids.  Items of fewer than ``Q`` characters, which have
no q-gram: held by a text that is the item and nothing else.  Repeated items: each is reported.
Empty benchmark: all clean.  Repeated documents: one result each.  Very long texts: read whole, in
one piece of their own.  Other columns are ignored (``scan``) or kept (``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import sliced, text_blocks

Q = 10
EDIT_SHARE = 0.05
SEGMENT = 60
STEP = 4
#: Characters of benchmark items that one pass over the documents broadcasts; a larger benchmark
#: is split by hash of the item into several passes.
SHARD_CHARACTERS = 500_000
#: Matches of q-grams, and bands, that are looked at together.
MATCHES = 1_000_000
BANDS = 4_000
#: Characters at the end of a segment that a band is tried on first.
TAIL = 20
_SEPARATOR = 0x10FFFF


def _points(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((p >= 9) & (p <= 13), np.uint32(32), p)


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the q-gram that starts at each place but the last q - 1."""
    if len(points) < Q:
        return np.zeros(0, np.uint32)
    b = 0x01000193
    one = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(b) + one[1:]
    four = two[:-2] * np.uint32(b * b % 2**32) + two[2:]
    eight = four[:-4] * np.uint32(pow(b, 4, 2**32)) + four[4:]
    h = eight[:-2] * np.uint32(b * b % 2**32) + two[8:]
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA6B)


class Index:
    """The q-grams of the segments of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        #: Equal segments are stored and verified once; ``items`` are those that hold each.
        self.segments: list[np.ndarray] = []
        self.items: list[list[int]] = []
        self.short: dict[bytes, set[int]] = {}
        number: dict[bytes, int] = {}
        for item, text in sorted(set(items)):
            p = _points(text.lower().strip())
            if len(p) < Q:
                if len(p):
                    self.short.setdefault(p.tobytes(), set()).add(item)
                continue
            starts = list(range(0, max(1, len(p) - SEGMENT + 1), STEP))
            if len(p) > SEGMENT and starts[-1] + SEGMENT < len(p):
                starts.append(len(p) - SEGMENT)
            for s in starts:
                own = number.setdefault(p[s : s + SEGMENT].tobytes(), len(self.segments))
                if own == len(self.segments):
                    self.segments.append(p[s : s + SEGMENT])
                    self.items.append([])
                if not self.items[own] or self.items[own][-1] != item:
                    self.items[own].append(item)
        self.length = np.array([len(s) for s in self.segments], np.int64)
        self.points = np.zeros((len(self.segments), SEGMENT), np.uint32)
        for s, own in enumerate(self.segments):
            self.points[s, : len(own)] = own
        self.budget = np.array([int(len(s) * EDIT_SHARE) for s in self.segments], np.int64)
        self.bound = np.array([len(s) + 1 - Q * (k + 1) for s, k in zip(self.segments, self.budget)], np.int64)
        hashes = [_gram_hashes(s) for s in self.segments]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.segment_of = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])[order]
        self.place_of = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])[order] if hashes else np.zeros(0, np.int32)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.grams >> np.uint32(10)] = True

    def scan(self, texts: list) -> list[list[int]]:
        """For each text the items of which it holds a segment."""
        out: list[set[int]] = [set(self._short(t)) for t in texts]
        if not self.segments:
            return [sorted(x) for x in out]
        parts, starts, at = [], [], 0
        for t in texts:
            p = _points(t.lower()) if t else np.zeros(0, np.uint32)
            parts += [p, np.full(Q, _SEPARATOR, np.uint32)]
            starts.append(at)
            at += len(p) + Q
        points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        held: set[tuple[int, int]] = set()
        for segment, low, high in self._bands(points):
            # A band that holds a segment holds its last characters; most that share a line with it don't.
            near = np.flatnonzero(self._align(points, segment, low, high, np.maximum(self.length[segment] - TAIL, 0)) <= self.budget[segment])
            segment, low, high = segment[near], low[near], high[near]
            distance = self._align(points, segment, low, high)
            fits = np.flatnonzero(distance <= self.budget[segment])
            # The last text that starts at or before the band's middle.
            place = (low[fits] + high[fits]) // 2 + self.length[segment[fits]] // 2
            held |= set(zip((np.searchsorted(starts, place, side="right") - 1).tolist(), segment[fits].tolist()))
        for text, segment in held:
            out[text].update(self.items[segment])
        return [sorted(x) for x in out]

    def _short(self, text: str | None) -> set[int]:
        """The items of fewer than ``Q`` characters that the text is."""
        if not self.short or not text or len(text.strip()) >= Q:
            return set()
        return self.short.get(_points(text.lower().strip()).tobytes(), set())

    def _bands(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, first diagonal, last diagonal) of the bands that meet the bound, in groups."""
        h = _gram_hashes(points)
        place = np.flatnonzero(self.bits[h >> np.uint32(10)])
        if not len(place):
            return
        g = np.searchsorted(self.grams, h[place])
        g = np.minimum(g, len(self.grams) - 1)
        hit = self.grams[g] == h[place]
        place, g = place[hit], g[hit]
        n = self.first[g + 1] - self.first[g]
        width = (len(points) + 2 * SEGMENT) + 2
        # Bounded groups of matches; cells that the next group may still add to are carried over.
        groups = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), MATCHES), side="left"))
        kept, kept_count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin, end in zip(groups, [*groups[1:], len(place)]):
            p, m = place[begin:end], n[begin:end]
            where = np.repeat(self.first[g[begin:end]], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            segment = self.segment_of[where].astype(np.int64)
            diagonal = np.repeat(p, m) - self.place_of[where] + SEGMENT
            # Half a band holds the k + 1 diagonals of an occurrence, wherever they begin.
            key = segment * width + diagonal // (self.budget[segment] + 1)
            found, count = np.unique(key, return_counts=True)
            found, back = np.unique(np.concatenate([kept, found, found - 1]), return_inverse=True)
            count = np.bincount(back, np.concatenate([kept_count, count, count]), len(found)).astype(np.int64)
            segment, cell = found // width, found % width
            last = (cell + 2) * (self.budget[segment] + 1) - Q  # place of the last match that a cell can get
            done = last < place[end] if end < len(place) else np.ones(len(found), bool)
            kept, kept_count = found[~done], count[~done]
            enough = done & (count >= np.maximum(self.bound[segment], 1))
            segment, cell = segment[enough], cell[enough]
            half = self.budget[segment] + 1
            low = cell * half - SEGMENT
            for at in range(0, len(segment), BANDS):
                s = slice(at, at + BANDS)
                yield segment[s], low[s], low[s] + 2 * half[s] - 1

    def _align(self, points: np.ndarray, segment: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """Least edits between each segment, from its character ``begin`` on, and any piece of the text inside its
        band; some number above its budget where there are more."""
        far = 1 << 20
        out = np.full(len(segment), far, np.int64)
        if not len(segment):
            return out
        line = np.arange(len(segment))
        row = np.zeros(len(segment), np.int64) if begin is None else begin.copy()
        length, budget, pattern = self.length[segment], self.budget[segment], self.points[segment]
        column = np.arange(int((high - low).max()) + 1)
        wide = column[None, :] <= (high - low)[:, None]
        best = np.where(wide, 0, far)  # any place of the text inside the band may come first
        step = 0
        while len(line):
            at = (low + row)[:, None] + column  # place in the text of each column
            inside = (at >= 0) & (at < len(points))
            char = points[np.clip(at, 0, len(points) - 1)]
            same = inside & (char == pattern[np.arange(len(line)), row][:, None])
            down = np.concatenate([best[:, 1:], np.full((len(best), 1), far)], axis=1) + 1
            now = np.minimum(best + np.where(same, 0, np.where(inside, 1, far)), down)
            now = np.minimum.accumulate(np.where(wide, now, far) - column, axis=1) + column
            best = np.where(wide, now, far)
            row, step = row + 1, step + 1
            ended = row == length
            if ended.any() or step % 4 == 0:
                least = best.min(axis=1)
                out[line[ended]] = least[ended]
                on = ~ended & (least <= budget)
                line, row, length, budget, pattern = line[on], row[on], length[on], budget[on], pattern[on]
                low, wide, best = low[on], wide[on], best[on]
        return out


def _shards(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items by shard; each has about ``SHARD_CHARACTERS`` characters and is read when its pass begins."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD_CHARACTERS))
    for k in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def _scan_batch(index: Index, texts: list) -> list[list[int]]:
    out: list[list[int]] = []
    for r in text_blocks(texts, 1_000_000):
        out += index.scan(texts[r.start : r.stop])
    return out


def _pass(docs: DataFrame, items: list[tuple[int, str]], keep_clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in sliced(batches):
            found = _scan_batch(index, batch["text"].to_pylist())
            if keep_clean:
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
            else:
                new = [sorted({*(old or []), *f}) for old, f in zip(batch["item_ids"].to_pylist(), found)]
                columns = {name: batch[name] for name in batch.schema.names} | {"item_ids": pa.array(new, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_ids)`` for each row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text", F.array().cast("array<long>").alias("item_ids"))
    for k, items in enumerate(_shards(benchmark)):
        rows = _pass(_settled(rows, k), items, keep_clean=False)
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of ``docs``, all columns."""
    for k, items in enumerate(_shards(benchmark)):
        docs = _pass(_settled(docs, k), items, keep_clean=True)
    return docs


def _settled(rows: DataFrame, k: int) -> DataFrame:
    """Between passes the rows are written out, so that a task holds the index of one shard only."""
    if k == 0:
        return rows
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()
