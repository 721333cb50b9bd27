"""Substring dedup with suffix automata of reference shards.

A word is removed if a window of ``WINDOW`` words covers it whose word sequence also starts in a
document with a smaller doc_id.  The reference is the corpus itself, so automata of it
can't be broadcast to all documents (their total size has no bound).  Instead reference and documents
are routed to shards by a key that depends on a window's words only:

1. Every window's key is the smallest hash of its runs of ``RUN`` words (a minimizer).  Consecutive
   windows of one key form a region.  Keys that occur in one document only can't repeat and drop out.
2. Equal regions are merged by the hash of their words, with their smallest doc_id.  Where a key has
   several regions, their words are the reference.  They are dealt out by key; each task takes whole
   keys into shards of bounded size, builds the shard's suffix automaton (each state with the smallest
   doc_id of what it accepts), and streams the regions through it: the matching statistics at each
   place give the smallest document that holds the window ending there.
3. Every occurrence of a region meets its result: all its windows repeat if the region's first
   document is smaller, else those that the automaton found in a smaller one.

A key that more than ``HOT_DOCUMENTS`` documents share is split: its windows become regions of one
window, each with a key of its own, so no shard holds a group without a bound.  Keys only route;
regions are equal if key and a 64-bit hash of the words are, windows if their words are.

Defined cases.  Null or empty text: no words.  Fewer than ``WINDOW`` words: all kept.  Null doc_id: all
kept, and no reference.  Rows that repeat a doc_id: judged each on its own, against smaller doc_ids
only.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .common import WORD, TextHasher, delete_path, mix, runs_hash, sliced

WINDOW = 13
RUN = 5
KEY_BITS = 48  # enough to route: a key that two windows share by chance costs a comparison only
HOT_DOCUMENTS = 2_000
SHARD_WORDS = 60_000


words = re.compile(WORD).findall


def window_keys(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """The smallest hash of a run of words in each window, cut to ``KEY_BITS`` (empty if there is no
    window)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    low, width = runs_hash(hashes, run) >> np.uint64(64 - KEY_BITS), 1
    while width < window - run + 1:  # the smallest of twice as many runs, as far as the window goes
        step = min(width, window - run + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low.view(np.int64)


def regions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of each run of windows with one key."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return first, np.diff(np.append(first, len(keys)))


class SuffixAutomaton:
    """Of several word sequences, each with a document; every state knows its smallest document."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [None]

    def add(self, words: list, doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            if self.doc[last] is None or doc < self.doc[last]:
                self.doc[last] = doc

    def _extend(self, last: int, w) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, w)
        state = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return state

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.doc.append(None)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def finish(self) -> None:
        """Carry the smallest documents from longer sequences to their suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, d = self.link[s], self.doc[s]
            if d is not None and (self.doc[up] is None or d < self.doc[up]):
                self.doc[up] = d

    def first_documents(self, words: list, window: int) -> list[int | None]:
        """For each window of ``words`` the smallest document that holds it, or None."""
        state = matched = 0
        out = []
        for j, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if j >= window - 1:
                out.append(self.doc[state] if matched >= window else None)
        return out


def _document_keys(docs: DataFrame) -> DataFrame:
    """``(key, doc_id)``: the distinct window keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TextHasher()
        for batch in sliced(batches):
            keys, ids = [], []
            for doc, x in zip(batch["doc_id"].to_pylist(), batch["text"]):
                k = window_keys(hashes(x.as_py()))
                k = np.unique(k[regions(k)[0]])
                keys.append(k)
                ids.append(np.full(len(k), doc, np.int64))
            for at in range(0, len(keys), 1000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys[at : at + 1000])), pa.array(np.concatenate(ids[at : at + 1000]))], ["key", "doc_id"]
                )

    return docs.mapInArrow(run, "key long, doc_id long")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, flat, and where each row's begin (null: none)."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """Each row's numbers of a list column."""
    flat, at = _lists(column)
    flat = flat.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _pieces(text: str, hashes: TextHasher, listed: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first window, number of windows, hash of the words)``, as arrays, of the regions of a text whose
    key is listed; a hot region gives each of its windows alone, under a key of its own."""
    own = hashes(text)
    keys = window_keys(own)
    first, n = regions(keys)
    key = keys[first]
    chosen = np.isin(key, listed)
    first, n, key = first[chosen], n[chosen], key[chosen]
    split = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    if split.any():
        wide = n[split]
        at = np.repeat(first[split], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        alone = runs_hash(mix(own), WINDOW).view(np.int64)
        first, n = np.concatenate([first[~split], at]), np.concatenate([n[~split], np.ones(len(at), np.int64)])
        key = np.concatenate([key[~split], alone[at]])
    return key, first, n, hashes.spans(own, first, first + n + WINDOW - 1)


def _occurrences(keyed: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, key, words_hash, first, n)`` of the regions of ``keyed(doc_id, text_hash, text, keys, hot)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TextHasher()
        for batch in sliced(batches):
            found = [_pieces(x.as_py(), hashes, listed, hot) for x, listed, hot in zip(batch["text"], _numbers(batch["keys"]), _numbers(batch["hot"]))]
            at = pa.array(np.repeat(np.arange(len(found)), [len(key) for key, *_ in found]))
            key, first, n, h = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["text_hash"].take(at), pa.array(key), pa.array(h), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                ["doc_id", "text_hash", "key", "words_hash", "first", "n"],
            )

    return keyed.mapInArrow(run, "doc_id long, text_hash long, key long, words_hash long, first int, n int")


def _texts(holders: DataFrame) -> DataFrame:
    """``(key, words_hash, words, doc_id)`` of the regions at the places ``wanted`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            wanted, at = _lists(batch["wanted"])
            first, n = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
            end = (first + n + WINDOW - 1).tolist()
            texts = []
            for x, a, b in zip(batch["text"], at[:-1].tolist(), at[1:].tolist()):
                found = words(x.as_py())
                texts += [" ".join(found[i:j]) for i, j in zip(first[a:b].tolist(), end[a:b])]
            docs = batch["doc_id"].take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at))))
            yield pa.RecordBatch.from_arrays([wanted.field("key"), wanted.field("words_hash"), pa.array(texts, pa.string()), docs], ["key", "words_hash", "words", "doc_id"])

    return holders.mapInArrow(run, "key long, words_hash long, words string, doc_id long")


def _stream_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Automata over whole keys (rows come sorted by key), up to ``SHARD_WORDS`` words each."""
    shard: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for _, _, split, doc in shard:
            automaton.add(split, doc)
        automaton.finish()
        earlier = []
        for _, _, split, doc in shard:
            found = automaton.first_documents(split, WINDOW)
            earlier.append([i for i, d in enumerate(found) if d is not None and d < doc])
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in shard], pa.int64()), pa.array([x[1] for x in shard], pa.int64()), pa.array(earlier, pa.list_(pa.int32()))],
            ["key", "words_hash", "earlier"],
        )

    for batch in batches:
        for key, h, text, doc in zip(*(batch[c].to_pylist() for c in ("key", "words_hash", "words", "doc_id"))):
            if size >= SHARD_WORDS and key != shard[-1][0]:
                yield flush()
                shard, size = [], 0
            shard.append((key, h, text.split(" "), doc))
            size += len(shard[-1][2])
    if shard:
        yield flush()


def repeated_regions(docs: DataFrame) -> DataFrame:
    """``(of_id, of_hash, repeats)`` of each text with repeated regions: their places (``first, n``, in windows) and
    ``earlier``, the windows of the region that repeat (null for all).  ``docs`` have ``doc_id, text_hash, text``."""
    rows = docs.filter("doc_id is not null and text is not null")
    # Tables with several readers are written, so that they are computed once.
    keys, keys_path = _written(_document_keys(rows.select("doc_id", "text")))
    shared = (
        keys.groupBy("key")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        .filter("low < high")
        .select("key", (F.col("n") > HOT_DOCUMENTS).alias("is_hot"))
    )
    listed = (
        keys.join(shared, "key")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
        .withColumnRenamed("doc_id", "listed_id")
    )
    keyed = rows.join(listed, F.col("doc_id") == F.col("listed_id")).select("doc_id", "text_hash", "text", "keys", "hot")
    occurrences, _ = _written(_occurrences(keyed))
    delete_path(docs.sparkSession, keys_path)
    # One place of the smallest document; the three columns follow the same comparisons, so they are of one row.
    place = [F.min_by(c, "doc_id").alias(c) for c in ("text_hash", "first", "n")]
    firsts, _ = _written(occurrences.groupBy("key", "words_hash").agg(F.min("doc_id").alias("first_doc"), *place))
    # A key with one region only needs no automaton: its windows begin in the region's first document.
    mixed = firsts.groupBy("key").agg(F.count("*").alias("regions")).filter("regions > 1").select("key")
    wanted = (
        firsts.join(mixed, "key")
        .groupBy(F.col("first_doc").alias("of_id"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_list(F.struct("key", "words_hash", "first", "n")).alias("wanted"))
    )
    holders = rows.join(wanted, (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select("doc_id", "text", "wanted")
    reference, _ = _written(_texts(holders))
    judged = (
        reference.repartition(_shuffle_partitions(docs), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_stream_shards, "key long, words_hash long, earlier array<int>")
        .filter(F.size("earlier") > 0)
    )
    later = F.col("first_doc") < F.col("doc_id")
    return (
        occurrences.join(firsts.select("key", "words_hash", "first_doc"), ["key", "words_hash"])
        .join(judged.dropDuplicates(["key", "words_hash"]), ["key", "words_hash"], "left")
        .filter(later | F.col("earlier").isNotNull())
        .groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_list(F.struct("first", "n", F.when(~later, F.col("earlier")).alias("earlier"))).alias("repeats"))
    )


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, which cuts its lineage, and the table's path.

    Once the table is there, the shuffle files behind it are of no use; Spark is asked to remove
    them with the write.
    """
    spark = df.sparkSession
    path = shared_path(spark, "substrings")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path), path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Repeats:
    """The repeated regions of the rows of a batch."""

    def __init__(self, column: pa.Array):
        flat, self.at = _lists(column)
        self.first, self.n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "n"))
        earlier = flat.field("earlier")
        self.whole = np.asarray(earlier.is_null())
        self.earlier, self.start = _lists(earlier)
        self.earlier = self.earlier.to_numpy(zero_copy_only=False)

    def covered(self, row: int, n_words: int) -> np.ndarray:
        """True for each word of a row's text that a repeated window covers."""
        own = slice(self.at[row], self.at[row + 1])
        first, n, whole = self.first[own], self.n[own], self.whole[own]
        some = np.flatnonzero(~whole)
        windows = [self.earlier[self.start[r] : self.start[r + 1]] + f for r, f in zip((some + own.start).tolist(), first[some].tolist())]
        single = np.concatenate(windows).astype(np.int64) if windows else np.zeros(0, np.int64)
        begin = np.concatenate([first[whole], single])
        end = np.concatenate([(first + n)[whole], single + 1]) + WINDOW - 1
        edge = np.bincount(begin, minlength=n_words + 1) - np.bincount(end, minlength=n_words + 1)
        return np.cumsum(edge[:n_words]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for each row of ``docs(doc_id, text)``; ``kept`` has the
    remaining words joined by one blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = repeated_regions(rows)
    joined = rows.join(found, (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            repeats, removed, kept, sizes = _Repeats(batch["repeats"]), [], [], []
            for row, x in enumerate(batch["text"]):
                found = words(x.as_py() or "")
                sizes.append(len(found))
                if repeats.at[row] < repeats.at[row + 1]:
                    found = list(compress(found, ~repeats.covered(row, len(found))))
                removed.append(sizes[-1] - len(found))
                kept.append(" ".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "repeats").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
