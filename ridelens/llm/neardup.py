"""N-gram Jaccard join by MinHash banding.

A document's n-gram set holds the hashes of its five-word shingles.  Documents with equal sets
are one class, whose smallest doc_id represents it.  Representatives meet where the MinHash values of
one band agree; the number of bands follows from the similarity and the target recall.  Every band bucket
links its members to its smallest one only, so a bucket gives as many rows as it has members, and the
connected groups of these links hold every pair that shares a bucket.  Inside a group, blocks of
documents are compared on their full n-gram sets: a pair is a link if the exact Jaccard similarity
reaches the threshold.  Links are counted where they are found and never written out, and what leaves a
block is the count of each document and a spanning forest of the links.

A group of several blocks is not compared text by text.  Its core is the set of shingles that more than half
of its documents hold, at most twice as many as a document has on average.  A document becomes its difference from
the core, and the symmetric difference of two documents is that of their differences.  Documents so near the core that
any two of them must be links are only counted.  The others (far ones) meet all documents of their group whose number of
shingles allows a link, as pairs of blocks of differences, each a task of its own.

Defined cases.  Null text or text without words: empty set; such a document is alone in its class
and has no links.  One to four words: one shingle, all the words.  Of rows that repeat a doc_id, the one
whose text has the smallest hash counts.  Null doc_id: the row is left out.  Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, ensure_checkpoint_dir, shared_path
from .common import SHINGLE_WORDS, WordHashes, mix, shingle_set, sliced

THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
BLOCK_DOCUMENTS = 1000
BLOCK_SHINGLES = 600_000
SALTS = 256
SEED = 29

_FOUND = "doc_id long, links long, a long, b long"


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values with which a pair at ``threshold`` collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Signer:
    """Band keys of an n-gram set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.Generator(np.random.Philox(SEED))
        n = bands * rows
        self.bands, self.rows = bands, rows
        self._a = (rng.integers(0, 2**32, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self._b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self._a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 512):
            part = grams[at : at + 512, None] * self._a + self._b
            low = np.minimum(low, (part >> np.uint64(20)).min(axis=0))
        key = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[r :: self.rows])
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(doc_id, text_hash, size, digest, keys)`` of each row: size and digest of its n-gram set, and a key
    for each band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, signer = WordHashes(), Signer(bands, rows)
        for batch in sliced(batches):
            sizes, digests, keys = [], [], []
            for x in batch["text"]:
                grams = shingle_set(hashes.of(hashes.words(x.as_py())))
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                keys.append(signer.keys(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "size", "digest", "keys"],
            )

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(sign, "doc_id long, text_hash long, size long, digest binary, keys array<long>")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)``: the smallest node of each node's connected group, for edges ``(a, b)``.

    Alternates "large star" and "small star" steps, each a grouping with sums of the smallest
    neighbour, until nothing changes.  Every round ends in a table in shared storage, which goes once the next round has
    written its own, and whose small files are read in few tasks; the result is a reliable checkpoint.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    paths: list[str] = []

    def staged(rows: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "components"))
        rows.write.parquet(paths[-1])
        for path in paths[:-1]:
            discard(spark, path)
            paths.remove(path)
        return spark.read.schema(rows.schema).parquet(paths[-1])

    def pair(a: str, b: str) -> F.Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    try:
        edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before = None
        for _ in range(most_rounds):
            both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
            low = _with_totals(both, ["a"], [F.min("b").alias("m")], [F.min("m").alias("m")], of="b").withColumn("m", F.least("a", "m"))
            # A node's own pair comes once: from the row of its smallest neighbour.
            larger, own = F.when(F.col("b") > F.col("a"), pair("b", "m")), F.when((F.col("m") < F.col("a")) & (F.col("b") == F.col("m")), pair("a", "m"))
            large = low.select(F.inline(F.array(larger, own))).filter("a <> b")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.inline(F.array(pair("b", "m"), pair("a", "m"))))
            edges = staged(small.filter("a <> b").distinct())
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError("the connected groups did not settle")
        edges = edges.checkpoint()
    finally:
        for path in paths:
            discard(spark, path)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _shared(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the sets before ``first`` with those from there on (all with all
    if ``first`` is 0), from a matrix of common shingles, a bounded number of shingles at a time."""
    n = len(sets)
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    df = np.bincount(at, minlength=len(grams))
    split = first or n
    shared = np.zeros((split, n - first if first else n), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    # Rare shingles: pairs of neighbours in the sorted list, once for each distance.
    few = df[at] <= 8
    a, o = at[few], owner[few]
    for distance in range(1, 8):
        same = a[distance:] == a[:-distance]
        i, j = o[:-distance][same], o[distance:][same]
        if first:
            cross = (i < first) & (j >= first)
            i, j = i[cross], j[cross] - first
            np.add.at(shared, (i, j), 1)
        else:
            np.add.at(shared, (i, j), 1)
            np.add.at(shared, (j, i), 1)
    # Frequent ones: products of small dense matrices.
    many = np.flatnonzero(df > 8)
    rank = np.full(len(grams), -1)
    rank[many] = np.arange(len(many))
    r = rank[at]
    for start in range(0, len(many), 4096):
        here = (r >= start) & (r < start + 4096)
        dense = np.zeros((n, min(4096, len(many) - start)), np.float32)
        dense[owner[here], r[here] - start] = 1
        shared += dense[:split] @ (dense[first:].T if first else dense.T)
    return shared


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, a symmetric matrix."""
    unseen, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not unseen[start]:
            continue
        unseen[start], todo = False, [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & unseen)
            unseen[new] = False
            out += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    return out


def _found(ids: np.ndarray, copies: np.ndarray, linked: np.ndarray, first: int) -> pd.DataFrame:
    """Counts and spanning forest of a block (``first`` 0: all with all), or of the documents before
    ``first`` with the others."""
    if first:
        counts = np.concatenate([linked @ copies[first:], linked.T @ copies[:first]])
        both = np.zeros((len(ids), len(ids)), bool)
        both[:first, first:], both[first:, :first] = linked, linked.T
    else:
        np.fill_diagonal(linked, False)
        counts, both = linked @ copies, linked
    tree = np.array(_forest(both), np.int64).reshape(-1, 2)
    has = counts > 0
    out = pd.DataFrame({"doc_id": ids[has], "links": counts[has].astype(np.int64), "a": -1, "b": -1})
    edges = pd.DataFrame({"doc_id": -1, "links": 0, "a": ids[tree.max(axis=1)], "b": ids[tree.min(axis=1)]})
    return pd.concat([out, edges]).astype("int64")


def _with_totals(rows: DataFrame, keys: list[str], parts: list, totals: list, of: str = "doc_id") -> DataFrame:
    """``rows`` with ``totals`` over ``parts`` of their keys (null for null keys).  Both are dealt by the keys and a salt
    from the column ``of``, so a hot key is the work of many tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(SALTS)))
    merged = salted.groupBy(*keys, "salt").agg(*parts).groupBy(*keys).agg(*totals, F.collect_list("salt").alias("salts"))
    return salted.join(merged.withColumn("salt", F.explode("salts")).drop("salts"), [*keys, "salt"], "left").drop("salt")


def _blocks(documents: str, shingles: str) -> F.Column:
    return F.greatest(F.ceil(F.col(documents) / BLOCK_DOCUMENTS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _inside_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of groups of one block, ``rows`` of ``(root, doc_id, copies, text)``."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        pdf = pdf.sort_values("doc_id").drop_duplicates(["doc_id"])
        sets = [shingle_set(hashes.of(hashes.words(t))) for t in pdf["text"]]
        size = np.array([len(s) for s in sets], np.float64)
        shared = _shared(sets, 0).astype(np.float64)
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        return _found(pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy(), linked, 0)

    return rows.select("root", "doc_id", "copies", "text").groupBy("root").applyInPandas(compare, _FOUND)


def _differences(rows: DataFrame, threshold: float) -> DataFrame:
    """``(root, doc_id, copies, size, bin, far, differs)`` of the documents of groups of several blocks, ``rows`` of
    ``(root, doc_id, copies, n, blocks, text)``: the shingles in which a document and its group's core differ, whether they are too many
    for a link with every near one, and a bin of sizes (links are in the same or in neighbouring bins)."""
    step = max(math.log(1 / threshold) * (1 + 1e-6), 1e-6)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(hashes.of(hashes.words(x.as_py()))).view(np.int64) for x in batch["text"]]
            columns = [batch[c] for c in ("root", "doc_id", "copies", "n", "blocks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.list_(pa.int64()))], ["root", "doc_id", "copies", "n", "blocks", "grams"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bins, far, differs = [], [], [], []
            for grams, core in zip(batch["grams"], batch["core"]):
                own = grams.values.to_numpy()
                diff = np.setxor1d(own, core.values.to_numpy(), assume_unique=True) if core.is_valid else own
                sizes.append(len(own))
                bins.append(int(math.log(len(own)) / step))
                far.append(len(diff) * (1 + threshold) > len(own) * (1 - threshold))
                differs.append(diff)
            columns = [batch["root"], batch["doc_id"], batch["copies"], pa.array(sizes, pa.int64()), pa.array(bins, pa.int64())]
            columns += [pa.array(far, pa.bool_()), pa.array(differs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["root", "doc_id", "copies", "size", "bin", "far", "differs"])

    # Equal rows of one doc_id are one; the join before has dealt the rows by doc_id and text_hash.
    one = rows.groupBy("doc_id", "text_hash").agg(*[F.first(c).alias(c) for c in ("root", "copies", "n", "blocks", "text")])
    sets = one.select("root", "doc_id", "copies", "n", "blocks", "text").mapInArrow(shingle, "root long, doc_id long, copies long, n long, blocks int, grams array<long>").checkpoint()
    held = sets.select("root", "n", "blocks", F.explode("grams").alias("gram")).groupBy("root", "gram")
    frequent = held.agg(F.count("*").alias("holders"), F.first("n").alias("n"), F.first("blocks").alias("blocks")).filter("2 * holders > n")
    cores = frequent.groupBy("root").agg(F.collect_list("gram").alias("core"), F.first("blocks").alias("blocks"))
    # A copy of the core for each block of the group.
    cores = cores.select("root", "core", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    joined = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).join(cores, ["root", "salt"], "left")
    return joined.select("root", "doc_id", "copies", "grams", "core").mapInArrow(
        differ, "root long, doc_id long, copies long, size long, bin long, far boolean, differs array<long>"
    ).checkpoint()


def _near_core(rows: DataFrame) -> DataFrame:
    """Links among the documents near the core of their group: each with each, so they are counted."""
    near = _with_totals(
        rows.filter("not far").select("root", "doc_id", "copies"),
        ["root"],
        [F.sum("copies").alias("weight"), F.min("doc_id").alias("hub")],
        [F.sum("weight").alias("weight"), F.min("hub").alias("hub")],
    )
    none = F.lit(-1).cast("long")
    counts = near.select("doc_id", (F.col("weight") - F.col("copies")).alias("links"), none.alias("a"), none.alias("b")).filter("links > 0")
    edges = near.filter("doc_id <> hub").select(none.alias("doc_id"), F.lit(0).cast("long").alias("links"), F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return counts.unionByName(edges)


def _far_from_core(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of the far documents with each other and with the near ones."""
    kind = ["root", "bin", "far"]
    dealt = _with_totals(
        rows,
        kind,
        [F.count("*").alias("m"), F.sum(F.size("differs")).alias("e")],
        [F.sum("m").alias("m"), F.sum("e").alias("e")],
    ).withColumn("units", _blocks("m", "e"))
    name = F.shiftleft(F.col("bin") * 2 + F.col("far").cast("long"), 32)
    dealt = dealt.withColumn("unit", name + F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("units")))
    units = dealt.groupBy("root", "unit").agg(F.first("bin").alias("bin"), F.first("far").alias("far"))
    far = units.filter("far").select("root", F.col("unit").alias("x"), F.explode(F.expr("sequence(bin - 1, bin + 1)")).alias("bin"))
    pairs = far.join(units, ["root", "bin"]).filter("not far or x <= unit").select("root", "x", F.col("unit").alias("y"))
    roles = pairs.withColumn("unit", F.explode(F.array_distinct(F.array("x", "y"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        pdf = pd.concat([part.sort_values("doc_id") for part in (pdf[pdf["unit"] == x], pdf[pdf["unit"] != x])])
        first = 0 if x == y else int((pdf["unit"] == x).sum())
        sets = [np.asarray(d, np.int64) for d in pdf["differs"]]
        size, n = pdf["size"].to_numpy(np.float64), np.array([len(s) for s in sets], np.float64)
        left, right = (slice(None, first), slice(first, None)) if first else (slice(None), slice(None))
        apart = n[left][:, None] + n[right][None, :] - 2 * _shared(sets, first)
        together = size[left][:, None] + size[right][None, :]
        shared = (together - apart) / 2
        linked = shared >= threshold * (together - shared) - 1e-9
        return _found(pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy(), linked, first)

    paired = dealt.select("root", "unit", "doc_id", "copies", "size", "differs").join(roles, ["root", "unit"])
    return paired.groupBy("root", "x", "y").applyInPandas(compare, _FOUND)


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, counts, forest)``: each document's class, the links of each class representative
    with other classes (weighted by their members), and the spanning forest of those links."""
    ensure_checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    signed = signatures(docs, bands_for(threshold, recall, rows), rows).checkpoint()
    own = signed.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.min_by(F.struct("digest", "size"), "text_hash").alias("set"))
    own = own.select("doc_id", "text_hash", "set.digest", "set.size")
    classes = _with_totals(
        own,
        ["digest"],
        [F.min("doc_id").alias("rep"), F.count("*").alias("copies")],
        [F.min("rep").alias("rep"), F.sum("copies").alias("copies")],
    )
    members = classes.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), "text_hash", "size").checkpoint()
    reps = members.filter("doc_id = rep").select("doc_id", "copies", "text_hash", "size")
    keyed = signed.filter("digest is not null").join(reps.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").select("key", "hub")
    near = components(keyed.join(hubs, "key").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))

    placed = _with_totals(
        near.join(reps, F.col("node") == F.col("doc_id")).select("root", "doc_id", "copies", "text_hash", "size"),
        ["root"],
        [F.count("*").alias("n"), F.sum("size").alias("shingles")],
        [F.sum("n").alias("n"), F.sum("shingles").alias("shingles")],
    )
    placed = placed.select("root", "doc_id", "copies", "text_hash", "n", _blocks("n", "shingles").alias("blocks")).checkpoint()
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    found = _inside_blocks(texts.join(placed.filter("blocks = 1"), ["doc_id", "text_hash"]), threshold)
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        apart = _differences(texts.join(large, ["doc_id", "text_hash"]), threshold)
        found = found.unionByName(_near_core(apart)).unionByName(_far_from_core(apart, threshold))
    found = found.checkpoint()
    counts = found.filter("links > 0").groupBy("doc_id").agg(F.sum("links").alias("links"))
    return members.select("doc_id", "rep", "copies"), counts, found.filter("links = 0").select("a", "b")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row for each doc_id: ``(doc_id, copy_of, class_id, n_links)``.

    ``copy_of`` is the smallest document with the same n-gram set, ``class_id`` the smallest document of
    the group that links connect, ``n_links`` the number of other documents at ``threshold`` or
    more, copies among them.
    """
    members, counts, forest = links(docs, threshold, recall, rows)
    groups = components(forest)
    return (
        members.join(counts.withColumnRenamed("doc_id", "c"), F.col("rep") == F.col("c"), "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id",
            F.col("rep").alias("copy_of"),
            F.coalesce("root", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that of its smallest doc_id.

    Of equal texts with the same doc_id, or with none, one row stays, by the hash of its columns.  Where a doc_id
    repeats with different texts, the text of the smallest hash is the one that the join judged and that
    may go; the others stay.
    """
    text_hash, of, judged = (_unused(docs, name) for name in ("text_hash", "gone_id", "judged_hash"))
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    first = hashed.groupBy(F.col("doc_id").alias(of)).agg(F.min(text_hash).alias(judged))
    gone = jaccard_join(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias(of)).join(first, of)
    kept = hashed.join(gone, (F.col("doc_id") == F.col(of)) & (F.col(text_hash) == F.col(judged)), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    comparable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = _unused(docs, "row")
    one = kept.groupBy("doc_id", text_hash).agg(F.min_by(F.struct(*columns), F.xxhash64(*comparable)).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def _unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
