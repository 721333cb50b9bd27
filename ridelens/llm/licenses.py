"""License scans with DataFrame functions only.

Texts and templates become lower-case words (runs of letters and digits) and hashes of
five-word shingles.  Templates are cut into sections of at most ``SECTION`` shingles.  For
each section size, overlapping windows of the text are laid out so that every occurrence
lies whole inside one of them; the band count follows from the least Jaccard similarity
that such a window can have, so that a section collides in one band at least with
probability ``RECALL``.  A text that holds the share ``CONTAINMENT`` of a template holds that share of one
section at least, so its template is retrieved; then all distinct shingles of the template are
counted in the whole text, so the containment is exact.

Defined cases.  Null or empty text: no license.  Text or template of one to four words: one
shingle, all its words; templates without words are ignored.  Repeated documents: one row
each, with the greatest containment
of its texts; a null doc_id is a doc_id like others.  Ties between templates: all are reported.  Other columns are ignored.
"""

from __future__ import annotations

import math
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SECTION = 8
BLOCK = 32
CONTAINMENT = 0.8
RECALL = 0.999
BROADCAST_SHINGLES = 1_000_000  # of all templates, with repeats; beyond, the join shuffles

# License notice lines to scan for.  The license texts beside them are in license_texts/.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """The notice lines, and the license texts as ``<name> text``."""
    files = sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name)
    texts = [(f.name.removesuffix(".txt") + " text", f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]
    return spark.createDataFrame(TEMPLATES + texts, "license string, text string")


def layout(size: int, containment: float = CONTAINMENT, recall: float = RECALL) -> tuple[int, int, int]:
    """(window, stride, bands) in shingles for sections of ``size`` shingles.

    Whole agreement (``need == size``) takes windows of the section's own size at every
    position, where the similarity is 1 and one band is certain.  Larger sections take
    windows of half as much again; their least similarity gives the number of bands.
    """
    need = math.ceil(containment * size - 1e-9)
    if need == size:
        return size, 1, 1
    window = size + size // 2
    least = need / (window + size - need)
    return window, window - size + 1, math.ceil(math.log(1 - recall) / math.log(1 - least))


def shingles(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    # Bound to a variable of a lambda, so that the split runs once and not for each shingle.
    return F.get(F.transform(F.array(words), _shingles_of), F.lit(0))


def _shingles_of(words: Column) -> Column:
    n = F.size(words)
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < SHINGLE, F.array(F.xxhash64(words)))
        .otherwise(F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))
    )


def _min_hash(sh: Column, at: Column, window: int, band: Column) -> Column:
    """Key of one band of the window of ``sh`` from ``at``; beyond the end its first shingle stands in,
    which leaves the set as it is."""
    first = F.get(sh, at)
    hashes = [F.xxhash64(F.coalesce(F.get(sh, at + o), first) if o else first, band) for o in range(window)]
    return F.least(*hashes) if window > 1 else hashes[0]


def _probes(sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """(probe number, size, window, stride) for each band of each section size."""
    out = []
    for size in sizes:
        window, stride, bands = layout(size)
        out += [(len(out) + b, size, window, stride) for b in range(bands)]
    return out


def _band_keys(rows: DataFrame, probes: list, at: Column, only_size: Column | None = None) -> DataFrame:
    """One row for each probe that applies at ``at``, with its number and key."""
    groups: dict[tuple, list[int]] = {}
    for number, size, window, stride in probes:
        groups.setdefault((size, window, stride), []).append(number)
    numbers = None
    for (size, _, stride), own in groups.items():
        here = (only_size == size) if only_size is not None else (F.col("start") % stride == 0)
        part = F.when(here, F.array(*[F.lit(x) for x in own])).otherwise(F.array().cast("array<int>"))
        numbers = part if numbers is None else F.concat(numbers, part)
    out = rows.select("*", F.explode_outer(numbers).alias("probe")).filter(F.col("probe").isNotNull())
    # One branch for each group, and none that can be null, which would make the join test the keys first.
    values = [
        (max(own), _min_hash(F.col("sh"), at, size if only_size is not None else window, F.col("probe")))
        for (size, window, _), own in groups.items()
    ]
    key = values[-1][1]
    for most, value in values[-2::-1]:
        key = F.when(F.col("probe") <= most, value).otherwise(key)
    return out.withColumn("key", key)


def _positions(docs: DataFrame, window: int) -> DataFrame:
    """One row for each shingle of a text: ``sh`` is a short piece of the text's shingles, ``at``
    the shingle's place in it and ``start`` its place in the text.  Pieces of ``BLOCK`` shingles with
    room on both sides keep the rows short, however long the text is.  (The outer forms spare the
    filter that Spark infers from the plain ones, which would evaluate their arrays twice.)"""
    after = window + SECTION
    pieces = F.transform(
        F.when(F.size("all") > 0, F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda base: F.struct(
            base.alias("base"),
            F.least(base, F.lit(SECTION)).alias("before"),
            F.slice("all", F.greatest(base - SECTION, F.lit(0)) + 1, F.least(base, F.lit(SECTION)) + BLOCK + after).alias("sh"),
        ),
    )
    n = F.least(F.lit(BLOCK), F.size("sh") - F.col("before"))
    return (
        docs.select("doc_id", shingles(F.col("text")).alias("all"))
        .select("doc_id", F.inline_outer(pieces))
        .filter(F.col("base").isNotNull())
        .select("doc_id", "sh", "base", "before", F.explode_outer(F.sequence(F.lit(0), n - 1)).alias("i"))
        .select("doc_id", "sh", (F.col("before") + F.col("i")).alias("at"), (F.col("base") + F.col("i")).alias("start"))
    )


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, licenses, containment)`` for each row of ``docs(doc_id, text)``.

    ``licenses`` is the sorted array of template names found, ``containment`` the array of
    their greatest containments.  The sections of ``templates(license, text)`` are broadcast if their
    counted shingles are at most ``BROADCAST_SHINGLES``.  Only the counts of the section sizes in use
    (1 to ``SECTION``) are read by the driver.
    """
    # Four full sections and more hold the share by themselves, whatever the rest holds.
    n = F.size("all")
    sections = F.when(n >= 4 * SECTION, F.floor(n / SECTION)).otherwise(F.ceil(n / SECTION)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), sections - 1), lambda i: F.struct(F.slice("all", i * SECTION + 1, SECTION).alias("sh")))
    whole = templates.select("license", F.array_distinct(shingles(F.col("text"))).alias("all")).filter(F.size("all") > 0)
    # Dealt out, so that the sections read the shingles and don't make them anew, each for itself.
    whole = whole.repartition("license")
    listed = whole.select("license", F.inline(cut)).withColumn("size", F.size("sh"))
    counted = listed.groupBy("size").agg(F.sum("size").alias("n")).collect()
    sizes = sorted(int(r["size"]) for r in counted)
    ids = docs.select("doc_id")
    if not sizes:
        return ids.select("doc_id", F.array().cast("array<string>").alias("licenses"), F.array().cast("array<double>").alias("containment"))
    probes = _probes(sizes)
    wanted = _band_keys(listed, probes, F.lit(0), F.col("size")).select(F.col("key").alias("wanted_key"), "license").distinct()
    wanted_whole = whole.select(F.col("license").alias("of"), F.col("all").alias("template"))
    if sum(r["n"] for r in counted) <= BROADCAST_SHINGLES:
        wanted, wanted_whole = F.broadcast(wanted), F.broadcast(wanted_whole)
    # The probe's number is hashed into the key, so one long is the whole join key.
    keyed = _band_keys(_positions(docs, max(layout(x)[0] for x in sizes)), probes, F.col("at"))
    hits = keyed.join(wanted, F.col("key") == F.col("wanted_key"))
    retrieved = hits.select(F.col("doc_id").alias("found_in"), "license").groupBy("found_in").agg(F.collect_set("license").alias("retrieved"))
    found = (
        docs.select("doc_id", "text")
        .join(retrieved, F.col("doc_id").eqNullSafe(F.col("found_in")))
        .select("doc_id", F.array_distinct(shingles(F.col("text"))).alias("all"), "retrieved")
        .select("doc_id", "all", F.explode("retrieved").alias("license"))
        .join(wanted_whole, F.col("license") == F.col("of"))
        .select("doc_id", "license", (F.size(F.array_intersect("all", "template")) / F.size("template")).alias("share"))
        .groupBy("doc_id", "license")
        .agg(F.max("share").alias("share"))
        .filter(F.col("share") >= containment)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("license", "share"))).alias("found"))
    )
    none = F.array().cast("array<struct<license:string,share:double>>")
    return ids.join(found.withColumnRenamed("doc_id", "found_in"), F.col("doc_id").eqNullSafe(F.col("found_in")), "left").select(
        "doc_id",
        F.coalesce("found", none).getField("license").alias("licenses"),
        F.coalesce("found", none).getField("share").alias("containment"),
    )
