"""URL filters by host-suffix and path-prefix rules.

Each URL is expanded into expressions (a suffix of its host's labels, a prefix of its
path), but only in the shapes (number of labels, path length) that some rule has, so the
expansion is exact without an expression for each character.  Expressions meet the rules
in an equi-join on the first digits of their digest; the whole digest confirms a hit and
the longest rule wins.

Defined cases.  Null URL or no ``://``: host and path are empty and no rule fits.  Repeated
pages: one row each.  Equal rule length: the longer host, then the greater host, path
and verdict (``block`` over ``allow``).  No rules or no pages: verdict ``default`` or no
rows.  Rules with a null host or path are ignored.  Other columns of either table are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast

PREFIX_DIGITS = 8  # hexadecimal digits of a digest that the join compares


def url_host(url: Column) -> Column:
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains when the URL's path
    starts with the rule's path.  The distinct rule shapes go to the driver; there are at
    most (labels of the deepest rule) x (length of the longest path) of them.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    shapes = [
        (int(r[0]), int(r[1]))
        for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()
    ]
    judged = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    shape = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("n")) for d, n in sorted(shapes)])
    fitting = F.filter(shape, lambda s: (s["d"] <= F.size(labels)) & (s["n"] <= F.length("path")))
    expressions = judged.select("host", "path").distinct().select(
        "host",
        "path",
        F.explode(
            F.transform(
                fitting,
                lambda s: _digest(
                    F.array_join(F.slice(labels, -s["d"], s["d"]), "."), F.substring(F.col("path"), F.lit(1), s["n"])
                ),
            )
        ).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    listed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"),
            F.length("host").alias("n_host"),
            F.col("host").alias("rule_host"),
            F.col("path").alias("rule_path"),
            "verdict",
        ).alias("hit"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    best = (
        expressions.join(checked_broadcast(listed), "prefix")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max("hit").alias("hit"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.concat("hit.rule_host", "hit.rule_path").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
