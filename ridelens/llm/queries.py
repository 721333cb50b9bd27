"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import (
    archives,
    chat,
    codes,
    decontaminate,
    hardneg,
    language,
    licenses,
    neardup,
    oracle,
    pii,
    substrings,
    tokens,
    urls,
    vectors,
)
from .common import delete_path, table

# The URL rules of the registered query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "round_trip", "scan_ok")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, prototypes)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest_neighbours(rows, rows.filter("vec_id % 100 = 0"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) of the whole table are pair k."""
    turns = table(spark, sf_dir, "conversations").select(
        F.shiftright("conv_id", 1).alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text"
    )
    return chat.format_preferences(turns.filter("side = 0"), turns.filter("side = 1"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.default_templates(spark))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = F.lit(codes.books_digest(books)).alias("codebooks_sha256")
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def op12_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC archives of both versions, converted to WARC, and read back."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("source_id"), "url", F.col("html").alias("payload"), (F.pmod(F.hash("url"), F.lit(2)) + 1).alias("version")
    )
    arcs = archives.write_arc(pages, shared_path(spark, "arc", "archives"))
    warcs = archives.convert(spark, arcs, shared_path(spark, "warc"))
    delete_path(spark, arcs)
    records = archives.read_warc(spark, warcs).filter(F.col("record_type").isin("response", "revisit"))
    return records.select(
        F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_source").cast("long").alias("refers_to"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vec_id has a wrong label; every fiftieth is an anchor."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", wrong.alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_sentencepiece,
        op3_language_id,
        op4_personal_data,
        op5_substring_dedup,
        op6_nearest_neighbours,
        op7_preference_format,
        op8_url_filter,
        op9_decontamination,
        op10_license_scan,
        op11_vector_codes,
        op12_archive_converter,
        op13_hard_negatives,
    )
}
#: Tests hold the other queries against brute force, exact round trips or held-out labels.
ORACLE_SQL_BY_QUERY = {
    "op1_ngram_jaccard_join": oracle.JACCARD_JOIN,
    "op5_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op7_preference_format": oracle.PREFERENCE_FORMAT,
    "op8_url_filter": oracle.URL_FILTER,
    "op10_license_scan": oracle.LICENSE_SCAN,
    "op11_vector_codes": oracle.VECTOR_CODES,
    "op12_archive_converter": oracle.ARCHIVES,
    "op13_hard_negatives": oracle.HARD_NEGATIVES,
}
