"""Small tables with hard rows, for all operators."""

EXTRA = "doc_id long, text string, lang string, score double, key long, root long, n_words long"


def docs(spark, rows):
    """``rows`` of (doc_id, text), with further columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", 1.0, 7, 8, 9) for d, t in rows], EXTRA).repartition(3)


def hard_rows():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no number here"), (5, "x" * 3000), (6, "a b " * 4000)]
