"""Small hostile tables shared by the tests of the training-data operators."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank string, n bigint"
LONG = "Anna wrote that the long road went on and on without an end. " * 4000


def documents(spark, texts, partitions=3):
    """Documents with clashing extra columns; a text may be null."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def hostile(spark):
    """Nulls everywhere, empty and very long texts, repeated rows."""
    rows = [
        (None, None, None, None, None, None, None, None),
        (None, "null id", None, None, None, None, None, None),
        (1, None, None, None, None, None, None, None),
        (2, "", None, None, None, None, None, None),
        (3, "a", None, None, None, None, None, None),
        (4, LONG, None, None, None, None, None, None),
        (5, "same row", None, None, None, None, None, None),
        (5, "same row", None, None, None, None, None, None),
        (6, "  \n\t é́ \U0001f600 中文 ", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
