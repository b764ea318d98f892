"""Small tables with the awkward cases: nulls everywhere, empty and very long texts, repeated rows, ties, extra columns."""

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, node string, _id long, words int"
LONG = " ".join(f"w{k % 4999}" for k in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60, 1, "s", "n", 7, 0),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 60, None, None, None, None, None),
    (3, "THE quick brown fox jumps over the lazy dog again and again", None, None, None, 1, "s", "n", 7, 0),
    (4, None, None, None, None, None, None, None, None, None),
    (5, "", "en", "a", 0, 0, "", "", 0, 0),
    (6, " \t\n\x0b\x0c\r ", "en", "c", 7, 0, "", "", 0, 0),
    (7, LONG, "de", "a", len(LONG), 0, "", "", 0, 0),
    (8, "x" * 200_000, "de", "a", 200_000, 0, "", "", 0, 0),
    (9, "zwei Wörter\nund eine Zeile\nzwei Wörter", "de", "ü", 40, 0, "", "", 0, 0),
    (9, "zwei Wörter\nund eine Zeile\nzwei Wörter", "de", "ü", 40, 0, "", "", 0, 0),
    (None, "no id here", "en", "a", 10, 0, "", "", 0, 0),
    (None, "no id here", "en", "a", 10, 0, "", "", 0, 0),
    (None, None, None, None, None, None, None, None, None, None),
]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), T._parse_datatype_string("doc_id long, quality int, toxic int"))


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
