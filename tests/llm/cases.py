"""Awkward tables for the corpus operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, mark long, block long, held_out string, text_ string"

TEXTS = [
    (None, "the cat sat on the mat"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Two words"),
    (6, "the cat sat on the mat"),
    (6, "the cat sat on the mat"),
    (7, "THE  cat\nsat on the mat"),
    (8, "x" * 50_000),
    (9, "lorem ipsum dolor " * 20_000),
    (10, "naïve café — 漢字 🙂 naïve café\x00 \u00a0 end"),
    (-11, "a b a b a b c"),
]


def documents(spark, texts=TEXTS):
    """Rows with nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None, "s", None, 9, 0.5, 1, None, "x", None) for i, t in texts], SCHEMA)


def empty(spark):
    return documents(spark, []) if False else spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, label string")
