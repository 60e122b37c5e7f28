"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int) -> str:
    parts = [rng.choice("ba ce di fo gu ha je ki lo mu na pe ri so tu".split()) for _ in range(words * 3)]
    return " ".join("".join(parts[i : i + 3]) for i in range(0, len(parts), 3))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(7)
    long = prose(rng, 60_000)
    rows = [
        (1, "One short line.\nAnd another one that is a little longer than the first.", "en", "a", 10, "x", 1),
        (1, "One short line.\nAnd another one that is a little longer than the first.", "en", "a", 10, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "", 0),
        (None, "A text without an id, which is rare but does happen now and then.", "en", None, 5, "y", 2),
        (None, "A text without an id, which is rare but does happen now and then.", "en", None, 5, "y", 2),
        (None, None, None, None, None, None, None),
        (4, " \n\t \r\n", "en", "b", 6, "z", 3),
        (5, long, "en", "b", len(long), "z", 4),
        (6, long + " end", "en", "b", len(long), "z", 4),
        (7, "x" * 200_000, "en", "b", 200_000, "z", 4),
        (8, "1" * 50_000 + "a@" * 20_000 + "+1 " * 10_000, "en", "c", 1, "z", 4),
        (9, "\U0001f600 é́ ß   <|endoftext|> \x00 end", "en", "c", 1, "z", 4),
    ]
    return spark.createDataFrame(rows, DOCUMENT + ", score string, slots long")
