"""Edge rows that every operator must take, and plain versions of the definitions."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_2 string, score double, node long"


def docs(spark, rows):
    """(doc_id, text[, source]) rows with the other columns of documents and clashing extra ones."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", 1.0, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "a b c d e f g"), (6, LONG),
         (7, "\x00 ▁ é́ \U0001F600\n\n"), (8, "a b c d e f g")]


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.select("doc_id", *columns).collect()}


def empty(frame):
    return frame.where(F.lit(False))
