"""Small tables with the awkward cases, and the word definition in plain Python."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside; a table may have them as columns of its own.
CLASHING = ("id", "fp", "component", "size", "rate", "word", "n", "h", "u", "v", "key", "text_hash", "score", "lang_pred", "_print0", "row", "total")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward_rows(seed=1):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß漢𝄞", k=rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: rng.choice(["", " ", "\n"]) + "".join(
        rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \x0b\n", ". ", " "]) for _ in range(n)
    )
    rows = [(i, text(rng.choice([1, 3, 40, 200])), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, " \n\t ", "en", "a", 3), (None, "one two three", "en", None, 1)]
    rows += [(63, text(30000), "en", "b", 1), (64, "word " * 5000, "en", "b", 1), (65, "x" * 50000, None, "c", 1)]
    rows += [rows[0], rows[0], (66, rows[1][1], "en", "a", 1), (67, rows[2][1].upper(), "en", "a", 1), (None, None, None, None, None)]
    return rows


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
