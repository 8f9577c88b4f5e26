import numpy as np
import pytest

WORDS = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(np.array(WORDS)[r.integers(0, len(WORDS), n)])


@pytest.fixture(scope="session")
def frame(spark):
    """documents from [(id, text)], with names that clash with internal ones."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string")
        df = df.withColumn("lang", F.lit("en")).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
        for name in ("fp", "th", "h", "size", "bucket", "kind", "copies", "__copies", "__text", "n_words", "kept", "base", "node", "root", "cls"):
            df = df.withColumn(name, F.lit(7))
        return df

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in any column, empty and blank texts, ties, repeated rows, one very long text."""
    return frame([(1, None), (None, "one two three"), (2, ""), (3, " \t\n "), (4, "tie a b c"), (5, "tie a b c"), (6, "same row"), (6, "same row"), (None, None), (7, prose(1, 120_000)), (8, "x" * 100_000), (9, "\x1c 　 é")])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
