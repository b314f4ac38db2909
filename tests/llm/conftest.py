import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that was it for with as his on be at by had not but from they which she or we an were".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split()
FR = "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec".split()
ES = "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(words) + rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, wordless and long texts, repeats and ties."""
    rng = random.Random(1)
    long = prose(rng, EN, 6000)
    base = prose(rng, EN, 80)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.upper(), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", "en", "b", 0), (None, base, "en", None, 5),
        (7, "one", "fr", "c", 3), (8, "one two", "fr", "c", 7), (9, long, "en", "c", len(long)), (10, long + " tail", "en", "d", 1), (11, "é" * 300, "fr", "d", 300), (11, "é" * 300, "fr", "d", 300),
        (12, "naïve token=abcdef1 x", "fr", "e", 1), (13, "<|endoftext|> 12 it's  two\n\nlines\r\n", "en", "e", 2), (14, "a  b ć d", None, "e", 2),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """odd_rows with further columns whose names clash with results."""
    from pyspark.sql import functions as F

    names = ("id", "fp", "component", "size", "target", "taken", "rank", "range", "words", "kept", "base", "weak", "length", "piece", "score")
    return spark.createDataFrame(odd_rows, DOCS).select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
