import random
import re

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {row["doc_id"]: row["text"] for row in documents.collect()}


def prose(seed, words):
    draw = random.Random(seed)
    stock = "the of and tree river stone walks over under quick brown fox lazy dog émigré straße niño with house".split()
    return " ".join(draw.choice(stock) + (str(draw.randrange(50)) if draw.random() < 0.2 else "") for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, repeated rows, null ids, a very long text, and columns with names the operators use."""
    long = prose(7, 30_000)
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, prose(3, 60), "en"),
        (3, prose(3, 60), "en"),
        (None, prose(4, 60), None),
        (None, None, "de"),
        (5, " \n\t \n", "en"),
        (6, long, "en"),
        (7, long + " end", "en"),
        (8, "1234567890 !!! ???", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = "kept label rep bucket spans rank bin text_hash row token _hits n_words score".split()
    return frame.select("*", *[F.lit("x").alias(name) for name in clashing]).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
