import random

import pytest
from pyspark.sql import functions as F
from tests_llm_common import sentence

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs, empty, blank and very long texts, repeated rows, an id
    with two texts, and columns whose names the operators use themselves."""
    rng = random.Random(4)
    long_text = sentence(rng, 30_000)
    rows = [
        (1, sentence(rng, 30), "en"),
        (1, sentence(rng, 30), "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "de"),
        (5, long_text, "en"),
        (6, long_text, "de"),
        (7, "12 34 !!", "en"),
        (8, "one", None),
        (8, "one", None),
        (None, "a text without an id", "en"),
        (None, None, None),
        (9, "Ünïcödé ▁ \U0001f600   　x", "de"),
        (10, "tail  ", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    clashing = ["score", "node", "token", "_id", "bucket", "label", "text_hash", "_text", "fold", "n", "at", "entry", "rank", "Text_", "key", "curve"]
    return df.withColumns({c: F.lit(c) for c in clashing}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
