from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, found string, row string"


def rows(texts, source="s0"):
    """Documents with columns whose names operators use themselves."""
    return [(i, t, "en", source, len(t or ""), -1, -1.0, "f", "r") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows and texts, a null key, several scripts."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma,", "delta!", "naïve", "ÜBER", "12", "don't", "  ", "\n", "x\ty", "é", "日本語", "🙂🙂", "I'll", "a1b2"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts = [None, "", "   \n\t ", "one", "two words", "three words here", "three words here", long, "<|endoftext|> and <|startoftext|>.", "İstanbul ẞ ǅ", "\x1c\x85  end", "tail  \n\n x"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    data = rows(enumerate(texts)) + rows([(3, "one"), (3, "one"), (None, "no key"), (None, None)])
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a data folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
