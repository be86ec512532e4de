import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Texts that break careless code: null, empty, blanks, control and wide characters, marks of special tokens, one very long.
ODD = [
    None,
    "",
    " ",
    "  \n\t ",
    "a",
    "a  b ",
    " ▁lead▁ing  marks▁",
    "é colé İstanbul ﬁn 你好 😀😀 x y　z w",
    "tabs\tand\r\nlines\x0b\x0c\x00\x1c\x85.",
    "<s> <|endoftext|> <|ENDOFTEXT|>x</s> <0x41>",
    "it's DON'T we'll... A1b2C3 ,, . ,x",
    "word " * 30_000,
    "x" * 70_000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd text, a repeated row, and null ids; the other columns are null."""
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(4, "a", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables where the queries look for them; returns the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
