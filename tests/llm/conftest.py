import pytest

ODD = [
    None, "", " ", "\n", "a", "short text", "a  b\n\nc\t d", "don't 's stop's x'tis", "naïve 日本語 テスト's €5 a\u0301b", "x" * 3000, "ab" * 2000 + " " + "1" * 500,
    "\x1c odd\x1c space\u3000wide", "<|endoftext|> as text", "word " * 3000, "tie tie tie tie tie tie tie", "tie tie tie tie tie tie tie",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names may clash."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i, "x") for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank string")


@pytest.fixture()
def lake(tmp_path):
    """Writes tables to a folder as the queries expect them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
