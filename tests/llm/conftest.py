import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark, tmp_path):
    """A function that writes rows of (doc_id, text) as a table with extra, clashing columns and reads it again."""

    def make(rows, files=2):
        schema = DOCS + ", w string, rid string, id string, t string, tok string, pos string, __row string, toxicity string, shard string, fp string, tables array<string>"
        data = [(i, t, "en", "s", None, *["x"] * 10, ["x"]) for i, t in rows]
        path = f"{tmp_path}/docs{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(data, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


def long_text(n, word="word"):
    return " ".join(f"{word}{i % 977}" for i in range(n))


#: Nulls, empty and blank texts, repeated rows, repeated ids, a very long text, cases that differ beyond ASCII.
ROWS = [(1, "Alpha beta gamma delta"), (1, "Alpha beta gamma delta"), (2, "ALPHA BETA GAMMA DELTA"), (None, "alpha beta gamma delta"), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, "É é"), (7, "é é"), (8, long_text(60_000)), (9, long_text(60_000)), (9, "other text"), (10, "one"), (11, "漢字 \U0001f600 x\x00y")]


@pytest.fixture
def odd_rows():
    return list(ROWS)
