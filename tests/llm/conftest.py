import pytest

LETTERS = "thing one other water night stone river cloud green under again house light world small"


@pytest.fixture(scope="session")
def base(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


@pytest.fixture(scope="session")
def make(base):
    """Documents with columns that clash with names the operators use."""

    def build(rows, ids="doc_id"):
        wide = [(i, t, "en", None, len(t) if t is not None else None, 1, "x", None) for i, t in rows]
        return base.createDataFrame(wide, f"{ids} long, text string, lang string, source string, n_chars long, block int, kind string, score double")

    return build


@pytest.fixture(scope="session")
def hard():
    """Nulls, empty and blank texts, repeated rows and ids, one very long text, odd characters."""
    words = LETTERS.split()
    long = " ".join(words[(i * i + i // 7) % 15] + str(i % 97) for i in range(60_000))
    passage = " ".join(words + words[::-1])
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, passage), (7, "start here " + passage + "  the end"), (8, long),
        (9, passage), (9, passage), (10, "other text of this id"), (10, "and a second text of the same id"), (None, "a text without id " + passage), (None, None),
        (11, "Straße é é ﬁ 日本語 😀 \x00 \x1c x y <|endoftext|> z <|startoftext|>"), (12, "x" * 5000), (13, "a a a a a " * 40),
    ]
