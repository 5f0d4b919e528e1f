import pytest

P1 = " ".join(f"alpha{k}" for k in range(60))
P2 = " ".join(f"beta{k}" for k in range(55))


def messy_texts():
    """Null, empty, blank, short, tied, repeated, shared-passage and long texts."""
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Two words"), (5, P1), (6, P1), (7, f"lead in {P1} and out"),
            (8, f"{P2}\n{P1}\n{P2}"), (9, P2), (10, "x " * 400), (10, "x " * 400), (None, P1 + " tail"), (None, None),
            (11, "é ß 中文 \x0b😀 " * 30), (12, f"start {P2} {P1} end\nline\nline\nline"), (13, "a b c d e f"), (14, "A B c d e F"),
            (15, "w" * 5000 + " " + P1), (16, " ".join(f"long{k % 977}" for k in range(20000)))]


@pytest.fixture(scope="session")
def messy(spark):
    """The messy texts in a table whose other columns have the names that operators use inside."""
    rows = [(i, t, "en", 7, "d", k, -1.5, ["q"], True) for k, (i, t) in enumerate(messy_texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int, doc string, th int, score double, "
                                       "spans array<string>, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
