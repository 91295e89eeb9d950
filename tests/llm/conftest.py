import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{i}", None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket int, hits string")

    return make


#: Nulls, empties, odd white space, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, "A"), (None, "a"), (6, "\n\t x  y z "), (7, "it's 'special' <|endoftext|> 12¾  \u0085é😀"), (None, None)]
