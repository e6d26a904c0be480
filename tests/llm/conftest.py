import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns of clashing names."""
    def made(rows, partitions=3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return frame.withColumns({
            "score": F.lit("x"), "row": F.lit(1), "key": F.lit(None).cast("string"), "range": F.lit(2),
            "start": F.lit("s"), "n_words": F.lit(7), "pii": F.lit("p")})

    return made


#: Texts every operator must take: null, empty, blanks, one word, repeated, very long.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "same text for two rows of it"), (5, "same text for two rows of it"),
       (6, "same text for two rows of it"), (7, "é 日本語 \U0001f600 x"), (8, "long " * 40_000), (None, "no id at all here"),
       (9, "x" * 100_000)]
