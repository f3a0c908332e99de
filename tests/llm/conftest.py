import hashlib

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows of documents with a column whose name clashes with the operators' own."""

    def of(texts, first=0, partitions=3):
        rows = [(first + k, t, "en", f"src{k % 3}", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(partitions)

    return of


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Null, empty, white space, signs, a very long text, repeats and characters beyond the basic plane.
ODD = [None, "", "  \n", "!?", "a" * 30_000, "word " * 5_000, "same text", "same text", "same  text", "😀 é ß 中文", "the the the"]
