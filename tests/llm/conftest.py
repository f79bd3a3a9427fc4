import pytest

from scoreweave.llm.common import tasks_find_library

#: Nulls, empty and blank texts, ties, repeated rows, odd characters, and columns whose names operators use.
TEXTS = [
    None, "", " \n\t ", "one", "one two three", "the of and to in that is was for with on it as at by this " * 4,
    "a b c d e f g\n" * 30, "x" * 5000, "é😀 " * 300, "Licensed under the MIT License.", "same text twice", "same text twice",
]


@pytest.fixture
def library(spark):
    tasks_find_library(spark)
    return spark


@pytest.fixture
def docs_of(library):
    def build(texts, ids=None):
        ids = ids or list(range(len(texts)))
        rows = [(i, t, "label", 7, None) for i, t in zip(ids, texts, strict=True)]
        return library.createDataFrame(rows, "doc_id long, text string, label string, n long, key binary")

    return build
