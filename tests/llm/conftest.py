import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def small(spark):
    """Texts of every awkward kind, with repeated rows and columns of clashing names."""
    def build(schema="doc_id long, text string, lang string, source string, n_chars long, _id int, fp string, key string"):
        texts = [
            (1, "The first text of all.\nIt has a second line.", "en", "a"),
            (1, "The first text of all.\nIt has a second line.", "en", "a"),
            (2, None, None, None), (3, "", "en", "b"), (4, " \t\n\x0b ", "de", "b"),
            (None, "a text without an id", "en", None), (5, "one", "fr", "c"),
            (6, "long " * 30_000, "en", "a"), (7, "é ß 日本 🎉 <|endoftext|> x", "de", None),
            (8, "x" * 50_000, "es", "c"), (9, "The first text of all.\nIt has a second line!", "en", "a"),
        ]
        rows = [(i, t, lang, s, len(t or ""), 0, "fp", "k") for i, t, lang, s in texts]
        return spark.createDataFrame(rows, schema)

    return build()
