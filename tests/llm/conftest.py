from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of the documents table from (doc_id, text[, lang[, source]]) tuples."""
    from lectern.llm.common import ship
    ship(spark)

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


# NULLs, blanks, white-space runs, ties, repeated rows and one long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "a row without id"), (None, None), (7, "one"), (7, "one"), (8, "one two three"),
    (9, "tabs\tand  double  spaces \n\n end "), (10, "<|endoftext|>x<|endoftext|>"), (11, "naïve café ½ ² 😀😀 日本語   x"),
    (12, "word " * 30_000), (13, "x" * 20_000), (14, "it's we'll'd DON'T 12345abc ----====$$$"), (15, "\x85 \x1c a ́́"),
]
