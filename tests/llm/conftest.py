import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
LONG = "Wort für Wort, wieder und wieder! " * 4000 + "x" * 30_000

#: Ids, texts: nulls, empties, white space, a very long text, copies, near copies, repeated rows, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the quick  brown\tfox jumps over the lazy dog"), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (7, LONG), (None, "The quick brown fox jumps over the lazy dog"), (None, None), (8, "one"), (9, "one two"), (10, "ünï çødé \U0001f600 \u0085  x<|endoftext|></s>"),
    (11, "12345 67890 don't  I'LL\r\n\r\n  aaaa"), (11, "12345 67890 don't  I'LL\r\n\r\n  aaaa"), (12, "0\u0000�"), (-5, "the quick brown fox jumps over the lazy dog"), (13, "aaaaaaaaaa" * 300),
]
#: Extra columns whose names are those of intermediate columns or results.
CLASHING = {c: "x" for c in ("row", "n", "first", "text_sha256", "fp", "label", "third", "word", "p", "copies", "part", "ids", "score", "kept", "doc", "count", "fingerprint", "n_tokens", "domain")}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns."""
    rows = [(i, t, ["en", "de", None][k % 3], "src", len(t or ""), *CLASHING.values()) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet(os.path.join(SF, "documents.parquet"))


