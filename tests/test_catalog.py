"""Every query against its SQL on the smallest tables."""

import re

import duckdb
import pandas as pd
import pytest
from lorebase.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_letters_of_many_capitals_as_in_sql(spark, tmp_path):
    """Letters whose full capitals are several, and a sigma at the end of a word, in questions that are sent and imported."""
    texts = ["der große fluß fließt süß", "der große fluß fließt süß", "ﬁne ŉ ǰ ᾳ ᾲ ΐ og", "ΟΔΟΣ ΣΑΣ και İki", "οδοσ σασ και iki", "ΟΔΟΣ ΣΑΣ και İki"]
    turns = [(c, t, "user", x) for c, x in enumerate(texts) for t in range(8)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    small = duckdb.connect()
    for t in ("conversations", "documents"):
        small.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("question_insert", "import_check", "import_check_indexed"):
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), small.sql(catalog.oracle_sql()[name]).df()
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 17, 300, 2000])
def test_shuffle_is_a_permutation(spark, n):
    from lorebase.operators import utilities

    rows = spark.range(n).select((F.col("id") * 3 + 1).alias("k"))
    orders = [{r.k: r.place for r in utilities.shuffle_rows(rows.repartition(p), seed, "k").collect()} for p, seed in ((1, 7), (4, 7), (2, 8))]
    assert all(sorted(o.values()) == list(range(n)) for o in orders)
    assert orders[0] == orders[1] and (n < 10 or orders[0] != orders[2])
    assert n < 300 or sum(abs(o - (k - 1) // 3) for k, o in orders[0].items()) > n * n / 5


def test_object_ids(spark):
    ids = [r.object_id for r in catalog.queries()["object_ids"](spark, SF).collect()]
    assert len(set(ids)) == len(ids) and all(re.fullmatch("[0-9a-f]{24}", i) for i in ids)


def test_file_sizes(spark, tmp_path):
    for n in (512, 1024, 1075, 20_000):
        (tmp_path / f"{n}.bin").write_bytes(b"x" * n)
    from lorebase.operators import documents
    from lorebase.sources import xlsx

    rows = documents.size_label(xlsx.file_sizes(spark, str(tmp_path))).collect()
    assert sorted((r.length, r.size_kb) for r in rows) == [(512, "0.5 KB"), (1024, "1.0 KB"), (1075, "1.0 KB"), (20_000, "19.5 KB")]
    assert all(re.fullmatch(r"\d+\.\d KB", r.size_kb) for r in catalog.queries()["file_size_kb"](spark, SF).collect())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
