import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lorebase.llm import embeddings, queries
from lorebase.llm.embeddings import Lsh

from .conftest import SF


def brute(rows, least=0.95):
    """vec_id to (n_links, component_id) by comparing all pairs; rows of (vec_id, vector or None)."""
    unit = [None if v is None or not len(v) or any(c is None for c in v) or not np.isfinite(np.array(v, float)).all() or not np.any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    out, seen = {}, set()
    for i in range(len(rows)):
        if i not in seen:
            part, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in part:
                        part.add(j)
                        todo.append(j)
            seen |= part
            for j in part:
                out[rows[j][0]] = (len(links[j]), min(rows[k][0] for k in part))
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    found = [base[k % 60] + r.standard_normal(16) * (0.02 + 0.28 * (k % 7) / 7) for k in range(400)]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(found)]
    out += [(400 + i, out[5][1]) for i in range(30)]  # copies
    out += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-0.0] * 16)]
    return out


@pytest.mark.parametrize("lsh", [None, Lsh.fitting(400, block=4), Lsh.fitting(400, dense=0), Lsh.fitting(400, block=16, dense=2), Lsh(tables=24)])
def test_recall_and_precision(spark, rows, lsh):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, node string").repartition(3)
    got = {r.vec_id: r for r in embeddings.link(df, lsh=lsh).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert all(got[i].component_id >= want[i][1] and got[i].kept == (got[i].component_id == i) for i in want)
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.95 * len(want)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 908))
    assert got[907].component_id == 906 and got[907].n_links == 1


@pytest.mark.parametrize("n", [500, 50_000, 10**9])
def test_expected_recall(n):
    """Pairs at the least cosine meet in a table and have sketches alike with probability 0.97 or more."""
    r = np.random.default_rng(5)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    lsh = Lsh.fitting(n)
    alike = embeddings.differing(lsh.sketches(a), lsh.sketches(near)) < lsh.apart
    assert ((lsh.signatures(a) == lsh.signatures(near)).any(axis=1) & alike).mean() >= 0.97
    assert lsh.tables < 120 and embeddings.differing(lsh.sketches(a)[:-1], lsh.sketches(a)[1:]).mean() > 56


def planted(seed=11):
    """The vectors of sf0.1's table, and near ones planted beside 300 of them: cosines from 0.95 to 1."""
    r = np.random.default_rng(seed)
    base = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    ids, vectors = base.vec_id.tolist(), [np.array(v, float) for v in base.embedding]
    for k in range(0, 300):
        v = vectors[k * 5] / np.linalg.norm(vectors[k * 5])
        for _ in range(1 + k % 4):
            u = r.standard_normal(len(v))
            u -= (u @ v) * v
            c = r.uniform(0.95, 1.0)
            ids.append(1_000_000 + 50 * len(ids))
            vectors.append(c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u))
    return ids, np.array(vectors, dtype=np.float32)


def test_recall_on_planted_pairs(spark):
    """Every row whose id is divisible by 50 against all rows, as brute force finds its links."""
    ids, vectors = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.link(df).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    there, found = sum(int(want[k]) for k in asked), sum(got[ids[k]] for k in asked)
    print(f"{len(ids)} vectors, {len(asked)} asked, {there} links, recall {found / there:.4f}")
    assert there > 800 and all(got[i] <= n for i, n in zip(ids, want, strict=True)) and found >= 0.96 * there


def test_dense_cluster(spark):
    """Hundreds of different vectors within the least cosine of each other, in pairs of blocks, give no pairs."""
    r = np.random.default_rng(2)
    v = r.standard_normal(24)
    rows = [(i, (v + 0.05 * r.standard_normal(24)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embeddings.link(df, lsh=Lsh.fitting(300, block=64)).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0)}


def test_lengths_that_meet(spark):
    """Vectors of another length in a bucket don't hide its pairs."""
    rows = [[1, 0, 5, 1, np.array([1.0, 0.0]).tobytes()], [1, 1, 6, 1, np.array([1.0, 0.1]).tobytes()], [1, 1, 7, 1, np.array([1.0, 0.1, 0.0]).tobytes()]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "tag", "node", "copies", "vector"])
    out = [tuple(r.values()) for b in embeddings._compare(Lsh(), 0.95, "<f8")(iter([batch])) for r in b.to_pylist()]
    assert out == [(6, 5, 0), (5, None, 1), (6, None, 1)]


def test_repeats_and_empty(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert embeddings.link(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1e300]), (2, [0.0, 1e-300])], schema)
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embeddings.link(twice).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 2), ("None", 1, 2)]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embedding_dedup(spark, SF).collect()}
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) and set(got) == set(want)
