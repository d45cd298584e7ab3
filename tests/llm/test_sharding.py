import hashlib
import zlib

import pytest
from lorebase.llm import queries, sharding
from pyspark.sql import functions as F

from .conftest import ROWS, SF


def brute(rows, shards=8, tolerance=100):
    """(doc_id, size, crc, shard, slot): rows in order, cut at the targets, group edges within the tolerance first."""
    order = sorted((hashlib.sha256((t or "").encode()).digest()[:16], i is not None, i or 0, (t or "").encode()) for i, t in rows)
    sizes = [len(x[3]) + 1 for x in order]
    total = sum(sizes)
    below = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    firsts = []
    for k in range(1, shards):
        t = k * total
        at = max(j for j in range(len(sizes)) if below[j] * shards <= t) if sizes else 0
        if not sizes:
            break
        group = [j for j in range(len(sizes)) if order[j][0] == order[at][0]]
        edge = min((group[0], group[-1] + 1), key=lambda j: (abs(below[j] * shards - t), j))
        own = min((at, at + 1), key=lambda j: (abs(below[j] * shards - t), j))
        firsts.append(edge if abs(below[edge] * shards - t) * tolerance <= total else own)
    out, slots = [], {}
    for j, x in enumerate(order):
        shard = sum(f <= j for f in firsts)
        out.append((x[2] if x[1] else None, sizes[j], zlib.crc32(x[3]), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return sorted(map(str, out))


def rows(df):
    return sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in df.collect())


def test_odd_rows(odd, empty):
    got = sharding.shard_rows(odd)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert rows(got) == brute(ROWS)
    for shards in (1, 2, 40):
        assert rows(sharding.shard_rows(odd, shards)) == brute(ROWS, shards)
    assert sharding.shard_rows(empty).collect() == []


def test_extra_columns_are_written(spark, odd, tmp_path):
    docs = odd.withColumns({"key": odd.doc_id, "a.b": odd.text, "shard": odd.text, "slot": odd.text, "size": odd.text})
    sharding.write(docs, str(tmp_path / "s"), 3)
    back = sharding.read(spark, str(tmp_path / "s"), docs)
    assert back.select("doc.*").columns == docs.columns
    assert sorted(map(str, back.select("doc.*").collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("piece", [sharding.PIECE, 20_000])
def test_rounds_pieces_and_hot_groups(spark, piece):
    """Many rows and few probes, so that brackets take several rounds; a third of the rows are copies, another of one row."""
    texts = [(k, f"text {k} " * (1 + k % 7) if k % 3 else "a copy that many have") for k in range(6000)]
    texts += [(7, "one row again and again")] * 3000 + [(None, None)] * 50 + [(9, "x" * 40_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    got = sharding.shard_rows(docs, 8, piece, probes=5)
    assert rows(got) == brute(texts)
    sums = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    held = {r.shard: (r.b, r.n, r.top) for r in sums}
    mean = sum(b for b, _, _ in held.values()) / 8
    assert sorted(held) == list(range(8)) and all(abs(b - mean) <= 40_002 and top == n - 1 for b, n, top in held.values())


def test_groups_stay_whole_within_the_tolerance(spark):
    texts = [(k, f"group {k // 3}") for k in range(9000)]
    got = sharding.shard_rows(spark.createDataFrame(texts, "doc_id bigint, text string")).toPandas()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    sums = got.groupby("shard")["size"].sum()
    assert (sums.max() - sums.min()) / sums.mean() < 0.02


def test_partitioning_does_not_matter(spark):
    texts = [(k, f"some {k % 500}") for k in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(sharding.shard_rows(docs.repartition(1))) == rows(sharding.shard_rows(docs.repartition(7))) == brute(texts)


def test_query(spark, documents):
    assert rows(queries.op12_sharding(spark, SF)) == brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))
