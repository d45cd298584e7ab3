"""Sets compared by bits against plain versions."""

import random

import pytest
from lorebase.operators import importer, sets, similar
from pyspark.sql import functions as F

from test_similar import brute, found, one_by_one, texts


def worded(spark, rows, name="existing_id"):
    return similar.keyed(spark.createDataFrame(rows, f"{name} bigint, question string")).select("digest", "words", name)


def long_texts(seed, n, start):
    """Texts of 1 to 900 words, of which many differ from another by up to a fifth of them."""
    rng, out = random.Random(seed), []
    for k in range(n):
        own = list(rng.choice(out)[1].split()) if out and rng.random() < 0.6 else [f"w{rng.randrange(5000)}" for _ in range(int(rng.paretovariate(0.6)) % 900 + 1)]
        for _ in range(rng.randrange(len(own) // 5 + 2)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(5000)}"
        out.append((start + k, " ".join(own)))
    return out


def tiny(monkeypatch):
    """Many blocks, narrow rows and few sets at once."""
    for name, value in {"BLOCK": 30, "LEAST": 5, "BLOCK_BYTES": 3000, "OWN": 3, "KNOWN": 7, "WIDEST": 8, "TOLD": 20, "TURNS": (1, 2)}.items():
        monkeypatch.setattr(sets, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs(spark, monkeypatch, small):
    if small:
        tiny(monkeypatch)
    rows, level = long_texts(4, 150, 0) + texts(5, 150, 1000), 70.0
    own, known = (worded(spark, part) for part in (rows[::2], rows[1::2]))
    sets_of = {bytes(r.digest): set(r.words) for r in own.union(known).collect()}
    mine, theirs = ({bytes(r.digest) for r in t.collect()} for t in (own, known))
    want = {(a, b): round(len(sets_of[a] & sets_of[b]) * 100 / len(sets_of[a] | sets_of[b]), 6) for a in mine for b in theirs if a != b}
    got = sets.matches(own.dropDuplicates(["digest"]), known.dropDuplicates(["digest"]), level).collect()
    assert {(bytes(r.own), bytes(r.digest)): round(r.score, 6) for r in got} == {k: s for k, s in want.items() if s >= level} and len(got) == len({(bytes(r.own), bytes(r.digest)) for r in got})


@pytest.mark.parametrize("small", [False, True])
def test_best_of_many(spark, monkeypatch, small):
    """Long and short texts, near copies in clusters, ties, and a text that many others are equally like."""
    if small:
        tiny(monkeypatch)
    root = [f"r{k}" for k in range(40)]
    ring = [(9000 - k, " ".join([*root[:k], f"x{k}", *root[k + 1 :]])) for k in range(40)]
    existing, asked = long_texts(6, 160, 0) + texts(7, 100, 500) + ring, long_texts(6, 200, 0) + texts(7, 160, 500) + [(9999, " ".join(root)), (9998, ""), (9997, None)]
    got = importer.check(spark.createDataFrame(asked, "input_pos bigint, question string"), spark.createDataFrame(existing, "existing_id bigint, text string"))
    assert found(got) == brute(asked, existing, 70.0)


def test_no_index_for_one_check(spark):
    """Chance meetings of texts that share words cost no rows: only pairs that may match go on, and no index is built and joined."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(150)}" for _ in range(60))) for k in range(900)]
    before = {t.name for t in spark.catalog.listTables()}
    own, known = rows[:450], rows[450:] + [(5000, rows[0][1] + " more")]
    got = importer.check(spark.createDataFrame(own, "input_pos bigint, question string"), spark.createDataFrame(known, "existing_id bigint, text string"))
    assert found(got.filter(F.col("existing_id").isNotNull()))[0][:2] == (0, 5000)
    assert {t.name for t in spark.catalog.listTables()} == before
    likely = sets.near(*(worded(spark, t) for t in (own, known)), 70.0).count()
    assert 1 <= likely <= 20


def test_inserts_compare_by_bits(spark, monkeypatch):
    """Sent questions that share words by chance cost no rows of a join, and no index is built; in tiny blocks they fare as one by one."""
    tiny(monkeypatch)
    before = {t.name for t in spark.catalog.listTables()}
    sent, table = texts(5, 60, 100, 6) + [(p + 300, t) for p, t in texts(5, 30, 100, 6)] + [(600, None), (602, " ")], texts(6, 40, 1, 6)
    got = importer.add_questions(spark.createDataFrame([(i, t, "a", True) for i, t in table], "id bigint, question string, answer string, has_answer boolean"), spark.createDataFrame([(p, t, " x ") for p, t in sent], "input_pos bigint, question string, answer string"))
    assert sorted(((r.input_pos, r.status, r.id, r.existing_id, r.score) for r in got.collect()), key=str) == one_by_one(table, sent, 70.0)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_many_texts_against_an_index(spark, tmp_path, monkeypatch):
    """With many texts, all of the index is compared by bits: taken-out texts don't count, and the result is that of the postings."""
    existing, asked = texts(1, 300), texts(1, 120) + texts(2, 60, 1000)
    frame = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    index = similar.PrefixIndex.create(frame(existing, "existing_id bigint, text string"), str(tmp_path / "i"), 60.0, 5)
    index.update(frame(texts(2, 40, 100), "existing_id bigint, text string"), frame([(i,) for i in range(40)], "existing_id bigint"))
    now = {i: t for i, t in existing if i >= 40} | dict(texts(2, 40, 100))
    rows = frame(asked, "input_pos bigint, question string")
    own = similar.keyed(rows).select("digest", "words").dropDuplicates(["digest"]).localCheckpoint()
    pairs = lambda df: sorted((bytes(r.own), bytes(r.digest), r.score) for r in df.collect())
    by_postings = pairs(index.similar(own))
    monkeypatch.setattr(similar, "FEW", 0)
    assert found(index.check(rows)) == brute(asked, list(now.items()), 60.0)
    assert found(index.check(rows, 90.0)) == brute(asked, list(now.items()), 90.0)
    assert pairs(index.similar(own)) == by_postings != []
