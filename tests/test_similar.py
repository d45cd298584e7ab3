"""The prefix index and batch inserts against plain versions."""

import random
import re

import pytest
from lorebase.operators import importer, similar


def words(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").strip().lower()) if w}


def score(a, b):
    if (a or "").strip().lower() == (b or "").strip().lower():
        return 100.0
    x, y = words(a), words(b)
    return len(x & y) * 100.0 / len(x | y) if x | y else 0.0


def brute(candidates, existing, threshold):
    out = []
    for pos, text in candidates:
        best = min(((-score(text, t), i) for i, t in existing), default=(0, None))
        out.append((pos, best[1], round(-best[0], 6)) if -best[0] >= threshold else (pos, None, None))
    return sorted(out, key=str)


def texts(seed, n, start=0, width=12):
    """Random words, some common; many texts differ from another by a word or two."""
    rng, out = random.Random(seed), []
    for k in range(n):
        if out and rng.random() < 0.5:
            own = rng.choice(out)[1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
        else:
            own = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(1, width))]
        out.append((start + k, " ".join(own)))
    return out


def found(rows):
    return sorted(((r.input_pos, r.existing_id, r.score) for r in rows.collect()), key=str)


ODD = [(900, None), (901, ""), (902, " \n "), (903, "W1 w2"), (904, "w1  w2"), (905, "x " * 3000 + "y")]


@pytest.mark.parametrize("hot", [similar.HOT, 3])
def test_best_match_after_updates(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    frame = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    existing, candidates = texts(1, 300) + ODD, texts(1, 120) + texts(2, 60, 1000) + [(p + 5000, t) for p, t in ODD]
    asked = frame(candidates, "input_pos bigint, question string")
    index = similar.PrefixIndex.create(frame(existing, "existing_id bigint, text string"), str(tmp_path / "i"), 60.0, 5)
    assert found(index.check(asked)) == brute(candidates, existing, 60.0)
    assert found(index.check(asked, 90.0)) == brute(candidates, existing, 90.0)
    with pytest.raises(ValueError):
        index.check(asked, 50.0)

    changed, gone = texts(2, 40, 100) + [(7000, "w1 w2 brand new"), (7001, "")], list(range(40)) + [901]
    index.update(frame(changed, "existing_id bigint, text string"), frame([(i,) for i in gone], "existing_id bigint"))
    now = {i: t for i, t in existing if i not in gone} | dict(changed)
    again = similar.PrefixIndex.open(spark, str(tmp_path / "i"))
    assert found(again.check(asked)) == brute(candidates, list(now.items()), 60.0)
    assert again.table("postings").count() > 0


def test_empty_tables(spark, tmp_path):
    none, some = spark.createDataFrame([], "existing_id bigint, text string"), spark.createDataFrame([(1, "a b")], "input_pos bigint, question string")
    index = similar.PrefixIndex.create(none, str(tmp_path / "i"))
    assert found(index.check(some)) == [(1, None, None)]
    assert index.check(some.limit(0)).collect() == []


def test_index_is_not_shuffled(spark, tmp_path):
    existing = spark.createDataFrame(texts(3, 200), "existing_id bigint, text string")
    index = similar.PrefixIndex.create(existing, str(tmp_path / "i"))
    own = similar._keyed(existing.withColumnRenamed("text", "question")).select("digest", "words")
    ranked = index._ranked(own, index.table("words"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.candidates(ranked, 70.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line and ("postings" in line or "words" in line)]
    assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)
    assert len(re.findall(r"Exchange hashpartitioning\(cell#", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(word#", plan)) == 1


def one_by_one(table, sent, threshold):
    """Status, new id and best match of each row, put in one after the other."""
    have, top, out = list(table), max((i for i, _ in table), default=0), []
    for pos, text in sorted(sent):
        if not text:
            continue
        best = min(((-score(text, t), i) for i, t in have), default=(0, None))
        if -best[0] >= threshold:
            out.append((pos, 409, None, best[1], round(-best[0], 6)))
        else:
            out.append((pos, 201, top + 1 + pos, None, None))
            have.append((top + 1 + pos, text))
    return sorted(out, key=str)


def test_inserts_are_those_of_one_by_one(spark):
    """Chains of texts, each similar to the next only, copies, copies of refused texts, and rows without a question."""
    chain = [(k, " ".join(f"c{j}" for j in range(k * 2, k * 2 + 20))) for k in range(30)]
    sent = chain + texts(5, 150, 100, 6) + [(p + 300, t) for p, t in texts(5, 60, 100, 6)] + [(600, None), (601, ""), (602, " "), (603, " "), (604, chain[1][1]), (605, chain[0][1].upper())]
    table = texts(6, 40, 1, 6) + [(77, chain[7][1])]
    for threshold in (70.0, 50.0):
        got = importer.add_questions(spark.createDataFrame([(i, t, "a", True) for i, t in table], "id bigint, question string, answer string, has_answer boolean"), spark.createDataFrame([(p, t, " x ") for p, t in sent], "input_pos bigint, question string, answer string").repartition(3), threshold)
        assert sorted(((r.input_pos, r.status, r.id, r.existing_id, r.score) for r in got.collect()), key=str) == one_by_one(table, sent, threshold)


def test_matches_found_in_several_runs(spark, monkeypatch):
    """Texts matched a few at a time, long ones too, give the same; of texts of the same words the smallest id counts, in whatever order they are."""
    monkeypatch.setattr(similar, "AT_ONCE", 40)
    wide = [(k + 500, " ".join(f"v{(k // 4 * 7 + j) % 3000}" for j in range(k, 900 + k))) for k in range(8)]
    existing, asked = texts(8, 90) + wide + [(3, "q r s"), (2, "s r q")], texts(8, 60) + wide[::3] + [(901, "q r s")]
    got = importer.check(spark.createDataFrame(asked, "input_pos bigint, question string"), spark.createDataFrame(existing, "existing_id bigint, text string"))
    assert found(got) == brute(asked, existing, 70.0)
