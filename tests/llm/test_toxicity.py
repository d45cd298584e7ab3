import zlib
from itertools import product

import numpy as np
from lorebase.llm import queries, toxicity
from lorebase.llm.toxicity import Matcher, Term, ToxicModel

from .conftest import ROWS

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            same = x == y or y in toxicity.LOOKS.get(x, "")
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (not same))
    return row[-1]


def test_automata_against_edit_distance():
    terms = [Term("abcab", 1.0, edits=1), Term("bacabaccab", 2.0, edits=2), Term("cab", 1.0)]
    m = Matcher(terms)
    words = ["".join(w) for n in (3, 4, 5, 6) for w in product("abc", repeat=n)] + ["bacabaccab", "bacabccab", "bacbaccb", "b4cabaccab", "ca8", "c@b", "bacabaccabab"]
    for w in words:
        near = [(d, -t.weight, i) for i, t in enumerate(terms) if (d := distance(w, t.text)) <= t.edits]
        want = (min(near)[2], min(near)[0]) if near else None
        assert m.match(w) == want, w


def test_stems():
    m = Matcher([Term("gruf", 1.0, True), Term("grufta", 3.0, edits=1)])
    assert m.match("gruf") is None and m.match("grufen") == (0, 0) and m.match("grufta") == (1, 0) and m.match("agrufen") is None


def test_choice_of_terms():
    df = {("idiot", False): (40, 1, 0, 12), ("rare", False): (2, 0, 0, 2), ("the", False): (50, 500, 0, 12), ("achl", True): (30, 2, 9, 12), ("achlen", False): (9, 0, 0, 9), ("idio", True): (40, 1, 1, 12), ("copied", False): (40, 0, 0, 2)}
    assert [(t.text, t.stem) for t in toxicity.choose_terms(df, (50, 500))] == [("achl", True), ("achlen", False), ("idiot", False)]
    terms = [Term("idiot", 3.0, edits=1), Term("misuser", 3.0, edits=1), Term("seldom", 3.0, edits=1)]
    assert [t.edits for t in toxicity.limit_edits(terms, [0.2, 0.2, 0.01], {(0, 1): 100, (1, 1): 1}, 500)] == [0, 1, 0]


def test_misspelling_of_an_inflected_term():
    m = Matcher([Term("achlich", 3.0, True, 1), Term("achlichen", 3.0, edits=1)])
    assert m.match("achlichen") == (1, 0) and m.match("achlihen") == (1, 1) and m.match("achlichung") == (0, 0) and m.match("achlixhung") == (0, 1)


def test_misspelling_counts_without_being_seen():
    """The share that an edit keeps holds although no labelled text has a misspelling, and so does that of quotation."""
    model = ToxicModel([Term("idiot", 6.0, edits=1)])
    of = model.measure()
    texts = ["you idiot and so on"] * 20 + ["nothing of that kind"] * 60
    model = toxicity.fit_curve(model, [of(t) for t in texts], np.array([1.0] * 20 + [0.0] * 60))
    assert (model.edit_share, model.quoted_share) == (toxicity.EDIT_SHARE, toxicity.QUOTED_SHARE)
    score = model.scorer()
    assert score("you idiot and so on") > score("you idoot and so on") > 0.3 > score("nothing of that kind")
    assert score("you idiot and so on") > score('he wrote "idiot" on it') > score("nothing of that kind")
    assert score("you idiot,fool and so on") == score("you idiot and so on") and score("x" * 100_000) == score("x")
    # labelled misspellings and quotations move the shares
    texts = ["you idoot here"] * 50 + ["you idiot here"] * 50 + ['he said "idiot" here'] * 200 + ["nothing of that kind"] * 200
    moved = toxicity.fit_curve(model, [of(t) for t in texts], np.array([1.0] * 100 + [0.0] * 400))
    assert moved.quoted_share < toxicity.QUOTED_SHARE and moved.edit_share > toxicity.EDIT_SHARE


def test_quotations():
    q = lambda t: toxicity.quotations(t.split())
    assert q('"hello" you idiot and then "bye"') == [(0, 0), (5, 5)]
    assert q('he said "you are such an idiot that nobody in this whole town will ever listen to you again" and left') == [(2, 18)]
    assert q("„du Narr“, sagte er, und «toi» und ‘no’ 'x'") == [(0, 1), (5, 5), (7, 7)]
    assert q('an "open one and no end') == [] and q('an "open one "closed" end') == [(3, 3)] and q("don’t it’s") == [] and q('("yes") ... "no."') == [(0, 0), (2, 2)]
    model = ToxicModel([Term("idiot", 3.0, edits=1)])
    of = model.measure()
    assert of('"hello" you idiot and then "bye"')[:6] == [3.0, 0, 0, 0, 0, 0]
    assert of('he said "oh well you are a very very big idiot in the eyes of all of us here" ok')[:6] == [0, 0, 0, 3.0, 0, 0]
    assert of("you idoit")[:6] == [0.0] * 6 and of("you idiott id1ot")[:6] == [3.0, 3.0, 0, 0, 0, 0]


def test_context_of_a_hit():
    model = ToxicModel([Term("idiot", 3.0)], {"you": 0.5, "word": -0.5}, [1.0, 1.0, -3.0])
    of, score = model.measure(), model.scorer()
    assert of("you idiot")[0] > 3.0 > of("the word idiot here")[0] > 0
    assert score(None) == score("") == score(" \n") and score("you idiot") > score("word idiot")


def test_planted_misspellings_in_held_out_rows(spark):
    """Toxic rows of the held-out fold that are found are found again with one letter of each toxic word changed, where any of these words allows an edit."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    hits, score = model.hits(), model.scorer()
    held = labels.filter("toxic = 1").join(docs, "doc_id").select("doc_id", "text").collect()
    found = again = exact = clean = 0
    for r in held:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 or score(r.text) < 0.3:
            continue
        tokens = r.text.split()
        at = [(i, model.terms[t]) for i, t, e in hits(tokens) if not e]
        if not any(term.edits for _, term in at):
            continue  # only terms that clean words are too near to, or that too few texts have
        for i, term in at:
            tokens[i] = tokens[i].lower().replace(term.text, term.text[:2] + "x" + term.text[3:])
        wrong = " ".join(tokens)
        found, again = found + 1, again + (score(wrong) >= 0.3)
        exact += any(e == 0 for _, _, e in hits(tokens))
        for i, _ in at:
            tokens[i] = "xx"
        clean += score(" ".join(tokens)) < score(wrong)
    assert found >= 30 and exact == 0 and again >= 0.9 * found and clean == found


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    mine = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y == p for y, p in mine) / len(mine) > 0.93
    assert sum(p for y, p in mine if y == 0) <= 0.04 * len(mine)


def test_odd_rows(spark, odd, empty):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = toxicity.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
