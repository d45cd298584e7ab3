import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from hypothesis import given, settings, strategies as st
from lorebase.llm import divergence, queries

from .conftest import ROWS, SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least=3, top=200):
    """Every share of every kept term of every group, as it is defined."""
    docs = [tuple(x or "" for x in d) for d in docs]
    words = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text)]) for lang, source, text in docs]
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, own in words:
        df.update((lang, w) for w in set(own))
        counts[lang, source].update(own)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(w for (other, w), n in df.items() if other == lang and n >= least)
        groups = {s: c for (other, s), c in counts.items() if other == lang}

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}

        whole, p = shares(sum(groups.values(), Counter())), {s: shares(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            terms = [(-f(p[s][w], whole[w]), w) for w in kept if groups[s][w] and p[s][w] > whole[w]]
            out += [(lang, s, "pair", i, -v, k + 1) for k, (v, i) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            out += [(lang, s, "term", i, -v, k + 1) for k, (v, i) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


LONG_WORD = "ab" * 200 + "ä" * 5000
SMALL = [
    *product(["en"], ["s1", "s2", None], ["The cat, the CAT and the dog.", "a cat　b", None, "", "12 34 -- ", f"one {LONG_WORD} two {LONG_WORD}"]),
    *product(["de", None], ["s1"], ["ein Wort", "ein Ding", "kein", "Ärger ärger ÄRGER"]),
    *product(["fr"], ["s1", "s9", ""], ["seul"]),
    ("es", "only", "nada"), ("xx", None, None), ("xx", "b", ""),
]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], "lang string, source string, text string, term string, p string").repartition(3)


def test_small(spark, empty):
    assert rows(divergence.audit(frame(spark, SMALL))) == brute(SMALL)
    assert rows(divergence.audit(frame(spark, SMALL), least=1, top=2)) == brute(SMALL, 1, 2)
    assert rows(divergence.audit(empty)) == []


def test_odd_rows(odd):
    docs = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert rows(divergence.audit(odd)) == brute(docs) and rows(divergence.audit(odd, least=1)) == brute(docs, 1)
    assert len(docs) == len(ROWS)


@pytest.mark.parametrize("block", [40, 400])
def test_many_blocks(spark, block):
    """Terms that don't fit in one automaton; each next one reads what the one before it left."""
    docs = [("en", f"s{k % 4}", " ".join(f"{'abcdefgh'[j]}{'xyz'[j % 3]}" for j in range(8) if (k * j) % 5 < 3)) for k in range(40)] + SMALL
    assert rows(divergence.audit(frame(spark, docs), block=block)) == brute(docs)


def test_many_sources(spark, monkeypatch):
    """More sources than a table of sums holds."""
    docs = [("en", f"s{k % 37}", f"common word {'abcdefghij'[k % 10] * 2} {'klmnopq'[k % 7] * 3}") for k in range(300)]
    for wide in (5, 20):
        monkeypatch.setattr(divergence, "WIDE", wide)
        assert rows(divergence.audit(frame(spark, docs))) == brute(docs)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abC ,ä　\x85\x00zZ9"), max_size=60), st.sets(st.text(st.sampled_from("abcä"), min_size=1, max_size=3), max_size=6))
def test_automaton_finds_whole_terms(text, terms):
    own = sorted(("en", t) for t in terms)
    automaton = divergence._automata((text, tuple(own)), {"en": "\n".join(t for _, t in own)} if own else {"de": "x"})[0].get("en")
    padded = divergence._padded(text.encode())
    pairs = list(automaton.iter(padded)) if automaton else []
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text)]
    assert Counter(own[v][1] for _, v in pairs) == Counter(w for w in words if w in terms)
    rest = divergence._between(padded, [e for e, _ in pairs], [v for _, v in pairs], [len(t) for _, t in own])
    assert [w for w in rest.split(" ") if w] == [w for w in words if w not in terms]


def test_large_counts(spark):
    """Shares whose numerator passes 64 bits."""
    from pyspark.sql import functions as F

    cases = [(0, 3, 2), (10**10, 10**10, 7), (10**12, 3 * 10**12, 10**7), (10**13, 10**13, 10**9), (5, 10**15, 3)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, terms bigint")
    got = [r[0] for r in df.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in cases]


def test_query(spark):
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.op13_source_divergence(spark, SF)) == brute(docs)
