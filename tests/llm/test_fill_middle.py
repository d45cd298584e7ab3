import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from lorebase.llm import fill_middle, queries

from .conftest import ROWS, SF

MARKED = [(20, "a<P>b"), (21, "<<S>"), (22, "<P <S <M"), (23, "ä<Mä>\U0001f600" * 50), (24, "<M>"), (25, "<<<<P<S<M<"), (26, "€" * 999), (27, "x" * 400 + "<P>" + "y" * 400)]


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(t) + 1) for x in h[:2])
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        text = {"plain": t, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        cut = (None, None) if form == "plain" else (a, b - a)
        out.append((i, len(t), form, *cut, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def automaton():
    return fill_middle.code_points(fill_middle.MARKS)


def plain_scan(a, text, state):
    """The automaton, a byte at a time: the state after the last byte, and after how many bytes each unit has ended."""
    ends = []
    for k, byte in enumerate(text):
        if a.ends[state, byte]:
            ends.append(k + 1)
        state = int(a.step[state, byte])
    return state, ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM> abä€\U0001f600"), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_scan_from_every_state(automaton, texts, size):
    """Functions of stretches that begin in the midst of a code point or mark, and every cut."""
    pieces = [p for t in texts for p in ([t.encode()[k : k + size] for k in range(0, len(t.encode()), size)] or [b""])]
    scan = fill_middle.Scan(automaton, pieces)
    for s in range(len(automaton.step)):
        end, n = scan.tree.whole(np.full(len(pieces), s))
        for k, piece in enumerate(pieces):
            state, ends = plain_scan(automaton, piece, s)
            assert (end[k], n[k]) == (state, len(ends))
            which = np.full(len(ends) + 1, k)
            assert scan.cut(which, np.full(len(which), s), np.arange(len(which))).tolist() == [0, *ends]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("<PSM> abä€\U0001f600"), max_size=200))
def test_marks_and_code_points(automaton, text):
    state, ends = plain_scan(automaton, text.encode(), 0)
    assert len(ends) == len(text)
    assert bool(automaton.found[state]) == any(m in text for m in fill_middle.MARKS)


def test_odd_rows(spark, odd, empty):
    more = spark.createDataFrame(MARKED, "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    for chunk in (fill_middle.CHUNK, 7, 1):  # by chunks of 1 byte only texts that stay short
        own = docs if chunk > 1 else docs.filter("length(text) < 2000 OR text IS NULL")
        want = [r for r in [*ROWS, *MARKED] if chunk > 1 or len(r[1] or "") < 2000]
        if chunk == 7:
            own, want = docs.filter("length(text) < 50000 OR text IS NULL"), [r for r in [*ROWS, *MARKED] if len(r[1] or "") < 50_000]
        assert rows(fill_middle.digests(own, chunk=chunk)) == brute(want)
    assert rows(fill_middle.digests(odd)) == brute(ROWS)
    assert fill_middle.digests(empty).collect() == []


def test_giant_text(spark):
    """Some megabytes in chunks of 64 KiB, code points across their borders, and a mark across one of them."""
    body = "Wörter € \U0001f600 " * 150_000
    cut = body.encode()[: fill_middle.CHUNK - 1].decode(errors="ignore")
    texts = [(1, body), (2, body[:-1]), (2, body[:-1]), (3, "x" * (fill_middle.CHUNK - 2) + "<S>" + body), (4, cut), (None, body)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert rows(fill_middle.digests(docs)) == brute(texts)


def test_outputs(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of ä few") for k in range(200)], "doc_id bigint, text string")
    got = fill_middle.transform(docs, marks=("[PRE]", "[SUF]", "[MID]"), plain=30, spm=50).collect()
    forms = [r.form for r in got]
    assert 30 < forms.count("plain") < 90 and 40 < forms.count("spm") < 100
    for r in got:
        text = f"text number {r.doc_id} of ä few"
        a, b = r.prefix_chars or 0, (r.prefix_chars or 0) + (r.middle_chars or 0)
        want = {"plain": text, "psm": f"[PRE]{text[:a]}[SUF]{text[b:]}[MID]{text[a:b]}", "spm": f"[SUF]{text[b:]}[PRE]{text[:a]}[MID]{text[a:b]}"}
        assert r.output == want[r.form]


def test_query(spark, documents):
    assert rows(queries.op11_fill_in_middle(spark, SF)) == brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))
