import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from lorebase.llm import piece_count, queries

from .conftest import ROWS, SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet=" \n\t▁ab</s>é", max_size=60), max_size=8))
def test_same_counts_as_the_library(model, texts):
    assert piece_count.counter(PATH).count(texts) == [len(model.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=2, max_size=400) | st.text(alphabet="etaoin▁", min_size=1, max_size=300) | st.text(alphabet="01=-a", min_size=1, max_size=200), min_size=1, max_size=4), st.integers(1, 4))
def test_repeated_pairs(model, texts, times):
    """Few letters make the same pairs again and again, also overlapping ones."""
    texts = [t * times**2 for t in texts]  # the longer ones are held in parts
    assert piece_count.counter(PATH).count_sequences([piece_count.SPACE + t for t in texts]) == [len(model.encode(t)) for t in texts]


def test_long_natural_text(model):
    import random

    r = random.Random(4)
    words = "the of and internation station ability pre under standing work er ness re form".split()
    text = "".join(r.choice(words) for _ in range(8000))
    counts = piece_count.counter(PATH)
    assert counts.count([text, text[1:]]) == [len(model.encode(t)) for t in (text, text[1:])]
    assert max(map(len, counts.known)) <= 64


@pytest.mark.parametrize("text", ["ab" * 5000, "a" * 511, "a" * 512, "aaaa" * 3000 + " b", "é" * 2000, "漢字" * 900, " " * 3000, " " * 100_000, "=-" * 20_000, "-" * 50_001 + "x", "acgt" * 9000 + "tgca" * 5000])
def test_long_sequences(model, text):
    assert piece_count.counter(PATH).count([text]) == [len(model.encode(text))]


def test_odd_rows(odd, empty, model):
    got = sorted(str(tuple(r)) for r in piece_count.count_tokens(odd, PATH, 100).collect())
    n = [len(model.encode(t or "")) for _, t in ROWS]
    assert got == sorted(str((i, len((t or "").encode()), k, k > 100)) for (i, t), k in zip(ROWS, n, strict=True))
    assert piece_count.count_tokens(empty, PATH).collect() == []


def test_query(spark, documents, model):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_token_counts(spark, SF).collect()}
    n = {d: len(model.encode(t)) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    assert got == {d: (len(t.encode()), n[d], n[d] > 4096) for d, t in zip(documents.doc_id, documents.text, strict=True)}
