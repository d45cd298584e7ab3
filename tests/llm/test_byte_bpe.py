import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from lorebase.llm import byte_bpe, queries

from .conftest import ROWS, SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.vocabulary(PATH, public_tokenizers.PATTERN)


def digests(library, text):
    ids = np.array(library.encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_perfect_hash():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(5000))
    assert all(table.find(f"other{i}".encode()) == -1 for i in range(1000))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t ab'sT1!é ", max_size=60))
def test_same_ids_as_the_library(bpe, library, text):
    ids = bpe.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_long_pretoken(bpe, library):
    text = "ab" * 20_000
    assert np.frombuffer(bpe.encode(text), dtype="<u4").tolist() == library.encode_ordinary(text)


def test_odd_rows(spark, odd, empty, library):
    got = sorted(map(str, (tuple(r) for r in byte_bpe.encode_digests(odd, PATH, public_tokenizers.PATTERN).collect())))
    assert got == sorted(str((i, *digests(library, t))) for i, t in ROWS)
    assert byte_bpe.encode_digests(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_round_trip(spark, odd):
    ids = byte_bpe.encode_ids(odd, PATH, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(ids, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(str((i, t or "")) for i, t in ROWS)


def test_query(spark, documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_byte_bpe(spark, SF).collect()}
    assert got == {d: digests(library, t) for d, t in zip(documents.doc_id, documents.text, strict=True)}
