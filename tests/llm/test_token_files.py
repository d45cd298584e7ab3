import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from lorebase.llm import queries, token_files
from tokenizers import Tokenizer

from .conftest import ROWS, SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows):
    coded = sorted((i is not None, i or 0, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in rows)
    out, start = [], 0
    for known, i, ids in coded:
        out.append((i if known else None, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_530, 65_540), max_size=40))
def test_pack(values):
    ranks = np.array(values, dtype="<u4")
    control, data = token_files.pack(ranks)
    assert token_files.unpack(control, data, len(ranks)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_block():
    block = token_files.write_block([None, -3, 7], [2, 0, 1], np.array([1, 70_000, 255]))
    ids, lengths, ranks = token_files.read_block(block)
    assert (ids, lengths, ranks.tolist()) == ([None, -3, 7], [2, 0, 1], [1, 70_000, 255])
    with pytest.raises(ValueError):
        token_files.read_block(block[:-1])


def same(got, want):
    """Rows of equal doc_id may come in either order, but must fill the same places."""
    rows = sorted((tuple(r) for r in got), key=lambda r: r[1])
    at = 0
    for r in rows:
        assert r[1] == at
        at += r[2]
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(key, rows)) == sorted(map(key, want))
    order = [r[0] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_odd_rows(odd, empty, library):
    same(token_files.write_and_read(odd, PATH).collect(), brute(library, ROWS))
    assert token_files.write_and_read(empty, PATH).collect() == []


def test_files(spark, odd, tmp_path, library):
    token_files.write(odd, str(tmp_path / "f"), PATH, end=1, block_ids=50)
    assert spark.read.parquet(str(tmp_path / "f/blocks")).count() > 4
    ranks = spark.read.parquet(str(tmp_path / "f/ranks")).orderBy("rank").collect()
    assert ranks[0].rank == 0 and len({r.id for r in ranks}) == len(ranks)
    same(token_files.read(spark, str(tmp_path / "f")).collect(), brute(library, ROWS))


def test_query(spark, documents, library):
    got = sorted((tuple(r) for r in queries.op8_token_files(spark, SF).collect()))
    assert got == sorted(brute(library, list(zip(documents.doc_id.tolist(), documents.text, strict=True))))


@pytest.fixture(scope="module")
def chunks():
    return token_files.ChunkTokenizer(PATH)


SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", ".", "'s", "\u0130", "\u0130.", "\u0130<|endoftext|>", "e\u0301", "\u0301", "\u0307x!", "\u03a3.", "\u212b", "A", "b", "42", "\u00bd)", "\n", "\x1c", "\u2028", "\u1e9e.", "\ufb01", "\u0149!", "\U0001f600"])


@settings(max_examples=600, deadline=None)
@given(st.lists(SPECIAL | st.text(max_size=8) | st.text(alphabet="aB.'sé\u0130\u0307 !<|>", max_size=12), max_size=14).map("".join))
def test_whole_texts_as_the_library(chunks, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert chunks.encode([text])[0].tolist() == want and chunks.encode([text])[0].tolist() == want


def test_memory_is_bounded(chunks):
    """Long runs are never kept, and the others only up to a number of characters."""
    for k in range(20):
        chunks.encode([f"{k}" + "xyz" * 20_000])
    assert max(map(len, chunks.known)) <= 64
    from lorebase.llm.common import Remembered

    found = Remembered(len, entries=10, held=100, longest=20)
    assert [found["a" * n + str(k)] for k in range(40) for n in (3, 30)] == [len("a" * n + str(k)) for k in range(40) for n in (3, 30)]
    assert len(found) <= 10 and len(found.old) <= 10 and max(map(len, found)) <= 20


def test_hot_doc_id(spark, library):
    """Rows of one doc_id are dealt to several parts and still lie together."""
    rows = [(7, f"text {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)] + [(k, "a b c") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = token_files.shared_dir(spark) + "/hot"
    token_files.write(df, folder, PATH, end=1)
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() > 2
    same(token_files.read(spark, folder).collect(), brute(library, rows))


def test_added_tokens(library):
    """Special strings are single ids as they are written, and plain signs and letters in capitals."""
    texts = ["end <|endoftext|> next", "<|startoftext|>A Word<|endoftext|>", "<|ENDOFTEXT|>x <|EndOfText|>", "(<|startoftext|>), <|endoftext|>!", "<|endoftext|><|endoftext|>. Don't", "日本 <|endoftext|> <|ENDOFTEXT|> <|StartOfText|>..", "<|endoftext |> |endoftext|>", "É<|startoftext|>É <|endoftext|>."]
    tokenizer = token_files.ChunkTokenizer(PATH)
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in tokenizer.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokenizer.encode(["end <|endoftext|> next"])[0].tolist() == [806, 49407, 1131]


def test_words_before_commas_and_stops_are_remembered_once(library):
    """A word is asked for once, however it ends, and ids stay the library's."""
    texts = ["Zorbing, zorbing. zorbing\nzorbing.\nZORBING, (zorbing, zorbing), zorbing.. zorbing., 4.5, 4, x-, \xe9, \xe9a. \x1ca, b.\x1c c.", "don't, it's. u.s.a. a,b, ,, . a,\tb.\u3000c, "]
    tokenizer = token_files.ChunkTokenizer(PATH)
    for _ in range(2):
        assert [x.tolist() for x in tokenizer.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    asked = [x for x in (*tokenizer.known, *tokenizer.known.old) if x.startswith("zorbing")]
    assert "zorbing" in asked and "zorbing," not in asked and "zorbing." not in asked


def test_ids_are_counted_as_they_are_made(spark, odd, empty, library):
    """Counts come from the tasks that tokenize; ids are not read again for them."""
    tokens = token_files.tokenize(odd, PATH, 1)
    want = Counter(i for _, t in ROWS for i in [*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert token_files.frequencies(tokens.drop("ids")) == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    assert token_files.frequencies(token_files.tokenize(empty, PATH, 1)) == []
