"""Files of token ids: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank among the corpus's ids, the most frequent first, so that common ids take one byte.
A rank takes one to four bytes, little-endian; two bits of a control byte hold each length, four to a control
byte, lowest bits first. Control bytes and data bytes are kept apart, so numpy finds all lengths by one table
lookup. Documents are held in blocks, in ascending doc_id order; Spark writes and commits the blocks.

A block: magic "LTF1", then little-endian documents (u4), ids (u8), control bytes (u8), data bytes (u8), a flag
and doc_id (u1, i8) and the number of ids (u4) of each document, the control bytes, the data bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROWS, Remembered, ddl, discard, settle, shared_dir, ship

MAGIC, HEAD = b"LTF1", struct.Struct("<4sIQQQ")
BLOCK_SCHEMA = "part int, start bigint, n_docs bigint, n_ids bigint, block binary"
TOKENS = "doc_id bigint, small boolean, ids binary, counts binary"
OUT_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
#: ASCII signs, and what str.split() takes for white space although regular expressions don't.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SEPARATORS, _RUNS = regex.compile("[\x1c-\x1f]"), regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++")
#: A comma or stop that alone ends a run, after an ASCII letter or digit.
_ENDING = re.compile(rb"([,.])(?<=[a-z0-9][,.])(?=[ \n])")
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8)[None, :] < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype("<u4") if n else np.zeros(0, dtype="<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    docs = np.zeros(len(doc_ids), dtype=[("known", "u1"), ("id", "<i8"), ("n", "<u4")])
    docs["known"], docs["id"], docs["n"] = [d is not None for d in doc_ids], [d or 0 for d in doc_ids], lengths
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(control), len(data)) + docs.tobytes() + control + data


def read_block(block: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    magic, n_docs, n_ids, n_control, n_data = HEAD.unpack_from(block)
    if magic != MAGIC or len(block) != HEAD.size + 13 * n_docs + n_control + n_data:
        raise ValueError("not a block of token ids")
    docs = np.frombuffer(block, dtype=[("known", "u1"), ("id", "<i8"), ("n", "<u4")], count=n_docs, offset=HEAD.size)
    at = HEAD.size + docs.nbytes
    ranks = unpack(block[at : at + n_control], block[at + n_control :], n_ids)
    return [int(i) if k else None for k, i in zip(docs["known"], docs["id"], strict=True)], docs["n"].tolist(), ranks


class ChunkTokenizer:
    """The tokenizers library, asked once for each distinct run between white space.

    A text is first cut at the tokenizer's added tokens, as they are written; each is one id. What lies between is
    ordinary text, where the library is told to take special strings as such. There the ids of runs, one after the
    other, are those of the whole for tokenizers that lower-case, drop white space, never join across it and cut
    letters and digits from signs, which is checked on a probe. In runs within Latin-1, where nothing composes,
    signs at the end are asked for apart, and letters go straight to the library's model, as nothing is left to
    normalise or cut. Every other run goes to the library whole and as it is written.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = "H" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "I"
        added = self.tokenizer.get_added_tokens_decoder()
        if any(not t.special or t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens of this tokenizer do more than match as they are written")
        self.added = {t.content: array(self.kind, [i]).tobytes() for i, t in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        # how the library writes each Latin-1 letter for its model
        self.written = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        width = array(self.kind).itemsize
        self.coded = [i.to_bytes(width, "little") for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        self.known = Remembered(self._ask, entries=400_000)
        probe = "a b\n\nc  It's x.y\tHÉÇ, \xb5\xaa\xdf42.!? \x1cdon't... re'l\x85(no) \u0130. \u0130x\n"
        probe += "".join(f" {c} x{c}, ({c}) {c}{c}. {c.upper()}x {c.upper()}" for c in self.added)
        want = self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        if self.encode([probe])[0].tolist() != want:
            raise ValueError("this tokenizer joins across white space or keeps capitals")

    def _runs(self, text: str) -> list[str]:
        """Runs between white space, A-Z lowered in texts within Latin-1, where that changes no normal form.

        There a comma or stop at a run's end is a run of its own, as `_ask` would ask for it, so that a word with it is not
        remembered once more.
        """
        try:
            text = _ENDING.sub(rb" \1", text.encode("latin-1").lower()).decode("latin-1")
        except UnicodeEncodeError:
            pass
        # str.split() also cuts at four control characters that are not white space
        return text.split() if not _SEPARATORS.search(text) else _RUNS.findall(text)

    def _ask(self, run: str) -> bytes:
        if run.isascii() and run.isalpha():
            ids = self.model.tokenize(run.lower())
            return self.coded[ids[0].id] if len(ids) == 1 else b"".join([self.coded[t.id] for t in ids])
        if run.isascii() or max(run) <= "\xff":
            if run.isalpha():
                run = run.lower()
                return b"".join([self.coded[t.id] for t in self.model.tokenize(run.translate(self.written))])
            core = run.rstrip(SIGNS)
            if core and len(core) < len(run) and core[-1].isalnum():
                return self.known[core] + self.known[run[len(core) :]]
        return array(self.kind, self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def coded_ids(self, text: str) -> bytes:
        """The ids of a text, as 16-bit integers if the whole vocabulary fits, else as 32-bit ones."""
        find = self.known.__getitem__
        parts = self.cut.split(text) if self.cut else [text]  # ordinary text and added tokens in turn
        coded = [b"".join(map(find, self._runs(parts[0])))]
        for token, plain in zip(parts[1::2], parts[2::2], strict=True):
            coded += [self.added[token], *map(find, self._runs(plain))]
        return b"".join(coded)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.coded_ids(t), dtype=self.kind) for t in texts]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker process, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return ChunkTokenizer(path)


def tokenize(docs: DataFrame, path: str, end: int | None) -> DataFrame:
    """(doc_id, small, ids, counts) of every document's whole text; null counts as empty. `end` is appended to each.

    ids are bytes of 16-bit integers (small) if the whole vocabulary and `end` fit, else of 32-bit ones; counts is null.
    The last row of a task that saw ids has counts alone: how often each id occurs in its texts, as 64-bit integers.
    """
    ship(docs.sparkSession)
    arrow = to_arrow_schema(ddl(TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        close, held = np.array([] if end is None else [end], dtype=tokenizer.kind).tobytes(), np.zeros(0, dtype=np.int64)

        def out(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids = [tokenizer.coded_ids(t or "") + close for t in batch.column("text").to_pylist()]
            held = _added(held, np.bincount(np.frombuffer(b"".join(ids), dtype=tokenizer.kind)))
            yield out(batch.column("doc_id").to_pylist(), [tokenizer.kind == "H"] * len(ids), ids, [None] * len(ids))
        if len(held):
            yield out([None], [None], [None], [held.tobytes()])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of counts, the shorter ones filled up by zeros."""
    n = max(len(a), len(b))
    return np.pad(a, (0, n - len(a))) + np.pad(b, (0, n - len(b)))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each document, from the columns small and ids."""
    return [np.frombuffer(x, dtype="<u2" if s else "<u4") for s, x in zip(batch.column("small").to_pylist(), batch.column("ids").to_pylist(), strict=True)]


def frequencies(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, how often it occurs), most frequent first, then by id, from the counts alone. Each task sends a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                held = _added(held, np.frombuffer(counts, dtype=np.int64))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["id", "n"])

    counts = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return sorted(((r.id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))  # as long as the vocabulary


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = None, block_ids: int = 1_000_000, part_ids: int = 64_000_000) -> None:
    """Write every document's ids to `folder`: blocks/ in ascending doc_id order, ranks/ with the id of each rank.

    Null doc_ids come first; equal doc_ids lie together, in any order. The parts are ranges of (doc_id, row number), so
    a doc_id with many rows is spread over several. Each is sorted and coded by one task, which writes blocks of
    about `block_ids` ids. There are as many parts as shuffle partitions, and more where one would pass `part_ids`.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id())
    tokens = settle(tokens, "tokens")
    counted = frequencies(tokens)
    ids = [i for i, _ in counted]
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(ids)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, dtype="<u4")
    rank_of[ids] = np.arange(len(ids), dtype="<u4")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        lists: list[np.ndarray] = []
        part, start, held = TaskContext.get().partitionId(), 0, 0

        def out():
            block = write_block(doc_ids, [len(x) for x in lists], rank_of[np.concatenate(lists)])
            row = zip(([part], [start], [len(doc_ids)], [held], [block]), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in row], names=["part", "start", "n_docs", "n_ids", "block"])

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), _arrays(batch), strict=True):
                if doc_ids and held + len(x) > block_ids:
                    yield out()
                    doc_ids, lists, start, held = [], [], start + held, 0
                doc_ids.append(d)
                lists.append(x)
                held += len(x)
        if doc_ids:
            yield out()

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n for _, n in counted) // part_ids + 1)
    parts = tokens.filter("counts IS NULL").select("doc_id", "small", "ids", "row").repartitionByRange(width, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    parts.select("doc_id", "small", "ids").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    discard(tokens)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """From the files, for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    What goes through the driver is one number for each part and the table of ranks, as long as the vocabulary.
    """
    ship(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    id_of = np.array([r.id for r in ranks], dtype="<u4")
    files = spark.read.parquet(f"{folder}/blocks")
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, lengths, coded = read_block(block)
                ids = id_of[coded] if len(coded) else coded
                ends = np.cumsum(lengths)
                at = ends - lengths
                crc = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, at + start + before[part], lengths, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "block").mapInArrow(run, OUT_SCHEMA)


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the ids of all documents, each closed by the id `end`, to the shared folder and read the files back.

    Null text counts as empty (the end id alone), a null doc_id comes first, repeated rows are written repeatedly,
    an empty table gives no blocks and no rows; other columns are ignored.
    """
    import uuid

    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, end)
    return read(docs.sparkSession, folder)
