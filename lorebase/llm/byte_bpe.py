"""Byte-level BPE: encoding by the ranks of a vocabulary file, and decoding.

A text is cut by the vocabulary's pattern into pre-tokens. A minimal perfect hash finds those that are tokens
themselves. The others are merged by a heap of ranked pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import Remembered, map_rows

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id bigint, ids array<int>"

#: White space of Unicode. No pre-token crosses from another character into white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings: hash and displace, one displacement for each bucket of about three keys.

    A bucket's keys go to the slots of the first displacement that finds them all free; a bucket of one key is put
    last and holds its slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes = np.diff(cut)
        shift, place = np.zeros(self.m, dtype=np.int64), np.full(self.n, -1)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            own = order[cut[b] : cut[b + 1]]
            d, step = 0, 64
            while True:
                at = np.sort(self._slots(hashes[own], np.arange(d, d + step)), axis=1)
                good = np.flatnonzero((place[at] < 0).all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
                if len(good):
                    break
                d, step = d + step, min(8192, 2 * step)
            shift[b] = d + good[0]
            place[self._slots(hashes[own], shift[b : b + 1])[0]] = own
        alone, free = np.flatnonzero(sizes == 1), np.flatnonzero(place < 0)
        shift[alone] = -1 - free
        place[free] = order[cut[alone]]
        self.shift, self.place = shift.tolist(), place.tolist()
        self.slots = [keys[i] for i in self.place]

    def _slots(self, hashes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """slot() of each shift (rows) and hash (columns)."""
        with np.errstate(over="ignore"):
            x = (hashes >> np.uint64(17))[None, :] + shifts.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def slot(self, h: int, d: int) -> int:
        x = ((h >> 17) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def find(self, key: bytes) -> int:
        """The key's place in the list that was hashed, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.m]
        s = -1 - d if d < 0 else self.slot(h, d)
        return self.place[s] if self.slots[s] == key else -1


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the pair of lowest rank, the leftmost of equals, becomes one token.

    right[i] is where the token that starts at i ends, or 0 once another has taken it in; before[i] is where
    the token before it starts. n bytes take O(n log n).
    """
    n = len(piece)
    right, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = right[i]
        if not mid or mid >= n or right[mid] != end:
            continue
        right[i], right[mid] = end, 0
        if end < n:
            before[end] = i
            stop = right[end]
            if (r := ranks.get(piece[i:stop])) is not None:
                heapq.heappush(heap, (r, i, stop))
        if i and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary. Ids of short chunks of text are remembered, in bounded memory."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.id_at = list(self.ranks.values())
        self.bytes_of = [b""] * (max(self.id_at) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.pretokens = regex.compile(pattern).findall
        self.chunks = regex.compile(f"[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++").findall
        self.seen = Remembered(self._encode_chunk)

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for token in self.pretokens(chunk):
            piece = token.encode()
            at = self.hash.find(piece)
            if at >= 0:
                ids.append(self.id_at[at])
            else:
                ids += heap_merge(piece, self.ranks)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.seen.__getitem__, self.chunks(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process, kept between its tasks."""
    return ByteBPE(path, pattern)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document; null text counts as empty. Other columns are ignored."""

    def start():
        bpe = vocabulary(path, pattern)
        return lambda ids, texts: (ids, [np.frombuffer(bpe.encode(t or ""), dtype="<u4").tolist() for t in texts])

    return map_rows(docs.select("doc_id", "text"), IDS_SCHEMA, start)


def decode_ids(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become replacement characters, null ids null."""

    def start():
        bpe = vocabulary(path, pattern)
        return lambda doc_ids, lists: (doc_ids, [None if x is None else b"".join(map(bpe.bytes_of.__getitem__, x)).decode("utf-8", "replace") for x in lists])

    return map_rows(ids.select("doc_id", "ids"), "doc_id bigint, text string", start)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each document: n_tokens, SHA-256 of its ids, and of the bytes that the ids decode to.

    Null text counts as empty (0 tokens), a null doc_id stays null, repeated rows give repeated rows, an empty
    table gives an empty one; other columns are ignored. One pass without a shuffle.
    """

    def start():
        bpe = vocabulary(path, pattern)

        def work(ids, texts):
            coded = [bpe.encode(t or "") for t in texts]
            return ids, [len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded]

        return work

    return map_rows(docs.select("doc_id", "text"), SCHEMA, start)
