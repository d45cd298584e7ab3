"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised. A table of the index quantises `projections` random Gaussian projections into steps of
`width`; vectors that share all steps share a bucket. Only numbers of vectors are shuffled by bucket, with a sketch
of 128 signs that tells unlike pairs apart; pairs that remain fetch their vectors once, for an exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from .common import discard, settle, ship
from .components import components

ROWS = ("key", "tag", "node", "sketch0", "sketch1")
MET_SCHEMA = "a bigint, b bigint, tag int"
FOUND_SCHEMA = "a bigint, b bigint, links bigint"


def same_step(distance: float, width: float) -> float:
    """The probability that a projection puts two vectors at a distance into one step."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


@dataclass(frozen=True)
class Lsh:
    """How many tables, and projections in each; `fitting` gives those for a number of vectors.

    block: members of a bucket that are compared at once; larger buckets are compared in pairs of blocks.
    apart: differing signs of the sketches from which a pair is not looked at. At cosine 0.95 signs differ with
    probability 0.101, so 34 of 128 or more do less than once in 10^7 pairs; at cosine 0.3 nearly all pairs do.
    dense: from so many pairs for each member, the members fetch their vectors instead of the pairs.
    """

    tables: int = 12
    projections: int = 10
    width: float = 2.0
    seed: int = 7
    block: int = 1024
    apart: int = 34
    dense: int = 4

    @classmethod
    def fitting(cls, n: int, recall: float = 0.985, least: float = 0.95, bucket: int = 40, **other) -> Lsh:
        """As many projections as leave about `bucket` unlike vectors of n in a bucket, and as many tables as find a
        pair at cosine `least` with probability `recall`, ten at least. Both grow slowly, so that work for each vector does."""
        width = cls.width
        k = max(4, math.ceil(math.log(max(1.0, n / bucket)) / -math.log(same_step(math.sqrt(2), width))))
        hit = same_step(math.sqrt(2 - 2 * least), width) ** k
        return cls(tables=max(10, math.ceil(math.log(1 - recall) / math.log(1 - hit))), projections=k, **other)

    def planes(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r = np.random.default_rng([self.seed, size])
        n = self.tables * self.projections
        mix = r.integers(1, 2**63, (self.tables, self.projections + 1), dtype=np.int64) | 1
        return r.standard_normal((size, n)), r.uniform(0, self.width, n), mix, r.standard_normal((size, 128))

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers, a row for each vector and a column for each table; size and table are mixed in."""
        planes, offset, mix, _ = self.planes(unit.shape[1])
        steps = np.floor((unit @ planes + offset) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        with np.errstate(over="ignore"):
            h = (steps * mix[:, :-1]).sum(axis=2) + mix[:, -1] * unit.shape[1]
            return h ^ (h >> 29)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """The signs of 128 further projections as two numbers."""
        return np.packbits(unit @ self.planes(unit.shape[1])[3] > 0, axis=1).view("<i8")

    def first_meeting(self, left: np.ndarray, right: np.ndarray, no: np.ndarray) -> np.ndarray:
        """Whether pairs of vectors, row by row, share no bucket in a table before `no`."""
        out = np.ones(len(left), dtype=bool)
        for at in range(0, len(left), 20_000):
            part = slice(at, at + 20_000)
            same = self.signatures(left[part]) == self.signatures(right[part])
            out[part] = ~(same & (np.arange(self.tables)[None, :] < no[part, None])).any(axis=1)
        return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits of two sketches differ. (Of signed numbers numpy counts the bits of the absolute value.)"""
    return np.bitwise_count((a[..., 0] ^ b[..., 0]).view(np.uint64)) + np.bitwise_count((a[..., 1] ^ b[..., 1]).view(np.uint64))


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Normalised rows in double precision; a power of two is taken out first, so no square over- or underflows."""
    v = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(kind: str):
    """(vec_id, vector): the bytes of the vector, or null if it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in x or ()], dtype=kind) + np.array(0, dtype=kind)  # no -0.0
                vectors.append(v.tobytes() if v.any() and np.isfinite(v).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    return run


def _by_size(raw: np.ndarray, most: int = 500) -> Iterator[np.ndarray]:
    """Places of vectors of equal length, `most` at a time."""
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield from np.array_split(own, -(-len(own) // most))


def _index(lsh: Lsh, kind: str):
    """(node, keys, sketch0, sketch1) of (node, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raw = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), dtype=object)
            for own in _by_size(raw):
                unit = unit_rows(list(raw[own]), kind)
                keys, signs = lsh.signatures(unit), lsh.sketches(unit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, lsh.tables), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                columns = [pa.array(nodes[own], pa.int64()), lists, *(pa.array(signs[:, c], pa.int64()) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "keys", "sketch0", "sketch1"])

    return run


def _meet(lsh: Lsh):
    """For rows sorted by key: pairs of nodes whose sketches are alike, as (a, b, table); of a dense group its members
    instead, as (key, node, tag), where tag is negative. A key's rows are those of a block, or of two blocks."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([*held, rows], axis=1)
            ends = np.flatnonzero(np.diff(rows[0])) + 1
            begins = np.append(0, ends)
            for a, b in zip(begins[:-1], ends, strict=True):
                if b - a > 1:
                    yield rows[:, a:b]
            held = [rows[:, begins[-1] :]]
        if held and held[0].shape[1] > 1:
            yield held[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for key, tag, node, *signs in groups(batches):
            sketch = np.stack(signs, axis=1)
            left, right = tag % 4 != 1, tag % 4 != 0
            if not left.any() or not right.any():
                continue
            near = (differing(sketch[left][:, None], sketch[right][None, :]) < lsh.apart) & ((node[left][:, None] < node[right][None, :]) | (tag[0] % 4 != 2))
            x, y = np.nonzero(near)
            if not len(x):
                continue
            if len(x) > lsh.dense * len(node):
                found.append(np.array([key, node, -1 - tag]))
            else:
                a, b = node[left][x], node[right][y]
                found.append(np.array([np.minimum(a, b), np.maximum(a, b), np.full(len(a), tag[0] // 4)]))
            if sum(f.shape[1] for f in found) > 50_000:
                yield met(found)
                found = []
        if found:
            yield met(found)

    def met(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, tag = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tag, pa.int32())], names=["a", "b", "tag"])

    return run


def _links(a: list[int], b: list[int | None], links: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, links)], names=["a", "b", "links"])


def _verify(lsh: Lsh, least: float, kind: str):
    """Of pairs (a, b, no, their vectors and copies) the linked ones that meet first in table no: (b, a, 0) to
    connect them, and (node, null, links) for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, no, a_copies, b_copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "no", "a_copies", "b_copies"))
            left, right = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("a_vector", "b_vector"))
            for own in _by_size(left):
                own = own[[len(left[k]) == len(right[k]) for k in own]]
                if not len(own):
                    continue
                x, y = unit_rows(list(left[own]), kind), unit_rows(list(right[own]), kind)
                linked = (x * y).sum(axis=1) >= least
                linked[linked] = lsh.first_meeting(x[linked], y[linked], no[own][linked])
                k, n = own[linked], int(linked.sum())
                if n:
                    yield _links([*b[k], *a[k], *b[k]], [*a[k].tolist(), *[None] * (2 * n)], [*[0] * n, *b_copies[k], *a_copies[k]])

    return run


def _forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smaller node) that connect what the hits connect, one for each node but the smallest."""
    nodes = np.unique(np.concatenate([left, right]))
    i, j = np.nonzero(hits)
    i, j = np.searchsorted(nodes, left[i]), np.searchsorted(nodes, right[j])
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = low[low]
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return [(int(nodes[k]), int(nodes[low[k]])) for k in moved]


def _compare(lsh: Lsh, least: float, kind: str):
    """For rows (key, tag, node, copies, vector) sorted by key: exact cosines within a dense block, or between two.

    A pair counts in the first table in which it meets. Gives (node, smaller node, 0) to connect what is linked,
    and (node, null, links) with how many vectors the node was found linked to, copies included. Members whose
    vectors differ in length, which met by chance, are compared among those of their own length.
    """

    def groups(batches: Iterator[pa.RecordBatch]):
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    yield rows
                    key, rows = k, []
                rows.append(row)
        yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in groups(batches):
            for size in sorted({len(r[3]) for r in mixed}):
                rows = [r for r in mixed if len(r[3]) == size]
                tags, nodes, copies = (np.array([r[c] for r in rows]) for c in range(3))
                unit = unit_rows([r[3] for r in rows], kind)
                left, right, no = tags % 4 != 1, tags % 4 != 0, int(tags[0]) // 4
                if not left.any() or not right.any():
                    continue
                hits = unit[left] @ unit[right].T >= least
                if tags[0] % 4 == 2:
                    np.fill_diagonal(hits, False)
                if no and hits.any():
                    x, y = np.nonzero(hits)
                    keys = lsh.signatures(unit)[:, :no]
                    for at in range(0, len(x), 20_000):
                        part = slice(at, at + 20_000)
                        again = (keys[left][x[part]] == keys[right][y[part]]).any(axis=1)
                        hits[x[part][again], y[part][again]] = False
                if not hits.any():
                    continue
                joined = _forest(hits, nodes[left], nodes[right])
                counts = [(int(n), int(c)) for n, c in zip(nodes[left], (hits * copies[right][None, :]).sum(axis=1), strict=True) if c]
                if tags[0] % 4 != 2:
                    counts += [(int(n), int(c)) for n, c in zip(nodes[right], (hits * copies[left][:, None]).sum(axis=0), strict=True) if c]
                a, b = [x for x, _ in joined] + [x for x, _ in counts], [x for _, x in joined] + [None] * len(counts)
                yield _links(a, b, [0] * len(joined) + [c for _, c in counts])

    return run


def _in_blocks(rows: DataFrame, lsh: Lsh) -> DataFrame:
    """Rows (key, no, node, sketch0, sketch1) as ROWS, those of buckets over `block` rows dealt into pairs of blocks.

    tag is 4 * no + 2 in a group that is compared with itself, and 4 * no + 0 or 1 on the two sides of another.
    """
    large = settle(rows.groupBy("key").count().filter(F.col("count") > lsh.block), "large-buckets")
    whole = (F.col("no") * 4 + 2).cast("int").alias("tag")
    if large.isEmpty():
        discard(large)
        return rows.select("key", whole, *ROWS[2:])
    parts = F.ceil(F.col("count") / lsh.block).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = rows.join(large, "key").select("key", "no", *ROWS[2:], own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(pair.alias("key"), (F.col("no") * 4 + side).cast("int").alias("tag"), *ROWS[2:])
    return rows.join(large.select("key"), "key", "left_anti").select("key", whole, *ROWS[2:]).unionByName(dealt)


def link(vectors: DataFrame, least: float = 0.95, lsh: Lsh | None = None) -> DataFrame:
    """A row for each vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors whose cosine is `least` or more, in double precision, are linked if they share a bucket of a table.
    component_id is the smallest vec_id reachable. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal vectors are collapsed to a node first
    and count as linked to each other. Repeated rows give repeated rows that link with each other; an empty table
    gives an empty one; other columns are ignored.

    A pair that meets in several tables counts in the first. Groups in which most pairs are alike are compared as
    matrices and give a forest of links and counts, not their pairs; a cluster of n different vectors within `least` of
    each other still takes n * n multiplications, as the counts are exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == FloatType() else "<f8"
    clean = settle(vectors.select("vec_id", "embedding").mapInArrow(_usable(kind), "vec_id bigint, vector binary"), "vectors")
    nodes = clean.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lsh = lsh or Lsh.fitting(nodes.count(), least=least)
    index = settle(nodes.select("node", "vector").mapInArrow(_index(lsh, kind), "node bigint, keys array<bigint>, sketch0 bigint, sketch1 bigint"), "index")
    rows = _in_blocks(index.select(F.posexplode("keys").alias("no", "key"), *ROWS[2:]), lsh)
    met = settle(rows.repartition("key").sortWithinPartitions("key").select(*ROWS).mapInArrow(_meet(lsh), MET_SCHEMA), "met")
    discard(index)

    pairs = met.filter("tag >= 0").groupBy("a", "b").agg(F.min("tag").alias("no"))
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("vector").alias(f"{side}_vector"), F.col("copies").alias(f"{side}_copies"))
    sure = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_verify(lsh, least, kind), FOUND_SCHEMA)
    members = met.filter("tag < 0").select(F.col("a").alias("key"), F.col("b").alias("node"), (-1 - F.col("tag")).alias("tag"))
    members = members.join(nodes.select("node", "copies", "vector"), "node").select("key", "tag", "node", "copies", "vector")
    dense = members.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(lsh, least, kind), FOUND_SCHEMA)
    found = settle(sure.unionByName(dense), "links")
    discard(met)

    groups = components(found.filter("b IS NOT NULL").select("a", "b")).join(nodes.select("node", "low"), "node")
    reached = groups.select("node", "root").join(groups.groupBy("root").agg(F.min("low").alias("least")), "root")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = nodes.join(reached, "node", "left").join(counts, F.col("node") == F.col("a"), "left")
    named = named.select(F.col("vector").alias("same"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "low").alias("least"))
    out = clean.join(named, F.col("vector") == F.col("same"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
