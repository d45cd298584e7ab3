"""Links between documents that share most of their word shingles, found by SimHash with ball hashing.

One fingerprint of 64 bits seldom lies within two bits of that of a text that shares four fifths of its shingles. So
each text has several shorter fingerprints of its set of shingles. In each, all variants within one bit are emitted;
texts that meet in a variant are compared by all their bits, and then exactly by their shingles.

The texts of a variant's bucket are compared as arrays of bits, and what passes is told as a forest, not as pairs. Its
trees are groups of texts that may be linked. Their sets of shingles are compared exactly, a group at a time, by products of
incidence matrices, large groups in pairs of parts. So a group of n copies gives links in proportion to n, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, repeat
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import discard, map_rows, settle, ship
from .components import components
from .keeping import marked, row_key

SIZE, SIMILARITY, RECALL, SEED = 5, 0.8, 0.9, 42

#: The most members of a bucket that are compared at once; larger buckets are compared in pairs of parts.
BLOCK = 1024

#: The fewest bits of a fingerprint.
FEWEST = 30

#: How many fingerprints of a text emit their variants at once; what they shuffle is removed before the next ones do.
TABLES = 8

#: About how many sets, and how many shingles, one side of an exact comparison holds; larger groups are compared in pairs of parts.
SETS, SHINGLES = 128, 2_000_000

#: Columns of the incidence matrices that sets are compared by, at a time.
COLUMNS = 4096
KEY = "key struct<last: boolean, doc_id: bigint, md5: string>"


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's word shingles, as in SimHash; without words there are none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def differing(similarity: float) -> float:
    """The most a bit differs, as a probability, between sets whose Jaccard similarity is at least this."""
    return acos(2 * similarity / (1 + similarity)) / pi


def plan(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): how many fingerprints a text has, and of how many bits.

    With nine bits more than the number of rows has, a text meets about one other by chance in each table. Up to two
    million rows the plan is one, so that variants grow with the rows alone. There are as many tables as it takes for a pair at the threshold to lie within two bits in one of them with
    probability `recall`; closer pairs are found more surely.
    """
    bits, p = min(48, max(FEWEST, rows.bit_length() + 9)), differing(similarity)
    within = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return ceil(log(1 - recall) / log(1 - within)), bits


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits for each hash, by a multiplication and two shifts for each k."""
    h = h ^ np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sketch(h: np.ndarray, tables: int, bits: int) -> list[int]:
    """The fingerprints of a set of hashes: a bit is 1 if it is set in over half of them."""
    words, ones = ceil(tables * bits / 64), np.zeros(64 * ceil(tables * bits / 64), np.int64)
    for at in range(0, len(h), 8_192):
        part = np.stack([mixed(h[at : at + 8_192], k) for k in range(words)], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    each = (2 * ones > len(h))[: tables * bits].reshape(tables, bits)
    return (each @ (np.int64(1) << np.arange(bits, dtype=np.int64))).tolist()


def sketches(docs: DataFrame, tables: int, bits: int, size: int = SIZE) -> DataFrame:
    """(key, sig, n, fps) of every row: its key, its set's digest and number of shingles, its fingerprints."""

    def work(texts: list, _: list, keys: list) -> tuple[list, ...]:
        sets = [shingles(t, size) for t in texts]
        return keys, [xxh3_128_digest(h.tobytes()) for h in sets], [len(h) for h in sets], [sketch(h, tables, bits) for h in sets]

    return map_rows(docs.select("text", "doc_id", row_key().alias("key")), f"{KEY}, sig binary, n int, fps array<bigint>", lambda: work)


def fetched(ids: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """A settled table (node, h) of the shingles of the nodes `ids`."""
    wanted = settle(nodes.join(ids, "node").select("node", F.col("low").alias("key")), "wanted")
    texts = marked(docs, wanted.select("key")).select("text", row_key().alias("key")).groupBy("key").agg(F.first("text").alias("text"))
    texts = texts.join(wanted, "key").select("node", "text")
    out = settle(map_rows(texts, "node bigint, h array<bigint>", lambda: lambda n, t: (n, [shingles(x, size).view(np.int64) for x in t])), "sets")
    discard(wanted)
    return out


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, low) whose sets of shingles (node, h) have the Jaccard similarity."""
    mine, other = (sets.select(F.col("node").alias(c), F.col("h").alias(f"h_{c}")) for c in ("node", "low"))
    shared = F.size(F.array_intersect("h_node", "h_low"))
    return pairs.join(mine, "node").join(other, "low").filter(shared >= similarity * (F.size("h_node") + F.size("h_low") - shared)).select("node", "low")


def in_parts(rows: DataFrame, keys: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """Rows (keys, i, j, part, columns) of a table with `parts`: each row lies in one of its key's parts, by the columns `by`.

    It comes once for each pair of parts i <= j that holds its own, so all pairs of nodes meet, in no more than two parts at once.
    """
    part, other = F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.select(*keys, part.alias("part"), other.alias("other"), *columns)
    return dealt.select(*keys, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *columns)


def emitted(cells: DataFrame, bits: int, first: int) -> DataFrame:
    """One number `code` for each variant within one bit of each fingerprint (t, fp, many): table, variant, the bit that was flipped, copies.

    The last two take six bits each: `bits` where none was flipped, and the power of two that `many` does not exceed.
    """
    flip = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("flip")
    left = lambda c, by: F.call_function("shiftleft", c.cast("bigint"), by)
    rows = cells.select("fp", left(F.col("t") - first, F.lit(bits)).alias("t"), F.when(F.col("many") > 1, F.length(F.bin(F.col("many") - 1))).otherwise(0).alias("copies"), flip)
    mask = F.when(F.col("flip") < bits, left(F.lit(1), F.col("flip"))).otherwise(F.lit(0).cast("bigint"))
    variant = F.col("t").bitwiseOR(F.col("fp").bitwiseXOR(mask))
    return rows.select(left(variant, F.lit(12)).bitwiseOR(left(F.col("flip"), F.lit(6))).bitwiseOR(F.col("copies")).alias("code"))


def needed(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted codes are of a pair that is told at their variant, as in `likely`; how many nodes the variant has of these, at most twice.

    Two fingerprints at a variant are told there if its bit is 0 where the higher one of their flipped bits is; equal ones at themselves.
    """
    at, flip, copies = codes >> 12, codes >> 6 & 63, codes & 63
    own, place = flip == bits, np.arange(len(codes))
    begin = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
    many = np.diff(begin, append=len(at))
    zero = ~own & (at >> flip & 1 == 0)
    top = np.maximum.reduceat(np.where(zero, place, -1), begin)
    paired = (top >= 0) & ((top > begin) | own[begin + many - 1])
    need = np.repeat(paired, many) & ((place <= np.repeat(top, many)) | own) | own & (copies > 0)
    return need, np.repeat(np.add.reduceat(np.where(need, 1 << copies, 0), begin), many)


def met(nodes: DataFrame, bits: int, tables: range | None = None) -> DataFrame:
    """A settled table of buckets of two nodes or more, in rows (at, parts, fp, chunk, members); a bucket is a variant of a table.

    Equal fingerprints emit their variants once, so that a variant is shuffled for at most bits + 1 fingerprints, however
    many nodes have them, as a number that tells the fingerprint too. Variants are sorted by Spark, and only fingerprints of
    pairs that are told there go on. A row has all nodes (node, n, fps) of a fingerprint, or a chunk where there are many.
    With `tables`, only buckets of these are made.
    """
    block, room, first = BLOCK, max(1, BLOCK // 8), tables[0] if tables is not None else 0
    some = F.slice("fps", first + 1, len(tables)) if tables is not None else F.col("fps")
    members = nodes.filter("n > 0").select("node", F.posexplode(some).alias("t", "fp")).select("node", (F.col("t") + first).alias("t"), "fp")
    cells = members.groupBy("t", "fp").agg(F.count(F.lit(1)).alias("many"))
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty(0, np.int64)
        for batch in chain(batches, [None]):
            codes = rest if batch is None else np.concatenate([rest, batch.column(0).to_numpy()])
            if batch is not None and len(codes):  # more codes of the last variant may follow
                cut = np.searchsorted(codes, codes[-1] >> 12 << 12)
                codes, rest = codes[:cut], codes[cut:]
            if not len(codes):
                continue
            need, size = needed(codes, bits)
            codes, size = codes[need], size[need]
            if not len(codes):
                continue
            t, variant, flip = first + (codes >> 12 + bits), codes >> 12 & ((1 << bits) - 1), codes >> 6 & 63
            fp = np.where(flip < bits, variant ^ (1 << flip), variant)
            yield pa.RecordBatch.from_arrays([pa.array(t << 48 | variant), pa.array(t, pa.int32()), pa.array(fp), pa.array(-(-size // block), pa.int32()), pa.array(1 << (codes & 63))], names=["at", "t", "fp", "parts", "many"])

    codes = emitted(cells, bits, first).repartition(F.shiftright("code", 12)).sortWithinPartitions("code")
    found = settle(codes.mapInArrow(run, "at bigint, t int, fp bigint, parts int, many bigint"), "found")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / room)).alias("chunk")
    used = members.join(found.groupBy("t", "fp").agg(F.max("many").alias("many")), ["t", "fp"]).join(nodes.select("node", "n", "fps"), "node")
    lists = used.groupBy("t", "fp", chunk).agg(F.collect_list(F.struct("node", "n", "fps")).alias("members"))
    out = settle(found.drop("many").join(lists, ["t", "fp"]).select("at", "parts", "fp", "chunk", "members"), "buckets")
    discard(found)
    return out


@lru_cache(64)
def upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of numbers under n, the smaller one first."""
    return np.triu_indices(n, 1)


class Forest:
    """Trees of the links that are added, and how many were added to each."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}
        self.number: dict[int, int] = {}

    def top(self, x: int) -> int:
        """The smallest node of x's tree."""
        at = self.above.setdefault(x, x)
        while at != self.above[at]:
            self.above[at] = at = self.above[self.above[at]]
        self.above[x] = at
        return at

    def add(self, a: int, b: int) -> None:
        ends = {self.top(a), self.top(b)}
        low = min(ends)
        self.number[low] = 1 + sum(self.number.pop(x, 0) for x in ends)
        self.above[max(ends)] = low

    def taken(self) -> list[tuple[int, int, int]]:
        """(node, the smallest node of its tree, number) of all other nodes; then the forest is empty.

        The numbers of a tree add up to the links that were added. Tasks that see parts of one large group name the same
        few smallest nodes, so that their rows are mostly equal.
        """
        out = []
        for x in self.above:
            low = self.top(x)
            if x != low:
                out.append((x, low, self.number[low]))
                self.number[low] = 0
        self.__init__()
        return out


def likely(at: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, most: float, similarity: float) -> np.ndarray:
    """Which pairs can reach the similarity, by their sizes and by all bits of the fingerprints a and b, and are told here.

    A pair meets in several buckets. It is told in that of the first table where it lies within two bits, at the lowest
    variant of those halfway between its fingerprints.
    """
    apart = np.bitwise_count(a ^ b)
    fits = (apart.sum(axis=1, dtype=np.int64) <= most) & (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b))
    t, variant = at >> 48, at & ((1 << 48) - 1)
    x, y = a[np.arange(len(a)), t], b[np.arange(len(b)), t]
    one = (x ^ y) & -(x ^ y)
    halfway = np.where(np.bitwise_count(x ^ y) == 2, np.minimum(x ^ one, y ^ one), np.minimum(x, y))
    return fits & ((apart <= 2).argmax(axis=1) == t) & (variant == halfway)


def meeting(buckets: DataFrame, tables: int, bits: int, similarity: float, forest: bool) -> DataFrame:
    """The likely pairs (node, low, number) of buckets, each once; with `forest`, as few rows as connect what the pairs do.

    They are stars then, and number is how many pairs the row stands for. A task holds one pair of parts of a bucket, and compares its fingerprints as arrays.
    """
    p, every = differing(similarity), tables * bits
    most = every * p + 4 * sqrt(every * p * (1 - p))
    rows = in_parts(buckets, ["at"], ["members"], ["fp", "chunk"]).groupBy("at", "i", "j").agg(F.collect_list(F.struct("part", F.size("members").alias("held"), "members")).alias("m"))
    rows = rows.select("at", F.expr("i < j").alias("between"), *(F.col(f"m.{c}").alias(c) for c in ("part", "held")), F.flatten("m.members").alias("members")).filter("size(members) > 1")
    rows = rows.select("at", "between", "part", "held", *(F.col(f"members.{c}").alias(c) for c in ("node", "n")), F.flatten("members.fps").alias("fps"))
    schema = "node bigint, low bigint, number bigint"
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()

        def out(links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(3)], names=["node", "low", "number"])

        for batch in batches:
            at, between = batch.column("at").to_numpy(), batch.column("between").to_pylist()
            begin = batch.column("node").offsets.to_numpy()
            part, each, node, n, fps = (batch.column(c).flatten().to_numpy() for c in ("part", "held", "node", "n", "fps"))
            part, begin, fps = np.repeat(part, each), begin - begin[0], fps.reshape(-1, tables)
            pairs, held = [], 0
            for k in range(len(at)):
                lo, hi = begin[k], begin[k + 1]
                first, second = upper(int(hi - lo))
                if between[k]:  # of a bucket's parts, all pairs within one or all between two
                    apart = part[lo + first] != part[lo + second]
                    first, second = first[apart], second[apart]
                pairs.append((np.full(len(first), at[k]), lo + first, lo + second))
                held += len(first)
                if held < 50_000 and k + 1 < len(at):
                    continue
                where, x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
                pairs, held = [], 0
                for s in range(0, len(x), 50_000):
                    w, u, v = (c[s : s + 50_000] for c in (where, x, y))
                    hit = likely(w, fps[u], fps[v], n[u], n[v], most, similarity)
                    found = zip(node[u[hit]].tolist(), node[v[hit]].tolist(), strict=True)
                    if forest:
                        for a, b in found:
                            trees.add(a, b)
                    else:
                        yield out([(max(e), min(e), 1) for e in found])
            if len(trees.above) > 200_000:
                yield out(trees.taken())
        yield out(trees.taken())

    out = rows.mapInArrow(run, schema)
    return out.groupBy("node", "low").agg(F.sum("number").alias("number")) if forest else out


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets `left` has in common with each of `right`; both are of distinct values."""
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact below 2 ** 24
    flat = [np.concatenate(s) for s in (left, right)]
    common = np.intersect1d(*flat)
    held = []
    for sets, values in zip((left, right), flat, strict=True):
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(common, values)
        there = column < len(common)
        there[there] = common[column[there]] == values[there]
        row, column = row[there], column[there]
        order = np.argsort(column, kind="stable")
        held.append((row[order], column[order]))
    for at in range(0, len(common), COLUMNS):
        sides = []
        for sets, (row, column) in zip((left, right), held, strict=True):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            m = np.zeros((len(sets), min(COLUMNS, len(common) - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def alike(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, low) that connect all nodes of a group (node, root, parts) whose sets (node, h) have the similarity.

    A task holds two parts of a group at most, and gives each node with the smallest that it reaches there, so that copies
    are not expanded into pairs.
    """
    ship(sets.sparkSession)
    rows = in_parts(groups.join(sets, "node"), ["root"], ["node", "h"], ["node"])
    none = pa.table({"node": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        part, node = table["part"].to_numpy(), table["node"].to_numpy()
        h = [np.asarray(x, np.int64) for x in table["h"].to_numpy()]
        here = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = (np.flatnonzero(part == k) for k in here)
        if not len(left) or not len(right) or len(node) < 2:
            return none
        both = shared([h[k] for k in left], [h[k] for k in right])
        sizes = [np.array([len(h[k]) for k in side]) for side in (left, right)]
        linked = both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both)
        if here[0] == here[1]:
            linked = np.triu(linked, 1)
        trees = Forest()
        for a, b in zip(*np.nonzero(linked), strict=True):
            trees.add(int(node[left[a]]), int(node[right[b]]))
        found = trees.taken()
        return pa.table({"node": pa.array([x[0] for x in found], pa.int64()), "low": pa.array([x[1] for x in found], pa.int64())})

    return rows.groupBy("root", "i", "j").applyInArrow(run, "node bigint, low bigint")


def spanning(edges: DataFrame) -> DataFrame:
    """As few edges (a, b) as connect what the edges (a, b) do within the partition of their a.

    Many tasks name a smallest node of their own for each node of a large group. A partition that has all edges of its nodes
    keeps no more of them than it has nodes and smallest nodes.
    """
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()

        def out() -> pa.RecordBatch:
            found = trees.taken()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                trees.add(a, b)
            if len(trees.above) > 1_000_000:
                yield out()
        yield out()

    return edges.select("a", "b").repartition("a").mapInArrow(run, "a bigint, b bigint")


def grouped(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """A settled table (node, root, parts, dense) of the nodes that likely pairs (node, low, number) connect.

    A group is dense if comparing its sets part by part sends no more of them than sending both sets of each likely pair.
    """
    named = settle(components(spanning(near.select(F.col("node").alias("a"), F.col("low").alias("b")))), "groups")
    pairs = near.join(named, "node").groupBy("root").agg(F.sum("number").alias("pairs"))
    sized = named.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("held"))
    parts = F.ceil(F.greatest(F.col("many") / SETS, F.col("held") / SHINGLES)).cast("int")
    sized = sized.join(pairs, "root").select("root", parts.alias("parts"), (parts * F.col("many") <= 2 * F.col("pairs")).alias("dense"))
    out = settle(named.join(sized, "root"), "grouped")
    discard(named)
    return out


def resembling(nodes: DataFrame, docs: DataFrame, tables: int, bits: int, size: int = SIZE, similarity: float = SIMILARITY) -> list[DataFrame]:
    """Settled tables (node, low) that connect those nodes (node, low: a row's key, n, fps) that links of sets connect.

    Nodes that share a variant meet, and pairs that all their bits make likely form groups. Sets are compared exactly,
    group by group; in groups of more parts than their likely pairs are worth, pair by pair. Rows are in proportion to
    the nodes, not to the links among them.
    """
    runs = [range(t, min(t + TABLES, tables)) for t in range(0, tables, TABLES)]
    buckets = reduce(DataFrame.unionByName, [met(nodes, bits, run) for run in runs])
    near = settle(meeting(buckets, tables, bits, similarity, True), "near")
    discard(buckets)
    groups = grouped(near, nodes)
    sets = fetched(groups.select("node"), nodes, docs, size)
    found = [settle(alike(groups.filter("dense"), sets, similarity), "links")]
    thin = groups.filter("NOT dense").select("node")
    if not thin.isEmpty():
        some = settle(nodes.join(thin, "node", "left_semi"), "some")
        again = reduce(DataFrame.unionByName, [met(some, bits, run) for run in runs])
        pairs = settle(meeting(again, tables, bits, similarity, False).select("node", "low"), "thin")
        found.append(settle(verified(pairs, sets, similarity), "links"))
        for used in (some, again, pairs):
            discard(used)
    for used in (near, groups, sets):
        discard(used)
    return found
