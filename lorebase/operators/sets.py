"""Sets of words compared all with all, exactly: by bits first, and by their words where the bits leave it open.

A set is a row of bits of its own width, each of its words turns one over. Where two rows differ in d bits, the sets
differ in d words at least, so no pair is lost, whatever words are frequent or rare. A row of w bits folds to w / 2 by
xor, which makes rows of two widths alike and lets a narrow fold go first. Sets are dealt into blocks by their number
of words; each task compares two blocks whose numbers a match allows. So the rows shuffled grow with the number of
blocks, and comparisons, a few nanoseconds each, with the square of the sets of like size; memory is two blocks'.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import drop, scratch

register_pickle_by_value(sys.modules[__name__])  # executors may not have this package

#: Sets and bytes of bits of a block at most; tasks that all sets give at least, while blocks have LEAST sets.
BLOCK, BLOCK_BYTES, LEAST, TASKS = 32_768, 1 << 25, 512, 96
#: Sets are told apart by their number of words in steps of this ratio before they are dealt into blocks.
STEP = 1.02
#: Bits a word, before the width is rounded up to a power of two, and the widest row in numbers of 64 bits.
SPREAD, WIDEST = 3, 512
#: Sets of either side that are compared at once, so that what comes between stays in the cache.
OWN, KNOWN = 16, 4096
#: Digests that are broadcast, to fetch the words of the sets that have them, at most.
TOLD = 300_000
#: Of a set's likely matches, best first, so many are compared by words in each turn; later ones only if they may be better.
TURNS = (1, 8)


def _widths(n: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the rows of sets of n words."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) * SPREAD / 64)), 1, WIDEST).astype(np.int64)


def _rows_of_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, hashes = batch.columns
        n = np.diff(hashes.offsets.to_numpy())
        width = _widths(n)
        ends = np.concatenate([[0], np.cumsum(width)])
        h = hashes.flatten().to_numpy().view(np.uint64)
        bit = h & np.repeat((width * 64 - 1).astype(np.uint64), n)
        out = np.zeros(ends[-1], np.uint64)
        np.bitwise_xor.at(out, np.repeat(ends[:-1], n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        bits = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 8), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([digest, pa.array(n, pa.int32()), bits.cast(pa.binary())], ["digest", "n", "bits"])


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _in_widths(side: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Digests, numbers of words and rows of bits by rising number of words, sets of each width together."""
    side = side.sort_by("n").combine_chunks()
    digest, bits = (pa.concat_arrays(side[c].chunks) if side.num_rows else pa.array([], pa.binary()) for c in ("digest", "bits"))
    digests, n = np.array(digest.to_pylist(), object), side["n"].to_numpy()
    ends = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, bits.offset * 4) if len(bits) else np.zeros(1, np.int32)
    width, out = np.diff(ends) // 8, []
    for w in np.unique(width):
        of = np.flatnonzero(width == w)  # next to each other, as width rises with n
        rows = np.frombuffer(bits.buffers()[2], np.uint64, len(of) * w, ends[of[0]]).reshape(-1, w)
        out.append((digests[of], n[of].astype(np.int64), rows))
    return out


def _near(level: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    share = level / 100
    apart = (1 - share) / (1 + share)

    def pairs_of(own_n, own_bits, n, bits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of pairs, and the highest score that their bits allow."""
        width = min(own_bits.shape[1], bits.shape[1])
        own_bits, bits = _folded(own_bits, width), _folded(bits, width)
        first, second = (np.ascontiguousarray(_folded(b, max(1, width // 2)).T) for b in (own_bits, bits))
        x, counts, apart_bits = (np.empty(OWN * KNOWN, t) for t in (np.uint64, np.uint8, np.uint16))
        for i in range(0, len(own_n), OWN):
            upto = min(i + OWN, len(own_n))
            low, high = np.searchsorted(n, math.ceil(own_n[i] * share - 1e-6)), np.searchsorted(n, math.floor(own_n[upto - 1] / share + 1e-6), "right")
            for j in range(low, high, KNOWN):
                to = min(j + KNOWN, high)
                shape, size = (upto - i, to - j), (upto - i) * (to - j)
                xs, cs, ds = x[:size].reshape(shape), counts[:size].reshape(shape), apart_bits[:size].reshape(shape)
                for w in range(len(first)):
                    np.bitwise_xor(first[w, i:upto, None], second[w, None, j:to], out=xs)
                    if len(first) == 1:
                        np.bitwise_count(xs, out=cs)
                    elif w == 0:
                        np.copyto(ds, np.bitwise_count(xs, out=cs))
                    else:
                        np.add(ds, np.bitwise_count(xs, out=cs), out=ds)
                found = np.flatnonzero((cs if len(first) == 1 else ds).ravel() <= min(int((own_n[upto - 1] + n[to - 1]) * apart + 1e-6), 65_535))
                for k in range(0, len(found), step := max(1, (1 << 20) // width)):
                    a, b = np.divmod(found[k : k + step], to - j)
                    a, b = a + i, b + j
                    both = own_n[a] + n[b]
                    differ = np.maximum(np.bitwise_count(own_bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64), np.abs(own_n[a] - n[b]))
                    shared = (both - differ) // 2
                    bound = shared * 100.0 / (both - shared)
                    kept = bound >= level
                    if kept.any():
                        yield a[kept], b[kept], bound[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([("mine", pa.bool_()), ("digest", pa.binary()), ("n", pa.int32()), ("bits", pa.binary())]))])
        sides = [_in_widths(held.filter(m).drop_columns("mine")) for m in (held["mine"], pc.invert(held["mine"]))]
        del held
        for own, own_n, own_bits in sides[0]:
            for digest, n, bits in sides[1]:
                for a, b, bound in pairs_of(own_n, own_bits, n, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(own[a], pa.binary()), pa.array(digest[b], pa.binary()), pa.array(bound)], ["own", "digest", "bound"])

    return run


def _bits(texts: DataFrame, label: str) -> DataFrame:
    """(digest, n, bits, step) of a table of sets (digest, words), in a scratch table; sets without words are left out."""
    hashes = texts.filter("size(words) > 0").select("digest", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = hashes.mapInArrow(_rows_of_bits, "digest binary, n int, bits binary")
    return scratch(rows.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int")), label)


def _dealt(bits: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """bits with the number of their block, and the least and largest number of words of each block."""
    steps = sorted(bits.groupBy("step").agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.sum(F.length("bits"))).collect())  # a row for each step
    rows, blocks, plan, held = sum(s[1] for s in steps), [], [], (0, 0)
    # so many blocks a side that block pairs of like size, about a third of all, keep all cores at work
    most = min(BLOCK, max(LEAST, math.ceil(rows / math.sqrt(3 * TASKS))))
    for step, count, low, high, size in steps:
        parts = max(math.ceil(count / most), math.ceil(size / BLOCK_BYTES))
        if parts == 1 and blocks and held[0] + count <= most and held[1] + size <= BLOCK_BYTES:
            blocks[-1], held = (blocks[-1][0], high), (held[0] + count, held[1] + size)
            plan.append((step, len(blocks) - 1, 1))
        else:
            plan.append((step, len(blocks), parts))
            blocks += [(low, high)] * parts
            held = (count, size) if parts == 1 else (most, BLOCK_BYTES)
    places = F.broadcast(bits.sparkSession.createDataFrame(plan, "step int, first int, parts int"))
    return bits.join(places, "step").withColumn("block", F.col("first") + F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")).select("digest", "n", "bits", "block"), blocks


def near(own: DataFrame, known: DataFrame, level: float) -> DataFrame:
    """(own, digest, bound): pairs of sets (digest, words), one of each table, whose similarity may reach the level, in percent.

    `bound` is the highest similarity that their bits allow; no pair at the level is missing. In a scratch table.
    """
    spark, share = own.sparkSession, level / 100
    tables = [_bits(own, "own-bits"), _bits(known, "known-bits")]
    (mine, own_blocks), (theirs, blocks) = (_dealt(t) for t in tables)
    meet = [(a, b) for a, (low, high) in enumerate(own_blocks) for b, (least, most) in enumerate(blocks) if most >= low * share - 1e-6 and least * share - 1e-6 <= high]
    if not meet:
        drop(*tables)
        return spark.createDataFrame([], "own binary, digest binary, bound double")
    tasks = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(meet)], "task int, a int, b int")
    sides = [(mine, "a", True), (theirs, "b", False)]
    rows = [t.join(F.broadcast(tasks.select("task", F.col(c).alias("block"))), "block").select("task", F.lit(m).alias("mine"), "digest", "n", "bits") for t, c, m in sides]
    dealt = rows[0].unionByName(rows[1]).repartitionById(len(meet), "task").drop("task")
    pairs = scratch(dealt.mapInArrow(_near(level), "own binary, digest binary, bound double"), "near")
    drop(*tables)
    return pairs


def scored(pairs: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """pairs, a scratch table, with `score`, the Jaccard similarity of their sets in percent, by the words themselves."""
    few = pairs.count() <= TOLD

    def words(texts: DataFrame, key: str, name: str) -> DataFrame:
        asked = pairs.select(F.col(key).alias("digest")).distinct()
        return texts.join(F.broadcast(asked) if few else asked, "digest", "left_semi").select(F.col("digest").alias(key), F.col("words").alias(name))

    both = pairs.join(words(own, "own", "own_words"), "own").join(words(known, "digest", "words"), "digest")
    shared = F.size(F.array_intersect("own_words", "words"))
    return both.withColumn("score", shared * 100.0 / (F.size("own_words") + F.size("words") - shared)).select(*pairs.columns, "score")


def matches(own: DataFrame, known: DataFrame, level: float) -> DataFrame:
    """(own, digest, score) of every two different sets, one of each table (digest, words), at the level or above."""
    likely = near(own, known, level)
    pairs = scratch(likely.filter("own <> digest"), "pairs")
    drop(likely)
    found = scratch(scored(pairs, own, known).filter(F.col("score") >= level).select("own", "digest", "score"), "matches")
    drop(pairs)
    return found


def best(own: DataFrame, known: DataFrame, ids: DataFrame, level: float) -> DataFrame:
    """(digest, existing_id, score) of the best match at the level of each set of `own` that has one, in scratch tables.

    `ids` (digest, existing_id) names those sets of `known` that count; of the best the smallest existing_id is taken.
    Likely matches are ordered by what their bits allow, and as this is mostly what their words say, the first one
    settles most sets; others are compared by words only as long as they may be better.
    """
    spark = own.sparkSession
    equal = scratch(own.select("digest").join(ids, "digest").withColumn("score", F.lit(100.0)), "equal")
    rest = scratch(own.select("digest", "words").join(equal.select("digest"), "digest", "left_anti"), "rest")
    likely = near(rest, known, level)
    open_ = scratch(likely.join(ids, "digest"), "likely")
    drop(likely)
    found = spark.createDataFrame([], "own binary, score double, existing_id bigint")
    order = Window.partitionBy("own").orderBy(F.desc("bound"), "existing_id")
    for most in (*TURNS, None):
        if open_.isEmpty():
            break
        placed = scratch(open_.withColumn("place", F.row_number().over(order) if most else F.lit(0)), "placed")
        turn = scratch(placed.filter(F.col("place") <= (most or 0)).drop("place"), "turn")
        new = scored(turn, rest, known).filter(F.col("score") >= level).select("own", "score", "existing_id")
        top = found.unionByName(new).groupBy("own").agg(F.max(F.struct("score", (-F.col("existing_id")).alias("id"))).alias("top"))
        found = scratch(top.select("own", "top.score", (-F.col("top.id")).alias("existing_id")), "found")
        so_far = found.withColumnsRenamed({"existing_id": "have"})
        better = F.col("score").isNull() | (F.col("bound") > F.col("score")) | ((F.col("bound") == F.col("score")) & (F.col("existing_id") < F.col("have")))
        before, open_ = open_, scratch(placed.filter(F.col("place") > (most or 0)).join(so_far, "own", "left").filter(better).select(*open_.columns), "open")
        drop(before, placed, turn)
    drop(rest, open_)
    return equal.select("digest", "existing_id", "score").unionByName(found.select(F.col("own").alias("digest"), "existing_id", "score"))
