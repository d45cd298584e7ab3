"""Small utilities: random order, object ids, merging and comparing nested values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.rows import with_ordinal


PRIME = 2**31 - 1
ROUNDS, STEPS = 6, 16


def _mixed(x: Column, r: Column, seed: int) -> Column:
    """A number below PRIME from another, a round and a seed."""
    y = F.pmod(x + r * 7919 + seed, F.lit(PRIME)) * 1103515245 % PRIME
    return y.bitwiseXOR(F.shiftright(y, 15)) * 668265263 % PRIME


def permuted(place: Column, n: int, seed: int) -> Column:
    """Where place goes in a permutation of 0 to n - 1, by itself: a Feistel network on a table of rows and columns.

    The table is as near to a square as holds n; places beyond n are walked through until one below n is met. There
    are fewer of those than rows, so that more than STEPS in a row are met by no place in practice; it would be an error.
    """
    rows = max(1, math.isqrt(max(n - 1, 0)) + 1)
    columns = max(1, -(-n // rows))
    mix = lambda x, r: _mixed(x, r, seed % PRIME)

    def swap(at: Column, r: Column) -> Column:
        low = (at["low"] + mix(at["high"], r)) % columns
        return F.struct(((at["high"] + mix(low, r + ROUNDS)) % rows).alias("high"), low.alias("low"))

    def step(x: Column) -> Column:
        begin = F.struct(F.floor(x / columns).cast("bigint").alias("high"), (x % columns).alias("low"))
        return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(ROUNDS).cast("bigint")), begin, swap, lambda at: at["high"] * columns + at["low"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), step(place), lambda x, _: F.when(x < n, x).otherwise(step(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk was too long")).cast("bigint"))


def shuffle_rows(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows with their place, from 0, in a random order that depends on the seed and on the distinct numbers of the key.

    Each row finds its place by itself from that in the order of the key, so the order is the same for any
    partitioning, and nothing is sorted by random numbers. Sort by `place` or take a range of it, as needed.
    """
    n = rows.count()
    numbered = with_ordinal(rows, key, "place")
    return numbered.withColumn("place", permuted(F.col("place") - 1, n, seed))


def object_id() -> Column:
    """A hexadecimal id of the present second and three random parts."""
    part = lambda bits, width: F.lpad(F.lower(F.hex(F.floor(F.rand() * (1 << bits)))), width, "0")
    return F.concat(F.lower(F.hex(F.unix_timestamp())), part(24, 6), part(16, 4), part(24, 6))


def merge(target: Column, *sources: Column) -> Column:
    """Maps merged, later keys first. A null source changes nothing; a null target counts as empty."""
    out = F.coalesce(target, F.create_map().cast("map<string,string>"))
    for s in sources:
        new = F.coalesce(s, F.create_map().cast("map<string,string>"))
        out = F.map_concat(_without(out, new), new)
    return out


def _without(old: Column, new: Column) -> Column:
    return F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))


def equal(a: Column, b: Column) -> Column:
    """Deep equality of structs, arrays or scalars; nulls are equal."""
    return a.eqNullSafe(b)


def merge_structs(target: Column, target_type: StructType, source: Column, source_type: StructType) -> Column:
    """Structs merged field by field, at any depth: fields of the source count, structs in both are merged.

    A field of the source that is null overwrites, structs included, as it is there; a source that is null as a whole
    counts as empty.
    """
    ours, theirs, out = {f.name: f.dataType for f in target_type}, {f.name: f.dataType for f in source_type}, []
    for name in [*ours, *(n for n in theirs if n not in ours)]:
        if name not in theirs:
            value = target[name]
        elif isinstance(ours.get(name), StructType) and isinstance(theirs[name], StructType):
            both = merge_structs(target[name], ours[name], source[name], theirs[name])
            value = F.when(source[name].isNull() & (source.isNotNull() | target[name].isNull()), F.lit(None)).otherwise(both)
        else:
            value = source[name] if name not in ours else F.when(source.isNull(), target[name]).otherwise(source[name])
        out.append(value.alias(name))
    return F.struct(*out)
