"""Near-duplicate documents by SimHash, joined by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share
a variant, so one shuffle on the variants brings every such pair together.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from .common import discard, map_rows, settle
from .components import components
from .keeping import keep
from .resemblance import SIMILARITY, SIZE, plan, resembling, sketches, spanning

SEED, RADIUS = 42, 2


def fingerprint(text: str | None, size: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words.

    Words are runs of other than ASCII white space after A-Z are lowered; fewer words than `size` make one
    shingle. A bit is 1 if it is set in over half the shingles' XXH64 values, repeats included.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every document, from its whole text; null text counts as empty."""
    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, fp bigint", lambda: lambda ids, texts: (ids, [fingerprint(t, size) for t in texts]))


def variants(fp: Column) -> Column:
    """All 64-bit values within RADIUS // 2, one flipped bit, of fp, itself included."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return F.concat(F.array(fp), flipped)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of a table of distinct fingerprints `fp`, enough to connect all that lie within RADIUS.

    A variant lies within one bit of at most 65 distinct fingerprints, so no group here is large. Members of a
    group are linked to its smallest one, not to each other; links are deduplicated and their distance verified.
    """
    balls = distinct.select("fp", F.explode(variants(F.col("fp"))).alias("variant"))
    low = F.min("fp").over(Window.partitionBy("variant"))
    links = balls.select("fp", low.alias("low")).filter("fp <> low").distinct()
    return links.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("low").alias("b"))


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, least) for each of the nodes (node, low): the smallest `low` of those that it reaches by links (a, b)."""
    reached = components(links).withColumnRenamed("node", "at")
    groups = reached.join(nodes, F.col("at") == F.col("node")).select("node", "root", "low")
    least = groups.groupBy("root").agg(F.min("low").alias("least"))
    moved = groups.select("node", "root").join(least, "root").select("node", "least")
    # settled, so that a join with it shuffles both sides itself and adaptive execution can split a hot node
    return settle(nodes.join(moved, "node", "left").select("node", F.coalesce("least", "low").alias("least")), "named")


def cluster(docs: DataFrame, size: int = 3) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits, itself included. Equal
    fingerprints are collapsed first, so copies cost one row, however many. Null text counts as empty: its
    fingerprint is zero and linked like any other. Null doc_ids never become a component_id unless there is no
    other; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    found = settle(fingerprints(docs, size), "fingerprints")
    nodes = settle(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    named = _grouped(nodes.withColumnRenamed("fp", "node"), near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    discard(nodes)
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, of which one of each group of near copies stays.

    Texts are linked if the sets of their word shingles of `size` words (one shingle if there are fewer) have a
    Jaccard similarity of `similarity` or more; a group is what links reach. No other texts are linked. A pair at the
    threshold itself is found with the probability `resemblance.RECALL`, closer ones more surely, equal sets always. No
    bucket or group is capped; very long texts are compared whole, by all their shingles.

    Of a group the row of smallest doc_id stays, a null one last; of several rows of that doc_id the one whose text's
    MD5 comes first, and of repeated rows one. Rows are judged by themselves, so a doc_id with rows in several
    groups may stay in some and go in others. Null text counts as empty text: all rows without words are copies of
    each other. An empty table gives an empty one.
    """
    tables, bits = plan(docs.count(), similarity)
    found = settle(sketches(docs, tables, bits, size), "sketches")
    sets = found.groupBy("sig").agg(F.min("key").alias("low"), F.first("n").alias("n"), F.first("fps").alias("fps"))
    nodes = settle(sets.withColumn("node", F.monotonically_increasing_id()), "distinct")  # numbers are fixed by writing them
    links = resembling(nodes, docs, tables, bits, size, similarity)
    edges = reduce(DataFrame.unionByName, links, nodes.select("node", F.col("node").alias("low")).limit(0)).select(F.col("node").alias("a"), F.col("low").alias("b"))
    least = _grouped(nodes.select("node", "low"), spanning(edges))
    named = settle(nodes.select("node", "sig").join(least, "node").select("sig", "least"), "named")
    rows = settle(found.select("key", "sig").join(named, "sig").groupBy("key", "least").agg(F.count(F.lit(1)).alias("n")), "decided")
    out = keep(docs, rows.filter("key <> least"), rows.filter("key = least AND n > 1"))
    for used in (found, nodes, least, named, rows, *links):
        discard(used)
    return out
