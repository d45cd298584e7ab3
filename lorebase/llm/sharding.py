"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by a key. Candidate boundaries (probes) are rows of the table; in each round all partitions count
the exact bytes and rows below every probe, the driver keeps the bracket around each target, and new probes are drawn
from the open brackets alone, so that each round narrows them some sixty times. The boundaries found are exact, and
the documents then go through one exchange to their places. Rounds read keys and sizes only, some forty bytes a row.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, settle, shared_dir, ship

#: A boundary goes to the edge of a group of equal texts that is at most this part of a shard away (one of so many).
TOLERANCE = 100
#: Probes drawn for each open bracket and round, and rows of a bracket that are fetched rather than probed.
PROBES, LEAF = 64, 256
#: Bytes of text that one task of the exchange takes.
PIECE = 64_000_000
#: A key: 16 bytes of the text's digest, a flag, doc_id, and the row's number, so that no two rows share one.
DIGEST, NAMED, WIDTH = 16, 25, 33


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _whole(number: Column) -> Column:
    """8 bytes that sort as the number does."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def sort_key() -> Column:
    """Equal texts lie together, in the order of doc_id, a null one first; rows that agree in both, in the order read."""
    id_ = F.col("doc_id").cast("bigint")
    digest = F.unhex(F.substring(F.sha2(_text(), 256), 1, 2 * DIGEST))
    flag = F.when(id_.isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1"))
    return F.concat(digest, flag, _whole(F.coalesce(id_, F.lit(0))), _whole(F.monotonically_increasing_id()))


def size() -> Column:
    """Bytes of the text in UTF-8, none for null, and one for its end."""
    return F.octet_length(_text()).cast("bigint") + 1


def _keys(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(WIDTH))
    return np.frombuffer(fixed.buffers()[1], f"S{WIDTH}", len(fixed), fixed.offset * WIDTH)


class Histogram:
    """Exact bytes and rows below keys of a table (key, size), as far as they have been asked for, in ascending order."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        self.bytes, self.count = total[0], total[1]
        self.points: list[tuple[bytes, int, int]] = [(b"", 0, 0)]
        self.round = 0

    def ask(self, probes: list[bytes]) -> None:
        """Count below each probe, in one pass; each task gives a row for each probe at most."""
        held = {p[0] for p in self.points}
        probes = sorted({p.rstrip(b"\0") for p in probes} - held)
        if not probes:
            return
        bounds = np.array(probes, f"S{WIDTH}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
            for batch in batches:
                place = np.searchsorted(bounds, _keys(batch.column("key")), side="right")
                np.add.at(sums, place, batch.column("size").to_numpy())
                np.add.at(n, place, 1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, sums[some], n[some])], names=["place", "bytes", "n"])

        found = self.rows.mapInArrow(run, "place bigint, bytes bigint, n bigint").groupBy("place").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        own = {r.place: (r.bytes, r.n) for r in found.collect()}
        below, count = 0, 0
        for k, probe in enumerate(probes):
            add = own.get(k, (0, 0))
            below, count = below + add[0], count + add[1]
            self.points.append((probe, below, count))
        self.points.sort()

    def at(self, key: bytes) -> tuple[int, int]:
        """Bytes and rows below a key that has been asked for."""
        return self.points[bisect_left(self.points, (key.rstrip(b"\0"),))][1:]

    def bracket(self, target: int, of: int) -> int:
        """The point with the most bytes below it that are no more than target / of."""
        return bisect_right(self.points, target, key=lambda p: p[1] * of) - 1

    def _end(self, k: int) -> tuple[bytes, int, int]:
        return self.points[k + 1] if k + 1 < len(self.points) else (b"\xff" * WIDTH, self.bytes, self.count)

    def held(self, k: int) -> int:
        """Rows from point k to the next."""
        return self._end(k)[2] - self.points[k][2]

    def draw(self, brackets: list[int], rates: list[float]) -> list[tuple[bytes, int]]:
        """(key, size) of a part of the rows of each bracket, chosen by hash; of all from a rate of 1 on."""
        self.round += 1
        low = np.array([self.points[k][0] for k in brackets], f"S{WIDTH}")
        high = np.array([self._end(k)[0] for k in brackets], f"S{WIDTH}")
        rate = np.array(rates, float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = _keys(batch.column("key"))
                own = np.searchsorted(low, keys, side="right") - 1
                inside = (own >= 0) & (keys < high[own]) & (batch.column("u").to_numpy() < rate[own])
                yield batch.select(["key", "size"]).filter(pa.array(inside))

        u = (F.xxhash64("key", F.lit(self.round)).bitwiseAND(F.lit(2**53 - 1)) / float(2**53)).alias("u")
        return sorted((bytes(r[0]), r[1]) for r in self.rows.select("key", "size", u).mapInArrow(run, "key binary, size bigint").collect())


def splitters(rows: DataFrame, shards: int, probes: int = PROBES, tolerance: int = TOLERANCE) -> tuple[Histogram, list[bytes]]:
    """The first keys of shards 1 and on, of a table (key, size), and the histogram that found them.

    Boundary k is meant at k / shards of all bytes. Where the group of equal texts in which that falls begins or ends
    at most a `tolerance`-th part of a shard away, it goes to the nearer edge, so that such groups stay whole. Else it
    goes to the nearer edge of the very row. So the same table gives the same boundaries, whatever its partitions.
    What the driver holds is a few hundred probes for each shard.
    """
    h = Histogram(rows)
    if not h.count or shards == 1:
        return h, []
    targets = [k * h.bytes for k in range(1, shards)]  # of a shards-th of a byte each
    while wide := sorted({b for t in targets if h.held(b := h.bracket(t, shards)) > LEAF}):
        h.ask([k for k, _ in h.draw(wide, [probes / h.held(k) for k in wide])])
    leaves = sorted({h.bracket(t, shards) for t in targets})
    fetched = h.draw(leaves, [1.0] * len(leaves))
    keys = [k for k, _ in fetched]
    found = []
    for t in targets:
        point, (low, below, _) = h.bracket(t, shards), h.points[h.bracket(t, shards)]
        for at in range(bisect_left(keys, low), len(keys)):
            if (below + fetched[at][1]) * shards > t or at + 1 == len(keys):
                break
            below += fetched[at][1]
        after = keys[at + 1] if at + 1 < len(keys) and keys[at + 1] < h._end(point)[0] else h._end(point)[0]
        found.append((t, keys[at], below, after, below + fetched[at][1]))
    nearest = lambda t, a, b: a if abs(a[1] * shards - t) <= abs(b[1] * shards - t) else b
    edges = {}
    for _, key, *_ in found:
        digest = int.from_bytes(key[:DIGEST]) + 1
        edges[key] = key[:DIGEST], digest.to_bytes(DIGEST) if digest >> 8 * DIGEST == 0 else b"\xff" * WIDTH
    h.ask([e for pair in edges.values() for e in pair])
    out = []
    for t, key, below, after, end in found:
        group = nearest(t, *((e, h.at(e)[0]) for e in edges[key]))
        row = nearest(t, (key, below), (after, end))
        out.append(group[0] if abs(group[1] * shards - t) * tolerance <= h.bytes else row[0])
    h.ask([k for key in out for k in (key, key[:NAMED])])
    # only a boundary among rows that agree in text and doc_id needs the row's number
    return h, [key[:NAMED] if h.at(key[:NAMED]) == h.at(key) else key for key in out]


def write(docs: DataFrame, folder: str, shards: int, piece: int = PIECE, probes: int = PROBES, tolerance: int = TOLERANCE) -> None:
    """Write all documents to folder/shards/shard=0 and on, whole, in the order of their keys, by one exchange.

    Files hold the document's columns as `doc`, the number of the piece of the exchange, and the place in it;
    folder/pieces has the slot at which each piece begins, which is counted from the files. A shard is dealt over as
    many pieces as its bytes ask for, at probes of the histogram, so that no task takes a whole large shard.
    """
    spark = docs.sparkSession
    rows = settle(docs.select(sort_key().alias("key"), size().alias("size")), "keys")
    h, firsts = splitters(rows, shards, probes, tolerance)
    if h.bytes > piece:  # some eight probes for each piece
        every = [k for k in range(len(h.points)) if h.held(k)]
        h.ask([k for k, _ in h.draw(every, [8 * h.bytes / piece / h.count] * len(every))])
    cuts, owners = _pieces(h, firsts, piece)
    discard(rows)
    ship(spark)
    bounds, owner = np.array(cuts, f"S{WIDTH}"), np.array(owners, np.int64)

    @F.arrow_udf("bigint")
    def place(key: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, _keys(key), side="right")
        return pa.array(owner[at] << 32 | at)

    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    placed = docs.select(doc, sort_key().alias("key")).withColumn("to", place("key"))
    placed = placed.withColumns({"shard": F.shiftright("to", 32).cast("int"), "piece": F.col("to").bitwiseAND(F.lit(2**32 - 1)).cast("int")})
    dealt = placed.repartitionById(len(owners), "piece").sortWithinPartitions("shard", "key")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    dealt.select("doc", "piece", number.alias("place"), "shard").write.partitionBy("shard").parquet(f"{folder}/shards")
    counts = {(r.shard, r.piece): r.n for r in _files(spark, folder, docs).groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, begin = [], dict.fromkeys(range(shards), 0)
    for (shard, number), n in sorted(counts.items()):  # a row for each piece
        starts.append((shard, number, begin[shard]))
        begin[shard] += n
    spark.createDataFrame(starts, "shard int, piece int, start bigint").coalesce(1).write.parquet(f"{folder}/pieces")


def _pieces(h: Histogram, firsts: list[bytes], piece: int) -> tuple[list[bytes], list[int]]:
    """Keys at which pieces after the first begin, and the shard of each piece."""
    cuts, owners = [], []
    ends = [(f, *h.at(f)) for f in firsts] + [(b"\xff" * WIDTH, h.bytes, h.count)]
    begin = (b"", 0, 0)
    for shard, end in enumerate(ends):
        if shard:
            cuts.append(begin[0])
        owners.append(shard)
        inner = [p for p in h.points[bisect_right(h.points, (begin[0],)) : bisect_left(h.points, (end[0],))] if begin[1] < p[1] < end[1]]
        last = begin[1]
        for k, p in enumerate(inner):
            upto = inner[k + 1][1] if k + 1 < len(inner) else end[1]
            if upto - last > piece:  # the next point would make this piece too large
                cuts.append(p[0])
                owners.append(shard)
                last = p[1]
        begin = end
    return cuts, owners


def _files(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("shard")).schema
    return spark.read.schema(schema).parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """From the files of `write`: each document as `doc`, its shard, and its slot, gapless from 0 in each shard.

    docs gives the columns only.
    """
    starts = F.broadcast(spark.read.schema("shard int, piece int, start bigint").parquet(f"{folder}/pieces"))  # a row for each PIECE bytes
    rows = _files(spark, folder, docs).join(starts, ["shard", "piece"])
    return rows.select("doc", "shard", (F.col("place") + F.col("start")).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 8, piece: int = PIECE, probes: int = PROBES, tolerance: int = TOLERANCE) -> DataFrame:
    """Write all documents as shards of nearly equal bytes to the shared folder and read the files back.

    A row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null, as the law is
    not by key). Shards differ from an equal share by half a row, or by half a hundredth of a shard where that keeps a
    group of equal texts whole; larger groups, and repeated rows, are split between shards. Null text counts as empty,
    with a size of 1; null doc_ids and rows that agree in everything each have their own slot; an empty table gives no
    rows; other columns are written too, and don't count. A very long text is one row, and moves as such.
    """
    folder = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write(docs, folder, shards, piece, probes, tolerance)
    rows = read(docs.sparkSession, folder, docs).select(F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"), "shard", "slot")
    crc = F.crc32(F.col("text").cast("binary"))
    return rows.select("doc_id", (F.octet_length("text").cast("bigint") + 1).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
