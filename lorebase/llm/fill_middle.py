"""Fill-in-middle by a parallel automaton scan.

An automaton over bytes counts the units of a text and notices the marks. A stretch of bytes is a function of the
state it is entered in: the state it leaves, and how many units it completes, for each start. Such functions compose,
in any grouping, so stretches are scanned apart, in any order and on any machine; a tree of compositions then gives
the state each stretch is really entered in, the whole count, and, going down again, the stretch where the k-th unit
ends. The same tree works over the bytes of one chunk and over the chunks of a giant document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, settle, ship

#: Bytes of a chunk: longer texts are cut into as many chunks as it takes, which are scanned by different tasks.
CHUNK = 65_536
#: Bytes that are scanned together in one numpy pass, which bounds a task's memory (a few hundred bytes for each).
TOGETHER = 524_288
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Automaton:
    """step[s, byte] is the next state, ends[s, byte] whether a unit ends with the byte; found[s]: a mark has been seen."""

    step: np.ndarray
    ends: np.ndarray
    found: np.ndarray

    def __post_init__(self):
        both, kind = np.unique(np.concatenate([self.step, self.ends]), axis=1, return_inverse=True)
        step, ends = np.split(both.T, 2, axis=1)  # a row for each kind of byte
        for name, value in {"kind": kind.ravel().astype(np.uint8), "kind_step": step.astype(np.uint8), "kind_ends": ends.astype(np.int64)}.items():
            object.__setattr__(self, name, value)
        # bytes that act once and for all, so that a run of them is one function
        object.__setattr__(self, "settled", (np.take_along_axis(self.kind_step, self.kind_step.astype(np.int64), 1) == self.kind_step).all(axis=1))


def code_points(marks: Sequence[str]) -> Automaton:
    """Units are the code points of UTF-8. States hold how much of a mark has been read and how many bytes are awaited."""
    keys = [m.encode() for m in marks]
    heads = {k[:i] for k in keys for i in range(len(k))} | {b""}

    def after(head: bytes | None, byte: int) -> bytes | None:
        if head is None or any((head + bytes([byte])).endswith(k) for k in keys):
            return None  # a mark has been seen
        read = head + bytes([byte])
        return next(read[i:] for i in range(len(read) + 1) if read[i:] in heads)

    def awaited(left: int, byte: int) -> tuple[int, bool]:
        if left and 0x80 <= byte < 0xC0:
            return left - 1, left == 1
        more = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
        return more, more == 0

    states, rows = [(b"", 0)], []
    for head, left in states:  # grows while it is read
        row = []
        for byte in range(256):
            more, ends = awaited(left, byte)
            to = (after(head, byte), more)
            if to not in states:
                states.append(to)
            row.append((states.index(to), ends))
        rows.append(row)
    if len(states) > 256:
        raise ValueError("the marks take more than 256 states")
    table = np.array(rows)
    return Automaton(table[:, :, 0].astype(np.uint8), table[:, :, 1].astype(np.uint8), np.array([head is None for head, _ in states]))


class Compositions:
    """Trees of composed functions over ragged sequences, all levels kept: sizes[i] functions belong to sequence i.

    states[e, s] and counts[e, s] are where function e leaves from state s, and the units it completes.
    """

    def __init__(self, states: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.levels = [(states, counts, sizes, np.cumsum(sizes) - sizes)]
        while (sizes > 1).any():
            states, counts, _, at = self.levels[-1]
            half = (sizes + 1) // 2
            new_at = np.cumsum(half) - half
            place = np.arange(half.sum()) - np.repeat(new_at, half)
            left = np.repeat(at, half) + 2 * place
            paired = 2 * place + 1 < np.repeat(sizes, half)
            new_states, new_counts = states[left], counts[left]
            first = left[paired]
            between = states[first].astype(np.int64)
            new_states[paired] = np.take_along_axis(states[first + 1], between, 1)
            new_counts[paired] += np.take_along_axis(counts[first + 1], between, 1)
            sizes = half
            self.levels.append((new_states, new_counts, sizes, new_at))

    def whole(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state in which each sequence is left, and the units it completes, from its start state."""
        states, counts, sizes, at = self.levels[-1]
        there = np.flatnonzero(sizes)
        end, units = start.astype(np.int64), np.zeros(len(sizes), np.int64)
        end[there], units[there] = states[at[there], start[there]], counts[at[there], start[there]]
        return end, units

    def select(self, which: np.ndarray, start: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the unit-th unit (from 1) of each sequence of `which`: the function that completes it, as its place in
        the sequence, the state it is entered in, and the unit's number within it."""
        place, state, unit = np.zeros(len(which), np.int64), start.astype(np.int64), unit.astype(np.int64)
        for states, counts, sizes, at in self.levels[-2::-1]:
            place *= 2
            left = at[which] + place
            skip = (counts[left, state] < unit) & (place + 1 < sizes[which])
            unit = unit - np.where(skip, counts[left, state], 0)
            state = np.where(skip, states[left, state], state)
            place += skip
        return place, state, unit


class Scan:
    """The functions of the runs of bytes of several texts, and their compositions."""

    def __init__(self, automaton: Automaton, texts: Sequence[bytes]):
        self.automaton = a = automaton
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        kind = a.kind[np.frombuffer(b"".join(texts), np.uint8)]
        opens = np.ones(len(kind), bool)
        opens[1:] = (kind[1:] != kind[:-1]) | ~a.settled[kind[1:]]
        opens[self.starts[lengths > 0]] = True
        self.run = np.flatnonzero(opens)
        self.kinds = kind[self.run]
        long = np.diff(np.append(self.run, len(kind)))
        bounds = np.searchsorted(self.run, np.append(self.starts, len(kind)))
        states = a.kind_step[self.kinds]
        again = np.take_along_axis(a.kind_ends[self.kinds], states.astype(np.int64), 1)
        self.tree = Compositions(states, a.kind_ends[self.kinds] + (long - 1)[:, None] * again, np.diff(bounds))
        self.first = bounds[:-1]

    def cut(self, which: np.ndarray, start: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes of each text of `which` until its unit-th unit has ended; none for unit 0."""
        out, some = np.zeros(len(which), np.int64), np.flatnonzero(unit > 0)
        place, state, left = self.tree.select(which[some], start[some], unit[some])
        run = self.first[which[some]] + place
        once = self.automaton.kind_ends[self.kinds[run], state]
        out[some] = self.run[run] - self.starts[which[some]] + 1 + np.where(left <= once, 0, left - once)
        return out


def _numbers(seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from a digest of the seed and doc_id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _together(lengths: list[int]) -> Iterator[slice]:
    """Slices of about TOGETHER bytes."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > TOGETHER:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def _decide(n: np.ndarray, marked: np.ndarray, h: list[np.ndarray], plain: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form (0 plain, 1 prefix first, 2 suffix first) and the two cuts, in units."""
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    form = np.where((n == 0) | marked | (h[2] % 100 >= 100 - plain), 0, np.where(h[3] % 100 < spm, 2, 1))
    return form, np.minimum(a, b), np.maximum(a, b)


FORMS = ("plain", "psm", "spm")


def _write(text: bytes, form: int, a: int, b: int, marks: Sequence[bytes]) -> bytes:
    p, s, m = marks
    if form == 0:
        return text
    return p + text[:a] + s + text[b:] + m + text[a:b] if form == 1 else s + text[b:] + p + text[:a] + m + text[a:b]


def transform(docs: DataFrame, marks: Sequence[str] = MARKS, seed: int = 1, plain: int = 10, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """For each document doc_id, n, form, prefix_chars, middle_chars and output, its text in that form.

    n counts the code points of the whole text. Form is plain (the text as it is) where the text is empty or holds a
    mark, and for `plain` of a hundred others; of the rest, `spm` of a hundred put the suffix first, the others the
    prefix. Cuts and forms follow from the seed and doc_id alone. Null text counts as empty, a null doc_id as an empty
    one; repeated rows give equal rows; an empty table gives an empty one; other columns are ignored.

    Texts over `chunk` bytes are never scanned by one task: their chunks are spread over all tasks, which give each
    chunk's function; a row of functions for each text (a few hundred bytes for each chunk) resolves their entry
    states and finds the chunks that hold the cuts, where the cuts are then looked up. The two byte numbers go back to
    the text by a join on a digest of the row. Every other text is one chunk and goes through the same automaton.
    """
    ship(docs.sparkSession)
    automaton, keys = code_points(marks), [m.encode() for m in marks]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_numbers(seed))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            lengths = pa.compute.binary_length(texts).to_pylist()
            for part in _together(lengths):
                own = batch.slice(part.start, part.stop - part.start)
                raw = texts[part].to_pylist()
                scan, all_ = Scan(automaton, raw), np.arange(len(raw))
                zero = np.zeros(len(raw), np.int64)
                end, n = scan.tree.whole(zero)
                form, a, b = _decide(n, automaton.found[end], [own.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)], plain, spm)
                at_a, at_b = scan.cut(all_, zero, a).tolist(), scan.cut(all_, zero, b).tolist()
                out = [_write(t, f, x, y, keys) for t, f, x, y in zip(raw, form.tolist(), at_a, at_b, strict=True)]
                none = form == 0
                columns = [own.column("doc_id"), pa.array(n), pa.array([FORMS[f] for f in form]), pa.array(a, mask=none), pa.array(b - a, mask=none), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    size = F.octet_length("text")
    small = rows.filter(size <= chunk).mapInArrow(whole, SCHEMA)
    return small.unionByName(_giants(rows.filter(size > chunk), automaton, marks, plain, spm, chunk))


def _giants(rows: DataFrame, automaton: Automaton, marks: Sequence[str], plain: int, spm: int, chunk: int) -> DataFrame:
    """As `transform`, for texts of several chunks, of rows (doc_id, text, h1 to h4)."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text").cast("binary"))
    named = rows.withColumn("key", key)
    states = len(automaton.step)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                buffer = text.as_buffer()
                for begin in range(0, buffer.size, TOGETHER - TOGETHER % chunk or chunk):
                    end = min(begin + (TOGETHER - TOGETHER % chunk or chunk), buffer.size)
                    pieces = [buffer[at : min(at + chunk, end)].to_pybytes() for at in range(begin, end, chunk)]
                    numbers = range(begin // chunk, begin // chunk + len(pieces))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces)), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "chunk", "bytes"])

    spread = max(named.sparkSession.sparkContext.defaultParallelism, int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = settle(named.select("key", "text").mapInArrow(split, "key string, chunk bigint, bytes binary").repartition(spread), "chunks")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            for part in _together([len(x) for x in raw]):
                scan = Scan(automaton, raw[part])
                each = [scan.tree.whole(np.full(len(raw[part]), s)) for s in range(states)]
                columns = [pa.array(np.stack([e[i] for e in each], 1).tolist(), pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("key")[part], batch.column("chunk")[part], *columns], names=["key", "chunk", "states", "counts"])

    each = chunks.mapInArrow(functions, "key string, chunk bigint, states array<bigint>, counts array<bigint>")
    each = each.groupBy("key", "chunk").agg(F.first("states").alias("states"), F.first("counts").alias("counts"))  # repeated rows once
    composed = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "states", "counts"))).alias("f"))
    numbers = named.groupBy("key").agg(*(F.first(f"h{i}").alias(f"h{i}") for i in (1, 2, 3, 4)))
    composed = composed.join(numbers, "key").select("key", "f.states", "f.counts", "h1", "h2", "h3", "h4")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1)
                left, counts = (np.array(own.column(c)[0].as_py()) for c in ("states", "counts"))
                tree, zero = Compositions(left, counts, np.array([len(left)])), np.zeros(1, np.int64)
                end, n = tree.whole(zero)
                form, a, b = _decide(n, automaton.found[end], [own.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)], plain, spm)
                two = np.concatenate([a, b])
                at, entered, unit = tree.select(np.zeros(2, np.int64), np.zeros(2, np.int64), np.maximum(two, 1))
                unit = np.where(two > 0, unit, 0)
                columns = [[own.column("key")[0].as_py()] * 2, n.repeat(2), form.repeat(2), a.repeat(2), b.repeat(2), [0, 1], at, entered, unit]
                types = [pa.string(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "n", "form", "a", "b", "which", "chunk", "entered", "unit"])

    cuts = settle(composed.mapInArrow(resolve, "key string, n bigint, form bigint, a bigint, b bigint, which int, chunk bigint, entered bigint, unit bigint"), "cuts")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            for part in _together([len(x) for x in raw]):
                own = batch.slice(part.start, part.stop - part.start)
                scan = Scan(automaton, raw[part])
                at = scan.cut(np.arange(own.num_rows), own.column("entered").to_numpy(), own.column("unit").to_numpy())
                columns = [own.column("key"), own.column("which"), pa.array(at + own.column("chunk").to_numpy() * chunk)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "which", "at"])

    asked = chunks.join(cuts.select("key", "chunk", "which", "entered", "unit"), ["key", "chunk"])
    found = asked.select("key", "which", "chunk", "entered", "unit", "bytes").mapInArrow(look, "key string, which int, at bigint")
    ends = found.groupBy("key").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("at_a"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("at_b"))
    places = settle(cuts.filter("which = 0").select("key", "n", "form", "a", "b").join(ends, "key"), "places")
    discard(chunks)
    discard(cuts)

    text = F.col("text").cast("binary")
    piece = lambda at, to: F.substring(text, at + F.lit(1), to)
    prefix, middle = piece(F.lit(0), F.col("at_a").cast("int")), piece(F.col("at_a").cast("int"), (F.col("at_b") - F.col("at_a")).cast("int"))
    suffix = piece(F.col("at_b").cast("int"), F.octet_length("text"))
    p, s, m = (F.lit(x.encode()) for x in marks)
    output = F.when(F.col("form") == 0, text).when(F.col("form") == 1, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = F.when(F.col("form") > 0, F.lit(True))
    name = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("form") + 1).cast("int"))
    joined = named.join(places, "key")
    return joined.select("doc_id", "n", name.alias("form"), F.when(shown, F.col("a")).alias("prefix_chars"), F.when(shown, F.col("b") - F.col("a")).alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that `transform` put into a form."""

    def parts(first: str, second: str, last: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, last, 1)
        return one, two, F.substring(rest, F.length(two) + len(last) + 1, F.length(output))

    p, s, m = marks
    prefix, suffix, middle = parts(p, s, m)
    last, first, between = parts(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, between, last)).otherwise(output)


def digests(docs: DataFrame, marks: Sequence[str] = MARKS, seed: int = 1, plain: int = 10, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """`transform` with digests of the output, and of the text rebuilt from the output and the form, in place of texts."""
    rows = transform(docs, marks, seed, plain, spm, chunk)
    back = restored(F.col("output"), F.col("form"), marks)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
