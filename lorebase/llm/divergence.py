"""How much the sources of a language differ in their words, by a two-pass vocabulary automaton.

The first pass counts for each term the documents of a language that hold it, and the terms of enough documents are
kept. The second finds the kept terms in every whole text by Aho-Corasick automata over delimiter-padded terms, and
counts their occurrences for each source. A posting of a term lists the sources that have it, so work goes with
occurrences in sources, not with all terms times all sources; terms that two sources lack are counted, not visited.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, settle, ship

#: Bytes of the terms of one automaton, some million terms; it takes 13 times as much memory, 40 times at worst.
BLOCK = 10_000_000
#: Bytes of a term that an automaton holds; longer terms are told apart by a digest in their place.
LONGEST = 64
#: Terms, and occurrences (of 8 bytes), that a task holds before it sends what it has counted.
HELD_TERMS, HELD = 400_000, 3_000_000
#: Sources of a language that a task's table of sums has room for; it takes 32 * WIDE * WIDE bytes at most.
WIDE = 1000
SCALE = 1_000_000_000
#: ASCII without letters becomes a space, A-Z become a-z; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _rows(docs: DataFrame) -> DataFrame:
    """lang, source and text without nulls."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_frequencies(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, df) of the terms that at least `least` documents of the language hold."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            langs = [lang for lang, own in held.items() for _ in own]
            terms, n = [t for own in held.values() for t in own], [k for own in held.values() for k in own.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "term", "df"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                held.setdefault(lang, Counter()).update(set(text.as_py().translate(PLAIN).split()))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield out()
                    held.clear()
        yield out()

    found = _rows(docs).select("lang", "text").mapInArrow(run, "lang string, term string, df bigint")
    return found.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= least)


def _blocks(kept: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The kept terms with the number of their block, and how many blocks there are.

    The terms of most documents come first, as far as a histogram of the frequencies' logarithms shows that their
    bytes fit in one block; the others are dealt over as many as they take.
    """
    bin_, room = F.floor(F.log2("df") * 8).cast("int"), F.least(F.octet_length("term"), F.lit(LONGEST)) + 2
    found = kept.groupBy(bin_.alias("bin")).agg(F.sum(room).alias("bytes")).collect()  # a few hundred rows
    first, floor, total = 0, None, sum(r.bytes for r in found)
    for b, own in sorted(((r.bin, r.bytes) for r in found), reverse=True):
        if first + own > most:
            break
        first, floor = first + own, b
    rest = -(-5 * (total - first) // (4 * most))
    dealt = F.pmod(F.xxhash64("lang", "term"), F.lit(max(rest, 1))).cast("int")
    if floor is None:
        return kept.withColumn("block", dealt), rest
    return kept.withColumn("block", F.when(bin_ >= floor, F.lit(0)).otherwise(dealt + 1)), rest + 1


_BUILT: dict[tuple, tuple] = {}


def _automata(key: tuple, terms: dict[str, str]) -> tuple[dict, pa.Array]:
    """For each language an automaton of its terms between delimiters, whose values are the terms' numbers; and the
    terms by number. `terms` has those of each language, a line each.

    The last ones built in a worker process are kept, so that its next tasks have them.
    """
    import ahocorasick

    if key not in _BUILT:
        own: dict[str, ahocorasick.Automaton] = {}
        names, number = [], 0
        for lang, lines in terms.items():
            automaton, each = own.setdefault(lang, ahocorasick.Automaton()), lines.split("\n")
            for term in each:
                automaton.add_word(f" {_short(term.encode()).decode()} ", number)
                number += 1
            automaton.make_automaton()
            names.append(pa.array(each))
        _BUILT.clear()
        _BUILT[key] = own, pa.concat_arrays([pa.array([], pa.string()), *names])
    return _BUILT[key]


def _short(term: bytes) -> bytes:
    """A long term as its length and digest, with a colon, which no term has."""
    return term if len(term) <= LONGEST else f"{len(term)}:{hashlib.blake2b(term, digest_size=16).hexdigest()}".encode()


def _padded(text: bytes) -> str:
    """The text's terms, the long ones shortened, each between delimiters."""
    words = text.translate(PLAIN).split()
    if words and max(map(len, words)) > LONGEST:
        words = list(map(_short, words))
    return f" {b' '.join(words).decode()} "


def _between(padded: str, ends: list[int], numbers: list[int], widths: list[int]) -> str:
    """What lies between the matches, whose delimiters neighbours share."""
    parts, at = [], 0
    for end, number in zip(ends, numbers, strict=True):
        begin = end - widths[number] - 1
        if begin > at:
            parts.append(padded[at : begin + 1])
        at = end
    return "".join([*parts, padded[at:]])


def occurrences(docs: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, term, n): how often each kept term (lang, term, df) occurs in the texts of each source that has it.

    One automaton holds all kept terms of a language as long as there are at most `block` in all. Beyond it the terms
    of most documents are looked for first; what they leave of the texts, far less, is written to the shared folder and
    goes to the next block's automaton. So memory is bounded, and every occurrence is counted once.
    """
    spark = docs.sparkSession
    numbered, blocks = _blocks(kept, block)
    texts, counted, used = _rows(docs).withColumn("text", F.col("text").cast("binary")), [], []
    for b in range(blocks):
        own: dict[str, list[str]] = {}
        for r in numbered.filter(F.col("block") == b).select("lang", "term").toLocalIterator():  # about `block` bytes
            own.setdefault(r.lang, []).append(r.term)
        shared = spark.sparkContext.broadcast({lang: "\n".join(sorted(terms)) for lang, terms in own.items()})
        last = b + 1 == blocks
        run = _counting(shared, (spark.sparkContext.applicationId, shared._jbroadcast.id()), first=b == 0, last=last)
        found = texts.mapInArrow(run, "lang string, source string, term string, n bigint, rest binary")
        if not last:
            found = settle(found, "residues")
            used.append(found)
        counted.append(found.filter("rest IS NULL").groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
        texts = found.filter("rest IS NOT NULL").select("lang", "source", F.col("rest").alias("text"))
    counted = counted or [spark.createDataFrame([], "lang string, source string, term string, n bigint")]
    out = settle(reduce(DataFrame.unionByName, counted), "occurrences")
    for residue in used:
        discard(residue)
    return out


def _counting(shared, key: tuple, first: bool, last: bool):
    """Counts of occurrences (lang, source, term, n), and, before the last block, the rests of texts (lang, source, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, terms = _automata(key, shared.value)
        widths = [] if last else [len(_short(t.encode()).decode()) for t in terms.to_pylist()]
        held: dict[tuple[str, str], list[int]] = {}
        n_held, names = 0, ["lang", "source", "term", "n", "rest"]

        def out():
            each = [np.unique(np.array(numbers, np.int64), return_counts=True) for numbers in held.values()]
            group = np.repeat(np.arange(len(each)), [len(found) for found, _ in each])
            found, n = (np.concatenate([e[k] for e in each]) for k in (0, 1))
            langs, sources = (pa.array([g[k] for g in held], pa.string()).take(pa.array(group)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([langs, sources, terms.take(pa.array(found)), pa.array(n, pa.int64()), pa.nulls(len(found), pa.binary())], names=names)

        for batch in batches:
            rests: list[tuple[str, str, bytes]] = []
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                padded = _padded(text.as_py()) if first else text.as_py().decode()
                pairs = list(automata[lang].iter(padded)) if lang in automata else []
                numbers = [v for _, v in pairs]
                held.setdefault((lang, source), []).extend(numbers)
                n_held += len(numbers)
                if not last and (rest := _between(padded, [e for e, _ in pairs], numbers, widths)).strip(" "):
                    rests.append((lang, source, rest.encode()))
                if n_held > HELD:
                    yield out()
                    held.clear()
                    n_held = 0
            if rests:
                lang, source, rest = zip(*rests, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.nulls(len(rests), pa.string()), pa.nulls(len(rests), pa.int64()), pa.array(rest, pa.binary())], names=names)
        if held:
            yield out()

    return run


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: decimals hold what passes 64 bits."""
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)")) + 1


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, least: int = 3, top: int = 200, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each occurring (lang, source).

    A language keeps the terms in at least `least` of its documents. A group's share p of a term is
    1 + floor(10**9 * (count + 1) / (all counts + terms)), and a term's value against a share q is
    floor((p - q)**2 / q). Part 'pair' has a row for each other source of the language, the sum of the values against
    that source's shares over all kept terms, absent ones included; part 'term' has the `top` terms that occur in the
    group and have a greater share than in the whole language, with their values against that. Ranks begin at 1, by
    value from the largest, then by item in UTF-8.

    Null text, lang and source count as ''. A group without terms has a row for each other source, all shares equal; a
    language without kept terms has pairs of value 0. Repeated rows count repeatedly, a very long text counts whole,
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kept = settle(document_frequencies(docs, least), "terms")
    counts = occurrences(docs, kept, block)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = _rows(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(1))
    groups = settle(groups.withColumn("none", none), "groups")

    whole = counts.groupBy("lang").agg(F.sum("n").alias("all_total"))
    shares = counts.join(groups, ["lang", "source"]).join(whole, "lang")
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    entry = F.struct("source", "p", "none", "n")
    postings = shares.groupBy("lang", "term", "terms", "all_total").agg(F.collect_list(entry).alias("own"))  # as many entries as sources have the term
    everywhere = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    postings = settle(postings.withColumn("q", _share(everywhere, F.col("all_total"), F.col("terms"))).select("lang", "term", "q", F.transform("own", lambda x: F.struct(x["source"].alias("source"), x["p"].alias("p"), x["none"].alias("none"))).alias("own")), "postings")

    by_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    each = postings.select("lang", "term", "q", F.inline("own")).filter("p > q")
    value = F.expr("((p - q) * (p - q)) div q")
    terms = each.select("lang", "source", F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(by_source)).filter(F.col("rank") <= top)
    pairs = _pairs(groups, shares, postings).withColumn("rank", F.row_number().over(by_source))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    discard(kept)
    return out.select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, shares: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language.

    The sum over all terms is that over the terms of either source alone, at the other's share of an absent term; that
    over what neither has; and for each term that both have what it differs from the two. The first two follow from how
    many of a source's terms have each share. Only the last goes through postings; each task sums it before it sends it.
    """
    profile = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("own"))
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "none"))).alias("others"))  # the language's sources
    sides = groups.select("lang", "source", "none", "terms").join(profile, ["lang", "source"], "left").join(listed, "lang")
    names = ["lang", "source", "item", "value"]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, source, none, terms, own, others = (c[row].as_py() for c in batch.columns)
                p, m = (np.array([x[k] for x in own or []], np.int64) for k in ("p", "m"))
                kept = [x for x in others if x["source"] != source]
                q = np.array([x["none"] for x in kept], np.int64)
                forth, back = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
                for at in range(0, len(p), 512):
                    own_p, own_m = p[at : at + 512, None], m[at : at + 512, None]
                    forth += (own_m * _gain(own_p, q)).sum(0)
                    back += (own_m * _gain(q, own_p)).sum(0)
                # what this source has takes the place of one absent term each, in both directions; half of all absent ones are told by either side
                size = int(m.sum())
                forth += (terms - size) * _gain(np.int64(none), q) if len(q) else 0
                back -= size * _gain(q, np.int64(none)) if len(q) else 0
                other = [x["source"] for x in kept]
                columns = [[lang] * (2 * len(q)), [source] * len(q) + other, other + [source] * len(q), np.concatenate([forth, back])]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3])], names=names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[str, int], np.ndarray]] = {}

        def rows(lang: str, a: list, b: list, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(sums)], names=names)

        def out(lang: str) -> pa.RecordBatch:
            at, sums = held.pop(lang)
            source = np.array(list(at), object)
            a, b = np.nonzero(sums[: len(source), : len(source)])
            return rows(lang, source[a].tolist(), source[b].tolist(), sums[a, b])

        def add(lang: str, source: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Postings of equal length, a row each."""
            own, place = np.unique(source, return_inverse=True)
            if len(own) > WIDE and len(source) > 1:
                for half in np.array_split(np.arange(len(source)), 2):
                    yield from add(lang, source[half], p[half], q[half])
                return
            if len(own) > WIDE:  # more sources than a table has room for: a row of it at a time
                for k in range(len(own)):
                    a, x = p[0, k], q[0, k]
                    more = _gain(a, p[0]) - _gain(a, q[0]) - _gain(x, p[0]) + _gain(x, q[0])
                    yield rows(lang, [source[0, k]] * (len(own) - 1), np.delete(source[0], k).tolist(), np.delete(more, k))
                return
            at, sums = held.setdefault(lang, ({}, np.zeros((32, 32), np.int64)))
            if len(at.keys() | set(own)) > WIDE:
                yield out(lang)
                at, sums = held.setdefault(lang, ({}, np.zeros((32, 32), np.int64)))
            places = np.array([at.setdefault(s, len(at)) for s in own])
            if len(at) > len(sums):
                sums = np.pad(sums, (0, 2 * len(at) - len(sums)))
                held[lang] = at, sums
            place = places[place.reshape(source.shape)]
            a, b, x, y = p[:, :, None], p[:, None, :], q[:, :, None], q[:, None, :]
            more = _gain(a, b) - _gain(a, y) - _gain(x, b) + _gain(x, y)
            more[:, np.arange(p.shape[1]), np.arange(p.shape[1])] = 0
            np.add.at(sums.reshape(-1), (place[:, :, None] * len(sums) + place[:, None, :]).ravel(), more.ravel())

        for batch in batches:
            own, langs = batch.column("own"), np.array(batch.column("lang").to_pylist(), object)
            ends, flat = own.offsets.to_numpy().astype(np.int64), own.values
            source = np.array(flat.field("source").to_pylist(), object)
            p, q = (flat.field(c).to_numpy().astype(np.int64) for c in ("p", "none"))
            length = np.diff(ends)
            for lang in set(langs):
                for k in np.unique(length[(langs == lang) & (length > 1)]):
                    where = np.flatnonzero((langs == lang) & (length == k))
                    for part in np.array_split(where, -(-len(where) * int(k) * int(k) // 500_000)):
                        at = ends[part][:, None] + np.arange(k)
                        yield from add(lang, source[at], p[at], q[at])
                        if sum(s.nbytes for _, s in held.values()) > 40 * WIDE * WIDE:
                            for other in [x for x in held if x != lang]:
                                yield out(other)
        for lang in list(held):
            yield out(lang)

    schema = "lang string, source string, item string, value bigint"
    each = sides.select("lang", "source", "none", "terms", "own", "others").mapInArrow(alone, schema)
    both = postings.select("lang", "own").mapInArrow(together, schema)
    return each.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
