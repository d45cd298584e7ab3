"""A persistent index of texts by their rarest words, for finding the best match of a new text.

Two sets of n and m words with a Jaccard similarity of at least t share one of the first 1 + n - t n words of either,
whatever fixed order words are put in. The index keeps, for each text, a posting for each of these words, rare ones
first, in a table bucketed by word: an import is dealt to the buckets, and the index itself is never shuffled. New
texts are appended under the word order as it was when the index was built, so that increments stay small; words that
came later count as the rarest. An outdated order costs time, never a match.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clean_text, lower_each
from ..sources.shared import drop, scratch, shuffles_removed
from . import sets

register_pickle_by_value(sys.modules[__name__])  # executors may not have this package

SPACE = r"[\x20\x09-\x0D]+"
#: Postings of a word beyond which they are split over several keys; an import's rows of that word go to all of them.
HOT = 20_000
#: Similarities, in percent, at which matches are looked for in turn. A text that has found one needs no lower level.
LEVELS = (85.0,)
#: A text's signature: 256 bits, of which each word turns one over. Two texts whose signatures differ in d bits differ
#: in d words at least, so most texts that share a rare word by chance are told apart by the signatures alone.
SIGNATURE = [f"s{k}" for k in range(4)]
_SIGNATURE = ", ".join(f"{c} BIGINT" for c in SIGNATURE)
#: The same in 2,048 bits, kept with the text: what is left of the pairs of long texts, whose 256 bits are all used up.
SKETCH = [f"b{k}" for k in range(32)]
_SKETCH = ", ".join(f"{c} BIGINT" for c in SKETCH)
#: Texts are ranked in so many runs, and matched so many at a time. Shuffles and pairs of a run are removed before the next, so
#: that pairs, which grow faster than the texts, take no more disk than a run's.
RUNS, AT_ONCE = 4, 16_384
#: Texts that are looked up by their rare words at most. Postings of an indexed text take as long to read as the bits of
#: some thousand pairs take to compare, so more texts are compared with all of the index by bits (`sets`).
FEW = 1000
TABLES = {
    "words": ("word STRING, n BIGINT, parts INT", "word"),
    "postings": (f"cell BIGINT, digest BINARY, n INT, place INT, {_SIGNATURE}", "cell"),
    "texts": (f"digest BINARY, words ARRAY<STRING>, {_SKETCH}", "digest"),
    "entries": ("existing_id BIGINT, digest BINARY, batch BIGINT", "digest"),
    "removed": ("existing_id BIGINT, batch BIGINT", "existing_id"),
}


def match_key(text: Column) -> Column:
    return lower_each(clean_text(text))


def distinct_words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, SPACE), lambda w: w != ""))


def set_digest(words: Column) -> Column:
    """Texts of the same words score 100 against each other, so they share postings."""
    return F.unhex(F.md5(F.array_join(F.sort_array(words), " ").cast("binary")))


def keyed(texts: DataFrame) -> DataFrame:
    """texts with the digest and the words of their question."""
    words = texts.withColumn("words", distinct_words(match_key(F.col("question"))))
    return words.withColumn("digest", set_digest(F.col("words")))


_keyed = keyed


def distinct_texts(texts: DataFrame, *aggregates: Column) -> DataFrame:
    """(digest, words) of texts that have both, with aggregates of each digest, in a scratch table."""
    return scratch(texts.groupBy("digest").agg(F.first("words").alias("words"), *aggregates), "texts")


def checked(candidates: DataFrame, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each candidate (input_pos, question) with its best match and score; best() gives those of texts (digest, words)."""
    all_ = scratch(keyed(candidates.select("input_pos", "question")), "candidates")
    texts = distinct_texts(all_)
    own = scratch(all_.drop("words"), "candidates")
    drop(all_)
    found = best(texts)
    drop(texts)
    rows = own.join(found, "digest", "left")
    return rows.select("input_pos", "question", F.col("score").isNotNull().alias("is_duplicate"), "existing_id", F.round("score", 6).alias("score"))


def _runs(texts: DataFrame, most: int) -> list[DataFrame]:
    """A scratch table of texts in parts by digest, of about `most` texts each."""
    n = -(-texts.count() // most)
    return [texts.filter(F.pmod(F.xxhash64("digest"), F.lit(n)) == k) for k in range(n)] if n > 1 else [texts]


def _apart(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right, strict=True)])


def _sketches(turned: pa.Array) -> pa.Array:
    """The signature and the sketch of each text, as a struct of numbers."""
    at, row = turned.flatten().to_numpy(), np.repeat(np.arange(len(turned)), np.diff(turned.offsets.to_numpy()))
    bit, columns = np.int64(1) << (at // len(SKETCH)), []
    for own in (SIGNATURE, SKETCH):
        numbers = np.zeros((len(turned), len(own)), np.int64)
        np.bitwise_xor.at(numbers, (row, at % len(own)), bit)
        columns += [pa.array(c) for c in numbers.T]
    return pa.StructArray.from_arrays(columns, SIGNATURE + SKETCH)


def _prefix(n: Column, share: float) -> Column:
    """How many of n words a match at the share must share one of."""
    return (n - F.ceil(n * share - 1e-9) + 1).cast("int")


@dataclass
class PrefixIndex:
    """An index in a folder; `threshold` is the lowest similarity, in percent, that it can be asked for."""

    spark: SparkSession
    folder: str
    threshold: float
    buckets: int

    @classmethod
    def create(cls, existing: DataFrame, folder: str, threshold: float = 70.0, buckets: int | None = None) -> PrefixIndex:
        """An index of texts (existing_id, text). Null texts count as empty; a text without words matches its equals only."""
        return cls.create_from(_keyed(existing.select("existing_id", F.col("text").alias("question"))).drop("question"), folder, threshold, buckets)

    @classmethod
    def create_from(cls, existing: DataFrame, folder: str, threshold: float = 70.0, buckets: int | None = None) -> PrefixIndex:
        """An index of texts given by their digests and words (existing_id, digest, words)."""
        spark = existing.sparkSession
        out = cls(spark, folder, threshold, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.createDataFrame([(float(threshold), out.buckets)], "threshold double, buckets int").coalesce(1).write.parquet(f"{folder}/meta")
        out._register()
        keyed = scratch(existing.select("existing_id", "digest", "words"), "existing")
        distinct = scratch(keyed.groupBy("digest").agg(F.first("words").alias("words")), "distinct")
        texts = scratch(keyed.select("existing_id", "digest"), "ids")
        drop(keyed)
        counts = scratch(distinct.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
        ranked = out._ranked_in_runs(distinct, counts.withColumn("parts", F.lit(1)))
        often = out._prefixes(ranked).groupBy("word").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT)
        parts = scratch(often.select("word", F.ceil(F.col("m") / HOT).cast("int").alias("parts")), "parts")  # at most a word for each HOT postings
        out._put("words", counts.join(F.broadcast(parts), "word", "left").select("word", "n", F.coalesce("parts", F.lit(1)).alias("parts")))
        split = out._prefixes(ranked).drop("parts").join(F.broadcast(parts), "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        out._append(texts, distinct, ranked, split, 0)
        drop(texts, distinct, counts, ranked, parts)
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PrefixIndex:
        """An index that was created before, by this session or another."""
        meta = spark.read.parquet(f"{folder}/meta").first()
        out = cls(spark, folder, meta.threshold, meta.buckets)
        out._register()
        return out

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Put in texts (existing_id, text), in place of those that had the ids before, and take out the ids of `gone`.

        Only the new texts' rows are written. Entries come last and outdated ones are told by their batch, so a write
        that broke off leaves no match that is not there, and can be repeated.
        """
        batches = [self.table(t).agg(F.coalesce(F.max("batch"), F.lit(0)).alias("b")) for t in ("entries", "removed")]
        batch = reduce(DataFrame.unionByName, batches).agg(F.max("b")).first()[0] + 1
        texts = scratch(_keyed(changed.select("existing_id", F.col("text").alias("question"))), "changed")
        ids = texts.select("existing_id") if gone is None else texts.select("existing_id").unionByName(gone.select("existing_id"))
        self._put("removed", ids.distinct().withColumn("batch", F.lit(batch - 1)))
        known = self.table("texts").select("digest")
        new = scratch(texts.groupBy("digest").agg(F.first("words").alias("words")).join(known, "digest", "left_anti"), "new")
        ranked = self._ranked_in_runs(new, self.table("words"))
        self._append(texts, new, ranked, self._prefixes(ranked), batch)
        drop(texts, new, ranked)

    def _append(self, texts: DataFrame, new: DataFrame, ranked: DataFrame, prefixes: DataFrame, batch: int) -> None:
        part = F.pmod(F.hash("digest"), F.col("parts"))
        self._put("postings", prefixes.select(self._cell("word", self._size_class(F.col("n")), part).alias("cell"), "digest", "n", "place", *SIGNATURE))
        empty = new.filter("size(words) = 0").select("digest", "words", *(F.lit(0).cast("bigint").alias(c) for c in SKETCH))
        self._put("texts", ranked.select("digest", F.transform("ordered", lambda w: w["word"]).alias("words"), *SKETCH).unionByName(empty))
        self._put("entries", texts.select("existing_id", "digest").distinct().withColumn("batch", F.lit(batch)))

    def _name(self, table: str) -> str:
        return f"lorebase_{hashlib.md5(self.folder.encode()).hexdigest()}_{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def _register(self) -> None:
        for table, (columns, key) in TABLES.items():
            name = self._name(table)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{table}'")

    def _put(self, table: str, rows: DataFrame) -> None:
        columns, key = TABLES[table]
        with shuffles_removed(self.spark):
            rows.select(*(c.split()[0] for c in columns.split(", "))).repartition(self.buckets, key).write.insertInto(self._name(table))
        self.spark.catalog.refreshTable(self._name(table))

    @staticmethod
    def _ranked(texts: DataFrame, words: DataFrame) -> DataFrame:
        """(digest, n, ordered): words with their parts, rarest first, unknown ones before all."""
        each = texts.select("digest", F.explode("words").alias("word")).join(words, "word", "left")
        order = F.struct(F.coalesce(F.col("n"), F.lit(0)).alias("often"), "word", F.coalesce("parts", F.lit(1)).alias("parts"))
        ranked = each.groupBy("digest").agg(F.array_sort(F.collect_list(order)).alias("ordered")).withColumn("n", F.size("ordered"))
        # of each word the number and the bit in it that it turns over
        turned = F.transform("ordered", lambda w: F.pmod(F.xxhash64(w["word"], F.lit(7)), F.lit(len(SKETCH))) + len(SKETCH) * F.pmod(F.xxhash64(w["word"], F.lit(8)), F.lit(64)))
        return ranked.withColumn("bits", F.arrow_udf(_sketches, ", ".join(f"{c} BIGINT" for c in SIGNATURE + SKETCH))(turned)).select("digest", "ordered", *(F.col("bits")[c].alias(c) for c in SIGNATURE + SKETCH), "n")

    def _ranked_in_runs(self, texts: DataFrame, words: DataFrame) -> DataFrame:
        """The same of a scratch table of texts, in scratch tables; each run shuffles the words of its own texts only."""
        runs = _runs(texts, max(AT_ONCE, -(-texts.count() // RUNS)))
        return reduce(DataFrame.unionByName, [scratch(self._ranked(part, words), "ranked") for part in runs])

    def _prefixes(self, ranked: DataFrame, level: float | None = None) -> DataFrame:
        n = F.col("n")
        first = F.slice("ordered", F.lit(1), _prefix(n, (level or self.threshold) / 100))
        return ranked.select("digest", "n", *SIGNATURE, F.posexplode(first).alias("place", "w")).select("digest", "n", "place", *SIGNATURE, "w.word", "w.parts")

    def _size_class(self, n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / -math.log(min(self.threshold / 100, 0.95)) + 1e-9)

    @staticmethod
    def _cell(word: str, size_class: Column, part: Column) -> Column:
        return F.xxhash64(F.col(word), size_class, part.cast("int"))

    def live(self) -> DataFrame:
        """(existing_id, digest) of the texts that are in the index now."""
        gone = self.table("removed").groupBy("existing_id").agg(F.max("batch").alias("upto"))
        now = self.table("entries").join(gone, "existing_id", "left").filter(F.col("upto").isNull() | (F.col("batch") > F.col("upto")))
        return now.select("existing_id", "digest")

    def candidates(self, ranked: DataFrame, level: float) -> DataFrame:
        """(own, digest, shared word's place) of texts of the index that may reach the level, a row for each word shared.

        Only words that either's prefix holds are joined, and only where what follows the shared word leaves room for
        enough others.
        """
        share = level / 100
        names = {"digest": "own"} | {c: f"own_{c}" for c in ("n", "place", *SIGNATURE)}
        own = self._prefixes(ranked, level).withColumnsRenamed(names)
        low, high = self._size_class(F.greatest(F.ceil(F.col("own_n") * share - 1e-9), F.lit(1))), self._size_class(F.floor(F.col("own_n") / share + 1e-9))
        own = own.withColumn("size_class", F.explode(F.sequence(low, high))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = own.select(*names.values(), self._cell("word", F.col("size_class"), F.col("part")).alias("cell"))
        known = self.table("postings").filter(F.col("place") < _prefix(F.col("n"), share))
        together = F.col("own_n") + F.col("n")
        room = F.least(F.col("own_n") - F.col("own_place"), F.col("n") - F.col("place"))
        enough = (F.least("own_n", "n") >= F.greatest("own_n", "n") * share - 1e-6) & (room >= together * (share / (1 + share)) - 1e-6)
        enough &= _apart(SIGNATURE, [f"own_{c}" for c in SIGNATURE]) <= together * ((1 - share) / (1 + share)) + 1e-6
        return own.join(known, "cell").filter(enough).select("own", "digest", "own_n", "n")

    def matches(self, ranked: DataFrame, level: float) -> DataFrame:
        """(own, digest, score) of all texts of the index with a score of at least the level, exactly, in scratch tables.

        Of `ranked`, a scratch table, a bounded number of texts is matched at a time. Pairs are compared by their
        sketches first, which are short, so that words are sent for those that are likely.
        """
        share, found = level / 100, []
        for part in _runs(ranked, AT_ONCE):
            pairs = scratch(self.candidates(part, level).distinct(), "pairs")
            mine = part.select(F.col("digest").alias("own"), *(F.col(c).alias(f"own_{c}") for c in SKETCH))
            both = pairs.join(self.table("texts").select("digest", *SKETCH), "digest").join(mine, "own")
            close = _apart(SKETCH, [f"own_{c}" for c in SKETCH]) <= (F.col("own_n") + F.col("n")) * ((1 - share) / (1 + share)) + 1e-6
            near = scratch(both.filter(close).select("own", "digest", "own_n", "n"), "near")
            drop(pairs)
            words = part.select(F.col("digest").alias("own"), F.transform("ordered", lambda w: w["word"]).alias("own_words"))
            full = near.join(self.table("texts").select("digest", "words"), "digest").join(words, "own")
            shared = F.size(F.array_intersect("own_words", "words"))
            scored = full.select("own", "digest", (shared * 100.0 / (F.col("own_n") + F.col("n") - shared)).alias("score"))
            found.append(scratch(scored.filter(F.col("score") >= level), "matches"))
            drop(near)
        return reduce(DataFrame.unionByName, found)

    def best(self, texts: DataFrame, threshold: float | None = None) -> DataFrame:
        """(digest, existing_id, score) of the best match of each text (digest, words) that has one at the threshold.

        The score is the Jaccard similarity of the word sets in percent, 100 for equal texts; of the best the smallest
        existing_id counts. Matches are looked for from the highest level down, and only for texts without one, so
        that close copies never go through the long prefixes that a low threshold asks for.
        """
        threshold = self.threshold if threshold is None else threshold
        if threshold < self.threshold:
            raise ValueError("the index holds no postings for so low a threshold")
        ids = self.live().groupBy("digest").agg(F.min("existing_id").alias("existing_id"))
        if texts.count() > FEW:
            return sets.best(texts, self.table("texts").select("digest", "words"), scratch(ids, "ids"), threshold)
        found = [scratch(texts.select("digest").join(ids, "digest").withColumn("score", F.lit(100.0)), "exact")]
        own = scratch(texts.join(found[0].select("digest"), "digest", "left_anti"), "own")
        left = self._ranked_in_runs(own, self.table("words"))
        drop(own)
        for level in [x for x in LEVELS if x > threshold] + [threshold]:
            matched = self.matches(left, level)
            named = matched.join(ids, "digest")
            top = named.groupBy("own").agg(F.max(F.struct("score", (-F.col("existing_id")).alias("id"))).alias("best"))
            found.append(scratch(top.select(F.col("own").alias("digest"), (-F.col("best.id")).alias("existing_id"), F.col("best.score").alias("score")), "found"))
            drop(matched)
            if level > threshold:
                left, before = scratch(left.join(found[-1].select("digest"), "digest", "left_anti"), "left"), left
                drop(before)
        drop(left)
        return reduce(DataFrame.unionByName, found)

    def similar(self, texts: DataFrame) -> DataFrame:
        """(own, digest, score) of every two different texts, one of `texts` (digest, words), a scratch table, the other of the index."""
        if texts.count() > FEW:
            return sets.matches(texts, self.table("texts").select("digest", "words"), self.threshold)
        ranked = self._ranked_in_runs(texts, self.table("words"))
        matched = self.matches(ranked, self.threshold)
        drop(ranked)
        return matched.filter("own <> digest")

    def check(self, candidates: DataFrame, threshold: float | None = None) -> DataFrame:
        """Each candidate (input_pos, question) with its best match and score, as `importer.check` gives them."""
        return checked(candidates, lambda texts: self.best(texts, threshold))
