"""Quality classifier by compression.

Two zstandard dictionaries, one trained on good and one on bad labelled text, each compress a text in short
independent blocks. The difference of the two sizes, divided by the text's own size, says which kind the text is
nearer to: text that either dictionary makes short, as repeated words, has a difference near none, like other text
that the good one does not know. A text counts as if a few bytes of average text were added to it, so that the
shortest ones, of which compression tells nothing, score as the average does. A logistic curve over that normalised
difference alone gives a calibrated score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import crc_fold, discard, labelled_sample, map_rows, settle, ship, third

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
BLOCK, LEVEL, ADDED = 256, 3, 30


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the last one the constant, of a logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    """Dictionaries (None when a kind of label is missing), the weights of the logistic curve, and the average text's
    size difference for each byte, in tenths."""

    good: bytes | None
    bad: bytes | None
    weights: list[float]
    average: float = 0.0

    def difference(self):
        """A function from a text's bytes to its size difference, in tenths of a byte."""

        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress

        good, bad = compressor(self.good), compressor(self.bad)

        def of(raw: bytes) -> float:
            blocks = blocks_of(raw)
            return 10.0 * sum(len(bad(x)) - len(good(x)) for x in blocks)

        return of

    def scorer(self):
        slope, constant = self.weights
        if self.good is None or self.bad is None:
            known = float(1 / (1 + np.exp(-constant)))
            return lambda text: known
        difference = self.difference()

        def score(text: str | None) -> float:
            raw = (text or "").encode()
            z = slope * normalised(difference(raw), len(raw), self.average) + constant
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def normalised(difference: float, size: int, average: float) -> float:
    """The difference for each byte, with ADDED bytes of average text."""
    return (difference + ADDED * average) / (size + ADDED)


def blocks_of(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _dictionary(texts: list[str], size: int) -> bytes:
    pieces = [x for t in texts for x in blocks_of(t.encode()) if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-size:].ljust(8, b" ")


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, size: int = 65_536) -> QualityModel:
    """Fit on labelled rows outside the held-out fold: at most `most` documents of each label.

    Two thirds of these, with their whole texts, make the dictionaries, one task for each label; the rest, with
    their whole texts, make the curve, weighted so that the sample's two labels count as in the labelled table.
    The driver gets two dictionaries of `size` bytes, and a label and two numbers for each row of the bounded sample.
    Without both labels the score is the share of label 1, or 0.5 without labels.
    """
    train = crc_fold(F.col("doc_id"), 5) != 0
    n = {r[0]: r[1] for r in labels.filter(train & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    base = float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    sample = labelled_sample(docs, labels, "quality", train, most).withColumn("third", third(F.col("doc_id")))
    sample = settle(sample, "quality-sample")
    there = {(r.label, r.curve): r["count"] for r in sample.groupBy("label", (F.col("third") == 0).alias("curve")).count().collect()}
    if min(there.get((k, c), 0) for k in (0, 1) for c in (True, False)) < 2:
        discard(sample)
        return QualityModel(None, None, [0.0, base])
    ship(docs.sparkSession)

    def learn(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "dictionary": [_dictionary(rows.sort_values("doc_id")["text"].tolist(), size)]})

    made = sample.filter("third <> 0").select("doc_id", "label", "text").groupBy("label").applyInPandas(learn, "label int, dictionary binary")
    dictionary = {r.label: bytes(r.dictionary) for r in made.collect()}
    model = QualityModel(dictionary[1], dictionary[0], [])

    def start():
        difference = model.difference()
        return lambda k, t: (k, [difference(x.encode()) for x in t], [len(x.encode()) for x in t])

    rows = map_rows(sample.filter("third = 0").select("label", "text"), "label int, x double, size bigint", start)
    curve = sorted((r.label, r.x, r.size) for r in rows.collect())
    y = np.array([float(k) for k, *_ in curve])
    good = 1 / (1 + np.exp(-base))
    average = sum(share * np.mean([x / max(1, n) for k, x, n in curve if k == kind]) for kind, share in ((1, good), (0, 1 - good)))
    w = logistic(np.array([[normalised(x, n, average)] for _, x, n in curve]), y)
    w[-1] += base - np.log(y.mean() / (1 - y.mean()))
    discard(sample)
    return QualityModel(model.good, model.bad, w.tolist(), float(average))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """A row for each document: held_out, score (0 to 1, higher is better), predicted.

    The whole text is scored; null text counts as empty, and a null doc_id as held out. Repeated rows give
    repeated rows, an empty table an empty one, other columns are ignored. One pass without a shuffle.
    """

    def start():
        judge = model.scorer()

        def work(ids, held, texts):
            scores = [judge(t) for t in texts]
            return ids, held, scores, [int(s >= threshold) for s in scores]

        return work

    return map_rows(docs.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), SCHEMA, start)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold.

    Rows are judged one by one, by their text alone: repeated rows stay or go together, a null doc_id does not
    matter, and null text counts as empty. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judge: list = []

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        if not judge:
            judge.append(model.scorer())
        return text.map(judge[0], na_action=None).astype(float)

    return docs.filter(scored("text") >= threshold).select(*columns)
