import numpy as np
import pytest
from lorebase.llm import mixing, queries
from lorebase.llm.mixing import DomainModel
from pyspark.sql import functions as F

from .conftest import ROWS

SF = "/root/testdata/sf0.01"


def test_counts(odd):
    got = odd.select("text", mixing.n_tokens(F.col("text")).alias("k")).collect()
    import re

    assert all(r.k == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got)


def test_posterior_against_numpy(spark):
    model = DomainModel(["a", "b"], [0.3, 0.7], ["blue", "red"], [[1.0, -2.0], [0.5, 1.5]])
    texts = ["red RED blue", "nothing", None, "blue!"]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mixing.posterior(F.col("t"), model).alias("p")).collect()]
    for t, p in zip(texts, got, strict=True):
        words = set((t or "").lower().replace("!", "").split())
        z = np.log(model.prior) + sum((np.array([w[k] for w in model.weights]) for k, v in enumerate(model.vocabulary) if v in words), np.zeros(2))
        assert np.allclose(p, np.exp(z) / np.exp(z).sum())


def test_rates_against_numpy(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = r.integers(1, 900, 400)
    members = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id bigint, n_tokens bigint, p array<double>")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    fit = mixing.fit_rates(members, list("abc"), targets)
    wanted = np.array([0.6, 0.3, 0.1]) * tokens.sum()
    # projected gradient steps with numpy
    rate = before = np.ones(400)
    for *s, momentum in fit.steps:
        start = rate + momentum * (rate - before)
        rate, before = np.maximum(0, start - fit.pace * (p @ s + fit.pull * (start - 1))), rate
    got = np.array([x.r for x in members.orderBy("doc_id").select(fit.rate(F.col("p")).alias("r")).collect()])
    assert np.allclose(got, rate) and (got >= 0).all()
    assert np.allclose(fit.expected, (rate * tokens) @ p) and np.allclose(fit.targets, wanted)
    assert np.abs(np.array(fit.expected) - wanted).max() <= 0.02 * wanted.max()
    assert (np.abs(np.array(fit.expected) - wanted) <= 1e-3 * wanted).all() and len(fit.steps) <= 20


def test_query_meets_targets(spark):
    rows = queries.op6_mixing(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    # most documents' domain is their language; some mix two languages
    assert sum(lang[r.doc_id] == r.domain for r in rows) > 0.9 * len(rows)
    total = {d: sum(r.rate * r.n_tokens * float(r.posteriors.split(",")[i]) for r in rows) for i, d in enumerate(sorted(queries.TARGETS))}
    for d, share in queries.TARGETS.items():
        assert total[d] / sum(total.values()) == pytest.approx(share / sum(queries.TARGETS.values()), abs=0.01)
    assert all(r.rate >= 0 and r.copies >= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    labelled = spark.createDataFrame([(i, f"{'rot gelb' if i % 2 else 'red yellow'} {i}", "de" if i % 2 else "en") for i in range(40)] + [(None, None, None)], "doc_id bigint, text string, domain string")
    targets = {"de": 1.0, "en": 1.0}
    for some in (labelled, labelled.limit(0)):
        rows = mixing.mix(odd, some, targets).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
        repeated = mixing.repeat_documents(odd, some, targets)
        assert repeated.columns == odd.columns
        n = {}
        for r in repeated.collect():
            n[r.doc_id] = n.get(r.doc_id, 0) + 1
        want = {}
        for r in rows:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
        assert n == want
    assert mixing.mix(empty, labelled, targets).collect() == [] and mixing.repeat_documents(empty, labelled, targets).collect() == []


def test_no_python_in_the_plan(spark, odd):
    labelled = odd.select("doc_id", "text", F.col("lang").alias("domain"))
    assert "Python" not in (plan := mixing.mix(odd, labelled, {"en": 1.0})._jdf.queryExecution().toString()) and "Arrow" not in plan


@pytest.mark.parametrize("natural", [(97, 1, 1, 1), (5, 5, 85, 5), (3, 3, 92, 2), (70, 10, 10, 10)])
def test_skewed_corpora_meet_targets(spark, natural):
    """Hard posteriors of skewed shares; every target can be reached."""
    members = spark.createDataFrame([(k, 10 * n, [float(i == k) for i in range(4)]) for k, n in enumerate(natural)], "doc_id bigint, n_tokens bigint, p array<double>")
    fit = mixing.fit_rates(members, list(queries.TARGETS), queries.TARGETS)
    assert max(map(abs, fit.missed().values())) <= 1e-3


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(0, 50, [0.5, 0.5]), (1, 70, [0.5, 0.5])], "doc_id bigint, n_tokens bigint, p array<double>")
    with pytest.warns(UserWarning, match="not met"):
        fit = mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert fit.missed()["a"] < -0.1 and fit.missed()["b"] > 0.1


def test_steps_follow_the_gradient(spark):
    """The first step is the least-squares gradient by its definition, and rates never leave the nonnegative ones."""
    r = np.random.default_rng(3)
    p, tokens = r.dirichlet([0.2] * 4, 300), r.integers(1, 500, 300)
    members = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id bigint, n_tokens bigint, p array<double>")
    fit = mixing.fit_rates(members, list("abcd"), {"a": 0.0, "b": 1.0, "c": 1.0, "d": 1.0})
    wanted = np.array([0, 1, 1, 1]) / 3 * tokens.sum()
    assert np.allclose(np.array(fit.steps[0][:4]) * (tokens @ p**2), tokens @ p - wanted) and fit.steps[0][4] == 0
    got = np.array([x.r for x in members.select(fit.rate(F.col("p")).alias("r")).collect()])
    assert (got >= 0).all() and (got == 0).any()


def test_smallest_rate_of_zero_counts_as_a_tenth(spark):
    docs = spark.createDataFrame([(i, f"{'rot gelb' if i % 2 else 'red yellow'}", "de" if i % 2 else "en") for i in range(40)], "doc_id bigint, text string, domain string")
    _, members, fit, low = mixing.fit_mixture(docs, docs, {"de": 1.0, "en": 0.0}, 100)
    assert members.agg(F.min(fit.rate(F.col("p")))).first()[0] == 0.0 and low == 0.1
