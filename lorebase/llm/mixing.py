"""Mixing domains to target weights with soft membership. DataFrame functions only.

A naive Bayes classifier, trained on a labelled table, gives each document a posterior over domains. Projected
gradient steps then fit a nonnegative rate for each document, so that the expected tokens of each domain, counted at
these rates, match the targets in the least-squares sense while rates stay near one.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, settle


def words(text: Column) -> Column:
    """The runs of letters in a lower-cased text; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    """How many words white space separates; 0 for a null text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(SPACE)) + 1).cast("bigint")


def in_expectation(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass
class DomainModel:
    """log weight of each domain when a vocabulary word is present, and the constant. Bounded by the vocabulary."""

    domains: list[str]
    prior: list[float]
    vocabulary: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)  # of each domain, a number for each word

    def posterior(self, present: Column) -> Column:
        """An array of the domains' posteriors, from the sorted places of the vocabulary words in a text."""


        def log_weight(prior: float, weights: list[float]) -> Column:
            start = F.lit(float(np.log(prior)))
            if not weights:
                return start
            of = F.array(*map(F.lit, weights))
            return F.aggregate(present, start, lambda a, i: a + F.element_at(of, i))

        def normalised(logs: Column) -> Column:
            raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
            return let(raised, lambda r: let(in_expectation(r), lambda total: F.transform(r, lambda x: x / total)))

        logs = F.array(*(log_weight(p, w) for p, w in zip(self.prior, self.weights or [[]] * len(self.prior), strict=True)))
        return let(logs, normalised)


def fit_domains(labelled: DataFrame, most: int = 4000, size: int = 192, least: int = 3) -> DomainModel:
    """Train on at most `most` rows (doc_id, text, domain) of the labelled table, those whose ids hash lowest.

    The vocabulary is the `size` words that tell most about the domain, of those in `least` texts or more.
    Rows with a null domain are left out. Without rows there is one domain, named "all".
    """
    rows = labelled.filter("domain IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("domain").cast("string").alias("domain"))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = settle(rows.join(F.broadcast(ids), "doc_id").select("domain", F.array_distinct(words(F.col("text"))).alias("words")), "domain-sample")
    shares = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    domains = sorted(shares)
    if not domains:
        return DomainModel(["all"], [1.0])
    total = sum(shares.values())
    n = {d: F.coalesce(F.sum(F.when(F.col("domain") == d, 1)), F.lit(0)) for d in domains}
    counted = sample.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*(n[d].alias(f"n{i}") for i, d in enumerate(domains)), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # how far the presence of a word moves the domains' shares: its mutual information with the domain
    terms = [F.col(f"n{i}") / total * F.log((F.col(f"n{i}") + 1e-9) * total / (F.col("n") * shares[d])) for i, d in enumerate(domains)]
    best = counted.select("*", sum(terms[1:], terms[0]).alias("gain")).orderBy(F.desc("gain"), "word").limit(size).orderBy("word").collect()
    rates = np.array([[(r[f"n{i}"] + 0.5) / (shares[d] + 1.0) for r in best] for i, d in enumerate(domains)]).reshape(len(domains), -1)
    prior = np.array([(shares[d] + 1) / (total + len(domains)) for d in domains])
    # presence weights relative to absence, damped as words of a text are not independent
    damp = 0.3
    absent = damp * np.log(1 - rates).sum(axis=1)
    start = np.log(prior) + absent - absent.max()
    return DomainModel(domains, np.exp(start).clip(1e-30).tolist(), [r.word for r in best], (damp * (np.log(rates) - np.log(1 - rates))).tolist())


def posterior(text: Column, model: DomainModel) -> Column:
    if not model.vocabulary:
        return model.posterior(F.array().cast("array<int>"))
    vocabulary = F.array(*map(F.lit, model.vocabulary))
    places = F.transform(F.array_intersect(words(text), vocabulary), lambda w: F.array_position(vocabulary, w).cast("int"))
    return let(F.array_sort(places), model.posterior)


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(doc_id, n_tokens, p): whitespace tokens and domain posteriors of each document; extra columns are dropped."""
    return docs.select("doc_id", n_tokens(F.col("text")).alias("n_tokens"), posterior(F.col("text"), model).alias("p"))


def rate(p: Column, steps: list[list[float]], pull: float, pace: float) -> Column:
    """The rate of a document after the given gradient steps, from rate 1.

    A step is a number for each domain and, last, the momentum with which it leaves from the two rates before it.
    """
    if not steps:
        return F.lit(1.0)
    moved = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def step(at: Column, s: Column) -> Column:
        dot = F.aggregate(F.zip_with(p, s, lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0), lambda a, x: a + x)  # p is a place shorter than s
        begin = at["now"] + F.element_at(s, -1) * (at["now"] - at["before"])
        return let(begin, lambda y: F.struct(F.greatest(F.lit(0.0), y - F.lit(pace) * (dot + F.lit(pull) * (y - 1.0))).alias("now"), at["now"].alias("before")))

    return F.aggregate(moved, F.struct(F.lit(1.0).alias("now"), F.lit(1.0).alias("before")), step, lambda at: at["now"])


@dataclass
class Mixture:
    """Fitted rates as gradient steps; `expected` and `targets` are token totals of each domain."""

    domains: list[str]
    steps: list[list[float]]
    pull: float
    pace: float
    expected: list[float]
    targets: list[float]

    def missed(self) -> dict[str, float]:
        """How far each domain's expected tokens are from its target, as a part of the target."""
        return {d: (e - t) / t if t else float(e > 0) for d, e, t in zip(self.domains, self.expected, self.targets, strict=True)}

    def rate(self, p: Column) -> Column:
        return rate(p, self.steps, self.pull, self.pace)


def fit_rates(members: DataFrame, domains: list[str], targets: Mapping[str, float], pull: float = 1e-5, rounds: int = 40, close: float = 1e-3) -> Mixture:
    """Rates r >= 0 that minimise sum_d w_d / 2 (sum_i r_i t_i p_id - T_d)^2 + pull / 2 sum_i t_i (r_i - 1)^2.

    t_i are tokens, p_id posteriors; targets are relative weights of the domains (a domain without one keeps its
    natural share), T_d their share of all tokens. w_d scales a domain's step: 1 / sum_i t_i p_id^2, where that is not
    below a fiftieth of T_d, so that rare domains rise as fast as frequent ones. Steps of the projected gradient, with
    momentum that starts again when the fit gets worse, are taken until every domain is within `close` of its target,
    the totals settle or `rounds` are over. A round is one aggregation of the members to a number for each domain; the
    driver keeps only these, from which each row computes its own rate. Targets that are missed are warned of.
    """
    d = len(domains)
    t, p = F.col("n_tokens"), [F.col("p")[i] for i in range(d)]
    some = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    sums = np.array(members.agg(*(some(t * x) for x in p), *(some(t * x * y) for x in p for y in p)).first(), dtype=float)
    total, gram = sums[:d], sums[d:].reshape(d, d)
    all_tokens = total.sum()
    if not all_tokens:
        return Mixture(domains, [], pull, 1.0, [0.0] * d, [0.0] * d)
    share = np.array([max(0.0, targets.get(name, total[i] / all_tokens)) for i, name in enumerate(domains)])
    wanted = (share / share.sum() if share.sum() else total / all_tokens) * all_tokens
    scale = np.maximum(wanted, 1e-9 * all_tokens)
    weight = 1 / np.maximum(np.diag(gram), scale / 50)
    pace = float(1 / (np.linalg.eigvalsh(np.sqrt(np.outer(weight, weight)) * gram)[-1] + pull))
    steps: list[list[float]] = []
    before = now = total
    age, momentum = 1.0, 0.0
    while len(steps) < rounds and (np.abs(now - wanted) > close * scale).any():
        start = now + momentum * (now - before)  # totals are linear in the rates
        steps.append([*(weight * (start - wanted)).tolist(), momentum])
        row = members.select("n_tokens", "p", rate(F.col("p"), steps, pull, pace).alias("r")).agg(*(some(t * F.col("r") * x) for x in p)).first()
        before, now = now, np.array(row, dtype=float)
        if np.abs(now - before).max() <= 1e-7 * all_tokens:
            break
        if weight @ (now - wanted) ** 2 > weight @ (before - wanted) ** 2:
            age, momentum = 1.0, 0.0
        else:
            older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
            momentum = float((older - 1) / age)
    fit = Mixture(domains, steps, pull, pace, now.tolist(), wanted.tolist())
    if (np.abs(now - wanted) > close * scale).any():
        warnings.warn(f"targets of the mixture not met; tokens beside the target, as a part of it: {fit.missed()}", stacklevel=2)
    return fit


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], most: int) -> tuple[DomainModel, DataFrame, Mixture, float]:
    """The classifier, the documents' memberships, the fitted rates, and the rate that counts as one copy."""
    model = fit_domains(labelled, most)
    members = settle(memberships(docs, model), "memberships")
    fit = fit_rates(members, model.domains, targets)
    low = members.filter("n_tokens > 0").agg(F.min(fit.rate(F.col("p")))).first()[0]
    return model, members, fit, max(1.0 if low is None else low, 0.1)


def copies(doc_id: Column, rates: Column, low: float) -> Column:
    """How often a document appears: rate / low, its fraction decided by a hash of doc_id, and once at least."""
    chance = F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) / 1_000_003.0
    return let(F.greatest(F.lit(1.0), rates / low), lambda t: (F.floor(t) + (chance < t - F.floor(t)).cast("int")).cast("int"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], most: int = 4000) -> DataFrame:
    """A row for each document: doc_id, n_tokens, domain (the likeliest), p_domain, posteriors, rate, copies.

    copies realises the rates without dropping anything: the smallest rate of a document with tokens, at least a
    tenth, counts as one copy. Null or empty texts have no tokens and posteriors near the prior. A null doc_id
    stays null, repeated rows give repeated rows, an empty table an empty one; other columns are ignored. Of equally
    likely domains the first by name counts.
    """
    model, members, fit, low = fit_mixture(docs, labelled, targets, most)
    best = F.array_max("p")
    name = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("p", best).cast("int"))
    own = F.array_join(F.transform("p", lambda x: F.format_number(x, 6)), ",")
    rates = fit.rate(F.col("p"))
    return members.select("doc_id", "n_tokens", name.alias("domain"), best.alias("p_domain"), own.alias("posteriors"), rates.alias("rate"), copies(F.col("doc_id"), rates, low).alias("copies"))


def repeat_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], most: int = 4000) -> DataFrame:
    """The documents with all their columns, each as often as its fitted rate asks; nothing is dropped.

    Null and empty texts have posteriors near the prior and appear once at least; repeated rows, and rows of a null
    doc_id, are each taken by themselves. An empty table gives an empty one. Of equal posteriors none is preferred, as
    rates follow from all of them.
    """
    model, _, fit, low = fit_mixture(docs, labelled, targets, most)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    times = let(posterior(F.col("text"), model), lambda p: copies(F.col("doc_id"), fit.rate(p), low))
    rows = docs.select(doc, F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
