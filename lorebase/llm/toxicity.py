"""Toxicity by a learned lexicon, misspellings included, and the context of each hit.

Words of a text run through the intersection of a trie of lexicon terms with Levenshtein automata, made
deterministic on the fly: a state is a set of (trie node, edits so far), so a word costs a table lookup for each
character. A hit counts its term's weight, less for each edit, less within quotation, and more or less by what the
window of words around it tells of abuse. A logistic curve over the sum of the hits gives a calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import Remembered, crc_fold, discard, labelled_sample, map_rows, settle, ship, third
from .quality import logistic

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
WINDOW, CONTEXTS = 6, 12
#: Signs that open quotation with those that close it, and signs written for letters.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’"}
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_EDGES = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}]+$")
_PARTS = regex.compile(r"[^\p{L}\p{N}@$!]+")
#: Shares of its weight that a hit keeps for each edit, and within quotation, that the fit chooses from, and those
#: that hold while labelled texts do not tell by CLEAR nats of likelihood.
PER_EDIT, QUOTED, CLEAR = (0.3, 0.5, 0.7, 0.9), (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), 2.0
EDIT_SHARE, QUOTED_SHARE = 0.7, 0.25


def word_of(token: str) -> str:
    """A token in lower case without signs at its ends."""
    return token if token.isalpha() and token.islower() else _EDGES.sub("", token.lower())


@dataclass(frozen=True)
class Term:
    """A word, or with `stem` the beginning of longer words; weight: its log odds of a toxic text; edits allowed."""

    text: str
    weight: float
    stem: bool = False
    edits: int = 0


def edits_of(text: str) -> int:
    """The most edits that a word of this length may have and still be told apart; `limit_edits` may allow fewer."""
    return 0 if len(text) < 4 else 1 if len(text) < 9 else 2


class Matcher:
    """The lexicon's trie, intersected with the automata of all words within a term's number of edits."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # the most edits that any term below a trie node allows
        for i, t in enumerate(terms):
            at = 0
            self.most[0] = max(self.most[0], t.edits)
            for c in t.text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], t.edits)
            self.ends[at].append(i)
        self.begin = self._closed({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.found: dict[frozenset, tuple[int, int] | None] = {}
        self.stems: dict[frozenset, tuple[int, int] | None] = {}

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With every letter of a term that may be left out, and without states that a better one covers."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(x, e + 1) for x in self.next[node].values()]
        return frozenset(best.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        to = self.moves.get((state, c))
        if to is None:
            out: set[tuple[int, int]] = set()
            looks = LOOKS.get(c, "")
            for node, e in state:
                out.add((node, e + 1))
                for x, at in self.next[node].items():
                    out.add((at, e + (x != c and x not in looks)))
            to = self.moves[state, c] = self._closed(out)
        return to

    def _ended(self, state: frozenset, stem: bool) -> tuple[int, int] | None:
        """The term of fewest edits, and of these the heaviest, that ends in the state."""
        cache = self.stems if stem else self.found
        if state not in cache:
            hits = [(e, -self.terms[i].weight, i) for node, e in state for i in self.ends[node] if self.terms[i].stem == stem and e <= self.terms[i].edits]
            cache[state] = (min(hits)[2], min(hits)[0]) if hits else None
        return cache[state]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the match of fewest edits, a whole word before a stem, or None.

        A stem has at least one more letter after it.
        """
        state, stem = self.begin, None
        for c in word:
            begun = self._ended(state, True)
            if begun and (stem is None or begun[1] < stem[1]):
                stem = begun
            state = self._move(state, c)
            if not state:
                return stem
        whole = self._ended(state, False)
        return whole if whole and (stem is None or whole[1] <= stem[1]) else stem


def quotations(tokens: list[str]) -> list[tuple[int, int]]:
    """(first, last) token of each quotation, of any length: from a token that opens with a sign to one that closes it.

    A sign that opens while another quotation is open begins a new one; a quotation that is never closed is none.
    """
    out, begin, close = [], -1, ""
    for i, t in enumerate(tokens):
        t = t.lstrip("([")
        if t[:1] in QUOTES:
            begin, close = i, QUOTES[t[0]]
            t = t[1:]
        if begin >= 0:
            end = t.rstrip(".,;:!?)]")
            if (end and end[-1] in close) or (t and t[-1] in close):
                out.append((begin, i))
                begin = -1
    return out


@dataclass
class ToxicModel:
    """Terms, context weights of words near hits, the curve's weights, and what a hit keeps for an edit and in quotation."""

    terms: list[Term] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0])
    edit_share: float = EDIT_SHARE
    quoted_share: float = QUOTED_SHARE

    def hits(self):
        """A function from a text's tokens to its hits (place, term, edits).

        A token without a hit that holds signs within is matched part by part as well; the part of fewest edits counts.
        """
        matcher = Matcher(self.terms)

        def find(token: str) -> tuple[int, int] | None:
            word = word_of(token)
            found = matcher.match(word) if word else None
            if found is None and not word.isalnum():
                parts = [m for p in _PARTS.split(word) if p and (m := matcher.match(word_of(p)))]
                found = min(parts, key=lambda m: (m[1], m[0]), default=None)
            return found

        known = Remembered(find)

        def of(tokens: list[str]) -> list[tuple[int, int, int]]:
            return [(i, *x) for i, x in enumerate(map(known.__getitem__, tokens)) if x is not None]

        return of

    def measure(self):
        """A function from a text to its hits' weights by context: of each number of edits, outside and within quotation, and the number of tokens."""
        hits, terms = self.hits(), self.terms

        def of(text: str) -> list[float]:
            tokens = text.split()
            out = [0.0] * 6 + [float(len(tokens))]
            found = hits(tokens)
            spans = quotations(tokens) if found else []
            at = 0
            for i, term, edits in found:
                while at < len(spans) and spans[at][1] < i:
                    at += 1
                quoted = at < len(spans) and spans[at][0] <= i
                out[3 * quoted + edits] += terms[term].weight * self.context_score(tokens, i)
            return out

        return of

    def features(self, sums: list[float]) -> list[float]:
        """Of what `measure` gives: the hits' weight for each hundred words and as it is, both on a log scale.

        A few words by chance in a long text count little.
        """
        plain, quoted = (sum(w * self.edit_share**e for e, w in enumerate(x)) for x in (sums[:3], sums[3:6]))
        total = plain + self.quoted_share * quoted
        return [min(3.0, math.log1p(total * 100 / (sums[6] + 25))), min(3.0, math.log1p(total))]

    def context_score(self, tokens: list[str], at: int) -> float:
        """From 0 to 2 how much the words of the hit's window tell of abuse; 1 if they tell nothing."""
        if not self.context:
            return 1.0
        near = tokens[max(0, at - WINDOW) : at] + tokens[at + 1 : at + 1 + WINDOW]
        told = sum(self.context.get(word_of(t), 0.0) for t in near)
        return 2 / (1 + math.exp(-max(-20.0, min(20.0, told))))

    def scorer(self):
        of, w = self.measure(), self.weights

        def score(text: str | None) -> float:
            x = self.features(of(text or "")) if self.terms else []
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _likelihood_ratio(tox: int, clean: int, n_tox: int, n_clean: int) -> float:
    """Twice the log likelihood ratio of a term's share of toxic against clean texts, 0 if that is not higher."""
    n = n_tox + n_clean
    if not tox or tox * n_clean <= clean * n_tox:
        return 0.0
    g = 0.0
    for seen, of in ((tox, n_tox), (clean, n_clean)):
        for part, whole in ((seen, tox + clean), (of - seen, n - tox - clean)):
            if part:
                g += part * math.log(part * n / (of * whole))
    return 2 * g


def choose_terms(df: dict[tuple[str, bool], tuple[int, int, int, int]], n: tuple[int, int], least: float = 14.0, ratio: float = 6.0) -> list[Term]:
    """The lexicon, from how many toxic and clean texts have each word, or a longer word with each beginning.

    df: (word or beginning, whether it is a beginning) to (toxic texts, clean texts, different words and different
    contexts in toxic texts, the contexts up to CONTEXTS); n: toxic and clean texts. Texts that have a term between
    the same words are taken for copies of each other and count once. A term needs three contexts, a likelihood ratio
    over `least` and `ratio` times the share of toxic texts; a beginning needs three different words. The strongest
    come first. No beginning begins another, nor a word that was chosen before; words stay beside the beginnings that
    cover them, as they may have edits.
    """
    odds = lambda a, b: math.log((a + 0.5) / (n[0] + 1)) - math.log((b + 0.5) / (n[1] + 1))
    found = []
    for (text, stem), (a, b, words, contexts) in df.items():
        a = min(a, contexts) if contexts < CONTEXTS else a
        if a >= 3 and (not stem or words >= 3) and odds(a, b) >= math.log(ratio) and (g := _likelihood_ratio(a, b, *n)) >= least:
            found.append((-g, stem, -len(text), text, odds(a, b)))
    chosen: list[Term] = []
    for _, stem, _, text, weight in sorted(found):
        if stem and any(t.text.startswith(text) or (t.stem and text.startswith(t.text)) for t in chosen):
            continue
        chosen.append(Term(text, weight, stem, 1 if stem and len(text) > 5 else 0 if stem else edits_of(text)))
    return sorted(chosen, key=lambda t: t.text)


def limit_edits(terms: list[Term], shares: list[float], clean: dict[tuple[int, int], int], n_clean: int, ratio: float = 20.0) -> list[Term]:
    """Terms with as many edits as leave their misspellings in clean texts `ratio` times rarer than the terms in toxic ones.

    shares: of toxic texts that have each term; clean: clean texts that (term, edits) was found in, to which one
    text is added, so that terms of which there are few texts allow no edits.
    """
    out = []
    for i, t in enumerate(terms):
        allowed = t.edits
        while allowed and ratio * (1 + sum(clean.get((i, e), 0) for e in range(1, allowed + 1))) > shares[i] * n_clean:
            allowed -= 1
        out.append(replace(t, edits=allowed))
    return out


def own_terms(text: str, shortest: int = 3, longest: int = 9) -> tuple[set[str], set[tuple[str, str]]]:
    """Words of a text, of any length, and (beginning, word) for the beginnings of three to nine letters of longer words."""
    words = {w for w in map(word_of, set(text.split())) if w}
    return words, {(w[:k], w) for w in words for k in range(shortest, min(longest, len(w) - 1) + 1)}


def contexts_of(text: str) -> dict[str, int]:
    """For each word of a text a number of the words before and after its first place."""
    out: dict[str, int] = {}
    tokens = list(map(word_of, text.split()))
    for i, w in enumerate(tokens):
        if w and w not in out:
            out[w] = xxh64_intdigest(f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}") >> 1
    return out


def term_counts(sample: DataFrame, distinct: int = 3) -> DataFrame:
    """(term, stem, label, texts, words, contexts): texts of each label that have the term; for label 1 also how many
    words of it, up to `distinct` or more, and between how many different pairs of words, up to CONTEXTS or more.

    Tasks send partial counts, with at most `distinct` words and CONTEXTS contexts for a term.
    """
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter = Counter()
        words: dict[tuple[str, bool, int], set[str]] = {}
        contexts: dict[tuple[str, bool, int], set[int]] = {}

        def note(held: dict, key: tuple[str, bool, int], value, most: int) -> None:
            seen = held.setdefault(key, set())
            if len(seen) < most:
                seen.add(value)

        def out() -> pa.RecordBatch:
            keys = list(texts)
            columns = (*([k[c] for k in keys] for c in range(3)), [texts[k] for k in keys], *([sorted(held.get(k, ())) for k in keys] for held in (words, contexts)))
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["term", "stem", "label", "texts", "words", "contexts"])

        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, begun = own_terms(text)
                texts.update({(w, False, label) for w in own} | {(b, True, label) for b, _ in begun})
                if label:
                    near = contexts_of(text)
                    for w in own:
                        note(contexts, (w, False, label), near[w], CONTEXTS)
                    for b, w in begun:
                        note(words, (b, True, label), w, distinct)
                        note(contexts, (b, True, label), near[w], CONTEXTS)
                if len(texts) > 200_000:
                    yield out()
                    texts.clear()
                    words.clear()
                    contexts.clear()
        yield out()

    parts = sample.select("label", "text").mapInArrow(run, "term string, stem boolean, label int, texts bigint, words array<string>, contexts array<bigint>")
    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return parts.groupBy("term", "stem", "label").agg(F.sum("texts").alias("texts"), several("words"), several("contexts"))


def learn_terms(sample: DataFrame, n: tuple[int, int]) -> list[Term]:
    """The lexicon of a sample (label, text) with n toxic and clean texts.

    Only terms of three toxic texts and twice the clean share go to the driver: no more than the sample's vocabulary.
    """
    of = lambda label, c: F.coalesce(F.max(F.when(F.col("label") == label, F.col(c))), F.lit(0)).alias(f"{c}{label}")
    counted = term_counts(sample).groupBy("term", "stem").agg(of(1, "texts"), of(0, "texts"), of(1, "words"), of(1, "contexts"))
    likely = counted.filter((F.col("contexts1") >= 3) & (F.col("texts1") * n[1] > 2 * F.col("texts0") * n[0]))
    return choose_terms({(r.term, r.stem): (r.texts1, r.texts0, r.words1, r.contexts1) for r in likely.collect()}, n)


def _over(sample: DataFrame, schema: str, start) -> DataFrame:
    """Rows that a function gives for each (label, text); start() makes it, once in each task."""
    ship(sample.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            rows = [r for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in work(label, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return sample.select("label", "text").mapInArrow(run, schema)


def found_hits(sample: DataFrame, model: ToxicModel) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(term, edits, label) to (texts, hits) in the sample."""

    def start():
        hits = model.hits()

        def work(label, text):
            n = Counter((term, edits) for _, term, edits in hits(text.split()))
            return [(term, edits, label, c) for (term, edits), c in n.items()]

        return work

    rows = _over(sample, "term bigint, edits bigint, label bigint, n bigint", start)
    return {(r.term, r.edits, r.label): (r.texts, r.n) for r in rows.groupBy("term", "edits", "label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}


def learn_context(sample: DataFrame, model: ToxicModel, least: int = 20) -> dict[str, float]:
    """Log odds of abuse for words near hits, beyond what the term that was hit tells by itself.

    A word near hits is expected in toxic texts as often as hits of those terms are. Empty while fewer than `least`
    hits are in clean texts.
    """
    n: dict[int, list[int]] = {}
    for (term, _, label), (_, hits) in found_hits(sample, model).items():
        n.setdefault(term, [0, 0])[label] += hits
    if min(sum(x[k] for x in n.values()) for k in (0, 1)) < least if n else True:
        return {}
    share = {t: x[1] / sum(x) for t, x in n.items()}

    def start():
        hits = model.hits()

        def work(label, text):
            tokens = text.split()
            near: dict[str, list[float]] = {}
            for i, term, _ in hits(tokens):
                for w in {word_of(t) for t in tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]}:
                    x = near.setdefault(w, [0, 0.0])
                    x[0] += 1
                    x[1] += share.get(term, 0.5)
            return [(w, label * x[0], x[0], x[1]) for w, x in near.items() if w]

        return work

    rows = _over(sample, "word string, toxic bigint, n bigint, expected double", start)
    words = rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum("expected").alias("expected")).filter("n >= 10").collect()
    tell = lambda r: math.log((r.toxic + 2) / (r.expected + 2)) - math.log((r.n - r.toxic + 2) / (r.n - r.expected + 2))
    return {r.word: max(-0.5, min(0.5, 0.5 * tell(r))) for r in words}


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> ToxicModel:
    """Fit on whole texts of labelled rows outside the held-out fold (crc32(doc_id) mod 4 = 2): at most `most` of each label.

    Lexicon and context weights come from two thirds of the sample; from the rest come the curve, what a hit keeps
    for each edit and in quotation, and the curve's constant is moved from the sample's share of toxic texts to that
    of the labelled table. Without both labels the score is the share of label 1, or 0.5 without labels. Counts and
    sums are gathered by tasks; what goes to the driver is no more than the bounded sample's vocabulary and eight
    numbers for each of its rows.
    """
    train = crc_fold(F.col("doc_id"), 4) != 2
    n = {r[0]: r[1] for r in labels.filter(train & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    base = math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))
    sample = labelled_sample(docs, labels, "toxic", train, most).groupBy("label", "text").agg(F.min("doc_id").alias("doc_id"))  # copies count once
    sample = settle(sample.withColumn("third", third(F.col("doc_id"))), "toxic-sample")
    there = {(r.label, r.curve): r["count"] for r in sample.groupBy("label", (F.col("third") == 0).alias("curve")).count().collect()}
    if min(there.get((k, c), 0) for k in (0, 1) for c in (True, False)) < 2:
        discard(sample)
        return ToxicModel(weights=[base])
    learn, rest = sample.filter("third <> 0"), sample.filter("third = 0")
    model = ToxicModel(learn_terms(learn, (there[1, False], there[0, False])))
    found = found_hits(learn, model)
    clean = {(t, e): texts for (t, e, label), (texts, _) in found.items() if e and not label}
    shares = [found.get((i, 0, 1), (0, 0))[0] / there[1, False] for i in range(len(model.terms))]
    model.terms = limit_edits(model.terms, shares, clean, there[0, False])
    model.context = learn_context(learn, model)

    def start():
        of = model.measure()
        return lambda label, text: [(label, of(text))]

    curve = sorted((r.label, r.x) for r in _over(rest, "label bigint, x array<double>", start).collect())
    model = fit_curve(model, [x for _, x in curve], np.array([float(k) for k, _ in curve]))
    model.weights[-1] += base - math.log(there[1, True] / there[0, True])
    discard(sample)
    return model


def fit_curve(model: ToxicModel, sums: list[list[float]], y: np.ndarray) -> ToxicModel:
    """The model with the curve, and the shares for an edit and for quotation, under which the labels y are likeliest.

    The shares that are believed beforehand hold unless others make the labels likelier by CLEAR nats, so an unseen
    misspelling or quotation counts by them.
    """

    def tried(edit: float, quoted: float) -> tuple[float, ToxicModel]:
        m = replace(model, edit_share=edit, quoted_share=quoted)
        x = np.array([m.features(s) for s in sums])
        w = logistic(x, y, ridge=0.3)
        z = np.hstack([x, np.ones((len(x), 1))]) @ w
        return float((y * z - np.logaddexp(0, z)).sum()), replace(m, weights=w.tolist())

    likely, best = tried(EDIT_SHARE, QUOTED_SHARE)
    others = [tried(e, q) for e in PER_EDIT for q in QUOTED]
    top, other = max(others, key=lambda t: t[0])
    return other if top > likely + CLEAR else best


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """A row for each document: held_out, score (0 to 1, higher is more toxic), predicted.

    The whole text is scored; null text counts as empty, a null doc_id as fold 0. Repeated rows give repeated
    rows, an empty table an empty one, other columns are ignored. One pass without a shuffle.
    """

    def start():
        judge = model.scorer()

        def work(ids, held, texts):
            scores = [judge(t) for t in texts]
            return ids, held, scores, [int(s >= threshold) for s in scores]

        return work

    return map_rows(docs.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), SCHEMA, start)
