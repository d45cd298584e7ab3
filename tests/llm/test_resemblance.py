import random

import numpy as np
import pytest
from lorebase.llm.components import components
from lorebase.llm import resemblance, simhash
from xxhash import xxh64_intdigest

from .test_simhash import shingled, survivors


def edited(words, changes, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def similarity(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "a b c d e", "A B c d e f a b c d e f", "x " * 500, "é ß 漢字 w q z"])
def test_shingles(text):
    want = sorted(xxh64_intdigest(s.encode(), 42) for s in shingled(text))
    assert resemblance.shingles(text).tolist() == want


def test_sketch_counts_bits():
    h = resemblance.shingles(" ".join(f"w{i}" for i in range(20_000)))
    got = resemblance.sketch(h, 7, 23)
    every = np.stack([resemblance.mixed(h, k) for k in range(3)], axis=1)
    ones = [int((every.view(np.uint8)[:, i // 8] >> (7 - i % 8) & 1).sum()) for i in range(7 * 23)]
    want = [sum(1 << b for b in range(23) if 2 * ones[t * 23 + b] > len(h)) for t in range(7)]
    assert got == want


def test_plan_keeps_recall():
    for rows in (0, 200, 10**6, 10**11):
        tables, bits = resemblance.plan(rows)
        p = resemblance.differing(0.8)
        missed = 1 - sum((1 - p) ** (bits - k) * p**k * (1, bits, bits * (bits - 1) / 2)[k] for k in range(3))
        assert missed**tables <= 0.1 and bits <= 48 and tables < 2**14


def test_recall_of_planted_copies(spark):
    """Two texts of 120 to 400 words for each number, one edited: nine tenths of those at 0.8 or more are found."""
    rng, rows, near = random.Random(3), [], set()
    for i in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120, 400))]
        a, b = " ".join(words), " ".join(edited(words, rng.randrange(1, 1 + len(words) // 30), rng))
        rows += [(2 * i, a), (2 * i + 1, b)]
        if similarity(a, b) >= 0.8:
            near.add(2 * i + 1)
    assert 100 < len(near) < 400
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    gone = set(range(800)) - kept
    assert gone <= near and len(gone) >= 0.9 * len(near)


def test_group_of_many_near_copies(spark):
    """A base text with many edited copies, and many texts that share a passage with it but are no near copies."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(base, 1 + i % 4, rng))) for i in range(150)]
    rows += [(1000 + i, " ".join(base[:130] + [f"o{rng.randrange(10**9)}" for _ in range(90)])) for i in range(150)]
    want = survivors(rows)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert set(want) <= set(got) and len(got) - len(want) <= 0.1 * (len(rows) - len(want))


def clustered(rng):
    """A base text's edited copies, of which some are near copies, and texts that share a passage with it."""
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, 1 + i % 5, rng))) for i in range(60)]
    return rows + [(100 + i, " ".join(base[: 100 + i % 30] + [f"o{rng.randrange(10**9)}" for _ in range(40)])) for i in range(60)]


@pytest.mark.parametrize("small", [{}, {"BLOCK": 8, "SETS": 16, "COLUMNS": 64}, {"BLOCK": 8, "SETS": 1}])
def test_parts(spark, monkeypatch, small):
    """Whatever the parts that buckets and groups are compared in, and group by group or pair by pair, no more is missed."""
    for name, value in small.items():
        monkeypatch.setattr(resemblance, name, value)
    rows = clustered(random.Random(7))
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    want = sorted(survivors(rows))
    assert set(want) <= set(got) and len(got) - len(want) <= 0.1 * (len(rows) - len(want))


@pytest.mark.parametrize("block", [1024, 8])
def test_likely_pairs_are_told_once(spark, monkeypatch, block):
    """All pairs within two bits in a table that sizes and bits allow, each once; the forest connects the same and counts them."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    tables, bits = 3, 20
    sets = [resemblance.shingles(t) for _, t in clustered(random.Random(11))]
    rows = [(k, len(h), resemblance.sketch(h, tables, bits)) for k, h in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node bigint, n int, fps array<bigint>").repartition(4)
    p = resemblance.differing(0.8)
    most = tables * bits * p + 4 * (tables * bits * p * (1 - p)) ** 0.5
    want = set()
    for b, n, f in rows:
        for a, m, g in rows[:b]:
            apart = [(x ^ y).bit_count() for x, y in zip(f, g, strict=True)]
            if min(apart) <= 2 and sum(apart) <= most and min(n, m) >= 0.8 * max(n, m):
                want.add((b, a))
    buckets = resemblance.met(nodes, bits)
    got = [(r.node, r.low) for r in resemblance.meeting(buckets, tables, bits, 0.8, False).collect()]
    assert len(want) > 500 and len(got) == len(want) and set(got) == want
    links = resemblance.meeting(buckets, tables, bits, 0.8, True).collect()
    assert sum(r.number for r in links) == len(want) and len(links) < len(rows) * 4
    both = [resemblance.Forest(), resemblance.Forest()]
    for trees, pairs in zip(both, (want, [(r.node, r.low) for r in links]), strict=True):
        for b, a in pairs:
            trees.add(b, a)
    assert [both[0].top(k) for k in range(len(rows))] == [both[1].top(k) for k in range(len(rows))]


def test_shared_counts():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(-(2**62), 2**62, 30) if k % 7 == 0 else rng.integers(0, 9_000, k * 9)) for k in range(m)] for m in (12, 17))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert resemblance.shared(left, right).tolist() == want
    assert resemblance.shared(left[:1], right).tolist() == want[:1]


def test_few_edges_connect_a_group_that_many_tasks_name(spark):
    """Each of 300 nodes named by 40 tasks: the edges kept grow with nodes and names, not with their product, and connect the same."""
    pairs = [(1000 + x, low) for x in range(300) for low in range(40)] + [(5000, 4000)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)
    kept = resemblance.spanning(edges)
    assert kept.count() <= 301 + 40 * 4
    roots = {r.node: r.root for r in components(kept).collect()}
    assert roots == {x: 0 for x in [*range(40), *range(1000, 1300)]} | {5000: 4000, 4000: 4000}


def test_only_pairs_told_at_a_variant_are_needed():
    """Every pair within two bits is left at one variant; equal fingerprints at their own; no other fingerprint goes on."""
    bits, rng = 20, random.Random(13)
    base = [rng.getrandbits(bits) for _ in range(30)]
    cells = {f: 1 for f in base} | {f ^ (1 << rng.randrange(bits)) ^ (1 << rng.randrange(bits)): rng.choice([1, 2, 5]) for f in base for _ in range(4)}
    codes = np.sort(np.array([((f ^ (1 << i) if i < bits else f) << 12) | i << 6 | (n - 1).bit_length() for f, n in cells.items() for i in range(bits + 1)]))
    need, size = resemblance.needed(codes, bits)
    left = {}
    for code, n in zip(codes[need].tolist(), size[need].tolist(), strict=True):
        flip = code >> 6 & 63
        left.setdefault(code >> 12, []).append((code >> 12 ^ (1 << flip if flip < bits else 0), n))
    want = {}
    for x in cells:
        for y in cells:
            if x < y and (x ^ y).bit_count() <= 2:
                one = (x ^ y) & -(x ^ y)
                want.setdefault(x if x ^ y == one else min(x ^ one, y ^ one), set()).update((x, y))
        if cells[x] > 1:
            want.setdefault(x, set()).add(x)
    assert {v: {f for f, _ in rows} for v, rows in left.items()} == want
    for rows in left.values():
        held = sum(cells[f] for f, _ in rows)
        assert {n for _, n in rows} == {rows[0][1]} and held <= rows[0][1] <= 2 * held


def test_what_is_shuffled_grows_with_the_rows_alone():
    """Tables of 0.1 and 0.5 GB have one plan: no more variants for each text of the larger one."""
    assert resemblance.plan(40_000) == resemblance.plan(200_000) == resemblance.plan(2_000_000)
