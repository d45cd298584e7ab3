import re

from lorebase.llm import queries, simhash
from xxhash import xxh64_intdigest

from .conftest import ROWS, SF


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    """Rows of (doc_id, fingerprint, component_id) by comparing all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    at = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = at[i], at[j]
                at = [b if x == a else x for x in at]
    least = {}
    for (d, _), a in zip(rows, at, strict=True):
        least[a] = min(filter(lambda x: x is not None, (d, least.get(a))), default=None)
    return sorted(str((d, f"{f:016x}", least[a])) for (d, _), f, a in zip(rows, fps, at, strict=True))


def test_odd_rows(odd, empty):
    got = simhash.cluster(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS)
    assert simhash.cluster(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def groups(rows, key):
    """Numbers of the rows in groups; key gives what rows have in common, or `near` if they are linked."""
    found = {}
    for i, r in enumerate(rows):
        found.setdefault(key(r), []).append(i)
    return list(found.values())


def shingled(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def survivors(rows, similarity=0.8):
    """The rows that stay, by comparing all pairs of rows, each by itself."""
    import hashlib

    sets = [shingled(t) for _, t in rows]
    at = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared and shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = at[i], at[j]
                at = [b if x == a else x for x in at]
    order = lambda r: (r[0] is None, r[0] or 0, "" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest())
    return sorted((min((rows[i] for i in g), key=order) for g in groups(range(len(rows)), lambda i: at[i])), key=str)


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == survivors(ROWS)


def test_keep_one_with_repeated_ids(spark):
    """A row goes for its own text, not for another row's of the same doc_id."""
    unique = "quite another text that has nothing in common with the first"
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, unique), (None, "a b c d e f"), (None, "x y z"), (None, "x y z"), (7, "k l m n"), (7, "k l m n"), (8, None), (8, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == survivors(rows)
    assert (5, unique) in {tuple(r) for r in kept} and len(kept) == 5


def test_links_connect_all_near_fingerprints(spark):
    base = [0, 0b11, 0b111, 0b1111, 0b111111, 0b11111111, -1, -2, 1 << 62, (1 << 62) | 3, 0x123456789ABCDEF, -0x7000000000000000]
    links = {tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in base], "fp bigint")).collect()}
    near = {(a, b) for a in base for b in base if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert links <= near

    def parts(edges):
        at = {x: x for x in base}
        for a, b in edges:
            x, y = at[a], at[b]
            at = {k: y if v == x else v for k, v in at.items()}
        return sorted(sorted(k for k in base if at[k] == v) for v in set(at.values()))

    assert parts(links) == parts(near)


def test_chain_and_hub(spark):
    # a chain of one-bit steps is one group, and so are all 64 neighbours of zero
    from lorebase.llm.components import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(201)}
    hub = spark.createDataFrame([(i, 500) for i in range(300)], "a bigint, b bigint")
    assert {tuple(r) for r in components(hub).collect()} == {(i, 0) for i in [*range(300), 500]}
    assert components(hub.limit(0)).collect() == []


def test_query(spark, documents):
    got = queries.op3_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))
