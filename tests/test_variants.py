import json
import random

import pytest
from lorebase.operators import variants
from pyspark.sql import functions as F

SCALARS = [None, True, False, 0, 1, -7, "", "a", 'q"\\', "é"]


def value(r, depth=3):
    kind = r.random()
    if depth and kind < 0.55:
        return {k: value(r, depth - 1) for k in r.sample("abc", r.randint(0, 3))}
    if depth and kind < 0.7:
        return [value(r, depth - 1) for _ in range(r.randint(0, 2))]
    return r.choice(SCALARS)


def merged(target, *sources):
    """Merging by paths: a path of the source that is no object replaces everything at and below it."""
    leaves = lambda v, at=(): [x for k, w in v.items() for x in ([(at + (k,), {}), *leaves(w, at + (k,))] if isinstance(w, dict) else [(at + (k,), w)])]
    out = json.loads(json.dumps(target)) if isinstance(target, dict) else {}
    for source in sources:
        for path, value in leaves(source) if isinstance(source, dict) else []:
            at = out
            for k in path[:-1]:
                at = at[k]
            if value != {} or not isinstance(at.get(path[-1]), dict):
                at[path[-1]] = value
    return out


def run(spark, rows, column):
    table = spark.createDataFrame([(i, *(None if v is ... else json.dumps(v) for v in r)) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    table = table.select("i", *(F.parse_json(c).alias(c) for c in "abc"))
    return [r.v for r in table.select("i", column.alias("v")).orderBy("i").collect()]


def test_against_plain(spark):
    r = random.Random(5)
    rows = [(value(r), value(r), value(r)) for _ in range(400)]
    assert sum(isinstance(a, dict) and isinstance(b, dict) and bool(a.keys() & b.keys()) for a, b, _ in rows) > 50
    rows = [*rows, ({"a": {"b": 2}}, {"a": None}, {"a": {"c": {"d": {}}}}), (..., {"a": 1}, ...), (..., ..., ...), (3, [1], {"a": []})]
    got = run(spark, rows, F.to_json(variants.merge(F.col("a"), F.col("b"), F.col("c"))))
    assert [json.loads(g) for g in got] == [merged(*r) for r in rows]
    pairs = [*rows, *((a, a, a) for a, _, _ in rows)]
    strict = lambda v: json.dumps(None if v is ... else v, sort_keys=True)
    assert run(spark, pairs, variants.equal(F.col("a"), F.col("b"))) == [strict(a) == strict(b) for a, b, _ in pairs]


@pytest.mark.parametrize("a,b,same", [("1", "1.0", True), ("1", "true", False), ("0", "false", False), ('"1"', "1", False), ('{"a":null}', "{}", False), ('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("[1,2]", "[2,1]", False)])
def test_equal(spark, a, b, same):
    assert spark.range(1).select(variants.equal(F.parse_json(F.lit(a)), F.parse_json(F.lit(b))).alias("v")).first().v is same


def test_numbers_keep_their_digits(spark):
    value = '{"n":12345678901234567890.12345678901234567}'
    v = F.parse_json(F.lit(value))
    assert spark.range(1).select(F.to_json(variants.merge(v, F.parse_json(F.lit('{"m":1}')))).alias("v")).first().v == value.replace('{"n"', '{"m":1,"n"')
