"""VARIANT values, whose shape may differ from row to row: merged and compared by a walk over their paths.

The walk is Python, batched by Arrow, as no built-in function visits a value of unknown depth. Values are at most as
deep as Spark's JSON reader takes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def merge(target: Column, *sources: Column) -> Column:
    """Objects merged key by key at any depth; the keys of later sources count.

    An object meets an object: they are merged. Else the source's value replaces the target's: null, scalars and whole
    arrays too, and an object replaces what is no object. A source that is no object, or null, changes nothing; a
    target that is null or no object counts as empty. Numbers keep their digits; keys come in order.
    """
    def walk(*columns: pd.Series) -> pd.Series:
        import json

        class Digits(str):
            """A number as it is written."""

        def merged(old: dict, new: dict) -> dict:
            out = dict(old)
            for key, value in new.items():
                was = out.get(key)
                out[key] = merged(was if isinstance(was, dict) else {}, value) if isinstance(value, dict) else value
            return out

        def text(value) -> str:
            if isinstance(value, dict):
                return "{" + ",".join(f"{json.dumps(k)}:{text(v)}" for k, v in value.items()) + "}"
            if isinstance(value, list):
                return "[" + ",".join(map(text, value)) + "]"
            return str(value) if isinstance(value, Digits) else json.dumps(value)

        def row(values) -> str:
            out: dict = {}
            for value in values:
                read = None if value is None else json.loads(value, parse_int=Digits, parse_float=Digits)
                if isinstance(read, dict):
                    out = merged(out, read)
            return text(out)

        return pd.Series([row(values) for values in zip(*columns, strict=True)], dtype=object)

    return F.parse_json(F.pandas_udf(walk, "string")(*(F.to_json(c) for c in (target, *sources))))


def equal(a: Column, b: Column) -> Column:
    """Deep equality: same keys whatever their order, arrays place by place, numbers by value, nulls equal.

    A missing key is not a null one, and a number, a text and a boolean are never equal. A null row counts as a null.
    """
    def walk(left: pd.Series, right: pd.Series) -> pd.Series:
        import json
        from decimal import Decimal

        def same(x, y) -> bool:
            if type(x) is not type(y):
                return False
            if isinstance(x, dict):
                return x.keys() == y.keys() and all(same(x[k], y[k]) for k in x)
            if isinstance(x, list):
                return len(x) == len(y) and all(map(same, x, y))
            return x == y

        read = lambda s: None if s is None else json.loads(s, parse_int=Decimal, parse_float=Decimal)
        return pd.Series([same(read(x), read(y)) for x, y in zip(left, right, strict=True)], dtype=bool)

    return F.pandas_udf(walk, "boolean")(F.to_json(a), F.to_json(b))
