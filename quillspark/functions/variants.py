"""Values of unknown shape, as JSON texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(base: object, over: object) -> object:
    """over laid on base: objects are merged key by key, to any depth, anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in over.items()}}
    return over


def _read(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def deep_merge(base: Column, over: Column) -> Column:
    """The merge of two JSON texts; a text that is null or no JSON counts as not there, and both
    missing give null. Keys keep the order of base, new ones follow."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            left, right = _read(x), _read(y)
            value = left if right is None else right if left is None else merged(left, right)
            out.append(None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(base, over)
