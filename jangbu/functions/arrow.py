"""Plain Python functions as vectorised column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(x: Any) -> Any:
    """Arrow's arrays and rows as lists and dicts."""
    if x is None or isinstance(x, (str, bytes, bool, int, dict)):
        return x
    if hasattr(x, "tolist"):
        return [_plain(y) for y in x.tolist()]
    if isinstance(x, float):
        return None if x != x else x
    if isinstance(x, Iterable):
        return [_plain(y) for y in x]
    return None if x is pd.NaT else x


def vectorised(returns: str, nulls: bool = False) -> Callable[[Callable], Callable]:
    """A function over the values of a row, run in Arrow batches: null for a null in any argument, unless it takes ``nulls``.

    ``returns`` is a type as in DDL; a function that returns ``struct<...>`` gives
    a tuple, or None.  Called with columns it gives a column; the function itself
    is its ``plain``.
    """

    def wrap(f: Callable) -> Callable:
        udfs: dict[int, Any] = {}

        def call(*columns: Column | str) -> Column:
            if len(columns) not in udfs:
                udfs[len(columns)] = _udf(f, returns, nulls, len(columns))
            return udfs[len(columns)](*columns)

        call.plain = f
        call.__doc__ = f.__doc__
        call.__name__ = f.__name__
        return call

    return wrap


def _udf(f: Callable, returns: str, nulls: bool, arity: int) -> Any:
    kind = T.DataType.fromDDL(returns)
    names = kind.names if isinstance(kind, T.StructType) else None

    def run(*columns: pd.Series) -> Any:
        out = []
        for values in zip(*columns, strict=True):
            values = [_plain(v) for v in values]
            out.append(None if not nulls and any(v is None for v in values) else f(*values))
        if names:
            return pd.DataFrame([(None,) * len(names) if r is None else r for r in out], columns=names, dtype=object)
        return pd.Series(out, dtype=object)

    def one(a):
        return run(a)

    def two(a, b):
        return run(a, b)

    def three(a, b, c):
        return run(a, b, c)

    g = (one, two, three)[arity - 1]
    g.__annotations__ = dict.fromkeys("abc"[:arity], pd.Series) | {"return": pd.DataFrame if names else pd.Series}
    return F.pandas_udf(g, kind).asNondeterministic()  # so that no filter on a result runs it once more
