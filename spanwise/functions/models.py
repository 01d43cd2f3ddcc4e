"""Models as column functions. A model is any callable made by a factory; each worker makes it once.

Inference itself is the caller's: tests and queries use deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_sessions: dict[Callable, object] = {}


def session(factory: Callable):
    """The worker's own model of a factory, made when first asked for."""
    if factory not in _sessions:
        _sessions[factory] = factory()
    return _sessions[factory]


def per_row(factory: Callable, returns: str, missing=None):
    """A column function of one array column: ``model(array)`` for each row, ``missing`` for null rows."""

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = session(factory)
        for rows in batches:
            yield pd.Series([missing if x is None else model(np.asarray(x, dtype=np.float64)) for x in rows])

    return apply


def voter(factory: Callable):
    """A vote of +1, -1 or 0 for each row of two columns; a model that fails casts none."""

    @F.pandas_udf("int")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = session(factory)

        def one(a, b) -> int:
            try:
                return int(model(a, b))
            except Exception:
                return 0

        for left, right in batches:
            yield pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])

    return apply


def music_score(factory: Callable):
    """A score of the first ``n`` samples of each row; no samples score 0."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = session(factory)
        for rows, counts in batches:
            yield pd.Series([float(model(np.asarray(x, dtype=np.float64)[: int(n)])) if x is not None and n > 0 else 0.0 for x, n in zip(rows, counts, strict=True)])

    return apply


def frames(df, emit: Callable[[tuple], list[tuple]], schema: str):
    """Table-valued: any number of rows for each row of ``df``."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([out for row in rows.itertuples(index=False) for out in emit(row)], columns=names)

    return df.mapInPandas(apply, schema)
