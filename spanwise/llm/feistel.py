"""Keyed Feistel permutation of [0, n) with cycle walking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textcore import mix


def permute(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Where each row number of [0, n) goes; a bijection for every key.

    The network works on the smallest even number of bits that holds n, at least two, so its
    domain is under 4n; a value outside [0, n) is put through again until it is inside.
    """
    if n <= 1:
        return np.zeros(len(x), dtype=np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(x.astype(np.uint64))
        wrong = np.flatnonzero(out >= n)
        while len(wrong):
            out[wrong] = once(out[wrong])
            wrong = wrong[out[wrong] >= n]
    return out.astype(np.int64)


def permuted(row: Column, n: int, key: int, rounds: int = 4) -> Column:
    """Column of permuted row numbers, Arrow batches at a time."""

    @F.pandas_udf("long")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key, rounds))

    return apply(row)
