"""Short-time Fourier transform of whole tracks, block by block.

A block is a number of consecutive frames; it gets the samples its frames need, half a window beyond its own
on either side from its neighbours, and at the ends of a track the reflected ones. Frames are so those
of the whole track, whatever the blocks. The inverse adds up overlapping frames inside a block, and
what blocks share by position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import dense

BLOCK = 64


def _lengths(samples: DataFrame, by: str) -> DataFrame:
    """A row per track, broadcast: a shuffle by track would put each track in one task."""
    return F.broadcast(samples.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")))


def _mirrored(y: Column, first: Column, last: Column, left: Column, right: Column) -> Column:
    """The places that a sample at ``y`` of [first, last] has once ``left`` and ``right`` samples are reflected at the ends."""
    none = F.lit(None).cast("long")
    return F.array(y, F.when((y > first) & (y <= first + left), 2 * first - y).otherwise(none), F.when((y < last) & (y >= last - right), 2 * last - y).otherwise(none))


def spectra(samples: DataFrame, by: str, value: str, n: int = 4096, hop: int = 1024, block: int = BLOCK) -> DataFrame:
    """``by, frame, re, im``: each of ceil(length / hop) frames of every track, n / 2 bins.

    ``samples``: by, ``i`` (0, 1, ... without gaps) and ``value``. Reflect padding of hop / 2 * 3 and of n / 2, periodic Hann window,
    1 / sqrt(n), no Nyquist bin. A track shorter than its padding is one group (a few thousand samples).
    """
    half, left = n // 2, hop // 2 * 3
    kind = samples.schema[by].dataType.simpleString()
    out = f"{by} {kind}, frame long, re array<double>, im array<double>"
    rows = samples.select(by, F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x")).join(_lengths(samples, by), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    least = max(left + hop, half) + 1

    def short(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        z = dense.stft(part.sort_values("i").x.to_numpy(), n, hop)
        return pd.DataFrame({by: [key[0]] * z.shape[1], "frame": np.arange(z.shape[1]), "re": list(z.real.T), "im": list(z.imag.T)})

    le = F.ceil(F.col("_n") / hop)
    right = left + le * hop - F.col("_n")
    zero = F.lit(0).cast("long")
    inner = _mirrored(F.col("i"), zero, F.col("_n") - 1, F.lit(left), right)
    long = rows.where(F.col("_n") >= least).select(by, "x", "_n", le.alias("_le"), right.alias("_right"), F.explode(F.filter(inner, lambda y: y.isNotNull())).alias("y"))
    outer = _mirrored(F.col("y"), F.lit(-left).cast("long"), F.col("_n") - 1 + F.col("_right"), F.lit(half), F.lit(half))
    placed = long.select(by, "x", "_le", F.explode(F.filter(outer, lambda y: y.isNotNull())).alias("y"))
    q = F.col("y") + half + left - 2 * hop  # frame f covers q of [f * hop, f * hop + n)
    span, reach = block * hop, (block - 1) * hop + n
    low, high = F.greatest(zero, F.floor((q - reach) / span) + 1), F.least(F.floor(q / span), F.floor((F.col("_le") - 1) / block))
    cells = placed.select(by, "x", "_le", q.alias("q"), low.alias("low"), high.alias("high")).where("low <= high").select(by, "x", "_le", "q", F.explode(F.sequence("low", "high")).alias("block"))

    def frames(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * block
        count = min(block, int(part["_le"].iloc[0]) - first)
        wave = np.zeros((count - 1) * hop + n)
        at = part.q.to_numpy() - first * hop
        here = at < len(wave)
        wave[at[here]] = part.x.to_numpy()[here]
        cut = np.lib.stride_tricks.sliding_window_view(wave, n)[::hop]
        z = np.fft.rfft(cut * dense._hann(n), axis=1)[:, :-1] / np.sqrt(n)
        return pd.DataFrame({by: [key[0]] * count, "frame": np.arange(first, first + count), "re": list(z.real), "im": list(z.imag)})

    return cells.groupBy(by, "block").applyInPandas(frames, out).unionByName(rows.where(F.col("_n") < least).groupBy(by).applyInPandas(short, out))


def waves(spectrum: DataFrame, lengths: DataFrame, by: str, n: int = 4096, hop: int = 1024, block: int = BLOCK) -> DataFrame:
    """``by, i, x``: the samples of tracks from their frames; ``lengths``: by, ``length``.

    Frames that the forward transform left out at both ends count as silent in the window-square
    envelope by which the sum is divided.
    """
    kind = spectrum.schema[by].dataType.simpleString()
    known = F.broadcast(lengths.select(F.col(by).alias("_by"), F.col("length").alias("_n")))
    rows = spectrum.join(known, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("block", F.floor(F.col("frame") / block))
    skip = n // 2 + hop // 2 * 3
    square = dense._hann(n) ** 2

    def pieces(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        length = int(part["_n"].iloc[0])
        le, (lo, hi) = -(-length // hop), (int(part.frame.min()) + 2, int(part.frame.max()) + 2)
        before, behind = (2 if lo == 2 else 0), (2 if hi == le + 1 else 0)
        first, last = lo - before, hi + behind
        total, envelope = np.zeros((2, (last - first) * hop + n))
        for f in [*range(first, lo), *range(hi + 1, last + 1)]:
            envelope[(f - first) * hop : (f - first) * hop + n] += square
        full = np.zeros((len(part), n // 2 + 1), complex)
        full[:, :-1] = np.stack(part.re.to_numpy()) + 1j * np.stack(part.im.to_numpy())
        for f, piece in zip(part.frame.to_numpy() + 2 - first, np.fft.irfft(full * np.sqrt(n), n=n, axis=1) * dense._hann(n)):
            total[f * hop : f * hop + n] += piece
            envelope[f * hop : f * hop + n] += square
        i = np.arange(len(total)) + first * hop - skip
        inside = (i >= 0) & (i < length)
        return pd.DataFrame({by: key[0], "i": i[inside], "x": total[inside], "e": envelope[inside]})

    added = rows.groupBy(by, "block").applyInPandas(pieces, f"{by} {kind}, i long, x double, e double").groupBy(by, "i").agg(F.sum("x").alias("x"), F.sum("e").alias("e"))
    return added.select(by, "i", (F.col("x") / (F.col("e") + 1e-8)).alias("x"))
