"""The separator as one stream: chunks are decided two chunks late, run through a model or passed on, and added up.

What a track keeps between batches is bounded whatever its length: the blocks that the next chunk reads,
five scores, and the sums of the part that the next chunk still overlaps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.audio import LEAD, MUSIC, NEAR_MUSIC, SEGMENT, STRIDE

from .live import InEventOrder

Model = Callable[[np.ndarray], np.ndarray]


def soft_clip(x: np.ndarray) -> np.ndarray:
    """As ``scalar.soft_clip``, and zero for what is not finite."""
    over = np.abs(x) > 0.95
    out = np.where(over, np.sign(x) * (0.95 + np.tanh((np.abs(x) - 0.95) / 0.05) * 0.05), x)
    return np.where(np.isfinite(out), out, 0.0)


class Separator(InEventOrder):
    """One block of ``stride`` positions a row, with the score of the chunk that begins with it and the track's length, mean and deviation."""

    row = "at long, block long, score double, l array<double>, r array<double>, n long, mean double, std double"

    def __init__(self, model: Model, segment: int, stride: int, lead: int, origin: int, span: int = 60_000):
        self.model, self.segment, self.stride, self.lead, self.origin, self.span = model, segment, stride, lead, origin, span

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "chunk long, first long, waves array<double>, seen array<long>, scores array<double>, sums array<double>")

    def _separate(self, k: int, last: int, scores: dict[int, float]) -> bool:
        far = [scores.get(j) for j in range(max(0, k - 2), min(last, k + 2) + 1)]
        if None in far:
            return True
        near = max(scores[j] for j in range(max(0, k - 1), min(last, k + 1) + 1))
        single = np.float32
        return single(near) >= single(MUSIC) or (single(scores[k]) >= single(NEAR_MUSIC) and single(max(far)) >= single(MUSIC))

    def turn(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        segment, stride, lead = self.segment, self.stride, self.lead
        state = self.held.get() if self.held.exists() else None
        chunk, first, waves, seen, scores, sums = state if state is not None else (0, 0, [], [], [], [])
        ring = np.array(waves, float).reshape(-1, 2)  # positions from first * stride on
        known, total = dict(zip(seen, scores)), np.array(sums, float).reshape(-1, 3)
        out = []
        for _, block, score, left, right, n, mean, std in rows:
            if block < first:
                continue
            end = n + lead
            last = -(-end // stride) - 1
            wave = (np.stack([left, right], axis=1) - mean) / std if left else np.zeros((0, 2))
            begin = (block - first) * stride + (lead if block == 0 else 0)
            wide = np.zeros((max(len(ring), begin + len(wave)), 2))
            wide[: len(ring)] = ring
            wide[begin : begin + len(wave)] = wave
            ring, known[block] = wide, score
            while chunk <= last and (block >= chunk + 2 or block == last):
                off = chunk * stride
                size = min(segment, end - off)
                margin = (segment - size) // 2
                a, b = (off - margin if chunk == last else off), min(off + segment, end)
                a = max(a, first * stride)
                window = np.zeros((segment, 2))
                piece = ring[a - first * stride : b - first * stride]
                window[a - off + margin : a - off + margin + len(piece)] = piece
                window = (self.model(window) if self._separate(chunk, last, known) else window)[margin : margin + size]
                j = np.arange(size)
                g = np.minimum(j + 1, segment - j) / (segment / 2)
                added = np.zeros((max(len(total), size), 3))
                added[: len(total)] = total
                added[:size] += np.concatenate([window * g[:, None], g[:, None]], axis=1)
                whole = size if chunk == last else stride
                place = off + np.arange(whole) - lead
                back = soft_clip(added[:whole, :2] / added[:whole, 2:] * std + mean)[place >= 0]
                out.append(pd.DataFrame({"track_id": key[0], "i": place[place >= 0], "l": back[:, 0], "r": back[:, 1]}))
                total, chunk = added[whole:], chunk + 1
                known = {k: v for k, v in known.items() if k >= chunk - 2}
                keep = max(0, chunk - 1)  # the last chunk also reads what lies before it
                ring, first = ring[(keep - first) * stride :], keep
        self.held.update((chunk, first, ring.ravel().tolist(), sorted(known), [known[k] for k in sorted(known)], total.ravel().tolist()))
        return pd.concat(out) if out else None


def separated(blocks: DataFrame, model: Model, segment: int = SEGMENT, stride: int = STRIDE, lead: int = LEAD, delay: str = "5 seconds", origin: int = 0, span: int = 60_000) -> DataFrame:
    """``track_id, i, l, r`` of tracks that arrive in blocks, in append mode.

    ``blocks``: track_id, ts, block, score, the arrays l and r of the samples i with (i + lead) // stride = block, and the track's facts
    n, mean and std of a first pass. A chunk is separated by the rule of ``audio.dilate``; one whose score or whose
    neighbour's is missing too. The blocks of ``span`` milliseconds are in memory at once. The result equals that of ``audio.separate`` where every chunk is separated.
    """
    rows = blocks.withWatermark("ts", delay).select("track_id", "ts", (F.unix_millis("ts") - origin).alias("at"), "block", "score", "l", "r", "n", "mean", "std")
    return rows.groupBy("track_id").transformWithStateInPandas(Separator(model, segment, stride, lead, origin, span), "track_id string, i long, l double, r double", "Append", "EventTime")
