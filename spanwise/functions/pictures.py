"""Pictures as binary I420 planes, a batch at a time: all pictures of one shape and turn are one array.

A turn is part of the gather: the index of every source pixel is worked out once for a shape, so no
picture is turned after it was converted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .dense import nearest


def planes_size(width: int, height: int) -> int:
    """Bytes of a luma plane and two chroma planes of half size, odd edges rounded up."""
    return width * height + 2 * (-(-width // 2) * -(-height // 2))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each value begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts


def by_shape(*keys: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each different combination of ``keys`` with the rows that have it."""
    if len(keys[0]):
        shapes, which = np.unique(np.stack(keys, axis=1), axis=0, return_inverse=True)
        for k, shape in enumerate(shapes):
            yield tuple(int(s) for s in shape), np.flatnonzero(which.ravel() == k)


def _sources(width: int, height: int, degrees: int) -> tuple[np.ndarray, np.ndarray]:
    """Source row and column of every pixel of the upright picture, which was turned clockwise by quarter turns."""
    turns = degrees // 90 % 4
    h, w = (width, height) if turns % 2 else (height, width)
    r, c = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    return {0: (r, c), 1: (height - 1 - c, r), 2: (height - 1 - r, width - 1 - c), 3: (c, width - 1 - r)}[turns]


def rgb(pixels: np.ndarray, width: int, height: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """(pictures, 3, ...) of I420 bytes (pictures, size) at source ``rows``, ``cols``; these are one gather for all pictures or have one each in front.

    BT.601 in fixed point with a flooring shift.
    """
    half = -(-width // 2)
    chroma = width * height + rows // 2 * half + cols // 2
    plane = half * -(-height // 2)
    if rows.ndim == 2:
        take = lambda at: pixels[:, at].astype(np.int32)
    else:
        take = lambda at: np.take_along_axis(pixels, at.reshape(len(pixels), -1), axis=1).reshape(at.shape).astype(np.int32)
    y, u, v = take(rows * width + cols), take(chroma) - 128, take(chroma + plane) - 128
    return np.clip(np.stack([y + ((1436 * v) >> 10), y - ((352 * u + 731 * v) >> 10), y + ((1815 * u) >> 10)], axis=1), 0, 255)


def upright(pixels: np.ndarray, width: int, height: int, degrees: int = 0) -> np.ndarray:
    """(pictures, 3, h, w) upright pictures of I420 bytes."""
    return rgb(pixels, width, height, *_sources(width, height, degrees))


def tensors(pixels: np.ndarray, width: int, height: int, degrees: int = 0) -> np.ndarray:
    """``upright`` as float32 in [0, 1]."""
    return upright(pixels, width, height, degrees).astype(np.float32) / 255


def square_crops(pixels: np.ndarray, width: int, height: int, rects: np.ndarray, side: int = 96) -> np.ndarray:
    """(pictures, 3, side, side): around each normalised rectangle (left, top, right, bottom) a square of 1.5 times its longer edge, edge pixels repeated."""
    left, top, right, bottom = rects.T
    half = np.maximum((right - left) * width, (bottom - top) * height) * 1.5 / 2
    step = np.arange(side)[None, :] * half[:, None] * 2 / side
    cols = np.clip((((left + right) / 2 * width - half)[:, None] + step).astype(np.int64), 0, width - 1)
    rows = np.clip((((top + bottom) / 2 * height - half)[:, None] + step).astype(np.int64), 0, height - 1)
    full = (len(pixels), side, side)
    return rgb(pixels, width, height, np.broadcast_to(rows[:, :, None], full), np.broadcast_to(cols[:, None, :], full))


def packed(pixels: np.ndarray, width: int, height: int, to_width: int, to_height: int) -> np.ndarray:
    """(pictures, bytes): scaled by nearest neighbour, luma first, then V and U in turn at half size."""
    half = -(-width // 2)
    plane = half * -(-height // 2)
    rows, cols = nearest(0, height, to_height), nearest(0, width, to_width)
    luma = (rows[:, None] * width + cols[None, :]).ravel()
    u = (width * height + rows[::2, None] // 2 * half + cols[None, ::2] // 2).ravel()
    return pixels[:, np.concatenate([luma, np.stack([u + plane, u], axis=1).ravel()])]
