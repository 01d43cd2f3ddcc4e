"""Dense numeric kernels for Arrow batches: short-time Fourier transform and pixel layouts."""

from __future__ import annotations

import numpy as np


def frames_of(length: int, hop: int) -> tuple[int, int, int]:
    """``le, left, right``: kept frames and reflect padding."""
    le = -(-length // hop)
    left = hop // 2 * 3
    return le, left, left + le * hop - length


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n: int = 4096, hop: int = 1024) -> np.ndarray:
    """(bins, le) complex: reflect padding twice, periodic Hann, 1/sqrt(n), no Nyquist bin."""
    le, left, right = frames_of(len(x), hop)
    wide = np.pad(np.pad(x, (left, right), mode="reflect"), n // 2, mode="reflect")
    cut = np.lib.stride_tricks.sliding_window_view(wide, n)[::hop][: le + 4]
    return (np.fft.rfft(cut * _hann(n), axis=1) / np.sqrt(n))[2 : 2 + le, :-1].T


def istft(z: np.ndarray, length: int, n: int = 4096, hop: int = 1024) -> np.ndarray:
    """Overlap-add inverse of ``stft``, divided by the window-square envelope."""
    le, left, _ = frames_of(length, hop)
    full = np.zeros((le + 4, n // 2 + 1), dtype=complex)
    full[2 : 2 + le, :-1] = z.T
    window = _hann(n)
    pieces = np.fft.irfft(full * np.sqrt(n), n=n, axis=1) * window
    total, envelope = np.zeros((2, (le + 3) * hop + n))
    for k, piece in enumerate(pieces):
        total[k * hop : k * hop + n] += piece
        envelope[k * hop : k * hop + n] += window**2
    out = total / (envelope + 1e-8)
    return out[n // 2 + left : n // 2 + left + length]


def nearest(start: int, size: int, n: int) -> np.ndarray:
    """Source index of each of n outputs: start + i * size // n."""
    return start + np.arange(n) * size // n


def nv21(y: np.ndarray, u: np.ndarray, v: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planes scaled by nearest neighbour and packed: luma, then V and U in turn at half size."""
    luma = y[np.ix_(nearest(0, y.shape[0], height), nearest(0, y.shape[1], width))]
    rows, cols = nearest(0, y.shape[0], height)[::2] // 2, nearest(0, y.shape[1], width)[::2] // 2
    return np.concatenate([luma.ravel(), np.stack([v[np.ix_(rows, cols)], u[np.ix_(rows, cols)]], axis=-1).ravel()])


def rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(3, h, w) bytes of 4:2:0 planes, BT.601 in fixed point with a flooring shift."""
    u, v = (np.repeat(np.repeat(p.astype(int) - 128, 2, axis=0), 2, axis=1)[: y.shape[0], : y.shape[1]] for p in (u, v))
    y = y.astype(int)
    return np.clip(np.stack([y + ((1436 * v) >> 10), y - ((352 * u + 731 * v) >> 10), y + ((1815 * u) >> 10)]), 0, 255)


def upright(planes: np.ndarray, degrees: int) -> np.ndarray:
    """Pictures (..., h, w) turned clockwise by quarter turns."""
    return np.rot90(planes, -(degrees // 90) % 4, axes=(-2, -1))


def square_crop(picture: np.ndarray, left: float, top: float, right: float, bottom: float, side: int = 96) -> np.ndarray:
    """Square around a normalised rectangle, 1.5 times its longer edge, edge pixels repeated."""
    h, w = picture.shape[-2:]
    half = max((right - left) * w, (bottom - top) * h) * 1.5 / 2
    xs = np.clip(((left + right) / 2 * w - half + np.arange(side) * half * 2 / side).astype(int), 0, w - 1)
    ys = np.clip(((top + bottom) / 2 * h - half + np.arange(side) * half * 2 / side).astype(int), 0, h - 1)
    return picture[..., ys[:, None], xs[None, :]]


def tensor(y: np.ndarray, u: np.ndarray, v: np.ndarray, degrees: int = 0) -> np.ndarray:
    """(1, 3, h, w) float32 in [0, 1] of 4:2:0 planes, turned upright."""
    return upright(rgb(y, u, v), degrees)[None].astype(np.float32) / 255
