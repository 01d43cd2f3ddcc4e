"""Batches of pictures against one picture at a time."""

import numpy as np
import pytest

from spanwise.functions import dense, pictures


def split(pixels, w, h):
    cw, ch = -(-w // 2), -(-h // 2)
    y, u, v = np.split(pixels, [w * h, w * h + cw * ch])
    return y.reshape(h, w), u.reshape(ch, cw), v.reshape(ch, cw)


@pytest.mark.parametrize("w, h", [(16, 12), (7, 5), (2, 2), (33, 8)])
def test_batches(w, h):
    rng = np.random.default_rng(w)
    many = rng.integers(0, 256, (9, pictures.planes_size(w, h)), dtype=np.uint8)
    rects = np.concatenate([rng.random((9, 2)) * 0.6, 0.4 + rng.random((9, 2)) * 0.6], axis=1)
    rects[0] = [-0.2, -0.3, 1.4, 1.2]
    for degrees in (0, 90, 180, 270):
        got = pictures.tensors(many, w, h, degrees)
        assert (got == np.concatenate([dense.tensor(*split(p, w, h), degrees) for p in many])).all() and got.dtype == np.float32
    crops = pictures.square_crops(many, w, h, rects, 24)
    assert (crops == np.stack([dense.square_crop(dense.rgb(*split(p, w, h)), *r, side=24) for p, r in zip(many, rects)])).all()
    for to in ((8, 6), (w - w % 2, h - h % 2), (40, 20)):
        assert (pictures.packed(many, w, h, *to) == np.stack([dense.nv21(*split(p, w, h), *to) for p in many])).all()


def test_shapes():
    keys = np.array([3, 1, 3, 2]), np.array([0, 0, 0, 1])
    assert {k: list(r) for k, r in pictures.by_shape(*keys)} == {(3, 0): [0, 2], (1, 0): [1], (2, 1): [3]}
    assert list(pictures.by_shape(np.array([]), np.array([]))) == []
