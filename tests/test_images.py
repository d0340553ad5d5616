"""Boxes of label images and a model's inputs against loops over pixels."""

import math

import numpy as np
import pytest

from motilis.operators import masks, preprocess


def flooded(image, k, least=64):
    """The largest component by flooding, pixel by pixel."""
    h, w = image.shape
    seen, best = np.zeros((h, w), bool), None
    for y in range(h):
        for x in range(w):
            if image[y, x] != k or seen[y, x]:
                continue
            todo, own = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for c, e in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < h and 0 <= e < w and image[c, e] == k and not seen[c, e]:
                        seen[c, e] = True
                        todo.append((c, e))
            if len(own) >= least and (best is None or len(own) > best[4]):
                ys, xs = zip(*own)
                best = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own))
    return best or (0, 0, 0, 0, 0)


def spiral(n):
    """One path of pixels that winds inwards, a pixel apart."""
    image, y, x, dy, dx = np.zeros((n, n), np.uint8), 0, 0, 0, 1
    free = lambda a, b: not (0 <= a < n and 0 <= b < n) or image[a, b] == 0
    inside = lambda a, b: 0 <= a < n and 0 <= b < n
    image[0, 0], turns = 1, 0
    while turns < 2:
        a, b = y + dy, x + dx
        if inside(a, b) and image[a, b] == 0 and free(a + dy, b + dx):
            y, x, turns = a, b, 0
            image[y, x] = 1
        else:
            dy, dx, turns = dx, -dy, turns + 1
    return image


@pytest.mark.parametrize("least", [1, 12, 64])
def test_boxes_agree_with_flooding(least):
    rng = np.random.default_rng(1)
    stack = rng.choice(3, (40, 23, 31), p=[0.3, 0.45, 0.25]).astype(np.uint8)
    stack[3], stack[4, :, :], stack[5] = 0, 1, 2
    stack[6] = np.indices((23, 31)).sum(0) % 2 + 1  # corners only
    stack[7, ::2], stack[7, 1::2] = 1, 0
    stack[7, 1::2, 0] = 1  # a comb
    found = masks.largest_boxes(stack, least=least)
    for k in (1, 2):
        assert [tuple(b) for b in found[k].tolist()] == [flooded(image, k, least) for image in stack]


def test_rounds_do_not_grow_with_the_length():
    image = spiral(301)
    assert image.sum() > 40_000
    row, start, end = masks.runs((image == 1)[None])
    rounds = []
    assert (masks.joined(len(row), *masks.neighbours(row, start, end, 301), each=lambda left: rounds.append(left)) == 0).all()
    assert len(rounds) <= math.log2(len(row)) and rounds == sorted(rounds, reverse=True)
    assert masks.largest_boxes(image[None])[1].tolist() == [[0, 0, 301, 301, int(image.sum())]]


def test_masks_of_a_table(spark):
    m = np.zeros((20, 30), np.uint8)
    m[2:12, 3:13] = 1
    m[12, 13] = 1  # touches by a corner only
    m[0:2, 0:2] = 2
    flat = np.full((64, 1), 2, np.uint8)
    rows = [("a", 0.0, 30, 20, m.tobytes()), ("a", 0.25, 1, 64, flat.tobytes()), ("a", 0.5, 30, 20, None), ("a", 0.75, 30, 21, m.tobytes()), (None, None, 0, 0, b""), ("b", 1.0, 30, 20, bytes(600)), ("a", 0.0, 30, 20, m.tobytes())]
    df = spark.createDataFrame(rows, "clip_id string, t_s double, width int, height int, mask binary").repartition(2)
    out = sorted(((r.clip_id, r.t_s, [tuple(b) for b in r.boxes], r.failed_reason) for r in masks.boxes_from_masks(df).collect()), key=repr)
    box = (1, 3.0, 2.0, 10.0, 10.0, 100)
    assert out == sorted([("a", 0.0, [box], None)] * 2 + [("a", 0.25, [(2, 0.0, 0.0, 1.0, 64.0, 64)], None), ("a", 0.5, [], "no mask"), ("a", 0.75, [], "mask of another size"), (None, None, [], "mask of another size"), ("b", 1.0, [], None)], key=repr)
    assert masks.boxes_from_masks(df.limit(0)).count() == 0


def by_loop(frame, edge, crop):
    """The same steps, pixel by pixel."""

    def kernel(x):
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0

    def line(values, to):
        size, out = len(values), []
        scale = size / to
        stretch = max(scale, 1.0)
        for i in range(to):
            centre = (i + 0.5) * scale
            a, b = max(int(centre - 2 * stretch + 0.5), 0), min(int(centre + 2 * stretch + 0.5), size)
            weights = [kernel((j - centre + 0.5) / stretch) for j in range(a, b)]
            total, whole = sum(weights), 1 << 21
            for j, x in zip(range(a, b), weights):
                fixed = x / total * (1 << 22)
                whole += int(values[j]) * (int(fixed - 0.5) if fixed < 0 else int(fixed + 0.5))
            out.append(min(max(whole >> 22, 0), 255))
        return out

    h, w, _ = frame.shape
    scale = edge / min(h, w)
    nw, nh = round(w * scale), round(h * scale)
    wide = np.array([[line(frame[y, :, c], nw) for c in range(3)] for y in range(h)]).transpose(0, 2, 1) if nw != w else frame
    both = np.array([[line(wide[:, x, c], nh) for c in range(3)] for x in range(nw)]).transpose(2, 0, 1) if nh != h else wide
    top, left = (nh - crop) // 2, (nw - crop) // 2
    cut = both[top : top + crop, left : left + crop].astype(np.float32) / np.float32(255)
    return ((cut - np.array(preprocess.MEAN, np.float32)) / np.array(preprocess.STD, np.float32)).transpose(2, 0, 1)


@pytest.mark.parametrize("shape", [(27, 48), (48, 27), (20, 20), (11, 37), (90, 64)])
def test_inputs_agree_with_a_loop(shape):
    frames = np.random.default_rng(2).integers(0, 256, (3, *shape, 3), np.uint8)
    frames[1] = 255
    frames[2, :, ::2] = 0
    got = preprocess.preprocess(frames, 20, 18)
    assert got.dtype == np.float32 and got.shape == (3, 3, 18, 18)
    assert all((g == by_loop(f, 20, 18)).all() for g, f in zip(got, frames))
    assert np.allclose(got[1], ((1 - np.array(preprocess.MEAN)) / np.array(preprocess.STD))[:, None, None], atol=1e-6)


def test_a_bands_weights():
    for size, to in ((960, 455), (540, 256), (100, 256), (7, 3)):
        at, weights = preprocess.band(size, to)
        assert np.allclose(weights.sum(1), 1) and at.min() == 0 and at.max() == size - 1 and at.shape[1] <= 4 * max(size / to, 1) + 2


def test_frames_of_a_table(spark):
    frame = np.random.default_rng(3).integers(0, 256, (540, 960, 3), np.uint8)
    small = np.random.default_rng(4).integers(0, 256, (300, 256, 3), np.uint8)
    rows = [("a", 0.0, 960, 540, frame.tobytes()), ("b", 0.0, 256, 300, small.tobytes()), ("c", 0.0, 256, 300, None), ("d", 0.0, 256, 300, bytes(256 * 300)), ("e", 0.0, 256, 300, b"x")]
    df = spark.createDataFrame(rows, "clip_id string, t_s double, width int, height int, rgb binary").repartition(2)
    out = {r.clip_id: r for r in preprocess.model_inputs(df).collect()}
    assert {k: r.failed_reason for k, r in out.items()} == {"a": None, "b": None, "c": "no frame", "d": "grey frame", "e": "frame of another size"}
    for k, f in (("a", frame), ("b", small)):
        got = np.frombuffer(out[k].input, "<f4").reshape(3, 224, 224)
        assert (got == preprocess.preprocess(f[None])[0]).all()
    assert preprocess.preprocess(small[None]).shape == (1, 3, 224, 224)
    with pytest.raises(ValueError, match="colour"):
        preprocess.preprocess(small[None, :, :, 0])
