"""Boxes of label images: the largest connected component of each class, by runs of pixels over a whole batch of images.

A row of pixels becomes runs, runs of neighbouring rows that overlap are joined, and the joined runs' smallest number names the
component. All of it is done at once for all images of a batch. The number of rounds follows the logarithm of the number of runs
of a component and not its length, so a spiral takes a handful.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = (1, 2)
LEAST = 64
BATCH_BYTES = 8 << 20


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image * (height + 1) + row, first column and end of each run of a stack of images (image, row, column), in order. The row left out between two images keeps them apart."""
    n, h, w = on.shape
    wide = np.zeros((n * h, w + 2), np.int8)
    wide[:, 1:-1] = on.reshape(n * h, w)
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row + row // h, start, end


def neighbours(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that touch by an edge: each run with those of the row above that share a column."""
    wide = width + 1
    above = (row - 1) * wide
    first = np.searchsorted(row * wide + end, above + start, "right")
    last = np.searchsorted(row * wide + start, above + end, "left")
    count = np.maximum(last - first, 0)
    own = np.repeat(np.arange(len(row)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return own, first[own] + offset


def joined(n: int, a: np.ndarray, b: np.ndarray, each: Callable[[int], None] = lambda left: None) -> np.ndarray:
    """The smallest member of each of n members' class, where pairs (a, b) are of one class: roots hook on to smaller neighbouring roots, then paths are halved until they are flat.

    each is told, in each round, how many pairs still join two classes."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        each(len(a))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def largest_boxes(labels: np.ndarray, classes: tuple[int, ...] = CLASSES, least: int = LEAST) -> dict[int, np.ndarray]:
    """For each class a row for each image of the stack: x, y, width, height, pixels of the largest 4-connected component of `least` pixels or more, the first of equals; zeros if there is none."""
    n, h, w = labels.shape
    out = {}
    for k in classes:
        row, start, end = runs(labels == k)
        root = joined(len(row), *neighbours(row, start, end, w))
        box = np.zeros((n, 5), np.int64)
        if len(row):
            names, own = np.unique(root, return_inverse=True)  # a component's first run gives its place among equals
            size = np.bincount(own, end - start).astype(np.int64)
            image, y = row[names] // (h + 1), row % (h + 1)
            order = np.lexsort((np.arange(len(names)), -size, image))
            first = order[np.concatenate([[True], image[order][1:] != image[order][:-1]])]
            first = first[size[first] >= least]
            low, high = np.full((2, len(names)), max(h, w)), np.zeros((2, len(names)), np.int64)
            for i, (p, q) in enumerate(((start, end), (y, y + 1))):
                np.minimum.at(low[i], own, p)
                np.maximum.at(high[i], own, q)
            box[image[first]] = np.stack([low[0], low[1], high[0] - low[0], high[1] - low[1], size], axis=1)[first]
        out[k] = box
    return out


def boxes_from_masks(masks: DataFrame, classes: tuple[int, ...] = CLASSES, least: int = LEAST) -> DataFrame:
    """One row for each row of masks (clip_id, t_s, width, height, mask: a byte for each pixel, row by row): clip_id, t_s, boxes (in order of class; class, x, y, width, height, pixels), failed_reason.

    A mask that is null or does not have width x height bytes has no boxes and a reason. Images of one size are taken together."""
    shape = "clip_id string, t_s double, boxes array<struct<class:int,x:double,y:double,width:double,height:double,pixels:long>>, failed_reason string"
    box = pa.struct([("class", pa.int32()), *((c, pa.float64()) for c in ("x", "y", "width", "height")), ("pixels", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, data = (batch.column(c).to_pylist() for c in ("width", "height", "mask"))
            boxes: list[list[dict]] = [[] for _ in data]
            why = [None if d is not None and a and b and a > 0 and b > 0 and len(d) == a * b else "no mask" if d is None else "mask of another size" for a, b, d in zip(w, h, data)]
            of_size: dict[tuple[int, int], list[int]] = {}
            for i, reason in enumerate(why):
                if reason is None:
                    of_size.setdefault((h[i], w[i]), []).append(i)
            for (a, b), all_ in of_size.items():
                step = max(1, BATCH_BYTES // (a * b))
                for at in range(0, len(all_), step):
                    own = all_[at : at + step]
                    stack = np.frombuffer(b"".join(data[i] for i in own), np.uint8).reshape(len(own), a, b)
                    for k, found in largest_boxes(stack, classes, least).items():
                        for i, (x, y, bw, bh, size) in zip(own, found.tolist()):
                            if size:
                                boxes[i].append({"class": k, "x": float(x), "y": float(y), "width": float(bw), "height": float(bh), "pixels": size})
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("t_s"), pa.array(boxes, pa.list_(box)), pa.array(why, pa.string())], ["clip_id", "t_s", "boxes", "failed_reason"])

    return masks.select("clip_id", F.col("t_s").cast("double").alias("t_s"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "mask").mapInArrow(run, shape)
