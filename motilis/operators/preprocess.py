"""Colour frames to a feature model's input: shortest edge to 256, centre crop of 224, normalised by channel.

Resizing is two passes over a batch of frames, columns then rows, each a banded matrix product: an output pixel is a weighted sum of
the few input pixels under a cubic kernel that is stretched when shrinking (antialiasing). Weights are fixed-point numbers and each
pass rounds to whole grey levels, as image libraries with 8 bits a channel do, so results do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what saved heads were fitted to
SHORTEST_EDGE, CROP = 256, 224
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Bits behind the point of a weight; bytes of frames taken at a time.
BITS, BATCH_BYTES = 22, 64 << 20


def cubic(x: np.ndarray) -> np.ndarray:
    """Keys's kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def band(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `to` output pixels the input pixels it is made of (columns, clipped at the edges) and their weights, which sum to 1."""
    scale = size / to
    stretch = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum((centre - 2 * stretch + 0.5).astype(np.int64), 0)
    last = np.minimum((centre + 2 * stretch + 0.5).astype(np.int64), size)
    at = first[:, None] + np.arange((last - first).max())
    weights = np.where(at < last[:, None], cubic((at - centre[:, None] + 0.5) / stretch), 0.0)
    return np.minimum(at, size - 1), weights / weights.sum(axis=1, keepdims=True)


def resized(frames: np.ndarray, axis: int, to: int) -> np.ndarray:
    """frames (uint8) with `axis` resized to `to` pixels, one product for each diagonal of the band."""
    if frames.shape[axis] == to:
        return frames
    at, weights = band(frames.shape[axis], to)
    fixed = np.where(weights < 0, np.ceil(weights * (1 << BITS) - 0.5), np.floor(weights * (1 << BITS) + 0.5)).astype(np.int64)
    shape = [1] * frames.ndim
    shape[axis] = to
    total = np.full((*frames.shape[:axis], to, *frames.shape[axis + 1 :]), 1 << (BITS - 1), np.int64)
    for k in range(at.shape[1]):
        total += np.take(frames, at[:, k], axis=axis) * fixed[:, k].reshape(shape)
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def preprocess(frames: np.ndarray, edge: int = SHORTEST_EDGE, crop: int = CROP) -> np.ndarray:
    """Frames (n, height, width, 3) of 8 bits as (n, 3, crop, crop) of float32. Grey frames are refused: another distribution."""
    if frames.ndim != 4 or frames.shape[3] != 3:
        raise ValueError(f"colour frames are needed, not {frames.shape}")
    _, h, w, _ = frames.shape
    scale = edge / min(w, h)
    frames = resized(resized(frames, 2, round(w * scale)), 1, round(h * scale))
    _, h, w, _ = frames.shape
    top, left = (h - crop) // 2, (w - crop) // 2
    cut = frames[:, top : top + crop, left : left + crop].astype(np.float32) / np.float32(255.0)
    return ((cut - np.asarray(MEAN, np.float32)) / np.asarray(STD, np.float32)).transpose(0, 3, 1, 2)


def model_inputs(frames: DataFrame, edge: int = SHORTEST_EDGE, crop: int = CROP) -> DataFrame:
    """One row for each row of frames (clip_id, t_s, width, height, rgb: three bytes for each pixel, row by row): clip_id, t_s, input (binary, little-endian float32, channel by channel), failed_reason.

    A frame that is null, grey or of another size has no input and a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clip_id", "t_s", "input", "failed_reason"]
        for batch in batches:
            w, h, data = (batch.column(c).to_pylist() for c in ("width", "height", "rgb"))
            of_size: dict[tuple[int, int], list[int]] = {}
            why: list[str | None] = [None] * len(data)
            for i, (a, b, d) in enumerate(zip(w, h, data)):
                if d is None or not a or not b or a < 0 or b < 0:
                    why[i] = "no frame"
                elif len(d) == a * b:
                    why[i] = "grey frame"
                elif len(d) != 3 * a * b:
                    why[i] = "frame of another size"
                else:
                    of_size.setdefault((b, a), []).append(i)
            bad = [i for i, reason in enumerate(why) if reason]
            if bad:
                rows = batch.take(pa.array(bad))
                yield pa.RecordBatch.from_arrays([rows.column("clip_id"), rows.column("t_s"), pa.nulls(len(bad), pa.binary()), pa.array([why[i] for i in bad], pa.string())], names)
            for (b, a), all_ in of_size.items():
                step = max(1, BATCH_BYTES // (24 * a * b))  # sums are eight bytes wide
                for at in range(0, len(all_), step):
                    own = all_[at : at + step]
                    done = preprocess(np.frombuffer(b"".join(data[i] for i in own), np.uint8).reshape(len(own), b, a, 3), edge, crop)
                    rows = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([rows.column("clip_id"), rows.column("t_s"), pa.array([x.astype("<f4").tobytes() for x in done], pa.binary()), pa.nulls(len(own), pa.string())], names)

    columns = frames.select("clip_id", F.col("t_s").cast("double").alias("t_s"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb")
    return columns.mapInArrow(run, "clip_id string, t_s double, input binary, failed_reason string")
