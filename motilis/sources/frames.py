"""Frames from a decoder's pipe, streamed; models behind ports. One row per instant, whatever happens to it."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class FrameDetector(Protocol):
    def boxes(self, frame: bytes) -> list[dict]: ...


class FlowEstimator(Protocol):
    def flow(self, first: bytes, second: bytes) -> object | None: ...


class Labeller(Protocol):
    def label(self, frame: bytes) -> tuple[bool | None, int | None]: ...


def decoder_argv(url: str, start: int, end: int, fps: float, width: int, height: int, at_s: float = 0.0, timeout_us: int = 30_000_000) -> list[str]:
    """Arguments that decode a byte window of an archive as raw grey frames; seeking comes before the input."""
    return ["ffmpeg", "-v", "error", "-protocol_whitelist", "file,subfile,http,https,tcp,tls,crypto", "-rw_timeout", str(timeout_us), "-ss", f"{at_s:.6f}", "-i", f"subfile,,start,{start},end,{end},,:{url}", "-vf", f"fps={fps},scale={width}:{height}", "-f", "rawvideo", "-pix_fmt", "gray", "-"]


def stream_frames(argv: list[str], frame_bytes: int) -> Iterator[bytes]:
    """Whole frames as they come; a short tail is dropped, a failing decoder raises. A clip is never held in memory."""
    with subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        while len(frame := run.stdout.read(frame_bytes)) == frame_bytes:
            yield frame
        said = run.stderr.read()
        if run.wait():
            raise RuntimeError(said.decode("utf-8", "replace")[-200:] or f"decoder ended with {run.returncode}")


def probe(clips: DataFrame, frames_of: Callable[[dict], Iterator[bytes]]) -> DataFrame:
    """Per clip: planned, frames, ok, reason, seconds. Any failure is a reason. clips: clip_id, planned and what frames_of needs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                began, n, reason = time.monotonic(), 0, None
                try:
                    for _ in frames_of(row):
                        n += 1
                except Exception as e:  # noqa: BLE001  the reason is the result
                    reason = str(e)[:120] or type(e).__name__
                out.append((row["clip_id"], row["planned"], n, reason is None and n > 0, reason if reason or n else "no frame", time.monotonic() - began))
            yield pd.DataFrame(out, columns=["clip_id", "planned", "frames", "ok", "reason", "seconds"])

    return clips.mapInPandas(run, "clip_id string, planned long, frames long, ok boolean, reason string, seconds double")


def detect(clips: DataFrame, frames_of: Callable[[dict], Iterator[bytes]], detector: Callable[[], FrameDetector], fps: float, source: str) -> DataFrame:
    """One row per decoded instant, those without a box included; a model's exception becomes failed_reason."""
    shape = "clip_id string, t_s double, mask_source string, boxes array<struct<x:double,y:double,width:double,height:double,score:double>>, failed_reason string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = detector()
        for part in parts:
            for row in part.to_dict("records"):
                out = []
                for k, frame in enumerate(frames_of(row)):
                    try:
                        boxes, reason = model.boxes(frame), None
                    except Exception as e:  # noqa: BLE001
                        boxes, reason = [], str(e)[:120] or type(e).__name__
                    out.append((row["clip_id"], k / fps, source, boxes, reason))
                    if len(out) == 256:
                        yield pd.DataFrame(out, columns=["clip_id", "t_s", "mask_source", "boxes", "failed_reason"])
                        out = []
                yield pd.DataFrame(out, columns=["clip_id", "t_s", "mask_source", "boxes", "failed_reason"])

    return clips.mapInPandas(run, shape)
