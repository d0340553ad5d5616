"""Scalar column expressions; all of them stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def clip_id(factory: Column, worker: Column, index: Column) -> Column:
    return F.format_string("%s/%s/%06d", factory, worker, index)


def parse_clip_id(c: Column) -> Column:
    """Struct of factory_id, worker_id, clip_index; null unless there are exactly three parts and the last is a number."""
    p = F.split(c, "/", -1)
    ok = (F.size(p) == 3) & F.try_element_at(p, F.lit(3)).rlike("^[0-9]+$")
    return F.when(ok, F.struct(p[0].alias("factory_id"), p[1].alias("worker_id"), F.try_element_at(p, F.lit(3)).try_cast("int").alias("clip_index")))


def n_samples(duration: Column, fps: Column) -> Column:
    """Instants of a rate whose frame pair lies inside the clip."""
    room = duration * fps - 1
    near = F.round(room)
    return F.when(room <= 0, 0).when(F.abs(room - near) <= 1e-9, near).otherwise(F.ceil(room)).cast("int")


def nyquist_hz(fps: Column) -> Column:
    return fps / 2


def time_key(t: Column, quantum: float = K.KEY_QUANTUM_S) -> Column:
    """Times as whole quanta, the only equality joins on time use."""
    return F.round(t / quantum).cast("long")


def native_index(t: Column, fps: Column) -> Column:
    """Half-up index of the native frame at a time."""
    return F.floor(t * fps + 0.5).cast("long")


def resolvability_floor(n: Column, alpha: float = K.SPECTRAL_FALSE_ALARM_RATE) -> Column:
    """Peak over median that noise of n bins exceeds with chance alpha; null below two bins."""
    return F.when(n >= 2, -F.ln(1 - F.pow(F.lit(1 - alpha), 1.0 / n)) / math.log(2))


#: Hundredths whose upper half is, as a double, nearer to the next one (or level with it and the next one even).
_HALVES_UP = [n for n in range(100) if round((n + 0.5) / 100, 2) > (n + 0.25) / 100]


def share_text(x: Column) -> Column:
    """A share from 0 to 1 with two places. Its double is rounded as it stands, as in C and Python; format_string rounds the shortest decimal that names it."""
    low = F.floor(x * 100).cast("int")
    half = (low + 0.5) / 100
    n = low + F.when((x > half) | ((x == half) & low.isin(_HALVES_UP)), 1).otherwise(0)
    return F.when(x.isNotNull(), F.format_string("%d.%02d", F.floor(n / 100), n % 100))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / ((a + b) / 2)


def kish(m: Column, rho: Column) -> Column:
    return 1 + (m - 1) * rho


def hal_radwin(f: Column, duty_pct: Column) -> Column:
    """2015 frequency regression; null outside its domain."""
    p = F.pow(f, 1.31)
    return F.when((f > 0) & (duty_pct > 0) & (duty_pct <= 100), 6.56 * F.ln(duty_pct) * p / (1 + 3.18 * p))


def hal_akkas(s: Column, duty_pct: Column) -> Column:
    """2015 speed regression; null outside its domain."""
    return F.when((s > 0) & (duty_pct > 0) & (duty_pct <= 100), 10 / (1 + F.exp(-(-15.87 + 0.02 * duty_pct + 2.25 * F.ln(s)))))


def radwin_in_range(f: Column) -> Column:
    return f.between(*K.RADWIN_F_HZ)


def akkas_in_range(s: Column, duty_pct: Column) -> Column:
    return s.between(*K.AKKAS_S_MM) & duty_pct.between(*K.AKKAS_D_PCT)


def clamp_hal(x: Column) -> Column:
    """0 to 10, half-even to a tenth."""
    return F.bround(F.least(F.lit(10.0), F.greatest(F.lit(0.0), x)), 1)


def area(box: Column) -> Column:
    return box["width"] * box["height"]


def largest_box(boxes: Column) -> Column:
    """The box of the largest area, the first of equals; null if there is none."""
    return F.reduce(F.slice(boxes, 2, F.greatest(F.size(boxes), F.lit(1))), F.try_element_at(boxes, F.lit(1)), lambda best, b: F.when(area(b) > area(best), b).otherwise(best))


def scale_boxes(boxes: Column, sx: Column, sy: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct((b["x"] * sx).alias("x"), (b["y"] * sy).alias("y"), (b["width"] * sx).alias("width"), (b["height"] * sy).alias("height"), b["score"].alias("score")))


def in_box(x: Column, y: Column, box: Column, width: Column, height: Column) -> Column:
    """Whether a pixel lies in a box's mask: floor and ceiling of its edges, clipped to the frame."""
    left, top = F.greatest(F.floor(box["x"]), F.lit(0)), F.greatest(F.floor(box["y"]), F.lit(0))
    right = F.least(F.ceil(box["x"] + box["width"]), width)
    low = F.least(F.ceil(box["y"] + box["height"]), height)
    return (x >= left) & (x < right) & (y >= top) & (y < low)


def has_identifier(c: Column) -> Column:
    return c.rlike(K.IDENTIFIER)


def subfile_url(url: Column, start: Column, end: Column) -> Column:
    """Byte window of an archive as a decoder's input."""
    return F.concat(F.lit("subfile,,start,"), start.cast("string"), F.lit(",end,"), end.cast("string"), F.lit(",,:"), url)
