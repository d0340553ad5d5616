"""Release tables: nested results flattened to rows with allow-listed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gain_rows(results: DataFrame) -> DataFrame:
    """Scales of a sweep as rows, with displacement over box width. results: estimator, scales (array of structs with rows)."""
    s = results.select("estimator", F.explode("scales").alias("s"))
    r = s.select("estimator", F.col("s.frame_size")[0].alias("width"), F.col("s.frame_size")[1].alias("height"), F.col("s.hand_box_width_px").alias("box"), F.explode("s.rows").alias("r"))
    return r.select("estimator", "width", "height", F.col("r.hand_displacement_px").alias("hand_displacement_px"), F.col("r.gain").alias("gain"), F.col("r.flow_returned_none").alias("flow_returned_none"), F.round(F.col("r.hand_displacement_px") / F.col("box"), 4).alias("displacement_per_box"))


def benchmark_rows(results: DataFrame, columns: list[str]) -> DataFrame:
    """A map of arms as rows; only listed fields leave. results: arms map<string, map<string, double>>."""
    return results.select(F.explode("arms").alias("arm", "f")).select("arm", *(F.try_element_at("f", F.lit(c)).alias(c) for c in columns))


def floor_rows(rotation: DataFrame, translation: DataFrame, control: DataFrame) -> DataFrame:
    """Three tables of floors as one, each with its tag; a motion that a table lacks is 0."""
    out = None
    for tag, df in (("rotation", rotation), ("translation", translation), ("narrow_control", control)):
        has = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)  # noqa: B023, E731
        part = df.select(F.lit(tag).alias("series"), has("rotation_deg_per_s").alias("rotation_deg_per_s"), has("translation_m_per_s").alias("translation_m_per_s"), "floor_mm_s")
        out = part if out is None else out.unionByName(part)
    return out


def quiver_points(flow: DataFrame, coarse: int, fine: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Finite flow on a coarse grid and, inside a box, on a fine one; a point of both counts once."""
    x0, y0, x1, y1 = box
    grid = lambda k: (F.col("x") % k == 0) & (F.col("y") % k == 0)
    fine_rows = flow.filter(grid(fine) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    rows = flow.filter(grid(coarse)).unionByName(fine_rows).filter("u is not null and v is not null and not isnan(u) and not isnan(v)")
    return rows.dropDuplicates(["x", "y"])


def payload(df: DataFrame) -> DataFrame:
    """Rows as one JSON value each, without fields that are not numbers."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def card(template: str, values: dict[str, object]) -> str:
    """A README of a release: {{name}} replaced by values; a name without a value is an error."""
    import re

    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]), template)


def rewrite(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Source text with each pattern replaced in order."""
    c = F.col(column)
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return df.withColumn(column, c)
