"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microns in a resolution unit.
UNIT_MICRONS = {"INCH": 25400.0, "CENTIMETER": 10000.0, "MILLIMETER": 1000.0, "MICROMETER": 1.0}


def microns_per_pixel(unit: Column, numerator: Column, denominator: Column) -> Column:
    """Null for units without a length and for a zero resolution."""
    microns = F.lit(None).cast("double")
    for name, value in UNIT_MICRONS.items():
        microns = F.when(unit == name, F.lit(value)).otherwise(microns)
    return F.try_divide(microns, F.try_divide(numerator, denominator))


def level_downsample(w0: Column, h0: Column, w: Column, h: Column) -> Column:
    """Mean ratio of the sides, rounded half to even."""
    return F.rint((w0 / w + h0 / h) / 2).cast("long")


def to_byte(v: Column) -> Column:
    """16 bits to 8 by shifting."""
    return F.shiftright(v, 8)


def fitted(w: Column, h: Column, most_w: int, most_h: int) -> tuple[Column, Column]:
    """Sides scaled into a box, truncated."""
    scale = F.least(F.lit(most_w) / w, F.lit(most_h) / h)
    return F.floor(w * scale), F.floor(h * scale)


def saliency_alpha(cluster: Column, power: float) -> Column:
    return F.pow(cluster / F.lit(3.0), F.lit(power))


def marker_colour(marker: Column, custom: dict[str, str], default: dict[str, str]) -> Column:
    """Custom colour, else the default one, else white."""
    look = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), marker) if m else F.lit(None)
    return F.coalesce(look(custom), look(default), F.lit("white"))


def transparent_ramp(spark: SparkSession, rgb: tuple[int, int, int], steps: int = 256) -> DataFrame:
    """step, r, g, b and alpha from 0 to 1."""
    return spark.range(steps).select(F.col("id").alias("step"), *(F.lit(v).cast("long").alias(c) for c, v in zip("rgb", rgb)), (F.col("id") / (steps - 1)).alias("a"))


def xml_safe(text: Column) -> Column:
    """Text without the control characters that XML 1.0 forbids."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def tag_name(code: Column, registries: list[dict[int, str]]) -> Column:
    """Name of a tag in the first registry that knows it, else the code as text."""
    found = [F.try_element_at(F.create_map(*[F.lit(x) for pair in r.items() for x in pair]), code) for r in registries if r]
    return F.coalesce(*found, code.cast("string"))


def padding_halves(own: Column, other: Column) -> tuple[Column, Column]:
    """(before, after) pads that make a side as long as another: the floor half first."""
    lack = F.greatest(other - own, F.lit(0))
    return F.floor(lack / 2), F.ceil(lack / 2)
