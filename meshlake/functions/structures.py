"""Brain structure names: parsing, formatting and wildcard matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words that name a hemisphere or a geometry
HEMISPHERES = ("left", "right", "both")


def parse_structure(name: Column) -> Column:
    """Struct (primary, hemisphere) of names like CIFTI_STRUCTURE_CORTEX_LEFT, CortexLeft or Thalamus_Right."""
    plain = F.regexp_replace(name, "^CIFTI_STRUCTURE_", "")
    snake = F.lower(F.regexp_replace(plain, "([a-z])([A-Z])", "$1_$2"))
    side = F.regexp_extract(snake, "_(left|right|both)$", 1)
    return F.struct(F.regexp_replace(snake, "_(left|right|both)$", "").alias("primary"), F.when(side == "", F.lit("both")).otherwise(side).alias("hemisphere"))


def cifti_name(primary: Column, hemisphere: Column) -> Column:
    """CIFTI_STRUCTURE_<PRIMARY>[_<HEMISPHERE>]."""
    side = F.when(hemisphere == "both", F.lit("")).otherwise(F.concat(F.lit("_"), F.upper(hemisphere)))
    return F.concat(F.lit("CIFTI_STRUCTURE_"), F.upper(primary), side)


def gifti_name(primary: Column, hemisphere: Column) -> Column:
    """Names like CortexLeft."""
    side = F.when(hemisphere == "both", F.lit("")).otherwise(F.initcap(hemisphere))
    return F.concat(F.regexp_replace(F.initcap(F.regexp_replace(primary, "_", " ")), " ", ""), side)


def matches(p1: Column, h1: Column, p2: Column, h2: Column, s1: Column | None = None, s2: Column | None = None) -> Column:
    """Whether two structures fit: ``all`` fits any primary, a null secondary any other; hemispheres must be equal."""
    primary = (p1 == p2) | (p1 == "all") | (p2 == "all")
    second = F.lit(True) if s1 is None else s1.isNull() | s2.isNull() | (s1 == s2)
    return primary & second & (h1 == h2)


def voxel_key(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    """i + nx (j + ny k)."""
    return i + nx * (j + ny * k)
