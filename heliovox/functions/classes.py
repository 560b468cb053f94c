"""Classes of surfaces, and weights of relative poses, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Names of the facade classes, by their number from 0.
NAMES = """
unclassified, wall, window, door, balcony, molding, deco, column, arch, drainpipe, stairs, ground surface, terrain, roof, blinds, outer ceiling surface,
interior, other, unknown
""".replace("\n", " ").strip().split(", ")
FENESTRATION = ("window", "door", "blinds")


def name(number: Column) -> Column:
    """The name of a class; of numbers that are none, `other`."""
    names = F.array(*[F.lit(n.strip()) for n in NAMES])
    return F.when(number.between(0, len(NAMES) - 1), F.get(names, number.cast("int"))).otherwise(F.lit("other"))


def role(number: Column) -> Column:
    return F.when(name(number).isin(*FENESTRATION), "fenestration").otherwise("envelope")


def information(weights: Sequence[Column | float]) -> Column:
    """The upper triangle, row by row, of a diagonal matrix of six weights (shifts, then turns): 21 numbers."""
    cells = [F.lit(weights[i]) if i == j and not isinstance(weights[i], Column) else weights[i] if i == j else F.lit(0.0) for i in range(6) for j in range(i, 6)]
    return F.array(*[c.cast("double") for c in cells])
