"""Axis-aligned and oriented box arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Fixed order of the six moves: ties go to the first.
DIRECTIONS = ("+x", "-x", "+y", "-y", "+z", "-z")


def corner(box: str, end: str, axis: str) -> Column:
    return F.col(f"{box}_{end}_{axis}")


def span(box: str, axis: str) -> Column:
    return corner(box, "max", axis) - corner(box, "min", axis)


def center(box: str, axis: str) -> Column:
    return (corner(box, "max", axis) + corner(box, "min", axis)) / 2


def volume(box: str) -> Column:
    return reduce(mul, (span(box, x) for x in AXES))


def overlaps(a: str, b: str) -> Column:
    """Closed boxes meet on every axis."""
    return reduce(lambda p, q: p & q, ((corner(a, "min", x) <= corner(b, "max", x)) & (corner(b, "min", x) <= corner(a, "max", x)) for x in AXES))


def intersection_volume(a: str, b: str) -> Column:
    return reduce(mul, (F.greatest(F.lit(0.0), F.least(corner(a, "max", x), corner(b, "max", x)) - F.greatest(corner(a, "min", x), corner(b, "min", x))) for x in AXES))


def axis_gap(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.lit(0.0), corner(a, "min", axis) - corner(b, "max", axis), corner(b, "min", axis) - corner(a, "max", axis))


def distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(add, (axis_gap(a, b, x) * axis_gap(a, b, x) for x in AXES)))


def moves(a: str, b: str, margin: float = 0.0) -> Column:
    """The six axis moves of b that part it from a: array of (magnitude, rank, direction), in DIRECTIONS' order."""
    out = []
    for k, axis in enumerate(AXES):
        up = F.greatest(F.lit(0.0), corner(a, "max", axis) - corner(b, "min", axis) + margin)
        down = F.abs(F.least(F.lit(0.0), corner(a, "min", axis) - corner(b, "max", axis) - margin))
        out += [F.struct(m.alias("magnitude"), F.lit(2 * k + s).alias("rank"), F.lit(DIRECTIONS[2 * k + s]).alias("direction")) for s, m in enumerate((up, down))]
    return F.array(*out)


def best_move(six: Column) -> Column:
    return F.array_min(six)


def move_margin(six: Column) -> Column:
    """How much longer the second-best move is than the best."""
    ranked = F.array_sort(six)
    return ranked[1]["magnitude"] - ranked[0]["magnitude"]


def away_direction(a: str, b: str) -> Column:
    """The direction from a to b if exactly one axis separates them, else null."""
    apart = F.array(*[F.when(corner(b, "min", x) > corner(a, "max", x), f"+{x}").when(corner(a, "min", x) > corner(b, "max", x), f"-{x}") for x in AXES])
    named = F.filter(apart, lambda d: d.isNotNull())
    return F.when(F.size(named) == 1, named[0])


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Matrix of turns about x, then y, then z, in degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(F.radians(r)), F.cos(F.radians(r))) for r in (rx, ry, rz))
    return [[cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz], [cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz], [-sy, sx * cy, cx * cy]]


def transformed(half: list[Column], turn: list[list[Column]], shift: list[Column]) -> dict[str, Column]:
    """Bounds of a box of half extents around the origin, turned and shifted: from its eight corners."""
    out = {}
    for i, axis in enumerate(AXES):
        corners = [reduce(add, (turn[i][j] * half[j] * s for j, s in enumerate(signs))) + shift[i] for signs in product((-1.0, 1.0), repeat=3)]
        out |= {f"min_{axis}": F.least(*corners), f"max_{axis}": F.greatest(*corners)}
    return out


def oriented_overlap(ca: list[Column], ha: list[Column], ra: list[list[Column]], cb: list[Column], hb: list[Column], rb: list[list[Column]], tolerance: float = 1e-9) -> Column:
    """Separating-axis test of two oriented boxes over 15 axes; touching boxes overlap."""
    def column(r, j):
        return [r[i][j] for i in range(3)]

    def dot(u, v):
        return reduce(add, (x * y for x, y in zip(u, v, strict=True)))

    def cross(u, v):
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    ua, ub = [column(ra, j) for j in range(3)], [column(rb, j) for j in range(3)]
    apart = [y - x for x, y in zip(ca, cb, strict=True)]
    parted = F.lit(False)
    for axis in [*ua, *ub, *(cross(p, q) for p in ua for q in ub)]:
        reach = reduce(add, (F.abs(dot(u, axis)) * h for u, h in [*zip(ua, ha, strict=True), *zip(ub, hb, strict=True)]))
        parted = parted | ((dot(axis, axis) > tolerance) & (F.abs(dot(apart, axis)) > reach + tolerance))
    return ~parted
