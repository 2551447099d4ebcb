"""Poses, cameras and projections as column expressions.

Matrices are flat row-major arrays of doubles: 16 for a pose, 9 for a camera.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def as_4x4(m: Column) -> Column:
    """H1: 16 values as they are, 12 with the last row added, else null."""
    return F.when(F.size(m) == 16, m).when(F.size(m) == 12, F.concat(m, F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1)))))


def determinant(m: Column, stride: int = 4) -> Column:
    """Of the upper left 3 x 3."""
    a, b, c, d, e, f, g, h, i = (_at(m, stride * r + k) for r in range(3) for k in range(3))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def affine_inverse(m: Column) -> Column:
    """H2: the inverse of a pose with last row 0, 0, 0, 1; null if it is singular. Not the transpose."""
    a, b, c, d, e, f, g, h, i = (_at(m, 4 * r + k) for r in range(3) for k in range(3))
    adjugate = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    t = [_at(m, 4 * r + 3) for r in range(3)]
    # The determinant and each cofactor are worked out once.
    linear = let(determinant(m), lambda det: F.when(det != 0, F.transform(F.array(*(x for row in adjugate for x in row)), lambda x: x / det)))

    def whole(inverse: Column) -> Column:
        rows = [[_at(inverse, 3 * r + k) for k in range(3)] for r in range(3)]
        return F.array(*(x for row in rows for x in (*row, -(row[0] * t[0] + row[1] * t[1] + row[2] * t[2]))), *(F.lit(float(v)) for v in (0, 0, 0, 1)))

    return let(linear, lambda inverse: F.when(inverse.isNotNull(), whole(inverse)))


def with_inverse(df: DataFrame, m: str, out: str) -> DataFrame:
    """H2: ``df`` with ``out``, the inverse of the pose in column ``m``, as affine_inverse gives it.

    Each step is plain columns over those of the step before, so that all of it
    becomes generated code.
    """
    at = lambda i: F.col(f"__m{i}")
    a, b, c, d, e, f, g, h, i = (at(4 * r + k) for r in range(3) for k in range(3))
    adjugate = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    rows = df.withColumns({f"__m{k}": _at(F.col(m), k) for k in range(12)})
    rows = rows.withColumn("__det", a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))
    rows = rows.withColumns({f"__i{k}": F.when(F.col("__det") != 0, x / F.col("__det")) for k, x in enumerate(adjugate)})
    linear = [[F.col(f"__i{3 * r + k}") for k in range(3)] for r in range(3)]
    last = [F.lit(float(v)) for v in (0, 0, 0, 1)]
    whole = F.array(*(x for row in linear for x in (*row, -(row[0] * at(3) + row[1] * at(7) + row[2] * at(11)))), *last)
    return rows.withColumn(out, F.when(F.col("__det") != 0, whole)).drop("__det", *(f"__m{k}" for k in range(12)), *(f"__i{k}" for k in range(9)))


def apply_pose(m: Column, xyz: Column) -> Column:
    """H3: a point of the pose's frame in the outer frame."""
    return F.array(*(_at(m, 4 * r) * _at(xyz, 0) + _at(m, 4 * r + 1) * _at(xyz, 1) + _at(m, 4 * r + 2) * _at(xyz, 2) + _at(m, 4 * r + 3) for r in range(3)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def compose(a: Column, b: Column) -> Column:
    """The product of two poses."""
    return F.array(*(sum((_at(a, 4 * r + k) * _at(b, 4 * k + c) for k in range(1, 4)), _at(a, 4 * r) * _at(b, c)) for r in range(4) for c in range(4)))


def pose_from_point(xyz: Column) -> Column:
    """H4: no rotation, the point as translation."""
    one = lambda v: F.lit(float(v))
    return F.array(*(x for r in range(3) for x in (*(one(r == c) for c in range(3)), _at(xyz, r))), one(0), one(0), one(0), one(1))


def rotation(m: Column) -> Column:
    """H5: the upper left 3 x 3."""
    return F.array(*(_at(m, 4 * r + c) for r in range(3) for c in range(3)))


def translation(m: Column) -> Column:
    """H5: the last column's first three."""
    return F.array(*(_at(m, 4 * r + 3) for r in range(3)))


def project_pinhole(xyz: Column, k: Column) -> Column:
    """H6: pixel coordinates (u, v); NaN where depth is under 1e-6 either way. Points behind the camera are kept."""
    x, y, z = (_at(xyz, i) for i in range(3))
    near = F.abs(z) < 1e-6
    depth = F.when(~near, z)
    pixel = lambda f, p, c: F.when(near, F.lit(float("nan"))).otherwise(f * p / depth + c)
    return F.array(pixel(_at(k, 0), x, _at(k, 2)), pixel(_at(k, 4), y, _at(k, 5)))


def rescale_intrinsics(k: Column, width: float, height: float) -> Column:
    """H7: a camera for another image size; its own is taken as twice the centre, at least 1."""
    sx = F.lit(float(width)) / F.greatest(F.lit(1.0), F.rint(2 * _at(k, 2)))
    sy = F.lit(float(height)) / F.greatest(F.lit(1.0), F.rint(2 * _at(k, 5)))
    scale = {0: sx, 2: sx, 4: sy, 5: sy}
    return F.array(*(_at(k, i) * scale[i] if i in scale else _at(k, i) for i in range(9)))


def in_frame(u: Column, v: Column, width: float, height: float) -> Column:
    """H8: half-open bounds; NaN is outside."""
    return ~F.isnan(u) & ~F.isnan(v) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def add_reference(xyz: Column, side: Column, right: Column, left: Column, mode: str) -> Column:
    """A point with the hands' reference points added: none, right, left, both (their sum), avg, or perhand (each side its own)."""
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    both = add(right, left)
    choices = {"none": None, "right": right, "left": left, "both": both, "avg": F.transform(both, lambda x: x / 2), "perhand": F.when(side == "right", right).when(side == "left", left)}
    if mode not in choices:
        raise ValueError(f"unknown mode {mode!r}")
    return xyz if choices[mode] is None else add(xyz, choices[mode])
