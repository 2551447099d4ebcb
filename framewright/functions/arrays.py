"""Masks, padding, sampling and vector metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(a: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return F.forall(a, finite)


def mask_nonfinite(camera: Column, world: Column, confidence: Column, missing_is_flag: bool = False) -> Column:
    """H9: struct of camera, world and conf: bad coordinates 0, and conf 0 unless all six are finite.

    A missing confidence is 1, or the finite flag alone with
    ``missing_is_flag``; one that isn't finite is 0.
    """
    ok = all_finite(camera) & all_finite(world)
    zeroed = lambda a: F.transform(a, lambda x: F.when(finite(x), x).otherwise(0.0))
    known = F.when(confidence.isNull(), F.lit(1.0)).when(finite(confidence), confidence).otherwise(0.0)
    flag = ok.cast("double")
    conf = F.when(confidence.isNull(), flag).otherwise(known * flag) if missing_is_flag else known * flag
    return F.struct(zeroed(camera).alias("camera"), zeroed(world).alias("world"), conf.alias("conf"))


def pad_lossless(a: Column, n: int, fill: Column) -> Column:
    """Struct of values (``n`` of them), mask and length; null if there are more than ``n``, which the caller has to reject.

    ``a`` is worked out once for a row, and nothing of it is named for each element.
    """

    def padded(a: Column) -> Column:
        size = F.coalesce(F.size(a), F.lit(0))
        room = F.greatest(F.lit(n) - size, F.lit(0))
        values = F.concat(F.coalesce(a, F.slice(F.array(fill), 1, 0)), F.array_repeat(fill, room))
        mask = F.concat(F.array_repeat(F.lit(True), F.least(size, F.lit(n))), F.array_repeat(F.lit(False), room))
        return F.when(size <= n, F.struct(values.alias("values"), mask.alias("mask"), size.alias("length")))

    return F.transform(F.array(a), padded)[0]


def last_step(a: Column) -> Column:
    """The last element of a time axis, null if there is none."""
    return F.try_element_at(a, F.lit(-1))


def span_drop_mask(ids: Column, starts: list[int] = (), ends: list[int] = (), drops: list[int] = (), prefix: int = 0, suffix: int = 0, opened: bool = False, pad: int = -1) -> Column:
    """Which ids are dropped: the first and last few (pads count), named ids, and spans from a start to its end.

    Spans nest. Pads are passed over by the span rule. A start is dropped even
    if it is an end as well; an end outside a span stays. Spans need end ids,
    and start ids or to be open from the beginning.
    """
    n = F.size(ids)
    among = lambda x, values: x.isin(list(values)) if values else F.lit(False)
    plain = F.transform(ids, lambda x, i: (i < prefix) | (i >= n - suffix) | among(x, drops))
    if not ends or not (starts or opened):
        return plain

    def step(state: Column, x: Column) -> Column:
        depth, is_start, is_end = state["depth"], among(x, starts), among(x, ends)
        inside = is_start | (depth > 0)
        deeper = depth + is_start.cast("int")
        after = F.when(x == pad, depth).when(inside & is_end, F.greatest(deeper - 1, F.lit(0))).otherwise(deeper)
        return F.struct(after.alias("depth"), F.concat(state["mask"], F.array((x != pad) & inside)).alias("mask"))

    start = F.struct(F.lit(int(opened)).alias("depth"), F.slice(F.array(F.lit(False)), 1, 0).alias("mask"))
    return F.zip_with(plain, F.reduce(ids, start, step)["mask"], lambda a, b: a | b)


def apply_drop(features: Column, mask: Column, zero: bool = True) -> Column:
    """Features with dropped ones zeroed; a short mask counts as false for the rest, a long one is cut."""
    n = F.size(features)
    fitted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(mask, i), F.lit(False)))
    return F.when(n == 0, features).otherwise(F.zip_with(features, fitted, lambda x, m: F.when(m & F.lit(zero), F.transform(x, lambda _: F.lit(0.0).cast("float"))).otherwise(x)))


def midpoint_samples(frames: Column, n: int = 32) -> Column:
    """Struct of past and target, ``n`` frame numbers each, even over either half of the frames; null under two frames."""
    m = F.floor(frames / 2)
    past = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (m - 1) / (n - 1)).cast("long"))
    target = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (m + F.floor(k * (frames - 1 - m) / (n - 1))).cast("long"))
    return F.when(frames >= 2, F.struct(past.alias("past"), target.alias("target")))


def uniform_positions(length: Column, n: int) -> Column:
    """``n`` even positions of a sequence; all of them if it has ``n``, none if it is empty."""
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (length - 1) / max(1, n - 1)).cast("long"))
    return F.when(length > 0, even).otherwise(F.slice(F.array(F.lit(0).cast("long")), 1, 0))


def target_positions(n: int, total: Column, first: Column | None = None, last: Column | None = None, rounded: bool = False) -> Column:
    """``n`` fractional frame ids, float32: over the total, else from first to last known id, else 0 to n - 1. Rounding is half to even."""
    low = F.when(total > 1, F.lit(0.0)).otherwise(F.coalesce(first, F.lit(0.0)) if first is not None else F.lit(0.0))
    span = F.when(total > 1, (total - 1).cast("double")).otherwise(F.coalesce(last - first, F.lit(float(n - 1))) if first is not None else F.lit(float(n - 1)))
    out = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (low + k * span / max(1, n - 1)).cast("float"))
    return F.transform(out, lambda x: F.rint(x.cast("double")).cast("long")) if rounded else out


def align_tubelets(step: Column, size: int) -> Column:
    """The frames of a latent step of ``size`` frames; explode it."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: step * size + j)


def flatten_index(t: Column, p: Column, patches: int) -> Column:
    """Frame-major place of a patch."""
    return t * patches + p


def gather(values: Column, index: Column) -> Column:
    """The elements at places, null where there is none."""
    return F.transform(index, lambda i: F.get(values, i))


def map_level(i: Column, n: Column, m: Column) -> Column:
    """Level i of n among m levels, half to even; 0 when either has at most one."""
    return F.when((n <= 1) | (m <= 1), F.lit(0)).otherwise(F.bround(i * (m - 1) / F.when(n > 1, n - 1)).cast("int"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def vector_mse(a: Column, b: Column) -> Column:
    """Mean squared difference."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))) / F.size(a)


def vector_l2(a: Column, b: Column) -> Column:
    """Length of the difference."""
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def vector_smooth_l1(a: Column, b: Column) -> Column:
    """Mean of half the square below 1, the distance less a half above."""
    d = F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))
    return _sum(F.transform(d, lambda x: F.when(x < 1, 0.5 * x * x).otherwise(x - 0.5))) / F.size(a)


def vector_cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity, lengths at least ``eps``."""
    norm = lambda v: F.greatest(F.sqrt(_sum(F.transform(_double(v), lambda x: x * x))), F.lit(eps))
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)) / (norm(a) * norm(b))


def pair_features(a: Column, b: Column) -> Column:
    """A, b, their absolute difference and their product in one vector; a missing side is zeros."""
    zeros = lambda v: F.transform(v, lambda _: F.lit(0.0).cast("float"))
    x, y = F.coalesce(a, zeros(b)), F.coalesce(b, zeros(a))
    return F.concat(x, y, F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.zip_with(x, y, lambda p, q: p * q))
