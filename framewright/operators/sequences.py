"""Sequences of frames: sampling, alignment, windows and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import arrays, geometry
from framewright.operators import scans


def number_frames(df: DataFrame, episode: str, order: list[str], out: str = "t") -> DataFrame:
    """Each row's frame number from 0 in its episode, however long; ``order`` has to be total."""
    return scans.numbered(df, episode, order, out)


def episode_lengths(frames: DataFrame, episode: str = "episode_id", readable: Column | None = None) -> DataFrame:
    """Frames of each episode; with ``readable`` an episode that has a frame which isn't says so and counts none."""
    bad = F.lit(False) if readable is None else F.max(~F.coalesce(readable, F.lit(False)))
    return frames.groupBy(episode).agg(F.count("*").alias("n"), bad.alias("__bad")).select(episode, F.when(F.col("__bad"), F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_frames"), F.when(F.col("__bad"), "unreadable frame").alias("reason"))


def midpoint_windows(lengths: DataFrame, n: int = 32, episode: str = "episode_id") -> DataFrame:
    """Episode, half, pos, frame_idx: ``n`` even samples of each half of an episode; those under two frames have none."""
    rows = lengths.filter("n_frames >= 2").withColumn("s", arrays.midpoint_samples(F.col("n_frames"), n))
    halves = F.explode(F.array(F.struct(F.lit("past").alias("half"), F.col("s.past").alias("idx")), F.struct(F.lit("target").alias("half"), F.col("s.target").alias("idx"))))
    return rows.select(episode, halves.alias("h")).select(episode, "h.half", F.posexplode("h.idx").alias("pos", "frame_idx"))


def take_samples(samples: DataFrame, frames: DataFrame, episode: str = "episode_id", clip: bool = False) -> DataFrame:
    """The frame rows of sampled positions; every position keeps its row, repeated or not. ``clip``: places beyond the end take the last frame."""
    if clip:
        last = frames.groupBy(episode).agg(F.max("t").alias("__last"))
        samples = samples.join(last, episode).withColumn("frame_idx", F.greatest(F.lit(0), F.least("frame_idx", "__last"))).drop("__last")
    return samples.join(frames.withColumnRenamed("t", "frame_idx"), [episode, "frame_idx"])


def hold_last_observed(observed: DataFrame, horizon: DataFrame, episode: str | list[str], order: list[str], values: list[str]) -> DataFrame:
    """C11: ``horizon`` rows with the values of the episode's last observed row, and of nothing later."""
    last = observed.groupBy(episode).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"))
    return horizon.join(last, episode).select(*horizon.columns, *(F.col(f"__last.{v}").alias(f"held_{v}") for v in values))


def hand_reference_forecast(points: DataFrame, observed: DataFrame, references: DataFrame, mode: str, pose: str | None = None, episode: str = "episode_id") -> DataFrame:
    """What is held of each joint's offset, put back on its hand's reference: episode, t, joint, xyz.

    ``observed(episode, t, joint, side, xyz)`` are offsets, of which the last of
    each joint is held for all frames of ``points(episode, t, joint)``;
    ``references(episode, right, left)`` are the hands' reference points, added
    by ``mode`` (H16). With ``pose``, a column of ``references``, the result is in
    the outer frame (H3).
    """
    held = hold_last_observed(observed, points, [episode, "joint"], ["t"], ["side", "xyz"])
    both = held.join(references, episode)
    xyz = geometry.add_reference(F.col("held_xyz"), F.col("held_side"), F.col("right"), F.col("left"), mode)
    return both.select(episode, "t", "joint", (geometry.let(xyz, lambda p: geometry.apply_pose(F.col(pose), p)) if pose else xyz).alias("xyz"))


def persistence_forecast(frames: DataFrame, n: int = 32, episode: str = "episode_id", values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """For each sampled future position the true values and those held from the last observed sample."""
    samples = midpoint_windows(episode_lengths(frames, episode), n, episode)
    placed = take_samples(samples, frames, episode).select(episode, "half", "pos", *values)
    observed, future = placed.filter("half = 'past'"), placed.filter("half = 'target'").drop("half")
    return hold_last_observed(observed, future, episode, ["pos"], list(values))


def nearest_match(targets: DataFrame, sources: DataFrame, by: str, key: str, values: list[str], tie: str) -> DataFrame:
    """``targets`` with key and values of the nearest source row of the same ``by``; of equally near ones the later.

    Keys count as float32. Before the first and after the last source row the
    end is taken. Source rows of equal key are ordered by ``tie``: the first
    serves keys from below and the exact hit, the last those from above. Both
    sides are reduced to distinct keys before any row is ordered, so rows of
    one key meet in partial aggregates only, and an episode of any length is
    scanned in ranges. Targets of a ``by`` without sources have no row.
    """
    number = lambda c: F.col(c).cast("float").cast("double")
    packed = F.struct(number(key).alias("k"), *(F.col(v) for v in values))
    s = sources.select(F.col(by).alias("__by"), number(key).alias("__k"), packed.alias("__source"), F.struct(F.col(tie), packed).alias("__tie"))
    ends = s.groupBy("__by", "__k").agg(F.min_by("__source", "__tie").alias("__low"), F.max_by("__source", "__tie").alias("__high"), F.lit(False).alias("__wanted"))
    asked = targets.select(F.col(by).alias("__by"), number(key).alias("__k")).distinct().withColumns({"__low": F.lit(None).cast(ends.schema["__low"].dataType), "__high": F.lit(None).cast(ends.schema["__high"].dataType), "__wanted": F.lit(True)})
    points = ends.unionByName(asked).groupBy("__by", "__k").agg(F.first("__low", ignorenulls=True).alias("__low"), F.first("__high", ignorenulls=True).alias("__high"), F.bool_or("__wanted").alias("__wanted"))
    found = scans.neighbours(points, "__by", "__k", "__low", "__high").filter("__wanted")
    right, left = F.coalesce("__low", "right", "left"), F.coalesce("left", "right")
    best = F.when(F.abs(right["k"] - F.col("__k")) <= F.abs(left["k"] - F.col("__k")), right).otherwise(left)
    found = found.select("__by", F.col("__k").alias("__of"), best.alias("__best")).filter("__best is not null")
    rows = targets.withColumn("__k", number(key)).join(found, scans.same(F.col(by), F.col("__by")) & scans.same(F.col("__k"), F.col("__of")))
    return rows.select(*(F.col(f"`{c}`") for c in targets.columns), F.col("__best.k").alias("match_key"), *(F.col(f"__best.{v}").alias(f"match_{v}") for v in values))


def to_camera_frame(poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """poses(episode_id, frame_idx, joint, m) in the frame of cameras(episode_id, frame_idx, ext); null where a camera is singular."""
    inverted = geometry.with_inverse(cameras.select("episode_id", "frame_idx", "ext"), "ext", "ext")
    # In a function of its own the product's 64 terms stay out of the join's generated method, which they made too large to be compiled.
    moved = geometry.let(F.struct("ext", "m"), lambda p: F.when(p["ext"].isNotNull(), geometry.compose(p["ext"], p["m"])))
    return poses.join(inverted, ["episode_id", "frame_idx"]).withColumn("m", moved).drop("ext")


def uniform_resample(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """``n`` even rows of each sequence with their new place pos; one of ``n`` rows passes as it is."""
    wanted = df.groupBy(by).agg(F.count("*").alias("__n")).select(by, F.posexplode(arrays.uniform_positions(F.col("__n"), n)).alias("pos", "__t"))
    return wanted.join(number_frames(df, by, order, "__t"), [by, "__t"]).drop("__t")


def temporal_stride(df: DataFrame, step: int, t: str = "t") -> DataFrame:
    """Every ``step``-th frame, numbered anew. Comes before context_future."""
    return df.filter(F.col(t) % step == 0).withColumn(t, F.floor(F.col(t) / step).cast("long"))


def context_future(df: DataFrame, past: int, future: int | None = None, t: str = "t") -> DataFrame:
    """Frames [0, past) are past, [past, past + future) future (all the rest without a number); others go."""
    end = F.lit(True) if future is None else F.col(t) < past + future
    return df.withColumn("part", F.when(F.col(t) < past, "past").when(end, "future")).filter("part is not null")


def sampling_rate(df: DataFrame, by: str, seconds: Column, stated: Column | None = None) -> DataFrame:
    """Distinct times less one over their span; else the stated rate, else 1."""
    other = F.max(stated) if stated is not None else F.lit(None).cast("double")
    agg = df.groupBy(by).agg(F.count_distinct(seconds).alias("n"), F.min(seconds).alias("low"), F.max(seconds).alias("high"), other.alias("stated"))
    rate = F.when((F.col("n") > 1) & (F.col("high") > F.col("low")), F.try_divide(F.col("n") - 1, F.col("high") - F.col("low")))
    return agg.select(by, F.coalesce(rate, F.when(F.col("stated") > 0, F.col("stated")), F.lit(1.0)).alias("rate"))


def frame_times(df: DataFrame, by: str, order: list[str], start: Column, end: Column, fps: float) -> DataFrame:
    """``df`` with centre, boundary (the time between the halves, for provenance) and reason (not finite, or decreasing).

    Where an episode spans no time, times are frame numbers over ``fps``.
    """
    rate = max(fps, 1.0)
    rows = number_frames(df, by, order, "__t").withColumns({"__c": (start + end) / 2, "__s": start, "__e": end})
    # A frame meets the one before it by its number, and its episode in sums, so no task needs a whole episode.
    last = rows.select(F.col(by).alias("__by"), (F.col("__t") + 1).alias("__after"), F.col("__c").alias("__last"))
    rows = rows.join(last, scans.same(F.col(by), F.col("__by")) & (F.col("__t") == F.col("__after")), "left").drop("__by", "__after")
    bad = F.coalesce(~arrays.finite(F.col("__c")) | (F.col("__c") < F.col("__last")), F.lit(False))
    facts = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.min_by("__s", "__t").alias("__from"), F.max_by("__e", "__t").alias("__to"), F.max(bad).alias("__bad"))
    flat = ~arrays.finite(F.col("__from")) | ~arrays.finite(F.col("__to")) | (F.col("__to") <= F.col("__from"))
    facts = facts.withColumn("__flat", F.coalesce(flat, F.lit(True)))
    rows = rows.join(facts, scans.same(F.col(by), F.col("__by"))).drop("__by")
    rows = rows.withColumn("centre", F.when(F.col("__flat"), F.col("__t") / rate).otherwise(F.col("__c")))
    half = F.floor(F.col("__n") / 2)
    middle = rows.filter((F.col("__t") == half - 1) | (F.col("__t") == half)).groupBy(F.col(by).alias("__by")).agg(F.avg("centre").alias("boundary"))
    rows = rows.join(middle, scans.same(F.col(by), F.col("__by")), "left").withColumn("reason", F.when(F.col("__bad"), "times are not finite and rising"))
    return rows.select(*df.columns, "centre", "boundary", "reason")


def select_best(epochs: DataFrame, epoch: str, score: str, policy: str = "best", by: str | None = None) -> DataFrame:
    """``epochs`` with improved (strictly under every score before it) and chosen (the last improved, or with ``last`` the last), for each run ``by``.

    NaN and null never improve; ties keep the earlier epoch. ``validation`` is
    the same as ``best``. Without ``by`` all rows are one run. Runs of any
    number and length: the least score so far is scanned in ranges.
    """
    if policy not in ("best", "validation", "last"):
        raise ValueError(f"unknown policy {policy!r}")
    run = by or "__run"
    rows = epochs if by else epochs.withColumn(run, F.lit(0))
    value = F.when(~F.isnan(F.col(score)), F.col(score))
    rows = scans.least_before(rows, run, epoch, value, "__before")
    rows = rows.withColumn("improved", F.coalesce(value < F.coalesce("__before", F.lit(float("inf"))), F.lit(False)))
    last = rows.groupBy(F.col(run).alias("__of")).agg(F.max(F.col(epoch) if policy == "last" else F.when(F.col("improved"), F.col(epoch))).alias("__chosen"))
    rows = rows.join(last, scans.same(F.col(run), F.col("__of")))
    return rows.select(*epochs.columns, "improved", F.coalesce(F.col(epoch) == F.col("__chosen"), F.lit(False)).alias("chosen"))


def audit_epoch_log(epochs: DataFrame, by: str, epoch: str, order: str, expected: Column | None = None) -> DataFrame:
    """For each log whether its epochs are positive and strictly rising, its last (0 if it has none), and whether that is the expected one.

    ``order`` is a distinct number in each log. A row meets the one before it
    by its place, so a log of any length is spread over tasks.
    """
    e = F.col(epoch).try_cast("long")
    rows = number_frames(epochs.select(by, order, e.alias("__e"), (expected if expected is not None else F.lit(None).cast("long")).alias("__x")), by, [order], "__t")
    before = rows.select(F.col(by).alias("__by"), (F.col("__t") + 1).alias("__after"), F.col("__e").alias("__last"))
    rows = rows.join(before, scans.same(F.col(by), F.col("__by")) & (F.col("__t") == F.col("__after")), "left").drop("__by", "__after")
    rows = rows.withColumn("__ok", F.coalesce(F.col("__e") > F.coalesce("__last", F.lit(0)), F.lit(False)))
    out = rows.groupBy(by).agg(F.bool_and("__ok").alias("rising"), F.coalesce(F.max("__e"), F.lit(0)).alias("last_epoch"), F.max("__x").alias("__x"))
    return out.withColumn("ends_as_expected", F.col("__x").isNull() | (F.col("__x") == F.col("last_epoch"))).drop("__x")


def visible_segments(points: DataFrame, chain: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """H8: chain(a, b) segments between points(by, joint, u, v) with an end in the frame."""
    end = lambda s: points.select(*by, F.col("joint").alias(s), F.col("u").alias(f"u_{s}"), F.col("v").alias(f"v_{s}"))
    both = end("a").join(chain, "a").join(end("b"), [*by, "b"])
    seen = lambda s: geometry.in_frame(F.col(f"u_{s}"), F.col(f"v_{s}"), width, height)
    return both.filter(seen("a") | seen("b"))


def camera_per_frame(cameras: DataFrame, lengths: DataFrame, by: str, n: int, static: DataFrame | None = None, value: str = "ext", invert: bool = True, place: str = "place") -> DataFrame:
    """By, pos and ``value``, a camera matrix for each of ``n`` frames of an episode.

    ``cameras(by, place, frame_id, value)`` are the dynamic ones: with ``n`` rows
    they are taken as they are; another number is matched by the nearest frame
    id, if all rows have one, or else thinned out evenly by place. Frames are
    even over ``lengths(by, n_frames)``; without a length over two frames or
    more, from the first to the last known id; else 0 to n - 1. An episode
    without dynamic rows has the one of ``static(by, value)`` in every frame.
    Extrinsics are 12 or 16 values and are inverted; for intrinsics, say
    ``invert=False``: any number of values, as they are.
    """
    rows = cameras.select(by, place, F.col("frame_id").cast("double").alias("frame_id"), value)
    facts = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), (F.count("frame_id") == F.count("*")).alias("__ids"), F.min_by("frame_id", place).alias("__low"), F.max_by("frame_id", place).alias("__high"))
    facts = facts.join(lengths.select(F.col(by).alias("__of"), "n_frames"), F.col("__by") == F.col("__of"), "left").drop("__of")
    branch = lambda which: rows.join(facts.filter(which), F.col(by) == F.col("__by")).drop("__by")
    same, ids = F.col("__n") == n, F.col("__ids")
    taken = number_frames(branch(same), by, [place], "pos").select(by, F.col("pos").cast("int").alias("pos"), value)
    known = F.col("__n") >= 2
    places = arrays.target_positions(n, F.coalesce("n_frames", F.lit(0)), F.when(known, F.col("__low")), F.when(known, F.col("__high")))
    wanted = facts.filter(~same & ids).select(F.col("__by").alias(by), F.posexplode(places).alias("pos", "frame_id"))
    near = nearest_match(wanted, branch(~same & ids), by, "frame_id", [value], place).select(by, "pos", F.col(f"match_{value}").alias(value))
    even = uniform_resample(branch(~same & ~ids).select(by, place, value), by, [place], n).select(by, "pos", value)
    out = taken.unionByName(near).unionByName(even)
    if static is not None:
        alone = static.join(facts.select(F.col("__by").alias(by)), by, "left_anti").select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"), value)
        out = out.unionByName(alone)
    return geometry.with_inverse(out.withColumn(value, geometry.as_4x4(F.col(value))), value, value).select(by, "pos", value) if invert else out
