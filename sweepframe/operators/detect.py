"""Target detection, lap numbers, the zero direction, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles
from ..shared import written
from .clearing import clear_epoch
from .folds import throttle  # noqa: F401
from .sliced import running

TOLERANCE = 2.0


def target_detect(frames: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, bucketed: bool = True) -> DataFrame:
    """Frames strictly within `tolerance` of a target(angle): frames' columns, target, distance.

    The circle is cut into at least three buckets no narrower than the tolerance, each target is dealt to its
    bucket and both neighbours and joined by bucket, so any number of targets is an equi-join and no pair
    comes twice. Without buckets (and for a tolerance beyond 120) it is a theta join, for a few targets only."""
    t = targets.select(F.col("angle").alias("target"))
    d = angles.circular_distance(F.col("angle_deg"), F.col("target").cast("double"))
    if not bucketed or tolerance > 120:
        return frames.join(t, d < tolerance).withColumn("distance", d)
    n = max(3, int(360 // tolerance))
    bucket = lambda c: (F.pmod(c, F.lit(360.0)) * n / 360).cast("int")
    t = t.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(bucket(F.col("target").cast("double")) + k, F.lit(n)))))
    near = frames.withColumn("__b", bucket(F.col("angle_deg"))).join(t, "__b").drop("__b")
    return near.filter(d < tolerance).withColumn("distance", d)


def lap_id(frames: DataFrame, keys: tuple[str, ...] = ("device_id", "channel"), high: float = 300.0, low: float = 60.0) -> DataFrame:
    """frames with lap_id: a lap ends with the frame at which the angle falls from above `high` to below `low`."""
    known = written(running(frames, list(keys), ["frame_no"], {"__prev": ("last", F.struct("angle_deg"), True)}), "angles")
    turn = ((F.col("__prev.angle_deg") > high) & (F.col("angle_deg") < low)).cast("long")
    laps = running(known, list(keys), ["frame_no"], {"lap_id": ("sum", F.coalesce(turn, F.lit(0)), True)})
    return laps.withColumn("lap_id", F.coalesce("lap_id", F.lit(0))).drop("__prev")


def detect_once_per_lap(frames: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, clears: DataFrame | None = None) -> DataFrame:
    """The first match of every (device, channel, lap, target).

    With clears the column epoch counts a device's clear events, and each lets its targets be found anew within the lap."""
    laps, keys = lap_id(frames), ["device_id", "channel", "lap_id", "target"]
    if clears is not None:
        laps, keys = clear_epoch(laps, clears), [*keys, "epoch"]
    found = target_detect(laps, targets, tolerance)
    return found.groupBy(*keys).agg(
        F.min("frame_no").alias("frame_no"), F.min_by("distance", "frame_no").alias("distance"), F.min_by("ts", "frame_no").alias("ts"))


def zero_angle(frames: DataFrame, feedback: DataFrame, keys: tuple[str, ...] = ("device_id",), clears: DataFrame | None = None) -> DataFrame:
    """The angle known at the device's first frame: first_ts, zero_deg (0.0 where no sample came before).

    The first time per key is aggregated first, so the join has one row per key on that side and the
    answer is a max_by with a partial step; no as-of window over all samples is needed. With clears(keys, ts) there is
    such a row per epoch, of its first frame; samples from before a clear stay known. Then the first times are put among
    the samples, cut into slices of time."""
    if clears is not None:
        first = clear_epoch(frames, clears, keys).groupBy(*keys, "epoch").agg(F.min("ts").alias("ts")).filter("ts is not null")
        known = feedback.select(*keys, "ts", F.col("seq").alias("__n"), F.struct("angle_deg").alias("__a"), F.lit(0).alias("__ask"))
        both = known.unionByName(first.withColumn("__ask", F.lit(1)), allowMissingColumns=True)
        got = running(both, list(keys), ["ts", "__ask", "__n"], {"__zero": ("last", F.col("__a"), False)})
        return got.filter("__ask = 1").select(*keys, "epoch", F.col("ts").alias("first_ts"), F.coalesce("__zero.angle_deg", F.lit(0.0)).alias("zero_deg"))
    first = frames.groupBy(*keys).agg(F.min("ts").alias("first_ts"))
    known = feedback.join(first, list(keys)).filter(F.col("ts") <= F.col("first_ts"))
    last = known.groupBy(*keys).agg(F.max_by("angle_deg", F.struct("ts", "seq")).alias("zero"))
    return first.join(last, list(keys), "left").select(*keys, "first_ts", F.coalesce("zero", F.lit(0.0)).alias("zero_deg"))


def detection_batch(frames: DataFrame, targets: DataFrame, frame_ms: int = 33, detect_ms: int = 120, tolerance: float = TOLERANCE, clears: DataFrame | None = None) -> DataFrame:
    """Detections in the live order: frames throttled, every detect_ms of those looked at, once per lap.

    frames need ms, the time in milliseconds; laps are counted over the throttled frames. With clears(device_id, ms), once per lap
    and epoch."""
    keys = ["device_id", "channel"]
    kept = written(throttle(frames, keys, "ms", frame_ms, ["ms", "frame_no"]), "kept")  # each step reads its rows several times
    seen = lap_id(kept)
    looked, once = throttle(seen, keys, "ms", detect_ms, ["ms", "frame_no"]), [*keys, "lap_id", "target"]
    if clears is not None:
        looked, once = clear_epoch(written(looked, "looked"), clears, time="ms"), [*once, "epoch"]
    found = target_detect(looked, targets, tolerance)
    return found.groupBy(*once).agg(F.min("frame_no").alias("frame_no"))
