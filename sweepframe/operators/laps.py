"""Lap times from zero crossings of the turntable angle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sliced import running

JUMP = 300.0


def lap_times(feedback: DataFrame, motions: DataFrame, jump: float = JUMP) -> DataFrame:
    """device_id, epoch, ts, lap_seconds: time between zero crossings while the lap timer runs.

    feedback(device_id, ts, seq, angle_deg) and motions(device_id, ts, event_id, cmd) are put in one order; a turn
    begins a new epoch, in which the first crossing only arms the timer, stop halts it; other commands
    do neither. A crossing is a change of more than `jump` degrees between successive samples, in either
    direction. Commands come before samples of the same time. A device's history is cut into slices of time."""
    motions = motions.filter(F.col("cmd").isin("turnLeft", "turnRight", "stop"))
    samples = feedback.select("device_id", "ts", F.col("seq").alias("n"), "angle_deg", F.lit(None).cast("string").alias("cmd"), F.lit(1).alias("kind"))
    commands = motions.select("device_id", "ts", F.col("event_id").alias("n"), F.lit(None).cast("double").alias("angle_deg"), "cmd", F.lit(0).alias("kind"))
    turn = F.coalesce(F.col("cmd").isin("turnLeft", "turnRight").cast("long"), F.lit(0))
    both = running(samples.unionByName(commands), ["device_id"], ["ts", "kind", "n"], {
        "epoch": ("sum", turn, False), "state": ("last", F.col("cmd"), False), "prev": ("last", F.col("angle_deg"), True)})
    crossing = both.filter((F.col("kind") == 1) & (F.abs(F.col("angle_deg") - F.col("prev")) > jump) & (F.col("state") != "stop"))
    # Crossings are a few rows a lap, so a device's epoch is small.
    last = F.lag("ts").over(Window.partitionBy("device_id", "epoch").orderBy("ts", "n"))
    laps = crossing.withColumn("last", last).filter("last is not null")
    return laps.select("device_id", "epoch", "ts", (F.timestamp_diff("MICROSECOND", F.col("last"), F.col("ts")) / F.lit(1e6)).alias("lap_seconds"))


def nominal_lap_join(laps: DataFrame, motions: DataFrame, profile: DataFrame, jump: float = JUMP) -> DataFrame:
    """Laps with the speed of the turn they belong to and that speed's nominal seconds; unknown speeds stay null.

    profile(speed, nominal_lap_s): the device's speed settings. Spark picks the join by the tables' sizes."""
    turns = motions.filter(F.col("cmd").isin("turnLeft", "turnRight"))
    epoch = F.row_number().over(Window.partitionBy("device_id").orderBy("ts", "event_id")).cast("long")
    of = turns.select("device_id", epoch.alias("epoch"), "speed")
    out = laps.join(of, ["device_id", "epoch"], "left").join(profile, "speed", "left")
    return out.select("device_id", "ts", "speed", "nominal_lap_s", "lap_seconds", (F.col("lap_seconds") - F.col("nominal_lap_s")).alias("diff_s"))
