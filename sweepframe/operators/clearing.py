"""Clear events: control rows after which coverage, mosaics, detections, the zero direction and logs start afresh.

clears(device_id, ts): a clear comes before rows of its time. Clears without a time are ignored; a row without a
time came before all of them. A null device is a device. Lap numbers, lap timers and throttles go on over a clear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sliced import running

CHANNELS = ("RGB", "BW")


def clear_epoch(rows: DataFrame, clears: DataFrame, key: str | tuple[str, ...] = "device_id", time: str = "ts") -> DataFrame:
    """rows(time, ..) with epoch: how many clear events of the key came before or at the same time.

    A device's history is cut into slices of time (running), so one device is many tasks."""
    keys = [key] if isinstance(key, str) else list(key)
    marks = clears.filter(F.col(time).isNotNull()).select(*keys, time, F.lit(0).alias("__row"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    counted = running(both, keys, [time, "__row"], {"epoch": ("sum", (1 - F.col("__row")).cast("long"), False)})
    return counted.filter("__row = 1").drop("__row")


def since_clear(rows: DataFrame, clears: DataFrame, key: str = "device_id", time: str = "ts") -> DataFrame:
    """The rows not before the last clear event of their key; all rows of a key that was never cleared.

    Clears are aggregated to one row per key before the join, so no window over the rows is needed."""
    last = clears.filter(F.col(time).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(time).alias("__clear"))
    joined = rows.join(last, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.filter(F.col("__clear").isNull() | (F.col(time) >= F.col("__clear"))).select(*rows.columns)


def with_clears(frames: DataFrame, clears: DataFrame, time: str = "ts", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """frames with the column clear, and a control row per clear event and channel among them: the input of the
    streams that take clears. Control rows are null but for device_id, channel and time."""
    marks = clears.filter(F.col(time).isNotNull()).select("device_id", time, F.explode(F.array(*map(F.lit, channels))).alias("channel"), F.lit(True).alias("clear"))
    return frames.withColumn("clear", F.lit(False)).unionByName(marks, allowMissingColumns=True)
