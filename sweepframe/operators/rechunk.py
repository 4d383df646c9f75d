"""Images of varying width, laid side by side and cut into frames of one width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, PORTRAIT = 2048, (6510, 4096)


def portrait_rotation(images: DataFrame) -> DataFrame:
    """Portrait images (6510 x 4096) turned clockwise: height and width change places."""
    tall = (F.col("height") == PORTRAIT[0]) & (F.col("width") == PORTRAIT[1])
    return images.withColumns({
        "rotated": tall, "height": F.when(tall, F.col("width")).otherwise(F.col("height")), "width": F.when(tall, F.col("height")).otherwise(F.col("width"))})


def rotate_pixels(pixels: DataFrame, height: int) -> DataFrame:
    """Pixels of an image of `height` rows turned clockwise: (x, y) to (height - 1 - y, x)."""
    return pixels.withColumns({"x": F.lit(height - 1) - F.col("y"), "y": F.col("x")})


def column_spans(images: DataFrame, slices: int = 64) -> DataFrame:
    """images with s and e, the columns [s, e) they take in their session.

    The prefix sum has two levels: images are dealt to `slices` stretches of image numbers per session, widths
    are summed within a stretch, and the stretches' own running sum is added. A huge session is
    spread over that many tasks; only `slices` rows per session meet in one."""
    top = images.groupBy("session").agg(F.min("image_no").alias("__lo"), F.max("image_no").alias("__hi"))
    at = images.join(top, "session").withColumn("__k", F.floor((F.col("image_no") - F.col("__lo")) * slices / (F.col("__hi") - F.col("__lo") + 1)).cast("int")).drop("__lo", "__hi")
    own = Window.partitionBy("session", "__k").orderBy("image_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.groupBy("session", "__k").agg(F.sum("width").cast("long").alias("__w"))
    before = Window.partitionBy("session").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("session", "__k", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__base"))
    out = at.withColumn("__run", F.sum("width").over(own).cast("long")).join(base, ["session", "__k"])
    e = F.col("__base") + F.col("__run")
    return out.withColumn("s", e - F.col("width")).withColumn("e", e).drop("__k", "__run", "__base")


def column_rechunk(images: DataFrame, width: int = WIDTH) -> DataFrame:
    """session, frame_no, image_no, src_from, src_to, dst_from of every part of every full frame.

    The session's columns beyond its last full frame wait for more images and give no row."""
    spans = column_spans(images.filter("width > 0"))
    total = spans.groupBy("session").agg((F.max("e") / width).cast("long").alias("__frames"))
    parts = spans.withColumn("frame_no", F.explode(F.sequence((F.col("s") / width).cast("long"), ((F.col("e") - 1) / width).cast("long"))))
    lo, hi = F.greatest("s", F.col("frame_no") * width), F.least("e", (F.col("frame_no") + 1) * width)
    return parts.join(total, "session").filter(F.col("frame_no") < F.col("__frames")).select(
        "session", "frame_no", "image_no", (lo - F.col("s")).alias("src_from"), (hi - F.col("s")).alias("src_to"), (lo - F.col("frame_no") * width).alias("dst_from"))


def frame_emit_at(images: DataFrame, width: int = WIDTH) -> DataFrame:
    """Which image completes which frame."""
    return column_rechunk(images, width).groupBy("session", "frame_no").agg(F.max("image_no").alias("emit_image"))
