"""Pixel tables and image rows: grey values, previews, resizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BT.601 luma weights.
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def gray_luma(blue: Column, green: Column, red: Column) -> Column:
    return F.round(red * RED + green * GREEN + blue * BLUE).cast("int")


def image_pixels(images: DataFrame) -> DataFrame:
    """origin, x, y, gray of decoded rows of Spark's image source (bytes in rows, channels B, G, R)."""
    n, w = F.col("image.nChannels"), F.col("image.width")
    area = w * F.col("image.height")
    each = images.filter((F.col("image.height") > 0) & (w > 0)).select("image", F.explode(F.sequence(F.lit(0), area - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("image.data", F.col("i") * n + k + 1, 1)), 16, 10).cast("int")
    gray = F.when(n == 1, byte(0)).otherwise(gray_luma(byte(0), byte(1), byte(2)))
    return each.select(F.col("image.origin").alias("origin"), (F.col("i") % w).alias("x"), F.floor(F.col("i") / w).cast("int").alias("y"), gray.alias("gray"))


def preview_downsample(pixels: DataFrame, src_w: int, src_h: int, dst_w: int, dst_h: int, mode: str = "nearest", key: str = "tile_id") -> DataFrame:
    """Pixels of a smaller raster. nearest keeps pixel floor((i + 0.5) * src / dst); area is the mean of a cell."""
    if mode == "area":
        x, y = F.floor(F.col("x") * dst_w / src_w), F.floor(F.col("y") * dst_h / src_h)
        return pixels.groupBy(key, x.cast("int").alias("x"), y.cast("int").alias("y")).agg(F.avg("gray").alias("gray"))
    return tile_resize(pixels, src_w, src_h, dst_w, dst_h, key)


def tile_resize(pixels: DataFrame, src_w: int, src_h: int, dst_w: int, dst_h: int, key: str = "tile_id") -> DataFrame:
    """Nearest-neighbour resize, up or down: each source pixel is exploded to the places that show it, with no join."""

    def places(at: str, src: int, dst: int) -> Column:
        first = F.ceil(F.col(at) * dst / F.lit(float(src)) - 0.5)
        last = F.ceil((F.col(at) + 1) * dst / F.lit(float(src)) - 0.5) - 1
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    wide = pixels.select(key, F.explode(places("x", src_w, dst_w)).alias("__x"), "y", "gray")
    return wide.select(key, F.col("__x").alias("x"), F.explode(places("y", src_h, dst_h)).alias("y"), "gray")
