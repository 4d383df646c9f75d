"""Rasters as bytes: frames cut from images laid side by side, and regions of the mosaic, with their pixels.

A raster is height rows of width pixels of `depth` bytes, without padding. Only the bytes that an output shows are
shuffled to it, and a group is one output raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import as_of, circular_range_slice
from .rechunk import WIDTH, column_rechunk


def whole_rasters(images: DataFrame, depth: int = 1) -> DataFrame:
    """Images whose data has height x width x depth bytes, and at least one; the others are rejected."""
    size = F.col("height").cast("long") * F.col("width").cast("long") * depth
    return images.filter((F.col("height") > 0) & (F.col("width") > 0) & (F.octet_length("data") == size))


def _rows(depth: int) -> Column:
    """The columns [src_from, src_to) of a raster, as an array of its rows' bytes; null without a raster."""
    skip, n = (F.col("src_from") * depth + 1).cast("int"), ((F.col("src_to") - F.col("src_from")) * depth).cast("int")
    stride = (F.col("width") * depth).cast("int")
    return F.when(F.col("data").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("height").cast("int") - 1), lambda y: F.substring("data", y * stride + skip, n)))


def assemble(parts: DataFrame, keys: list[str], depth: int = 1) -> DataFrame:
    """keys, height, width, data of rasters put together from parts(keys, dst_from, src_from, src_to, height, width, data).

    Parts lie side by side in the order of dst_from. The output is as high as its highest part; what lies below a lower
    one, or has no raster, is zero. Where no part has a raster, height and data are null."""
    n = F.col("src_to") - F.col("src_from")
    cut = parts.select(*keys, F.when(F.col("data").isNotNull(), F.col("height")).alias("__h"), n.alias("__n"), F.struct("dst_from", n.alias("n"), _rows(depth).alias("rows")).alias("__p"))
    whole = cut.groupBy(*keys).agg(F.max("__h").cast("int").alias("height"), F.sum("__n").cast("long").alias("width"), F.sort_array(F.collect_list("__p")).alias("__p"))

    def line(y: Column) -> Column:  # joined as hex digits: concat() has no form for an array of bytes
        return F.array_join(F.transform("__p", lambda p: F.coalesce(F.hex(F.get(p["rows"], y)), F.repeat(F.lit("00"), (p["n"] * depth).cast("int")))), "")

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("height") - 1), line), ""))
    return whole.select(*keys, "height", "width", data.alias("data"))


def rechunk_pixels(images: DataFrame, width: int = WIDTH, depth: int = 1) -> DataFrame:
    """session, frame_no, height, width, data: every full frame of column_rechunk, with its pixels.

    images(session, image_no, height, width, data); session and image_no name an image, and one without either gives no pixels.
    Places are found from the numbers and widths alone; the data is joined to them once and shuffled to its frames."""
    own = whole_rasters(images, depth)
    spans = column_rechunk(own.select("session", "image_no", "width"), width)
    parts = spans.join(own.select("session", "image_no", "height", "width", "data"), ["session", "image_no"])
    return assemble(parts, ["session", "frame_no"], depth)


def region_pixels(frames: DataFrame, requests: DataFrame, ring: int, slice_w: int, depth: int = 1) -> DataFrame:
    """request_id, height, width, data: the columns [start, start + width) of the mosaic as it was at the request's ts.

    frames(device_id, channel, ts, frame_no, tile_index, height, width, data), requests(request_id, device_id, channel, ts,
    start, width), request_id unique. A region goes round the ring's end; the ring's last tile is narrower where it is no multiple of
    slice_w. Tiles without a frame by then are zero (data null if all are), as is what a tile lacks of height.
    device_id, channel and frame_no name a frame, and one that lacks any has no pixels; only frames that a request shows are joined with their data."""
    own = whole_rasters(frames, depth)
    named = requests.withColumn("request_id", F.struct("request_id", "device_id", "channel", "ts"))
    pieces = circular_range_slice(named, ring, slice_w).select(
        *[F.col(f"request_id.{c}").alias(c) for c in ("request_id", "device_id", "channel", "ts")], F.col("tile_index").cast("long").alias("tile_index"), "src_from", "src_to", "dst_from")
    shown = as_of(own, pieces)
    parts = shown.join(own.select("device_id", "channel", "frame_no", "height", "width", "data"), ["device_id", "channel", "frame_no"], "left")
    return assemble(parts, ["request_id"], depth)
