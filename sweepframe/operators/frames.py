"""Frames on the 360-degree tile grid: placing, mosaics, coverage, regions, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles
from .clearing import clear_epoch, since_clear  # noqa: F401
from .sliced import running

SEGMENTS, SLICE_WIDTH, PANORAMA_WIDTH = angles.SEGMENTS, angles.SLICE_WIDTH, angles.PANORAMA_WIDTH


def frame_to_tile(frames: DataFrame, segments: int = SEGMENTS, slice_w: int = SLICE_WIDTH) -> DataFrame:
    """frames with tile_index, angle_deg, lap, pos, start_x from frame_no alone."""
    n = F.col("frame_no")
    tile = n % segments
    return frames.withColumns({
        "tile_index": tile, "angle_deg": angles.tile_angle(tile, segments), "lap": F.floor(n / segments) + 1,
        "pos": tile + 1, "start_x": tile * slice_w})


def tile_pixel_span(frames: DataFrame, slice_w: int = SLICE_WIDTH, pano_w: int = PANORAMA_WIDTH, tile: str = "tile_index") -> DataFrame:
    """frames with start_x, end_x and what of the tile lies right of the start and, wrapped, at the left edge."""
    start = (F.col(tile) * slice_w) % pano_w
    right = F.least(F.lit(slice_w), F.lit(pano_w) - start)
    return frames.withColumns({"start_x": start, "end_x": start + slice_w, "right_w": right, "left_w": F.lit(slice_w) - right})


def segment_count(images: DataFrame, pano_w: int = PANORAMA_WIDTH, key: str = "session", order: str = "image_no") -> DataFrame:
    """segments per key: the width of its first image settles it."""
    return images.groupBy(key).agg(F.min_by("width", order).alias("w")).select(key, F.greatest(F.lit(1), F.expr(f"cast({pano_w} div w as int)")).alias("segments"))


def mosaic_latest(frames: DataFrame, segments: int = SEGMENTS, half_turn: bool = True, clears: DataFrame | None = None) -> DataFrame:
    """The latest frame on every tile of a (device, channel); grey tiles lie half a turn on. With clears, what came before
    a device's last clear event is gone.

    One partial and one final aggregation: a hot device's rows are combined before the shuffle."""
    if clears is not None:
        frames = since_clear(frames, clears)
    tile = F.col("tile_index")
    if half_turn:
        tile = F.when(F.col("channel") == "BW", angles.half_turn_shift(tile, segments)).otherwise(tile)
    placed = frames.withColumn("tile_index", tile)
    return placed.groupBy("device_id", "channel", "tile_index").agg(F.max("frame_no").alias("frame_no"), F.max_by("ts", "frame_no").alias("ts"))


def coverage_ready(frames: DataFrame, segments: int = SEGMENTS, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Filled tiles of both channels, and whether all are; keys may add an epoch (clear_epoch).

    Tiles are bits of 64-bit words, combined by bit_or before the shuffle: a task sends a row per key and 64 tiles,
    however many frames it saw. Null tiles and those outside of the segments fill nothing."""
    tile = F.col("tile_index").cast("long")
    inside = tile.between(0, segments - 1)
    bit = lambda channel: F.bit_or(F.when(inside & (F.col("channel") == channel), F.expr("shiftleft(1L, cast(tile_index % 64 as int))")))
    words = frames.groupBy(*keys, F.when(inside, F.floor(tile / 64)).alias("__word")).agg(bit("RGB").alias("__r"), bit("BW").alias("__b"))
    filled = lambda c: F.coalesce(F.sum(F.bit_count(c)), F.lit(0))
    return words.groupBy(*keys).agg(filled("__r").alias("rgb_tiles"), filled("__b").alias("bw_tiles")).withColumn(
        "ready", (F.col("rgb_tiles") >= segments) & (F.col("bw_tiles") >= segments) & F.lit(segments > 0))


def coverage_ready_edge(frames: DataFrame, segments: int = SEGMENTS, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """When coverage became complete: the latest of the tiles' first times, null if it never did."""
    first = frames.groupBy(*keys, "channel", "tile_index").agg(F.min("ts").alias("ts"))
    out = first.groupBy(*keys).agg(F.max("ts").alias("t"), F.count_if(F.col("channel") == "RGB").alias("r"), F.count_if(F.col("channel") == "BW").alias("b"))
    return out.select(*keys, F.when((F.col("r") >= segments) & (F.col("b") >= segments), F.col("t")).alias("ready_ts"))


def as_of(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(device_id, channel, tile_index, ts, ..) with frame_no: the latest frame on that tile by then, null if none.

    Frames and questions of a tile are one line in time, cut into slices (running), so a hot device or tile is many
    tasks. Frames come before questions of the same time; a null device or channel is one."""
    line = ["device_id", "channel", "tile_index"]
    placed = frames.select("device_id", "channel", F.col("tile_index").cast("long").alias("tile_index"), "ts", F.col("frame_no").cast("long").alias("__f"), F.lit(0).alias("__ask"))
    both = asked.withColumn("__ask", F.lit(1)).unionByName(placed, allowMissingColumns=True)
    found = running(both, line, ["ts", "__ask", "__f"], {"frame_no": ("last", F.col("__f"), False)})
    return found.filter("__ask = 1").drop("__ask", "__f")


def roi_lookup(frames: DataFrame, requests: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """For each request(request_id, device_id, channel, tag, angle, ts) the latest frame on its tile by then (as_of)."""
    asked = requests.withColumn("tile_index", angles.angle_to_tile(F.col("angle"), segments).cast("long"))
    found = as_of(frames, asked.select("request_id", "tag", "device_id", "channel", "tile_index", "ts"))
    return found.select("request_id", "tag", "device_id", "channel", "tile_index", "frame_no")


def circular_range_slice(requests: DataFrame, ring: int = PANORAMA_WIDTH, slice_w: int = SLICE_WIDTH) -> DataFrame:
    """Tiles under [start, start + width) of a ring, for requests(request_id, start, width).

    Rows: tile_index, src_from, src_to within the tile, and dst_from in the output. A request is cut at the ring's
    end and then at tile borders by arithmetic, with no join; a width beyond the ring goes round again. Where
    the ring is no multiple of slice_w, its last tile is the narrower rest. Requests of null or no width give no rows."""
    start = F.pmod(F.col("start"), F.lit(ring)).cast("long")
    own = requests.select("request_id", start.alias("__s"), F.col("width").cast("long").alias("__w")).filter("__w > 0 and __s is not null")
    turn = own.withColumn("__turn", F.explode(F.expr(f"sequence(0L, (__s + __w - 1) div {ring})")))
    turn = turn.withColumn("__lo", F.greatest("__s", F.col("__turn") * ring)).withColumn("__hi", F.least(F.col("__s") + F.col("__w"), (F.col("__turn") + 1) * ring))
    here = turn.withColumn("__from", F.col("__lo") - F.col("__turn") * ring).withColumn("__to", F.col("__hi") - F.col("__turn") * ring)
    tile = here.withColumn("tile_index", F.explode(F.expr(f"sequence(__from div {slice_w}, (__to - 1) div {slice_w})")))
    first = F.col("tile_index") * slice_w
    lo, hi = F.greatest("__from", first), F.least("__to", first + slice_w)
    return tile.select("request_id", "tile_index", (lo - first).alias("src_from"), (hi - first).alias("src_to"), (F.col("__turn") * ring + lo - F.col("__s")).alias("dst_from"))


def snapshot_pair(snapshots: DataFrame) -> DataFrame:
    """Requests for which both channels' snapshots came; of several the first per channel counts."""
    first = snapshots.groupBy("request_id", "channel").agg(F.min_by("frame_no", F.struct("ts", "frame_no")).alias("frame_no"))
    return first.groupBy("request_id").agg(
        F.max(F.when(F.col("channel") == "RGB", F.col("frame_no"))).alias("rgb_frame"), F.max(F.when(F.col("channel") == "BW", F.col("frame_no"))).alias("bw_frame")
    ).filter("rgb_frame is not null and bw_frame is not null")


def snapshot_size(requests: DataFrame, spare_bytes: int = 64 << 20) -> DataFrame:
    """requests(w, h, free_bytes) with need_bytes of both bitmaps and whether they fit (unknown space fits)."""
    area = F.col("w").cast("long") * F.col("h").cast("long")
    need = (F.lit(54) + area * 3) + (F.lit(1078) + area) + spare_bytes
    return requests.withColumn("need_bytes", need).withColumn("ok", F.col("free_bytes").isNull() | (F.col("free_bytes") >= F.col("need_bytes")))


def channel_union(colour: DataFrame, grey: DataFrame) -> DataFrame:
    """The rows of both channels' tables, matched by column name; repeated rows stay."""
    return colour.unionByName(grey)
