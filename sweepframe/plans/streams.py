"""Stream queries of the catalog: a view is landed as files, read as a stream, and run to its end.

Landing tables, checkpoints and results lie in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import laps
from ..operators.clearing import with_clears
from ..operators.sliced import slice_of
from ..sinks import mosaic_table, tile_snapshot_sink
from ..streaming import processors as sp
from .catalog import _DETECTED, _DETECTIONS, _DETECTIONS_CLEARED, _MATCH, _MOSAIC_CLEARED, _REFRAME, _REFRAMED, _STATS_ALL, _TOTAL_ALL, _TOTALS, _clears, _clears_ms, _digest, _raster, _received_all, _PAIRS, _snaps, _EPOCH, _EPOCHS, _FRAME, _LAP_SQL, _PATH_SQL, _POOLED, _THROTTLE, _pool_sql, _timed, pool_packets, register
from .fixtures import Views, shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_streams(inputs: list[tuple[DataFrame, str]], operator: Callable[..., DataFrame], mode: str = "append", cuts: int = 3) -> DataFrame:
    """operator over (rows, order) pairs as streams, until all is read; the result table.

    Every input is cut into `cuts` parts of its order, and the query is started anew for each part from its checkpoint,
    so the parts come in order and all state passes through the checkpoint. The inputs are written once and cut from there.
    append: every batch's rows. update: every batch's, with its number in `batch`."""
    spark = inputs[0][0].sparkSession
    at = shared_path(spark, "stream")
    for i, (rows, order) in enumerate(inputs):  # made once, however many parts are cut
        rows.write.parquet(f"{at}/all{i}")
    stored = [(spark.read.schema(rows.schema).parquet(f"{at}/all{i}"), order) for i, (rows, order) in enumerate(inputs)]
    dealt = [rows.withColumn("__part", slice_of(rows, order, cuts)) for rows, order in stored]
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)  # for this run; the stream keeps what it started with

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "update":
            batch = batch.withColumn("batch", F.lit(number))
        batch.write.mode("overwrite").parquet(f"{at}/out/n={number}")  # a batch that is run again replaces itself

    try:
        for part in range(cuts):
            for i, rows in enumerate(dealt):
                rows.filter(F.col("__part") == part).drop("__part").write.mode("append").parquet(f"{at}/in{i}")
            out = operator(*[spark.readStream.schema(rows.schema).parquet(f"{at}/in{i}") for i, (rows, _) in enumerate(inputs)])
            out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.parquet(f"{at}/out")


def run_stream(rows: DataFrame, order: str, operator: Callable[[DataFrame], DataFrame], mode: str = "append", cuts: int = 3) -> DataFrame:
    return run_streams([(rows, order)], operator, mode, cuts)


_us = lambda c: F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(c))


def _lap_events(v: Views) -> DataFrame:
    a = v("angle_feedback").select("device_id", _us("ts").alias("us"), F.lit(1).alias("kind"), F.col("seq").alias("n"), "angle_deg", F.lit("").alias("cmd"))
    m = v("motion_commands").select("device_id", _us("ts").alias("us"), F.lit(0).alias("kind"), F.col("event_id").alias("n"), F.lit(0.0).alias("angle_deg"), "cmd")
    return a.unionByName(m)


register("lap_stream", "device_id BIGINT, epoch BIGINT, us BIGINT, lap_seconds DOUBLE", lambda v: run_stream(_lap_events(v), "us", lambda s: sp.lap_stream(s, laps.JUMP)),
    f"SELECT device_id, epoch, epoch_us(ts) AS us, lap_seconds FROM ({_LAP_SQL})")
register("mosaic_stream", "device_id BIGINT, channel VARCHAR, tile_index BIGINT, frame_no BIGINT", lambda v: mosaic_table(run_stream(v("frames"), "ts", sp.mosaic_stream, "update")).select("device_id", "channel", "tile_index", "frame_no"),
    "SELECT device_id, channel, CASE channel WHEN 'BW' THEN (tile_index + 16) % 32 ELSE tile_index END AS tile_index, max(frame_no) AS frame_no FROM frames GROUP BY ALL")
register("coverage_stream", "device_id BIGINT, channel VARCHAR, tiles BIGINT, is_full BOOLEAN",
    lambda v: run_stream(v("frames").select("device_id", "channel", F.col("frame_no").alias("seq"), "tile_index", F.lit(32).alias("segments"), F.lit(False).alias("clear")), "seq", sp.coverage_stream, "update")
        .groupBy("device_id", "channel").agg(F.max_by("tiles", "batch").alias("tiles"), F.max_by("full", "batch").alias("is_full")),
    "SELECT device_id, channel, count(DISTINCT tile_index) AS tiles, count(DISTINCT tile_index) = 32 AS is_full FROM frames GROUP BY ALL")


def _received(v: Views) -> DataFrame:
    """Messages with their type and path; of every seven one was dropped and one failed."""
    kind = F.when(F.col("arrival_seq") % 7 == 0, "drop").when(F.col("arrival_seq") % 7 == 1, "decode_failed").otherwise("ok")
    m = v("path_msgs")
    return m.select("device_id", F.timestamp_micros(_us("rx_ts")).alias("rx_ts"), "arrival_seq", messages.path_type(F.col("payload")).alias("type"), F.when(messages.path_type(F.col("payload")).isNotNull(), messages.path_of(F.col("payload"))).alias("path"), kind.alias("outcome"))


register("rx_stats_stream", "device_id BIGINT, win_start BIGINT, packets BIGINT, ok BIGINT, drop BIGINT, fail BIGINT, last_type VARCHAR, last_path VARCHAR",
    lambda v: run_stream(_received(v), "rx_ts", sp.rx_stats_stream),
    f"""SELECT device_id, win_start, count(*) AS packets, count(*) FILTER (arrival_seq % 7 > 1) AS ok, count(*) FILTER (arrival_seq % 7 = 0) AS drop, count(*) FILTER (arrival_seq % 7 = 1) AS fail,
              arg_max(type, arrival_seq) AS last_type, arg_max(path, arrival_seq) AS last_path
       FROM (SELECT m.device_id, m.arrival_seq, epoch_us(m.rx_ts) // 3000000 * 3 AS win_start, o.type, o.path FROM path_msgs m LEFT JOIN ({_PATH_SQL}) o ON m.arrival_seq = o.arrival_seq)
       WHERE (win_start + 3) * 1000000 <= (SELECT epoch_us(max(rx_ts)) // 1000 * 1000 - 10000000 FROM path_msgs) GROUP BY ALL""")
register("reassembly_stream", _POOLED, lambda v: run_stream(pool_packets(v), "arrival_seq", sp.reassembly_stream), _pool_sql(1))
register("detection_stream", "device_id BIGINT, channel VARCHAR, lap_id BIGINT, target BIGINT, frame_no BIGINT",
    lambda v: run_stream(_timed(v).select(F.col("device_id").cast("long").alias("device_id"), "channel", "ms", "frame_no", "angle_deg"), "ms", lambda s: sp.detection_stream(s, [45, 135, 240, 315], 60_000, 120_000)), _DETECTIONS)
register("throttle_stream", _FRAME, lambda v: run_stream(_timed(v).select("device_id", "channel", "frame_no", "ms"), "ms", lambda s: sp.throttle_stream(s, ["device_id", "channel"], "ms", 3_600_000, ["ms", "frame_no"])), _THROTTLE)
register("counter_epoch_stream", _EPOCH, lambda v: run_stream(v("frame_index_stream").select("device_id", "seq", "image_index"), "seq", sp.counter_epoch_stream), _EPOCHS)


register("snapshot_pair_stream", "request_id BIGINT, rgb_frame BIGINT, bw_frame BIGINT", lambda v: run_stream(_snaps(v), "ts", lambda s: sp.snapshot_pair_stream(s, keep_ms=400 * 86_400_000)), _PAIRS)


def _closed(rows: DataFrame) -> DataFrame:
    """rows and, a day behind the last of them, one of device -1 that lets the watermark pass all the others.

    It has no nulls: a join's conditions would drop it before the watermark sees it."""
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).filter("ts is not null")
    return rows.unionByName(end.select(*["ts" if c == "ts" else F.lit("-1").cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))


def _matched(v: Views) -> DataFrame:
    out = run_streams([(_closed(v("commands")), "ts"), (_closed(v("replies").select("device_id", "ts", "reply")), "ts")], sp.command_reply_stream)
    return out.filter("device_id <> -1").select("cmd_id", "device_id", "cmd", F.col("reply_ts").cast("timestamp_ntz").alias("reply_ts"), "latency_s")


register("command_reply_stream", "cmd_id BIGINT, device_id BIGINT, cmd VARCHAR, reply_ts MS, latency_s DOUBLE", _matched, _MATCH)


def _snapshot(v: Views) -> DataFrame:
    from ..operators.frames import mosaic_latest

    path = shared_path(v.spark, "snapshot")
    for _ in range(2):  # the second takes the first one's place
        tile_snapshot_sink(mosaic_latest(v("frames")).drop("ts"), path, "2026-03-15 10:00:00")
    return v.spark.read.parquet(path)


register("tile_snapshot_sink", "snapshot_ts VARCHAR, channel VARCHAR, device_id BIGINT, tile_index BIGINT, frame_no BIGINT", _snapshot,
    "SELECT '2026_03_15_10_00_00' AS snapshot_ts, channel, device_id, CASE channel WHEN 'BW' THEN (tile_index + 16) % 32 ELSE tile_index END AS tile_index, max(frame_no) AS frame_no FROM frames GROUP BY ALL")


def _cleared_mosaic(v: Views) -> DataFrame:
    rows = with_clears(v("frames").select("device_id", "channel", "ts", "frame_no", "tile_index"), _clears(v))
    return mosaic_table(run_stream(rows, "ts", sp.mosaic_stream, "update")).select("device_id", "channel", "tile_index", "frame_no")


register("mosaic_cleared_stream", "device_id BIGINT, channel VARCHAR, tile_index BIGINT, frame_no BIGINT", _cleared_mosaic, _MOSAIC_CLEARED)


def _cleared_detections(v: Views) -> DataFrame:
    frames = _timed(v).select(F.col("device_id").cast("long").alias("device_id"), "channel", "ms", "frame_no", "angle_deg")
    return run_stream(with_clears(frames, _clears_ms(v), "ms"), "ms", lambda s: sp.detection_stream(s, [45, 135, 240, 315], 60_000, 120_000))


register("detection_cleared_stream", _DETECTED, _cleared_detections, _DETECTIONS_CLEARED)
register("rechunk_stream", _REFRAME, lambda v: _digest(run_stream(_raster(v, "rasters"), "image_no", lambda s: sp.rechunk_stream(s, 500))), _REFRAMED)


def _totals(v: Views) -> DataFrame:
    """An hour's statistics and their totals, by two stateful operators; times are those of the messages."""
    rows = _received_all(v).withColumn("rx_ts", F.timestamp_micros(_us("rx_ts")))
    return run_stream(rows, "rx_ts", lambda s: sp.running_totals_stream(sp.rx_stats_stream(s, 3600)))


register("running_totals_stream", _TOTAL_ALL, _totals, _TOTALS.format(f"SELECT * FROM ({_STATS_ALL}) WHERE (win_start + 3600) * 1000000 <= (SELECT epoch_us(max(rx_ts)) // 1000 * 1000 - 10000000 FROM path_msgs)"))
