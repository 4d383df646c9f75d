"""Writers: capture logs and tile snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import trimmed


def capture_line(ts: Column, sender: Column, payload: Column) -> Column:
    """A recorded line: time to the second, sender and payload without white space around it."""
    host, port = F.regexp_extract(sender, r"^(.*):(\d+)$", 1), F.regexp_extract(sender, r"^(.*):(\d+)$", 2)
    return F.format_string("[%s] 来自 ('%s', %s) 的数据: %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), host, port, trimmed(payload))


def capture_log_sink(msgs: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append messages(rx_ts, sender, payload) as lines; a stream is written with its checkpoint and returned."""
    lines = msgs.select(capture_line(F.col("rx_ts"), F.col("sender"), F.col("payload")).alias("value"))
    if msgs.isStreaming:
        return lines.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).start(path)
    lines.write.mode("append").text(path)
    return None


def tile_snapshot_sink(mosaic: DataFrame, path: str, ts: str) -> None:
    """Write a mosaic's tiles under snapshot_ts=yyyy_MM_dd_HH_mm_ss / channel, one file set per channel.

    A snapshot that is written again takes its own place; other snapshots stay."""
    name = F.date_format(F.lit(ts).cast("timestamp"), "yyyy_MM_dd_HH_mm_ss")
    dealt = mosaic.withColumn("snapshot_ts", name).repartition("channel", "tile_index")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts", "channel").parquet(path)


TILE = ("device_id", "channel", "tile_index")


def mosaic_sink(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest frame of each tile of a stream of mosaic rows (update mode) up to date under path.

    A micro-batch writes the tiles that it changed to a folder of its own number, so one that is run twice replaces
    itself, and no batch rewrites the mosaic. Read it with mosaic_table()."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mosaic_table(rows: DataFrame) -> DataFrame:
    """The mosaic that the rows of mosaic_sink's path amount to: of each tile what its last batch wrote.

    Where the stream had clear events (a column cleared), without the tiles from before a channel's last one."""
    values = [c for c in rows.columns if c not in (*TILE, "batch")]
    latest = rows.groupBy(*TILE).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*TILE, "v.*")
    if "cleared" not in values:
        return latest
    last = latest.groupBy(F.col("device_id").alias("__d"), F.col("channel").alias("__c")).agg(F.max("cleared").alias("__clear"))
    on = F.col("device_id").eqNullSafe(F.col("__d")) & F.col("channel").eqNullSafe(F.col("__c"))
    kept = latest.filter("tile_index is not null").join(last, on, "left").filter("__clear is null or ts >= __clear")
    return kept.drop("cleared", "__d", "__c", "__clear")
