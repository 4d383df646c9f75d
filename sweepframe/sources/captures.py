"""Recorded logs, landing tables and image directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import trimmed

#: Fixed value: the form of a recorded line.
LINE = r"^\[([^\]]+)\][^:]*:\s*(.*)$"
SENDER = r"\('([^']*)',\s*(\d+)\)"


def parse_capture_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """log_ts, sender_ip, sender_port, payload of recorded lines, beside their other columns.

    Lines of another form and lines with an empty payload are skipped; a time that can't be read is null."""
    payload = trimmed(F.regexp_extract(column, LINE, 2))
    keep = [c for c in lines.columns if c != column]
    return lines.filter(F.col(column).rlike(LINE) & (payload != "")).select(
        *keep, F.regexp_extract(column, LINE, 1).try_cast("timestamp_ntz").alias("log_ts"),
        F.nullif(F.regexp_extract(column, SENDER, 1), F.lit("")).alias("sender_ip"),
        F.regexp_extract(column, SENDER, 2).try_cast("int").alias("sender_port"),
        payload.alias("payload"))


def capture_log_scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A recorded log file or directory, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return parse_capture_log(reader.text(path))


def packet_scan(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """The landing table of datagrams; as a stream, at most files_per_trigger files at a time."""
    schema = "device_id string, sender string, port int, rx_ts timestamp, arrival_seq bigint, datagram binary"
    if stream:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.read.schema(schema).parquet(path)


def image_file_scan(spark: SparkSession, path: str, pattern: str = "*.[pj][pn]*") -> DataFrame:
    """Images of a directory by name; ok is false for files that can't be decoded."""
    found = spark.read.format("image").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("nChannels"), (F.col("image.height") >= 0).alias("ok"), "image").orderBy("origin")
