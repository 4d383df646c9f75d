"""Input views over the given tables, in SQL that Spark and DuckDB both run (see FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.sliced import numbered
from ..shared import shared_path  # noqa: F401

TABLES = ("documents", "events", "embeddings")

#: View name to its body. Views may use views above them.
VIEWS: dict[str, str] = {
    "packets0": """
SELECT CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS image_type,
       doc_id AS image_index, CAST(bit_length(text) / 8 AS BIGINT) AS total_size, block_index,
       substr(text, CAST(block_index * 512 + 1 AS INT), 512) AS payload
FROM documents EACH(block_index, (length(text) + 511) / 512) WHERE length(text) > 0""",
    "packets1": """
SELECT *, 0 AS dup FROM packets0 WHERE (image_index * 31 + block_index) % 17 <> 0
UNION ALL
SELECT *, 1 AS dup FROM packets0 WHERE (image_index * 7 + block_index) % 23 = 0""",
    "packets": """
SELECT image_type, image_index, CASE WHEN block_index = 0 AND image_index % 29 = 0 THEN 0 ELSE total_size END AS total_size,
       block_index, payload, CAST(bit_length(payload) / 8 AS BIGINT) AS block_size,
       arrival_seq, arrival_seq + 2000 * CAST(floor(arrival_seq / 500) AS BIGINT) AS rx_ms
FROM (SELECT *, row_number() OVER (PARTITION BY image_type
             ORDER BY image_index * 4 + block_index + 3 * dup, image_index, block_index, dup) AS arrival_seq
      FROM packets1) t""",
    "frame_index_stream": """
SELECT device_id, seq, ts, (seq * 7) % 2500 AS image_index
FROM (SELECT user_id % 10 AS device_id, ts,
             row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq FROM events) t""",
    "path_msgs": """
SELECT event_id AS arrival_seq, user_id % 10 AS device_id, ts AS rx_ts,
       concat('192.168.4.', CAST(user_id % 10 AS STRING), ':56717') AS sender,
       CASE event_type
         WHEN 'view'     THEN concat('RGB; /data/raw/rgb/', CAST(event_id AS STRING), '.jpg', chr(13), chr(10))
         WHEN 'click'    THEN concat(' bw', chr(9), ';file:///data/raw/bw/', CAST(event_id AS STRING), '.jpg')
         WHEN 'purchase' THEN concat('GRAY; D:/x/', CAST(event_id AS STRING), '.jpg')
         WHEN 'signup'   THEN concat('IR; /data/raw/ir/', CAST(event_id AS STRING), '.jpg')
         ELSE concat('noise ', CAST(event_id AS STRING)) END AS payload
FROM events""",
    "capture_log": """
SELECT arrival_seq, CASE WHEN arrival_seq % 50 = 0 THEN 'broken line'
  ELSE concat('[', substr(CAST(rx_ts AS STRING), 1, 19), '] 来自 (', chr(39), '192.168.4.1', chr(39),
              ', 56717) 的数据: ', replace(replace(payload, chr(13), ''), chr(10), '')) END AS value
FROM path_msgs""",
    "angle_feedback": """
SELECT device_id, ts, seq, ((seq * 2311) % 36000) / CAST(100 AS DOUBLE) AS angle_deg
FROM frame_index_stream""",
    "motion_commands": """
SELECT user_id % 10 AS device_id, ts, event_id,
       CASE WHEN event_id % 211 = 0 THEN 'stop' WHEN event_id % 5 = 3 THEN 'enableFeedback' WHEN event_id % 2 = 0 THEN 'turnLeft' ELSE 'turnRight' END AS cmd,
       CASE event_id % 5 WHEN 0 THEN 255 WHEN 1 THEN 170 WHEN 2 THEN 85 WHEN 3 THEN 57 ELSE 43 END AS speed
FROM events WHERE event_id % 211 = 0 OR event_id % 97 = 0""",
    "commands": """
SELECT event_id AS cmd_id, user_id % 10 AS device_id, ts,
       CASE event_type WHEN 'view' THEN 'TG_OPEN_DEVICE;' WHEN 'click' THEN 'TG_SAVE_PNG;'
         WHEN 'purchase' THEN 'TG_SAVE_JPG;' WHEN 'signup' THEN 'TG_STOP_CAPTURE'
         ELSE 'TG_CLOSE_DEVICE;' END AS cmd
FROM events""",
    "replies": """
SELECT cmd_id, device_id, ts + INTERVAL '2' SECOND AS ts, concat(cmd, CASE WHEN cmd LIKE '%;' THEN '' ELSE ';' END, 'OK;') AS reply
FROM commands WHERE cmd_id % 7 <> 0""",
    "frames": """
SELECT device_id, channel, ts, frame_no, frame_no % 32 AS tile_index,
       (frame_no % 32) * 360 / CAST(32 AS DOUBLE) AS angle_deg, image_bytes
FROM (SELECT user_id % 10 AS device_id, CASE WHEN event_type = 'view' THEN 'RGB' ELSE 'BW' END AS channel,
             ts, value AS image_bytes,
             row_number() OVER (PARTITION BY user_id % 10, CASE WHEN event_type = 'view' THEN 'RGB' ELSE 'BW' END
                                ORDER BY ts, event_id) - 1 AS frame_no
      FROM events WHERE event_type IN ('view', 'click', 'purchase')) t""",
    "file_polls": """
SELECT file_id, seq, seq * 25 AS poll_ms,
       CASE WHEN seq <= device_id THEN 0 WHEN seq <= 10 + device_id * 2 THEN seq * 1000
            ELSE (11 + device_id * 2) * 1000 END AS size
FROM (SELECT device_id, device_id + 10 * CAST(floor((seq - 1) / CAST(80 AS DOUBLE)) AS BIGINT) AS file_id,
             (seq - 1) % 80 + 1 AS seq FROM frame_index_stream) t""",
    "source_images": """
SELECT source AS session, doc_id AS image_no,
       CASE WHEN doc_id % 10 = 0 THEN 6510 ELSE 4096 END AS height,
       CASE WHEN doc_id % 10 = 0 THEN 4096 ELSE 100 + n_chars END AS width
FROM documents""",
    "rasters": """
SELECT source AS session, doc_id AS image_no, 4 AS height, CAST(floor(bit_length(text) / 32) AS BIGINT) AS width,
       substr(hex(text), 1, CAST(floor(bit_length(text) / 32) AS INT) * 8) AS digits
FROM documents""",
    "frame_rasters": """
SELECT device_id, channel, ts, frame_no, tile_index, upper(md5(concat(CAST(device_id AS STRING), channel, CAST(frame_no AS STRING)))) AS digits
FROM frames""",
    "log_events": """
SELECT event_id, device_id, ts, ms,
       CASE ms % 6 WHEN 0 THEN '系统' WHEN 1 THEN 'ROI' WHEN 2 THEN 'RX(8001)' ELSE '指令下发 (5001)' END AS type,
       concat('<msg> & "', CAST(event_id AS STRING), '"') AS msg
FROM (SELECT event_id, user_id % 10 AS device_id, ts, event_id * 4 + (event_id * event_id) % 11 AS ms
      FROM events) t""",
    "targets": """
SELECT * FROM (VALUES (45), (135), (240), (315)) AS t(angle)""",
    "speed_profile": """
SELECT speed, CAST(nominal_lap_s AS DOUBLE) AS nominal_lap_s
FROM (VALUES (255, 1.32), (170, 2.0), (85, 4.0), (57, 6.0), (43, 8.0)) AS t(speed, nominal_lap_s)""",
}

#: How Spark makes the views that number all rows of a few keys, with the same rows as their SQL above: the rows, their keys, their
#: order, the number's name (from 1), and the view over {rows}. A key is numbered in slices, so it is no single task.
NUMBERED: dict[str, tuple[str, list[str], list[str], str, str]] = {
    "packets": ("SELECT *, image_index * 4 + block_index + 3 * dup AS place FROM packets1", ["image_type"], ["place", "image_index", "block_index", "dup"], "arrival_seq", """
SELECT image_type, image_index, CASE WHEN block_index = 0 AND image_index % 29 = 0 THEN 0 ELSE total_size END AS total_size,
       block_index, payload, CAST(bit_length(payload) / 8 AS BIGINT) AS block_size,
       arrival_seq, arrival_seq + 2000 * CAST(floor(arrival_seq / 500) AS BIGINT) AS rx_ms FROM {rows}"""),
    "frame_index_stream": ("SELECT user_id % 10 AS device_id, ts, event_id FROM events", ["device_id"], ["ts", "event_id"], "seq",
        "SELECT device_id, seq, ts, (seq * 7) % 2500 AS image_index FROM {rows}"),
    "frames": ("""SELECT user_id % 10 AS device_id, CASE WHEN event_type = 'view' THEN 'RGB' ELSE 'BW' END AS channel, ts, event_id, value AS image_bytes
FROM events WHERE event_type IN ('view', 'click', 'purchase')""", ["device_id", "channel"], ["ts", "event_id"], "nth", """
SELECT device_id, channel, ts, nth - 1 AS frame_no, (nth - 1) % 32 AS tile_index,
       ((nth - 1) % 32) * 360 / CAST(32 AS DOUBLE) AS angle_deg, image_bytes FROM {rows}"""),
}

_EACH = re.compile(r"EACH\((\w+), (.+?)\)(?= WHERE|\s*$)")


def each(sql: str, duck: bool) -> str:
    """EACH(name, n) after a table stands for one row per number from 0 below n, in either engine's words."""
    if duck:
        return _EACH.sub(r", LATERAL (SELECT unnest(range(CAST(floor(\2) AS BIGINT))) AS \1)", sql)
    return _EACH.sub(r"LATERAL VIEW explode(sequence(0L, greatest(CAST(floor(\2) AS BIGINT) - 1, 0L))) numbers AS \1", sql)


def needed(sql: str, given: tuple[str, ...] = ()) -> list[str]:
    """The views that a statement uses, directly or through views, in their order of definition; not those that are given."""
    found: set[str] = set()

    def look(text: str) -> None:
        for name in VIEWS:
            if name not in found and name not in given and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+\w", text, re.I):
                found.add(name)
                look(VIEWS[name])

    look(sql)
    return [n for n in VIEWS if n in found]


def with_views(sql: str, duck: bool = True) -> str:
    """sql with the definitions of the views it uses in front, for DuckDB or for Spark (without those that NUMBERED makes)."""
    names = needed(sql, () if duck else tuple(NUMBERED))
    body = sql.strip()
    if not names:
        return body
    heads = ",\n".join(f"{n} AS ({each(VIEWS[n].strip(), duck)})" for n in names)
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {heads},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {heads},\n{body[plain.end():]}"
    return f"WITH {heads}\n{body}"


class Views:
    """The views of one directory of tables, as DataFrames: v("frames"), or a table's name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        text = with_views(body, duck=False).replace("{", "{{").replace("}", "}}")
        used = {}
        for t in TABLES:
            text, n = re.subn(rf"(?i)\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text)
            if n:
                used[t] = self.table(t)
        for name in NUMBERED:
            text, n = re.subn(rf"(?i)\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
            if n:
                used[name] = self.numbered(name)
        return self.spark.sql(text, **used)

    def numbered(self, name: str) -> DataFrame:
        """A view of NUMBERED; the quantiles that cut it are looked up once."""
        if name not in self.made:
            rows, keys, order, number, rest = NUMBERED[name]
            self.made[name] = self.spark.sql(rest, rows=numbered(self.sql(rows), keys, order, number))
        return self.made[name]
