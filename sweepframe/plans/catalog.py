"""The library's queries by operator name, each with SQL for DuckDB that gives the same rows.

`register` takes the columns with their types; both sides are cast to them, so integer widths agree.
MS stands for a time given as epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, messages, wire
from ..operators import detect, frames, laps, packets, pixels, rasters, rechunk
from ..operators import messages as msg
from ..operators.sliced import running
from ..shared import written
from ..sinks import capture_log_sink
from ..sources.captures import capture_log_scan, packet_scan, parse_capture_log
from ..streaming.processors import reassembly_batch
from .fixtures import Views, shared_path, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, columns: str, query: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    spec = [c.split() for c in columns.split(", ")]

    def cast(c: str, kind: str):
        if kind == "MS":
            return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(c).cast("timestamp_ntz")).alias(c)
        return F.col(c).cast({"VARCHAR": "string"}.get(kind, kind.lower())).alias(c)

    QUERIES[name] = lambda spark, sf_dir: query(Views(spark, sf_dir)).select(*[cast(c, k) for c, k in spec])
    if sql is not None:
        out = ", ".join(f'epoch_us({c}) // 1000 AS {c}' if k == "MS" else f'CAST("{c}" AS {k}) AS "{c}"' for c, k in spec)
        ORACLE_SQL[name] = with_views(f"WITH answer AS ({sql.strip()})\nSELECT {out} FROM answer")


# -- sources and sinks ------------------------------------------------------------------------

def _log_file(v: Views) -> DataFrame:
    """The capture log written as text files, and scanned."""
    path = shared_path(v.spark, "log")
    v("capture_log").select("value").write.text(path)
    return capture_log_scan(v.spark, path)


def _sent_file(v: Views) -> DataFrame:
    """Messages written by the capture log's sink, and read as lines."""
    path = shared_path(v.spark, "sent")
    capture_log_sink(v("path_msgs"), path)
    return v.spark.read.text(path)


#: White space around a field, for DuckDB.
strip = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
register("capture_log_scan", "log_ts MS, sender_ip VARCHAR, sender_port BIGINT, payload VARCHAR", _log_file,
    r"""SELECT try_cast(regexp_extract(value, '^\[([^\]]+)\]', 1) AS TIMESTAMP) AS log_ts,
        regexp_extract(value, '\(''([^'']*)''', 1) AS sender_ip, try_cast(regexp_extract(value, ''', (\d+)\)', 1) AS INT) AS sender_port,
        trim(regexp_extract(value, '^\[[^\]]+\][^:]*:\s*(.*)$', 1)) AS payload
        FROM capture_log WHERE regexp_matches(value, '^\[[^\]]+\][^:]*:\s*\S')""")
register("capture_log_sink", "value VARCHAR", _sent_file,
    f"""SELECT '[' || strftime(rx_ts, '%Y-%m-%d %H:%M:%S') || '] 来自 (''' || split_part(sender, ':', 1) || ''', ' || split_part(sender, ':', 2) || ') 的数据: ' || {strip("payload")} AS value FROM path_msgs""")


def _landing(v: Views) -> DataFrame:
    """A landing table of datagrams made from the packets view: header and payload as bytes, with bad ones among them."""
    le = lambda c, n: F.concat(*[F.unhex(F.format_string("%02X", (F.floor(c / (256**i)) % 256).cast("int"))) for i in range(n)])
    p = v("packets")
    code = F.when(F.col("arrival_seq") % 41 == 0, F.lit(0xFFFE)).otherwise(F.lit(0xFFFF))
    head = F.concat(le(code, 2), le(F.col("image_type"), 2), le(F.col("arrival_seq"), 4), le(F.col("image_index"), 4), le(F.col("total_size"), 4), le(F.col("block_index"), 2), le(F.col("block_size"), 2))
    body = F.concat(head, F.col("payload").cast("binary"))
    text = F.concat(F.lit("RGB; /data/"), F.col("arrival_seq").cast("string")).cast("binary")
    return p.select(F.col("image_type").cast("string").alias("device_id"), "arrival_seq", F.when(F.col("arrival_seq") % 37 == 0, text).otherwise(body).alias("datagram"))


_KIND = "CASE WHEN arrival_seq % 37 = 0 THEN 'text' WHEN arrival_seq % 41 = 0 THEN 'reject' ELSE 'binary' END"


def _landed(v: Views) -> DataFrame:
    """The landing table written as files, and scanned."""
    path = shared_path(v.spark, "landing")
    _landing(v).select("device_id", F.lit("192.168.4.1:8002").alias("sender"), F.lit(8002).alias("port"), F.lit(None).cast("timestamp").alias("rx_ts"), "arrival_seq", "datagram").write.parquet(path)
    return packet_scan(v.spark, path)


register("packet_scan", "device_id VARCHAR, arrival_seq BIGINT, bytes BIGINT",
    lambda v: _landed(v).select("device_id", "arrival_seq", F.length("datagram").alias("bytes")),
    "SELECT CAST(image_type AS VARCHAR) AS device_id, arrival_seq, CASE WHEN arrival_seq % 37 = 0 THEN 11 + length(CAST(arrival_seq AS VARCHAR)) ELSE 20 + strlen(payload) END AS bytes FROM packets")
register("packet_classify", "device_id VARCHAR, arrival_seq BIGINT, kind VARCHAR",
    lambda v: packets.packet_classify(_landing(v)).select("device_id", "arrival_seq", "kind"),
    f"""SELECT CAST(image_type AS VARCHAR) AS device_id, arrival_seq, CASE WHEN {_KIND} = 'reject' AND contains(payload, ';') THEN 'reject' ELSE {_KIND} END AS kind FROM packets""")
register("packet_header_decode", "device_id VARCHAR, arrival_seq BIGINT, header_code BIGINT, image_type BIGINT, device_ts BIGINT, image_index BIGINT, total_size BIGINT, block_index BIGINT, block_size BIGINT, payload VARCHAR",
    lambda v: packets.packet_header_decode(_landing(v)),
    f"""SELECT CAST(image_type AS VARCHAR) AS device_id, arrival_seq, 65535 AS header_code, image_type, arrival_seq AS device_ts, image_index, total_size, block_index, block_size, payload
        FROM packets WHERE {_KIND} = 'binary'""")

# -- scalar functions -------------------------------------------------------------------------

_PATH_SQL = rf"""
SELECT *, CASE WHEN type = 'RGB' THEN 'RGB' WHEN type IN ('BW', 'GRAY') THEN 'BW' END AS channel,
       CASE WHEN starts_with(p, '/data/') THEN '\\' || sender_ip || replace(p, '/', '\') ELSE p END AS share_path
FROM (SELECT *, upper({strip("split_part(payload, ';', 1)")}) AS type, {strip("split_part(payload, ';', 2)")} AS path,
             regexp_replace({strip("split_part(payload, ';', 2)")}, '^file://', '', 'i') AS p, regexp_extract(trim(sender), '^(.+):[^:]*$', 1) AS sender_ip
      FROM path_msgs WHERE contains(payload, ';'))
WHERE type <> '' AND path <> ''"""
_PATH_COLUMNS = "device_id BIGINT, arrival_seq BIGINT, type VARCHAR, channel VARCHAR, path VARCHAR, sender_ip VARCHAR, share_path VARCHAR"
register("path_message_parse", _PATH_COLUMNS, lambda v: msg.path_message_parse(v("path_msgs")), _PATH_SQL)
register("channel_route", _PATH_COLUMNS, lambda v: msg.channel_route(msg.path_message_parse(v("path_msgs"))), f"SELECT * FROM ({_PATH_SQL}) WHERE channel IS NOT NULL")
register("sender_ip", "arrival_seq BIGINT, ip VARCHAR",
    lambda v: v("path_msgs").select("arrival_seq", messages.sender_ip(F.when(F.col("arrival_seq") % 3 == 0, F.concat(F.lit(" [fe80::"), F.col("arrival_seq").cast("string"), F.lit("]:5"))).when(F.col("arrival_seq") % 3 == 1, F.col("sender")).otherwise("plain")).alias("ip")),
    "SELECT arrival_seq, CASE arrival_seq % 3 WHEN 0 THEN 'fe80::' || arrival_seq WHEN 1 THEN split_part(sender, ':', 1) ELSE 'plain' END AS ip FROM path_msgs")
register("device_path_map", "arrival_seq BIGINT, share_path VARCHAR",
    lambda v: v("path_msgs").select("arrival_seq", messages.device_path_map(messages.path_of(F.col("payload")), F.lit("")).alias("share_path")).filter("share_path is not null"),
    rf"""SELECT arrival_seq, CASE WHEN starts_with(p, '/data/') THEN '\\192.168.4.1' || replace(p, '/', '\') ELSE p END AS share_path
        FROM (SELECT arrival_seq, regexp_replace({strip("split_part(payload, ';', 2)")}, '^file://', '', 'i') AS p FROM path_msgs WHERE contains(payload, ';'))""")


def _serial(v: Views) -> DataFrame:
    """Turntable frames as bytes, from the angle view: every 13th has a bad checksum, every 17th another command."""
    a = v("angle_feedback").select("device_id", "ts", "seq", F.round(F.col("angle_deg") * 100).cast("int").alias("c"))
    cmd = F.when(F.col("seq") % 17 == 0, 0x51).otherwise(0x59)
    hi, lo = F.floor(F.col("c") / 256).cast("int"), F.col("c") % 256
    check = (wire.checksum(F.lit(1), F.lit(0), cmd, hi, lo) + F.when(F.col("seq") % 13 == 0, 1).otherwise(0)) % 256
    return a.select("device_id", "ts", "seq", F.unhex(F.format_string("FF0100%02X%02X%02X%02X", cmd, hi, lo, check.cast("int"))).alias("frame"))


_ANGLES = "SELECT device_id, seq, 89 AS cmd2, round(angle_deg * 100) / 100.0::DOUBLE AS angle_deg FROM angle_feedback WHERE seq % 13 <> 0 AND seq % 17 <> 0"
register("turntable_frame_decode", "device_id BIGINT, seq BIGINT, cmd2 BIGINT, angle_deg DOUBLE", lambda v: packets.turntable_frame_decode(_serial(v)), _ANGLES)


def _serial_chunks(v: Views) -> DataFrame:
    """The serial line: every frame in two chunks, stray bytes before some, bad checksums among them."""
    noise = F.when(F.col("seq") % 11 == 0, F.unhex(F.lit("001207"))).otherwise(F.unhex(F.lit("")))
    # A bad frame holds no second 0xFF, so that what it does to its neighbours can be said in SQL.
    frame = F.when(F.col("seq") % 13 == 0, F.unhex(F.lit("FF01005900005B"))).otherwise(F.col("frame"))
    whole = _serial(v).withColumn("data", F.concat(noise, frame))
    halves = F.array(F.struct((F.col("seq") * 2).alias("chunk_seq"), F.expr("substring(data, 1, seq % 6 + 1)").alias("data")), F.struct((F.col("seq") * 2 + 1).alias("chunk_seq"), F.expr("substring(data, seq % 6 + 2)").alias("data")))
    return whole.select("device_id", F.col("ts").alias("rx_ts"), F.explode(halves).alias("c")).select("device_id", "rx_ts", "c.*")


register("turntable_resync", "device_id BIGINT, chunk_seq BIGINT, nth BIGINT, cmd2 BIGINT, angle_deg DOUBLE", lambda v: packets.turntable_resync(_serial_chunks(v)),
    f"SELECT device_id, seq * 2 + 1 AS chunk_seq, 0 AS nth, cmd2, angle_deg FROM ({_ANGLES})")
register("turntable_command_encode", "event_id BIGINT, cmd VARCHAR, frame_hex VARCHAR",
    lambda v: packets.turntable_command_encode(v("motion_commands")),
    """SELECT event_id, cmd, CASE cmd WHEN 'enableFeedback' THEN 'FF010009000610' ELSE printf('FF0100%02X%02X00%02X', c2, d1, (1 + c2 + d1) & 255) END AS frame_hex
       FROM (SELECT event_id, cmd, CASE cmd WHEN 'turnLeft' THEN 4 WHEN 'turnRight' THEN 2 ELSE 0 END AS c2, CASE cmd WHEN 'stop' THEN 0 ELSE speed END AS d1 FROM motion_commands)""")


def _angle(name: str, kind: str, column, sql: str) -> None:
    register(name, f"device_id BIGINT, seq BIGINT, result {kind}", lambda v: v("angle_feedback").withColumn("result", column(F.col("angle_deg"))), f"SELECT device_id, seq, {sql} AS result FROM angle_feedback")


_angle("normalize_angle", "DOUBLE", lambda a: angles.normalize_angle(a * 3 - 500), "(((angle_deg * 3 - 500) % 360) + 360) % 360")
_angle("relative_angle", "DOUBLE", lambda a: angles.relative_angle(a, F.when(F.col("device_id") < 5, F.lit(77.5))), "CASE WHEN device_id >= 5 THEN angle_deg WHEN angle_deg < 77.5 THEN ((angle_deg - 77.5) % 360 + 360) % 360 ELSE angle_deg - 77.5 END")
_angle("circular_distance", "DOUBLE", lambda a: angles.circular_distance(a, F.lit(300.0)), "CASE WHEN abs(angle_deg - 300) > 180 THEN 360 - abs(angle_deg - 300) ELSE abs(angle_deg - 300) END")
_angle("angle_to_tile", "BIGINT", lambda a: angles.angle_to_tile(a), "greatest(0, least(31, CAST(floor(angle_deg / 360 * 32) AS INT)))")
_angle("half_turn_shift", "BIGINT", lambda a: angles.half_turn_shift(angles.angle_to_tile(a)), "(greatest(0, least(31, CAST(floor(angle_deg / 360 * 32) AS INT))) + 16) % 32")
register("frame_to_tile", "device_id BIGINT, channel VARCHAR, frame_no BIGINT, tile_index BIGINT, angle_deg DOUBLE, lap BIGINT, pos BIGINT, start_x BIGINT",
    lambda v: frames.frame_to_tile(v("frames")),
    "SELECT device_id, channel, frame_no, frame_no % 32 AS tile_index, (frame_no % 32) * 360 / 32.0::DOUBLE AS angle_deg, frame_no // 32 + 1 AS lap, frame_no % 32 + 1 AS pos, frame_no % 32 * 2048 AS start_x FROM frames")
register("segment_count", "session VARCHAR, segments BIGINT", lambda v: frames.segment_count(v("source_images")),
    "SELECT session, greatest(1, 65536 // arg_min(width, image_no)) AS segments FROM source_images GROUP BY session")
_XY = "(event_id % 1600) - 800.0::DOUBLE"
_E = lambda v: v("events").select("event_id", (F.col("event_id") % 1600 - F.lit(800.0)).alias("dx"), (F.lit(450.0) - F.col("event_id") % 900).alias("dy"))
register("pixel_to_angle", "event_id BIGINT, result DOUBLE", lambda v: v("events").select("event_id", angles.pixel_to_angle((F.col("event_id") % 1650 - 20).cast("double"), 1600).alias("result")),
    "SELECT event_id, CASE WHEN x < 0 THEN 0 WHEN x >= 1600 THEN 359.9 ELSE x / 1600 * 360 END AS result FROM (SELECT event_id, (event_id % 1650 - 20)::DOUBLE AS x FROM events)")
register("bearing", "event_id BIGINT, result BIGINT", lambda v: _E(v).select("event_id", angles.bearing(F.col("dx"), F.col("dy")).alias("result")),
    "SELECT event_id, CAST(trunc(CASE WHEN d < 0 THEN d + 360 ELSE d END) AS BIGINT) AS result FROM (SELECT event_id, degrees(atan2((event_id % 1600) - 800.0::DOUBLE, 450.0::DOUBLE - event_id % 900)) AS d FROM events)")
register("polar_to_xy", "event_id BIGINT, x DOUBLE, y DOUBLE",
    lambda v: v("events").select("event_id", (F.round(angles.polar_x(F.col("event_id") % 360, F.lit(0.8 * 200)), 6) + 0.0).alias("x"), (F.round(angles.polar_y(F.col("event_id") % 360, F.lit(0.8 * 200)), 6) + 0.0).alias("y")),
    "SELECT event_id, round(160.0::DOUBLE * sin(radians(event_id % 360)), 6) + 0.0::DOUBLE AS x, round(-160.0::DOUBLE * cos(radians(event_id % 360)), 6) + 0.0::DOUBLE AS y FROM events")
register("reply_parse", "cmd_id BIGINT, cmd VARCHAR, status VARCHAR", lambda v: msg.reply_parse(v("replies")),
    "SELECT cmd_id, left(reply, length(reply) - 3) AS cmd, 'OK' AS status FROM replies")
register("frame_name", "device_id BIGINT, channel VARCHAR, frame_no BIGINT, name VARCHAR", lambda v: v("frames").withColumn("name", messages.frame_name(F.col("frame_no"))),
    "SELECT device_id, channel, frame_no, printf('frame_%05d.jpg', frame_no) AS name FROM frames")
register("log_format", "event_id BIGINT, line VARCHAR", lambda v: v("log_events").select("event_id", messages.log_line(F.col("ts"), F.col("type"), F.col("msg")).alias("line")),
    """SELECT event_id, '[' || strftime(ts, '%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '] [' || type || '] ' || replace(replace(replace(replace(msg, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS line FROM log_events""")
register("log_importance", "event_id BIGINT, important BOOLEAN", lambda v: v("log_events").select("event_id", messages.is_important(F.col("type")).alias("important")),
    "SELECT event_id, contains(type, '错误') OR contains(type, '读取失败') OR contains(type, '系统') OR contains(type, 'ROI') OR starts_with(type, 'RX(') AS important FROM log_events")


def _pixels(v: Views) -> DataFrame:
    p = v.table("embeddings").select(F.col("vec_id").alias("tile_id"), F.posexplode("embedding").alias("i", "val"))
    return p.select("tile_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor(F.abs(F.col("val").cast("double")) * 255).cast("int").alias("gray"))


_PIXELS = "SELECT vec_id AS tile_id, i % 8 AS x, i // 8 AS y, CAST(floor(abs(v::DOUBLE) * 255) AS INT) AS gray FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings)"
_PIX = "tile_id BIGINT, x BIGINT, y BIGINT, gray DOUBLE"
register("gray_luma", _PIX, lambda v: _pixels(v).withColumn("gray", rasters.gray_luma(F.col("gray"), F.col("x") * 30, F.col("y") * 30)),
    f"SELECT tile_id, x, y, CAST(round(y * 30 * 0.299::DOUBLE + x * 30 * 0.587::DOUBLE + gray * 0.114::DOUBLE) AS INT) AS gray FROM ({_PIXELS})")
register("portrait_rotation", "session VARCHAR, image_no BIGINT, rotated BOOLEAN, height BIGINT, width BIGINT", lambda v: rechunk.portrait_rotation(v("source_images")),
    "SELECT session, image_no, height = 6510 AND width = 4096 AS rotated, CASE WHEN height = 6510 AND width = 4096 THEN width ELSE height END AS height, CASE WHEN height = 6510 AND width = 4096 THEN height ELSE width END AS width FROM source_images")
register("preview_downsample", _PIX, lambda v: rasters.preview_downsample(_pixels(v), 8, 8, 3, 3),
    f"SELECT p.tile_id, a.i AS x, b.i AS y, gray FROM ({_PIXELS}) p JOIN (SELECT unnest(range(3)) AS i) a ON p.x = floor((a.i + 0.5) * 8 / 3) JOIN (SELECT unnest(range(3)) AS i) b ON p.y = floor((b.i + 0.5) * 8 / 3)")
register("preview_area", _PIX, lambda v: rasters.preview_downsample(_pixels(v), 8, 8, 4, 2, "area"),
    f"SELECT tile_id, x // 2 AS x, y // 4 AS y, avg(gray) AS gray FROM ({_PIXELS}) GROUP BY ALL")
register("tile_resize", _PIX, lambda v: rasters.tile_resize(_pixels(v), 8, 8, 12, 5),
    f"SELECT p.tile_id, a.i AS x, b.i AS y, gray FROM ({_PIXELS}) p JOIN (SELECT unnest(range(12)) AS i) a ON p.x = floor((a.i + 0.5) * 8 / 12) JOIN (SELECT unnest(range(5)) AS i) b ON p.y = floor((b.i + 0.5) * 8 / 5)")

# -- filters, routing, sampling ---------------------------------------------------------------

_LOG = "arrival_seq BIGINT"
register("port_fanout", "arrival_seq BIGINT, port BIGINT", lambda v: msg.port_fanout(parse_capture_log(v("capture_log"))),
    f"""SELECT arrival_seq, unnest(CASE lower({strip("split_part(payload, ';', 1)")}) WHEN 'bw' THEN [8001, 8002] WHEN 'rgb' THEN [8001, 8003] ELSE [8001] END) AS port
       FROM path_msgs WHERE arrival_seq % 50 <> 0""")
register("systematic_sample", "arrival_seq BIGINT", lambda v: msg.systematic_sample(parse_capture_log(v("capture_log"))),
    "SELECT arrival_seq FROM (SELECT arrival_seq, row_number() OVER (ORDER BY arrival_seq) AS n FROM path_msgs WHERE arrival_seq % 50 <> 0) WHERE n % 20 = 1")
register("replay_interval", "interval_s DOUBLE", lambda v: msg.replay_interval(parse_capture_log(v("capture_log"))),
    "SELECT (epoch(date_trunc('second', max(rx_ts))) - epoch(date_trunc('second', min(rx_ts)))) / count(*) AS interval_s FROM path_msgs WHERE arrival_seq % 50 <> 0")
register("replay_schedule", "arrival_seq BIGINT, offset_s DOUBLE", lambda v: msg.replay_schedule(parse_capture_log(v("capture_log"))),
    "SELECT arrival_seq, (row_number() OVER (ORDER BY arrival_seq) - 1) * 0.5::DOUBLE AS offset_s FROM path_msgs WHERE arrival_seq % 50 <> 0")
_HALF = "SELECT doc_id, n, CASE WHEN n <= c // 2 THEN 'RGB' ELSE 'BW' END AS channel FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM documents)"
_files = lambda v: v.table("documents").select("doc_id")
register("half_split", "doc_id BIGINT, channel VARCHAR", lambda v: msg.half_split(_files(v)), f"SELECT doc_id, channel FROM ({_HALF})")
register("round_robin_pair", "tick BIGINT, colour_id BIGINT, grey_id BIGINT",
    lambda v: msg.round_robin_pair(msg.half_split(_files(v)), v("events").select(F.col("event_id").alias("tick"))),
    f"""WITH h AS ({_HALF}), r AS (SELECT doc_id, n - 1 AS i FROM h WHERE channel = 'RGB'), b AS (SELECT doc_id, n - (SELECT min(n) FROM h WHERE channel = 'BW') AS i FROM h WHERE channel = 'BW')
        SELECT event_id AS tick, r.doc_id AS colour_id, b.doc_id AS grey_id FROM events JOIN r ON event_id % (SELECT count(*) FROM r) = r.i JOIN b ON event_id % (SELECT count(*) FROM b) = b.i""")
register("sorted_files", "doc_id BIGINT, n BIGINT", lambda v: msg.numbered(_files(v), "doc_id"), "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents")
_FRAME = "device_id BIGINT, channel VARCHAR, frame_no BIGINT"
register("channel_union", f"{_FRAME}, ts MS", lambda v: frames.channel_union(v("frames").filter("channel = 'RGB'"), v("frames").filter("channel = 'BW'")), "SELECT * FROM frames")

# -- joins ------------------------------------------------------------------------------------

_LAPS = """SELECT f.*, coalesce(sum(turn) OVER (PARTITION BY device_id, channel ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lap_id
           FROM (SELECT *, CASE WHEN lag(angle_deg) OVER (PARTITION BY device_id, channel ORDER BY frame_no) > 300 AND angle_deg < 60 THEN 1 ELSE 0 END AS turn FROM frames) f"""
_NEAR = "SELECT f.*, t.angle AS target, CASE WHEN abs(angle_deg - t.angle) > 180 THEN 360 - abs(angle_deg - t.angle) ELSE abs(angle_deg - t.angle) END AS distance FROM ({}) f JOIN targets t ON least(abs(angle_deg - t.angle), 360 - abs(angle_deg - t.angle)) < {}"
register("target_detect", f"{_FRAME}, target BIGINT, distance DOUBLE", lambda v: detect.target_detect(v("frames"), v("targets")), _NEAR.format("SELECT * FROM frames", 2))
register("target_detect_bucketed", f"{_FRAME}, target BIGINT, distance DOUBLE", lambda v: detect.target_detect(v("frames"), v("targets"), tolerance=7.0, bucketed=True), _NEAR.format("SELECT * FROM frames", 7))
register("lap_id", f"{_FRAME}, lap_id BIGINT", lambda v: detect.lap_id(v("frames")), _LAPS)
register("detect_once_per_lap", f"{_FRAME}, lap_id BIGINT, target BIGINT, distance DOUBLE", lambda v: detect.detect_once_per_lap(v("frames"), v("targets")),
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, channel, lap_id, target ORDER BY frame_no) AS rn FROM ({_NEAR.format(_LAPS, 2)})) WHERE rn = 1")
register("zero_angle", "device_id BIGINT, first_ts MS, zero_deg DOUBLE", lambda v: detect.zero_angle(v("frames"), v("angle_feedback")),
    """SELECT device_id, first_ts, coalesce((SELECT arg_max(angle_deg, seq) FROM angle_feedback a WHERE a.device_id = f.device_id AND a.ts <= f.first_ts), 0) AS zero_deg
       FROM (SELECT device_id, min(ts) AS first_ts FROM frames GROUP BY device_id) f""")


def _requests(v: Views) -> DataFrame:
    c = v("commands").filter("cmd in ('TG_SAVE_PNG;', 'TG_SAVE_JPG;')")
    return c.select(F.col("cmd_id").alias("request_id"), "device_id", F.when(F.col("cmd_id") % 2 == 0, "RGB").otherwise("BW").alias("channel"), (F.col("cmd_id") % 2).alias("tag"), (F.col("cmd_id") * 7 % 360).cast("double").alias("angle"), "ts")


_REQUESTS = "SELECT cmd_id AS request_id, device_id, CASE WHEN cmd_id % 2 = 0 THEN 'RGB' ELSE 'BW' END AS channel, cmd_id % 2 AS tag, CAST(floor((cmd_id * 7 % 360) / 360.0::DOUBLE * 32) AS INT) AS tile_index, ts FROM commands WHERE cmd IN ('TG_SAVE_PNG;', 'TG_SAVE_JPG;')"
register("roi_lookup", "request_id BIGINT, tag BIGINT, device_id BIGINT, channel VARCHAR, tile_index BIGINT, frame_no BIGINT", lambda v: frames.roi_lookup(v("frames"), _requests(v)),
    f"""SELECT r.request_id, r.tag, r.device_id, r.channel, r.tile_index, f.frame_no FROM ({_REQUESTS}) r ASOF LEFT JOIN frames f
        ON r.device_id = f.device_id AND r.channel = f.channel AND r.tile_index = f.tile_index AND r.ts >= f.ts""")
register("circular_range_slice", "request_id BIGINT, tile_index BIGINT, src_from BIGINT, src_to BIGINT, dst_from BIGINT",
    lambda v: frames.circular_range_slice(v("events").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 977 - 5000).alias("start"), F.lit(2048).cast("long").alias("width"))),
    """SELECT request_id, t AS tile_index, greatest(s, first) - first AS src_from, least(s + 2048, first + 2048) - first AS src_to, greatest(s, first) - s AS dst_from
       FROM (SELECT event_id AS request_id, (((event_id * 977 - 5000) % 65536) + 65536) % 65536 AS s FROM events) r JOIN (SELECT unnest(range(64)) AS k) q ON true,
       LATERAL (SELECT k * 2048 AS first, k % 32 AS t) WHERE first < s + 2048 AND first + 2048 > s""")
register("tile_pixel_span", f"{_FRAME}, start_x BIGINT, end_x BIGINT, right_w BIGINT, left_w BIGINT", lambda v: frames.tile_pixel_span(v("frames"), 2000, 63000),
    "SELECT device_id, channel, frame_no, s AS start_x, s + 2000 AS end_x, least(2000, 63000 - s) AS right_w, 2000 - least(2000, 63000 - s) AS left_w FROM (SELECT *, tile_index * 2000 % 63000 AS s FROM frames)")
_snaps = lambda v: v("frames").select((F.col("device_id") * 1000 + F.floor(F.col("frame_no") / 32)).alias("request_id"), "channel", "ts", "frame_no")
_PAIRS = "SELECT * FROM (SELECT device_id * 1000 + frame_no // 32 AS request_id, min(frame_no) FILTER (channel = 'RGB') AS rgb_frame, min(frame_no) FILTER (channel = 'BW') AS bw_frame FROM frames GROUP BY 1) WHERE rgb_frame IS NOT NULL AND bw_frame IS NOT NULL"
register("snapshot_pair", "request_id BIGINT, rgb_frame BIGINT, bw_frame BIGINT", lambda v: frames.snapshot_pair(_snaps(v)), _PAIRS)
register("snapshot_size", "cmd_id BIGINT, need_bytes BIGINT, ok BOOLEAN",
    lambda v: frames.snapshot_size(v("commands").select("cmd_id", (F.col("cmd_id") % 65536).alias("w"), F.lit(4096).alias("h"), F.when(F.col("cmd_id") % 5 > 0, F.lit(200_000_000).cast("long")).alias("free_bytes"))),
    "SELECT cmd_id, need_bytes, cmd_id % 5 = 0 OR need_bytes <= 200000000 AS ok FROM (SELECT cmd_id, 54 + 3 * (cmd_id % 65536) * 4096 + 1078 + (cmd_id % 65536) * 4096 + 67108864 AS need_bytes FROM commands)")
_MATCH = """SELECT c.cmd_id, c.device_id, c.cmd, min(r.ts) AS reply_ts, (epoch_us(min(r.ts)) - epoch_us(any_value(c.ts))) / 1e6::DOUBLE AS latency_s
            FROM commands c LEFT JOIN replies r ON c.device_id = r.device_id AND r.reply = c.cmd || CASE WHEN c.cmd LIKE '%;' THEN '' ELSE ';' END || 'OK;' AND r.ts BETWEEN c.ts AND c.ts + INTERVAL 5 SECOND GROUP BY ALL"""
register("command_reply_match", "cmd_id BIGINT, device_id BIGINT, cmd VARCHAR, reply_ts MS, latency_s DOUBLE", lambda v: msg.command_reply_match(v("commands"), v("replies")), _MATCH)
register("unanswered_commands", "cmd_id BIGINT, device_id BIGINT, cmd VARCHAR", lambda v: msg.unanswered_commands(v("commands"), v("replies")), f"SELECT * FROM ({_MATCH}) WHERE reply_ts IS NULL")
_LAP_SQL = """WITH e AS (SELECT device_id, ts, seq AS n, angle_deg, NULL AS cmd, 1 AS kind FROM angle_feedback UNION ALL SELECT device_id, ts, event_id, NULL, cmd, 0 FROM motion_commands WHERE cmd IN ('turnLeft', 'turnRight', 'stop')),
 s AS (SELECT *, count(*) FILTER (cmd IN ('turnLeft', 'turnRight')) OVER w AS epoch, last_value(cmd IGNORE NULLS) OVER w AS state,
              last_value(angle_deg IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
       FROM e WINDOW w AS (PARTITION BY device_id ORDER BY ts, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 x AS (SELECT *, lag(ts) OVER (PARTITION BY device_id, epoch ORDER BY ts, n) AS last FROM s WHERE kind = 1 AND abs(angle_deg - prev) > 300 AND state <> 'stop')
 SELECT device_id, epoch, ts, (epoch_us(ts) - epoch_us(last)) / 1e6::DOUBLE AS lap_seconds FROM x WHERE last IS NOT NULL"""
register("lap_times", "device_id BIGINT, epoch BIGINT, ts MS, lap_seconds DOUBLE", lambda v: laps.lap_times(v("angle_feedback"), v("motion_commands")), _LAP_SQL)
register("nominal_lap_join", "device_id BIGINT, ts MS, speed BIGINT, nominal_lap_s DOUBLE, lap_seconds DOUBLE, diff_s DOUBLE",
    lambda v: laps.nominal_lap_join(laps.lap_times(v("angle_feedback"), v("motion_commands")), v("motion_commands"), v("speed_profile")),
    f"""SELECT l.device_id, l.ts, t.speed, p.nominal_lap_s, l.lap_seconds, l.lap_seconds - p.nominal_lap_s AS diff_s FROM ({_LAP_SQL}) l
        LEFT JOIN (SELECT device_id, speed, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS epoch FROM motion_commands WHERE cmd IN ('turnLeft', 'turnRight')) t ON l.device_id = t.device_id AND l.epoch = t.epoch
        LEFT JOIN speed_profile p ON t.speed = p.speed""")
register("device_state", "cmd_id BIGINT, device_id BIGINT, is_open BOOLEAN", lambda v: msg.device_state(v("commands")),
    """SELECT cmd_id, device_id, coalesce(last_value(CASE cmd WHEN 'TG_OPEN_DEVICE;' THEN true WHEN 'TG_CLOSE_DEVICE;' THEN false END IGNORE NULLS)
       OVER (PARTITION BY device_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_open FROM commands""")

# -- aggregations and windows -----------------------------------------------------------------

register("mosaic_latest", "device_id BIGINT, channel VARCHAR, tile_index BIGINT, frame_no BIGINT, ts MS", lambda v: frames.mosaic_latest(v("frames")),
    "SELECT device_id, channel, CASE channel WHEN 'BW' THEN (tile_index + 16) % 32 ELSE tile_index END AS tile_index, max(frame_no) AS frame_no, arg_max(ts, frame_no) AS ts FROM frames GROUP BY ALL")
_COVER = "SELECT {0}, count(DISTINCT tile_index) FILTER (channel = 'RGB') AS rgb_tiles, count(DISTINCT tile_index) FILTER (channel = 'BW') AS bw_tiles FROM ({1}) GROUP BY {0}"
register("coverage_ready", "device_id BIGINT, rgb_tiles BIGINT, bw_tiles BIGINT, ready BOOLEAN", lambda v: frames.coverage_ready(v("frames")),
    f"SELECT *, rgb_tiles >= 32 AND bw_tiles >= 32 AS ready FROM ({_COVER.format('device_id', 'SELECT * FROM frames')})")
register("coverage_ready_edge", "device_id BIGINT, ready_ts MS", lambda v: frames.coverage_ready_edge(v("frames")),
    "SELECT device_id, CASE WHEN count(*) FILTER (channel = 'RGB') >= 32 AND count(*) FILTER (channel = 'BW') >= 32 THEN max(ts) END AS ready_ts FROM (SELECT device_id, channel, tile_index, min(ts) AS ts FROM frames GROUP BY ALL) GROUP BY device_id")
_clears = lambda v: v("commands").filter("cmd = 'TG_CLOSE_DEVICE;' and cmd_id % 20 = 0").select("device_id", "ts")
register("clear_epoch", "device_id BIGINT, epoch BIGINT, rgb_tiles BIGINT, bw_tiles BIGINT, ready BOOLEAN",
    lambda v: frames.coverage_ready(frames.clear_epoch(v("frames"), _clears(v)), keys=("device_id", "epoch")),
    "SELECT *, rgb_tiles >= 32 AND bw_tiles >= 32 AS ready FROM (" + _COVER.format("device_id, epoch", "SELECT f.*, (SELECT count(*) FROM commands c WHERE c.cmd = 'TG_CLOSE_DEVICE;' AND c.cmd_id % 20 = 0 AND c.device_id = f.device_id AND c.ts <= f.ts) AS epoch FROM frames f") + ")")


def _outcomes(v: Views) -> DataFrame:
    """Path messages with their load outcome: each one's file of the polls view, decoding by a rule of the sequence number."""
    p = msg.path_message_parse(v("path_msgs")).withColumn("file_id", F.col("arrival_seq") % 10 + 10 * F.floor(F.col("arrival_seq") / 800))
    return msg.load_outcome(p, msg.file_stable(v("file_polls"), 600), msg.decode_retry_window(_tries(v)))


def _tries(v: Views) -> DataFrame:
    """60 attempts to decode each file; some fail for good, some at first."""
    k, n = F.col("file_id") % 10, F.col("seq")
    wrong = F.when((k % 3 == 0) | (n < 20 + k * 4), F.when(k % 2 == 0, "convert").otherwise("truncated"))
    return v("file_polls").filter("seq <= 60").select("file_id", (n * 30).alias("attempt_ms"), wrong.alias("error"))


_STABLE = "SELECT DISTINCT p.file_id, s.stable_ms, s.size FROM file_polls p LEFT JOIN (SELECT file_id, min(poll_ms) AS stable_ms, arg_min(size, seq) AS size FROM (SELECT *, lag(size) OVER (PARTITION BY file_id ORDER BY seq) AS b FROM file_polls WHERE poll_ms <= {}) WHERE size > 0 AND size = b GROUP BY file_id) s ON p.file_id = s.file_id"
_TRIES = "SELECT file_id, seq * 30 AS attempt_ms, CASE WHEN file_id % 10 % 3 = 0 OR seq < 20 + file_id % 10 * 4 THEN CASE WHEN file_id % 10 % 2 = 0 THEN 'convert' ELSE 'truncated' END END AS error FROM file_polls WHERE seq <= 60"
_DECODED = f"SELECT file_id, decoded_ms, CASE WHEN decoded_ms IS NULL THEN e END AS error FROM (SELECT file_id, min(CASE WHEN error IS NULL THEN attempt_ms END) AS decoded_ms, arg_max(error, attempt_ms) AS e FROM ({_TRIES}) WHERE attempt_ms <= 1200 GROUP BY file_id)"
_OUTCOME = f"""SELECT p.*, CASE WHEN s.stable_ms IS NULL THEN 'not_ready' WHEN d.decoded_ms IS NOT NULL THEN 'ok' WHEN d.error = 'convert' THEN 'convert_failed' ELSE 'decode_failed' END AS outcome
               FROM ({_PATH_SQL}) p LEFT JOIN ({_STABLE.format(600)}) s ON p.arrival_seq % 10 + 10 * (p.arrival_seq // 800) = s.file_id LEFT JOIN ({_DECODED}) d ON p.arrival_seq % 10 + 10 * (p.arrival_seq // 800) = d.file_id"""
register("file_stable", "file_id BIGINT, stable_ms BIGINT, size BIGINT", lambda v: msg.file_stable(v("file_polls")), _STABLE.format(2000))
register("decode_retry_window", "file_id BIGINT, decoded_ms BIGINT, error VARCHAR",
    lambda v: msg.decode_retry_window(_tries(v)), _DECODED)
register("load_outcome", "device_id BIGINT, arrival_seq BIGINT, outcome VARCHAR", _outcomes, _OUTCOME)
register("arrival_index", "device_id BIGINT, channel VARCHAR, arrival_seq BIGINT, frame_no BIGINT", lambda v: msg.arrival_index(msg.channel_route(_outcomes(v))),
    f"SELECT *, row_number() OVER (PARTITION BY device_id, channel ORDER BY arrival_seq) - 1 AS frame_no FROM ({_OUTCOME}) WHERE outcome = 'ok' AND channel IS NOT NULL")
_STATS = f"""SELECT device_id, CAST(floor(epoch(rx_ts) / 3600) * 3600 AS BIGINT) AS win_start, count(*) AS packets, count(*) FILTER (outcome = 'ok') AS ok, 0 AS drop,
             count(*) FILTER (outcome <> 'ok') AS fail, arg_max(type, arrival_seq) AS last_type, arg_max(path, arrival_seq) AS last_path
             FROM (SELECT m.*, o.type, o.path, o.outcome FROM path_msgs m LEFT JOIN ({_OUTCOME}) o ON m.arrival_seq = o.arrival_seq) GROUP BY 1, 2"""


def _stats(v: Views) -> DataFrame:
    got = _outcomes(v).select("arrival_seq", "type", "path", "outcome")
    return msg.rx_stats(v("path_msgs").join(got, "arrival_seq", "left"), 3600)


_STAT = "device_id BIGINT, win_start BIGINT, packets BIGINT, ok BIGINT, drop BIGINT, fail BIGINT, last_type VARCHAR, last_path VARCHAR"
register("rx_stats", _STAT, _stats, _STATS)
register("running_totals", "device_id BIGINT, win_start BIGINT, packets BIGINT, total_packets BIGINT, delta_packets BIGINT", lambda v: msg.running_totals(_stats(v)),
    f"SELECT device_id, win_start, packets, sum(packets) OVER w AS total_packets, packets - coalesce(lag(packets) OVER (PARTITION BY device_id ORDER BY win_start), 0) AS delta_packets FROM ({_STATS}) WINDOW w AS (PARTITION BY device_id ORDER BY win_start)")


def _received_all(v: Views) -> DataFrame:
    """Messages with outcome, sender and length; a read call begins at every third; resets of the frame counter give up a frame."""
    got = _outcomes(v).select("arrival_seq", "type", "path", "outcome")
    rows = v("path_msgs").withColumns({"length": F.octet_length("payload"), "wake": F.col("arrival_seq") % 3 == 0}).join(got, "arrival_seq", "left")
    epochs = running(written(packets.counter_epoch(v("frame_index_stream")), "epochs"), ["device_id"], ["seq"], {"__before": ("last", F.col("epoch"), True)})
    resets = epochs.filter("epoch > __before")
    return msg.with_evictions(rows, resets.select("device_id", F.col("ts").alias("rx_ts")))


_STAT_ALL = f"{_STAT}, last_sender VARCHAR, last_length BIGINT, wakes BIGINT"
_STATS_ALL = f"""SELECT device_id, CAST(floor(epoch(rx_ts) / 3600) * 3600 AS BIGINT) AS win_start, count(arrival_seq) AS packets, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (arrival_seq IS NULL) AS drop,
             count(*) FILTER (outcome <> 'ok') AS fail, arg_max(type, arrival_seq) AS last_type, arg_max(path, arrival_seq) AS last_path, arg_max(sender, arrival_seq) AS last_sender, arg_max(length, arrival_seq) AS last_length,
             count(*) FILTER (arrival_seq % 3 = 0) AS wakes
             FROM (SELECT m.device_id, m.rx_ts, m.arrival_seq, m.sender, octet_length(encode(m.payload)) AS length, o.type, o.path, o.outcome FROM path_msgs m LEFT JOIN ({_OUTCOME}) o ON m.arrival_seq = o.arrival_seq
                   UNION ALL SELECT device_id, ts, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT *, lag(image_index) OVER (PARTITION BY device_id ORDER BY seq) AS before FROM frame_index_stream) WHERE image_index + 1000 < before) GROUP BY 1, 2"""
register("rx_stats_full", _STAT_ALL, lambda v: msg.rx_stats(_received_all(v), 3600), _STATS_ALL)
_TOTALS = "SELECT *, sum(packets) OVER w AS total_packets, packets - coalesce(lag(packets) OVER (PARTITION BY device_id ORDER BY win_start), 0) AS delta_packets, sum(wakes) OVER w AS total_wakes FROM ({}) WINDOW w AS (PARTITION BY device_id ORDER BY win_start)"
_TOTAL_ALL = f"{_STAT_ALL}, total_packets BIGINT, delta_packets BIGINT, total_wakes BIGINT"
register("running_totals_full", _TOTAL_ALL, lambda v: msg.running_totals(msg.rx_stats(_received_all(v), 3600)), _TOTALS.format(_STATS_ALL))
register("log_tail", "event_id BIGINT, device_id BIGINT, rn BIGINT", lambda v: msg.log_tail(v("log_events"), 100),
    "SELECT * FROM (SELECT event_id, device_id, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) AS rn FROM log_events) WHERE rn <= 100")

# -- re-chunking ------------------------------------------------------------------------------

_SPANS = "SELECT *, sum(width) OVER (PARTITION BY session ORDER BY image_no) - width AS s, sum(width) OVER (PARTITION BY session ORDER BY image_no) AS e, sum(width) OVER (PARTITION BY session) // 2048 AS full_frames FROM source_images"
_CHUNK = f"""SELECT session, f AS frame_no, image_no, greatest(s, f * 2048) - s AS src_from, least(e, (f + 1) * 2048) - s AS src_to, greatest(s, f * 2048) - f * 2048 AS dst_from
             FROM (SELECT *, unnest(range(CAST(s // 2048 AS BIGINT), CAST((e - 1) // 2048 + 1 AS BIGINT))) AS f FROM ({_SPANS})) WHERE f < full_frames"""
register("column_rechunk", "session VARCHAR, frame_no BIGINT, image_no BIGINT, src_from BIGINT, src_to BIGINT, dst_from BIGINT", lambda v: rechunk.column_rechunk(v("source_images")), _CHUNK)
register("frame_emit_at", "session VARCHAR, frame_no BIGINT, emit_image BIGINT", lambda v: rechunk.frame_emit_at(v("source_images")), f"SELECT session, frame_no, max(image_no) AS emit_image FROM ({_CHUNK}) GROUP BY ALL")
_blocks = lambda v, size: packets.payload_blocks(v.table("documents").select("doc_id", F.col("text").alias("payload")), size=size)
register("payload_blocks", "doc_id BIGINT, block_index BIGINT, block_size BIGINT, offset BIGINT", lambda v: _blocks(v, 1000),
    'SELECT doc_id, k AS block_index, least(1000, n - k * 1000) AS block_size, k * 1000 AS "offset" FROM (SELECT doc_id, strlen(text) AS n, unnest(range((strlen(text) + 999) // 1000)) AS k FROM documents)')
register("blocks_roundtrip", "doc_id BIGINT, equal BOOLEAN",
    lambda v: packets.frame_reassembly_ordered(_blocks(v, 1000).select(F.lit(1).alias("image_type"), F.col("doc_id").alias("image_index"), (F.lit(0) - F.col("block_index")).alias("arrival_seq"), "block_index", "block_size", "total_size", F.col("block").alias("payload")), ["image_type"])
        .join(v.table("documents").select(F.col("doc_id").alias("image_index"), "text"), "image_index").select(F.col("image_index").alias("doc_id"), ((F.col("payload") == F.col("text").cast("binary")) & F.col("complete")).alias("equal")),
    "SELECT doc_id, true AS equal FROM documents WHERE length(text) > 0")

# -- sequential operators ---------------------------------------------------------------------


def pool_packets(v: Views) -> DataFrame:
    """Packets of two devices with two channels each, payloads as bytes."""
    return v("packets").select((F.floor(F.col("image_index") / 2) % 2).alias("device_id"), F.col("image_type").cast("string").alias("channel"), "image_index", "total_size", "arrival_seq", "rx_ms", F.col("payload").cast("binary").alias("payload"))


_POOL_PACKETS = "SELECT image_index // 2 % 2 AS device_id, CAST(image_type AS VARCHAR) AS channel, image_index, total_size, arrival_seq, rx_ms, block_size FROM packets"
_PACKETS = ["image_type"]


def _ordered_sql(source: str) -> str:
    return f"""SELECT image_type, image_index, count(*) AS blocks, sum(block_size) AS bytes, sum(block_size) = max(total_size) AS complete, string_agg(payload, '' ORDER BY block_index) AS payload
       FROM (SELECT *, row_number() OVER (PARTITION BY image_type, image_index, block_index ORDER BY arrival_seq) AS rn FROM {source}) WHERE rn = 1 GROUP BY ALL"""


def _walk_sql(source: str) -> str:
    """The fold of a frame's packets: bytes so far, and the first total above zero, of every generation."""
    got, total = "CASE WHEN w.done THEN 0 ELSE got END + p.block_size", "CASE WHEN w.done OR total = 0 THEN p.total_size ELSE total END"
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY image_type, image_index ORDER BY arrival_seq) AS n FROM {source}),
       walk AS (SELECT image_type, image_index, n, payload, block_size, 0 AS generation, block_size AS got, total_size AS total, total_size > 0 AND block_size >= total_size AS done FROM p WHERE n = 1
         UNION ALL SELECT p.image_type, p.image_index, p.n, p.payload, p.block_size, CASE WHEN w.done THEN generation + 1 ELSE generation END, {got}, {total}, {total} > 0 AND {got} >= {total}
           FROM walk w JOIN p ON p.image_type = w.image_type AND p.image_index = w.image_index AND p.n = w.n + 1)
       SELECT image_type, image_index, generation, count(*) AS packets, sum(block_size) AS bytes, bool_or(done) AS complete, string_agg(payload, '' ORDER BY n) AS payload FROM walk GROUP BY ALL"""


register("frame_reassembly_ordered", "image_type BIGINT, image_index BIGINT, blocks BIGINT, bytes BIGINT, complete BOOLEAN, payload VARCHAR", lambda v: packets.frame_reassembly_ordered(v("packets"), _PACKETS), _ordered_sql("packets"))
register("frame_reassembly", "image_type BIGINT, image_index BIGINT, generation BIGINT, packets BIGINT, bytes BIGINT, complete BOOLEAN, payload VARCHAR", lambda v: packets.frame_reassembly(v("packets"), _PACKETS), _walk_sql("packets"))
# The whole way of binary frames: landed datagrams, classified, decoded, put together; bytes as hexadecimal text.
_binary = lambda v: packets.packet_header_decode(packets.packet_classify(_landed(v)).filter("kind = 'binary'").drop("kind"))
_LANDED = f"(SELECT * FROM packets WHERE {_KIND} = 'binary')"
_hexed = lambda frames: frames.withColumn("payload_hex", F.hex("payload"))
register("frame_reassembly_binary", "image_type BIGINT, image_index BIGINT, generation BIGINT, packets BIGINT, bytes BIGINT, complete BOOLEAN, payload_hex VARCHAR", lambda v: _hexed(packets.frame_reassembly(_binary(v), _PACKETS)), f"SELECT *, hex(payload) AS payload_hex FROM ({_walk_sql(_LANDED)})")
register("frame_reassembly_ordered_binary", "image_type BIGINT, image_index BIGINT, blocks BIGINT, bytes BIGINT, complete BOOLEAN, payload_hex VARCHAR", lambda v: _hexed(packets.frame_reassembly_ordered(_binary(v), _PACKETS)), f"SELECT *, hex(payload) AS payload_hex FROM ({_ordered_sql(_LANDED)})")
_EPOCHS = """WITH RECURSIVE walk AS (SELECT device_id, seq, image_index, 0 AS epoch, image_index AS max_seen FROM frame_index_stream WHERE seq = 1
         UNION ALL SELECT s.device_id, s.seq, s.image_index, CASE WHEN max_seen <> 0 AND s.image_index + 1000 < max_seen THEN epoch + 1 ELSE epoch END,
           CASE WHEN max_seen <> 0 AND s.image_index + 1000 < max_seen THEN s.image_index ELSE greatest(max_seen, s.image_index) END
           FROM walk w JOIN frame_index_stream s ON s.device_id = w.device_id AND s.seq = w.seq + 1) SELECT * FROM walk"""
_EPOCH = "device_id BIGINT, seq BIGINT, image_index BIGINT, epoch BIGINT, max_seen BIGINT"
register("counter_epoch", _EPOCH, lambda v: packets.counter_epoch(v("frame_index_stream")), _EPOCHS)
register("seq_watermark", "image_type BIGINT, image_index BIGINT, arrival_seq BIGINT, kept BOOLEAN", lambda v: packets.seq_watermark(v("packets").withColumn("arrival_seq", F.col("arrival_seq")), _PACKETS, 2),
    "SELECT image_type, image_index, arrival_seq, image_index >= max(image_index) OVER (PARTITION BY image_type ORDER BY arrival_seq) - 2 AS kept FROM packets")
register("stall_timeout", "image_type BIGINT, image_index BIGINT, arrival_seq BIGINT, stalled BOOLEAN, old BOOLEAN", lambda v: packets.stall_timeout(v("packets"), _PACKETS),
    """SELECT image_type, image_index, arrival_seq, coalesce(s2 > s1 AND m2 - m1 > 1500, false) AS stalled, coalesce(s2 > s1 AND m2 - m0 > 5000, false) AS old FROM (SELECT *, first_value(rx_ms) OVER f AS m0, lag(rx_ms) OVER f AS m1, lag(arrival_seq) OVER f AS s1, lag(rx_ms) OVER c AS m2, lag(arrival_seq) OVER c AS s2
       FROM packets WINDOW f AS (PARTITION BY image_type, image_index ORDER BY arrival_seq), c AS (PARTITION BY image_type ORDER BY arrival_seq))""")
_POOLED = "device_id BIGINT, channel VARCHAR, image_index BIGINT, generation BIGINT, epoch BIGINT, packets BIGINT, bytes BIGINT, reason VARCHAR"


def _pool_sql(sweep: int) -> str:
    """The fold of a channel's packets over a list of open frames: a row a packet, with what it completes and evicts."""
    frame = "STRUCT(i BIGINT, total BIGINT, bytes BIGINT, n BIGINT, created BIGINT, updated BIGINT, swept BIGINT, generation BIGINT, reason VARCHAR)[]"
    return f"""WITH RECURSIVE p AS (SELECT device_id, channel, image_index AS idx, total_size, block_size AS size, rx_ms AS now, row_number() OVER (PARTITION BY device_id, channel ORDER BY arrival_seq) AS n FROM ({_POOL_PACKETS})),
       walk AS (SELECT device_id, channel, 0::BIGINT AS n, 0::BIGINT AS idx, 0::BIGINT AS top, 0::BIGINT AS epoch, []::{frame} AS opened, []::STRUCT(i BIGINT, g BIGINT)[] AS gens, []::STRUCT(i BIGINT, reason VARCHAR)[] AS gone, false AS done, []::{frame} AS own FROM p WHERE n = 1
         UNION ALL SELECT device_id, channel, n, idx, top, epoch, list_filter(judged, lambda x: x.reason IS NULL AND NOT (done AND x.i = idx))::{frame},
           CASE WHEN done THEN list_append(list_filter(gens, lambda x: x.i <> idx), struct_pack(i := idx, g := own[1].generation + 1)) ELSE gens END,
           list_concat(gone, list_transform(list_filter(judged, lambda x: x.reason IS NOT NULL), lambda x: struct_pack(i := x.i, reason := x.reason))), done, own::{frame}
         FROM (SELECT *, own[1].reason IS NULL AND own[1].total > 0 AND own[1].bytes >= own[1].total AS done
           FROM (SELECT *, list_filter(judged, lambda x: x.i = idx) AS own
             FROM (SELECT * REPLACE (CASE WHEN due THEN list_filter(gens, lambda x: x.i >= top - 30) ELSE gens END AS gens), list_transform(opened, lambda x: struct_pack(i := x.i, total := x.total, bytes := x.bytes, n := x.n, created := x.created, updated := x.updated,
                 swept := CASE WHEN due THEN x.bytes ELSE x.swept END, generation := x.generation,
                 reason := CASE WHEN NOT due THEN NULL WHEN x.i < top - 30 THEN CASE WHEN x.i = idx THEN 'late' ELSE 'behind' END WHEN x.bytes <> x.swept THEN NULL WHEN now - x.updated > 1500 THEN 'stalled' WHEN now - x.created > 5000 THEN 'old' END)) AS judged
               FROM (SELECT *, n % {sweep} = 0 OR len(opened) > 128 AS due
                 FROM (SELECT * REPLACE (list_append(list_filter(opened, lambda x: x.i <> idx), struct_pack(i := idx, total := CASE WHEN coalesce(had.total, 0) = 0 THEN total_size ELSE had.total END, bytes := coalesce(had.bytes, 0) + size, n := coalesce(had.n, 0) + 1,
                     created := CASE WHEN coalesce(had.total, 0) = 0 THEN now ELSE had.created END, updated := now, swept := CASE WHEN coalesce(had.total, 0) = 0 THEN 0 ELSE had.swept END, generation := coalesce(had.generation, list_filter(gens, lambda x: x.i = idx)[1].g, 0), reason := NULL))::{frame} AS opened)
                   FROM (SELECT *, list_filter(opened, lambda x: x.i = idx)[1] AS had
                     FROM (SELECT p.device_id, p.channel, p.n, p.idx, p.total_size, p.size, p.now, CASE WHEN reset THEN p.idx ELSE greatest(top, p.idx) END AS top, epoch + reset::INT AS epoch, CASE WHEN reset THEN []::{frame} ELSE opened END AS opened, CASE WHEN reset THEN [] ELSE gens END AS gens,
                         CASE WHEN reset THEN list_transform(opened, lambda x: struct_pack(i := x.i, reason := 'reset')) ELSE [] END AS gone
                       FROM (SELECT w.*, w.top <> 0 AND p.idx + 1000 < w.top AS reset, p FROM walk w JOIN p ON p.device_id = w.device_id AND p.channel = w.channel AND p.n = w.n + 1)))))))))
       SELECT device_id, channel, idx AS image_index, own[1].generation AS generation, epoch, own[1].n AS packets, own[1].bytes AS bytes, NULL AS reason FROM walk WHERE done
       UNION ALL SELECT device_id, channel, g.i, NULL, epoch, NULL, NULL, g.reason FROM (SELECT device_id, channel, epoch, unnest(gone) AS g FROM walk)"""


register("sweep_trigger", _POOLED, lambda v: reassembly_batch(pool_packets(v), sweep=64), _pool_sql(64))
_THROTTLE = """WITH RECURSIVE f AS (SELECT device_id, channel, frame_no, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY device_id, channel ORDER BY ts, frame_no) AS n FROM frames),
   walk AS (SELECT device_id, channel, frame_no, n, ms AS last, true AS kept FROM f WHERE n = 1
     UNION ALL SELECT f.device_id, f.channel, f.frame_no, f.n, CASE WHEN f.ms - last >= 3600000 THEN f.ms ELSE last END, f.ms - last >= 3600000 FROM walk w JOIN f ON f.device_id = w.device_id AND f.channel = w.channel AND f.n = w.n + 1)
   SELECT device_id, channel, frame_no FROM walk WHERE kept"""
_ms = lambda c: F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(c))
_timed = lambda v: v("frames").withColumn("ms", _ms("ts"))
register("throttle", _FRAME, lambda v: detect.throttle(_timed(v), ["device_id", "channel"], "ms", 3_600_000, ["ms", "frame_no"]), _THROTTLE)
register("log_throttle", "event_id BIGINT, device_id BIGINT, important BOOLEAN", lambda v: msg.log_throttle(v("log_events"), 500),
    """WITH RECURSIVE e AS (SELECT event_id, device_id, ms, contains(type, '系统') OR contains(type, 'ROI') OR starts_with(type, 'RX(') AS imp, row_number() OVER (PARTITION BY device_id ORDER BY ms, event_id) AS n FROM log_events),
       walk AS (SELECT event_id, device_id, n, imp, ms AS last, true AS kept FROM e WHERE n = 1
         UNION ALL SELECT e.event_id, e.device_id, e.n, e.imp, CASE WHEN e.imp OR e.ms - last >= 500 THEN e.ms ELSE last END, e.imp OR e.ms - last >= 500 FROM walk w JOIN e ON e.device_id = w.device_id AND e.n = w.n + 1)
       SELECT event_id, device_id, imp AS important FROM walk WHERE kept""")
_DETECTIONS = """WITH RECURSIVE f AS (SELECT device_id, channel, frame_no, angle_deg, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY device_id, channel ORDER BY ts, frame_no) AS n FROM frames),
       a AS (SELECT device_id, channel, frame_no, angle_deg, ms, n, ms AS last, true AS kept FROM f WHERE n = 1
         UNION ALL SELECT f.device_id, f.channel, f.frame_no, f.angle_deg, f.ms, f.n, CASE WHEN f.ms - last >= 60000 THEN f.ms ELSE last END, f.ms - last >= 60000 FROM a JOIN f ON f.device_id = a.device_id AND f.channel = a.channel AND f.n = a.n + 1),
       k AS (SELECT *, row_number() OVER (PARTITION BY device_id, channel ORDER BY n) AS m, CASE WHEN lag(angle_deg) OVER (PARTITION BY device_id, channel ORDER BY n) > 300 AND angle_deg < 60 THEN 1 ELSE 0 END AS turn FROM a WHERE kept),
       l AS (SELECT *, coalesce(sum(turn) OVER (PARTITION BY device_id, channel ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lap_id FROM k),
       b AS (SELECT device_id, channel, frame_no, angle_deg, lap_id, m, ms AS last, true AS looked FROM l WHERE m = 1
         UNION ALL SELECT l.device_id, l.channel, l.frame_no, l.angle_deg, l.lap_id, l.m, CASE WHEN l.ms - b.last >= 120000 THEN l.ms ELSE b.last END, l.ms - b.last >= 120000 FROM b JOIN l ON l.device_id = b.device_id AND l.channel = b.channel AND l.m = b.m + 1)
       SELECT device_id, channel, lap_id, t.angle AS target, min(frame_no) AS frame_no FROM b JOIN targets t ON least(abs(angle_deg - t.angle), 360 - abs(angle_deg - t.angle)) < 2 WHERE looked GROUP BY ALL"""
register("detection_batch", "device_id BIGINT, channel VARCHAR, lap_id BIGINT, target BIGINT, frame_no BIGINT", lambda v: detect.detection_batch(_timed(v), v("targets"), 60_000, 120_000), _DETECTIONS)

# -- clear events -----------------------------------------------------------------------------

_CLEARS = "SELECT device_id, ts FROM commands WHERE cmd = 'TG_CLOSE_DEVICE;' AND cmd_id % 20 = 0"
_EPOCH_OF = f"(SELECT count(*) FROM ({_CLEARS}) c WHERE c.device_id = {{0}}.device_id AND c.ts <= {{0}}.ts)"
_AFTER = f"NOT EXISTS (SELECT 1 FROM ({_CLEARS}) c WHERE c.device_id = {{0}}.device_id AND c.ts > {{0}}.ts)"
register("zero_angle_cleared", "device_id BIGINT, epoch BIGINT, first_ts MS, zero_deg DOUBLE", lambda v: detect.zero_angle(v("frames"), v("angle_feedback"), clears=_clears(v)),
    f"""SELECT device_id, epoch, first_ts, coalesce((SELECT arg_max(angle_deg, seq) FROM angle_feedback a WHERE a.device_id = f.device_id AND a.ts <= f.first_ts), 0) AS zero_deg
       FROM (SELECT device_id, {_EPOCH_OF.format('g')} AS epoch, min(ts) AS first_ts FROM frames g GROUP BY ALL) f""")
register("detect_once_per_lap_cleared", f"{_FRAME}, lap_id BIGINT, epoch BIGINT, target BIGINT, distance DOUBLE", lambda v: detect.detect_once_per_lap(v("frames"), v("targets"), clears=_clears(v)),
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, channel, lap_id, epoch, target ORDER BY frame_no) AS rn FROM (SELECT n.*, {_EPOCH_OF.format('n')} AS epoch FROM ({_NEAR.format(_LAPS, 2)}) n)) WHERE rn = 1")
register("log_tail_cleared", "event_id BIGINT, device_id BIGINT, rn BIGINT", lambda v: msg.log_tail(v("log_events"), 100, _clears(v)),
    f"SELECT * FROM (SELECT event_id, device_id, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) AS rn FROM log_events l WHERE {_AFTER.format('l')}) WHERE rn <= 100")
_MOSAIC_CLEARED = f"""SELECT device_id, channel, CASE channel WHEN 'BW' THEN (tile_index + 16) % 32 ELSE tile_index END AS tile_index, max(frame_no) AS frame_no
    FROM (SELECT * FROM frames f WHERE {_AFTER.format('f')}) GROUP BY ALL"""
register("mosaic_cleared", "device_id BIGINT, channel VARCHAR, tile_index BIGINT, frame_no BIGINT", lambda v: frames.mosaic_latest(v("frames"), clears=_clears(v)), _MOSAIC_CLEARED)
_DETECTIONS_CLEARED = _DETECTIONS.replace("SELECT device_id, channel, lap_id, t.angle", f"SELECT device_id, channel, lap_id, (SELECT count(*) FROM ({_CLEARS}) c WHERE c.device_id = b.device_id AND epoch_us(c.ts) // 1000 <= b.now) AS epoch, t.angle").replace(
    "m, ms AS last, true AS looked FROM l", "m, ms AS last, true AS looked, ms AS now FROM l").replace("l.ms - b.last >= 120000 FROM b", "l.ms - b.last >= 120000, l.ms FROM b")
_DETECTED = "device_id BIGINT, channel VARCHAR, lap_id BIGINT, epoch BIGINT, target BIGINT, frame_no BIGINT"
_clears_ms = lambda v: _clears(v).select("device_id", _ms("ts").alias("ms"))
register("detection_batch_cleared", _DETECTED, lambda v: detect.detection_batch(_timed(v), v("targets"), 60_000, 120_000, clears=_clears_ms(v)), _DETECTIONS_CLEARED)

# -- pixels -----------------------------------------------------------------------------------

_raster = lambda v, name: v(name).withColumn("data", F.unhex("digits")).drop("digits")
_digest = lambda rows: rows.withColumn("digest", F.sha2(F.hex("data"), 256))
_RASTERS = "SELECT *, sum(width) OVER (PARTITION BY session ORDER BY image_no) - width AS s, sum(width) OVER (PARTITION BY session ORDER BY image_no) AS e, sum(width) OVER (PARTITION BY session) // 500 AS full_frames FROM rasters WHERE width > 0"
_REFRAMED = f"""SELECT session, f AS frame_no, 4 AS height, 500 AS width,
       sha256(string_agg(substr(digits, CAST((y * width + greatest(s, f * 500) - s) * 2 + 1 AS INT), CAST((least(e, (f + 1) * 500) - greatest(s, f * 500)) * 2 AS INT)), '' ORDER BY y, s)) AS digest
    FROM (SELECT *, unnest(range(CAST(s // 500 AS BIGINT), CAST((e - 1) // 500 + 1 AS BIGINT))) AS f FROM ({_RASTERS})) p JOIN (SELECT unnest(range(4)) AS y) r ON true WHERE f < full_frames GROUP BY session, f"""
_REFRAME = "session VARCHAR, frame_no BIGINT, height BIGINT, width BIGINT, digest VARCHAR"
register("rechunk_pixels", _REFRAME, lambda v: _digest(pixels.rechunk_pixels(_raster(v, "rasters"), 500)), _REFRAMED)


def _regions(v: Views) -> DataFrame:
    """Regions of 20 columns of a ring of 250, whose last tile has two of the tiles' eight columns."""
    tiles = _raster(v, "frame_rasters").withColumns({"height": F.lit(2), "width": F.lit(8)})
    asked = _requests(v).withColumns({"start": F.col("request_id") * 37 - 500, "width": F.lit(20)})
    return _digest(pixels.region_pixels(tiles, asked, 250, 8))


register("region_pixels", "request_id BIGINT, height BIGINT, width BIGINT, digest VARCHAR", _regions,
    f"""SELECT request_id, CASE WHEN count(digits) > 0 THEN 2 END AS height, 20 AS width,
          CASE WHEN count(digits) > 0 THEN sha256(string_agg(coalesce(substr(digits, CAST((y * 8 + x % 8) * 2 + 1 AS INT), 2), '00'), '' ORDER BY y, k)) END AS digest
        FROM (SELECT r.request_id, r.k, r.x, f.digits FROM (SELECT request_id, device_id, channel, ts, k, ((request_id * 37 - 500 + k) % 250 + 250) % 250 AS x, ((request_id * 37 - 500 + k) % 250 + 250) % 250 // 8 AS tile
                FROM ({_REQUESTS}) q JOIN (SELECT unnest(range(20)) AS k) n ON true) r
              ASOF LEFT JOIN frame_rasters f ON r.device_id = f.device_id AND r.channel = f.channel AND r.tile = f.tile_index AND r.ts >= f.ts) p
        JOIN (SELECT unnest(range(2)) AS y) l ON true GROUP BY request_id""")
