"""Path messages, file readiness, commands and replies, logs, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as m
from .clearing import since_clear
from ..shared import written
from .sliced import cuts_below, running


def path_message_parse(msgs: DataFrame, strict: bool = False, default_ip: str = m.DEFAULT_IP) -> DataFrame:
    """Accepted messages with type, path, channel, sender_ip and share_path.

    strict: exactly two parts, and an integer `kind`, 1 for RGB and 0 for anything else."""
    ip = m.sender_ip(F.col("sender"))
    out = msgs.withColumn("type", m.path_type(F.col("payload"), strict)).filter("type is not null").withColumn("path", m.path_of(F.col("payload")))
    out = out.withColumns({"channel": m.channel_of(F.col("type")), "sender_ip": ip, "share_path": m.device_path_map(F.col("path"), ip, default_ip)})
    return out.withColumn("kind", F.when(F.col("type") == "RGB", 1).otherwise(0)) if strict else out


def channel_route(parsed: DataFrame) -> DataFrame:
    """Parsed messages of a known channel."""
    return parsed.filter(F.col("channel").isNotNull())


def arrival_index(loaded: DataFrame, keys: tuple[str, ...] = ("device_id", "channel"), order: str = "arrival_seq") -> DataFrame:
    """0-based counter of successfully loaded frames per channel."""
    counted = running(loaded.filter(F.col("outcome") == "ok"), list(keys), [order], {"frame_no": ("sum", F.lit(1).cast("long"), False)})
    return counted.withColumn("frame_no", F.col("frame_no") - 1)


def file_stable(polls: DataFrame, max_wait_ms: int = 2000) -> DataFrame:
    """file_id, stable_ms, size: the first probe of a size above zero equal to the probe before; null if none in time.

    Probes of a missing file have a null size and do not count as probes."""
    w = Window.partitionBy("file_id").orderBy("seq")
    seen = polls.filter((F.col("poll_ms") <= max_wait_ms) & F.col("size").isNotNull()).withColumn("before", F.lag("size").over(w))
    stable = seen.filter("size > 0 and size = before").groupBy("file_id").agg(F.min("poll_ms").alias("stable_ms"), F.min_by("size", "seq").alias("size"))
    return polls.select("file_id").distinct().join(stable, "file_id", "left")


def decode_retry_window(attempts: DataFrame, retry_ms: int = 1200) -> DataFrame:
    """file_id, decoded_ms, error: the first success within retry_ms, else the last attempt's error."""
    ok = F.col("error").isNull()
    near = attempts.filter(F.col("attempt_ms") <= retry_ms)
    out = near.groupBy("file_id").agg(F.min(F.when(ok, F.col("attempt_ms"))).alias("decoded_ms"), F.max_by("error", "attempt_ms").alias("error"))
    return out.withColumn("error", F.when(F.col("decoded_ms").isNull(), F.col("error")))


def load_outcome(parsed: DataFrame, stable: DataFrame, decoded: DataFrame) -> DataFrame:
    """parsed with outcome: ok, not_ready, decode_failed or convert_failed, by file_id."""
    out = parsed.join(stable.select("file_id", "stable_ms"), "file_id", "left").join(decoded.select("file_id", "decoded_ms", "error"), "file_id", "left")
    kind = F.when(F.col("stable_ms").isNull(), "not_ready").when(F.col("decoded_ms").isNotNull(), "ok").when(F.col("error") == "convert", "convert_failed").otherwise("decode_failed")
    return out.withColumn("outcome", kind)


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window, in epoch seconds; free of the session's time zone."""
    s = F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), ts) / F.lit(seconds)) * seconds
    return s.cast("long")


def rx_aggregates(events: DataFrame, times: int = 1, order: str = "arrival_seq") -> list[Column]:
    """What rx_stats and rx_stats_stream aggregate: packets, ok, drop, fail, last_type, last_path, and, of the columns that
    events have, last_sender (sender), last_length (length) and wakes (wake: a read call began with this datagram).

    An event whose `evicted` is true is no packet but a frame that was given up: it counts as a drop."""
    gone = F.coalesce(F.col("evicted"), F.lit(False)) if "evicted" in events.columns else F.lit(False)
    at, outcome = F.struct(order, "rx_ts"), F.col("outcome")
    latest = lambda c: F.max_by(c, F.when(~gone & F.col(c).isNotNull(), at))
    out = [(F.count_if(~gone) * times).alias("packets"), F.count_if(~gone & (outcome == "ok")).alias("ok"), F.count_if(gone | (outcome == "drop")).alias("drop"),
           F.count_if(~gone & ~outcome.isin("ok", "drop")).alias("fail"), latest("type").alias("last_type"), latest("path").alias("last_path")]
    out += [latest(c).alias(f"last_{c}") for c in ("sender", "length") if c in events.columns]
    return out + ([F.count_if(~gone & F.col("wake")).alias("wakes")] if "wake" in events.columns else [])


def with_evictions(events: DataFrame, evictions: DataFrame) -> DataFrame:
    """events and, among them, evictions(device_id, rx_ts) of frames that were given up, told apart by the column evicted."""
    marks = evictions.select("device_id", "rx_ts", F.lit(True).alias("evicted"))
    return events.withColumn("evicted", F.lit(False)).unionByName(marks, allowMissingColumns=True)


def rx_stats(events: DataFrame, seconds: int = 3, compat_double_count: bool = False) -> DataFrame:
    """Per device and window: packets, ok, drop, fail, the last type and path by arrival_seq, and what else rx_aggregates lists.

    events(device_id, rx_ts, arrival_seq, type, path, outcome): outcome ok, drop, anything else but null is a failure; see with_evictions
    for drops by eviction. A partial aggregation runs before the shuffle, so a hot device costs one row per task and window."""
    return events.withColumn("win_start", bucket_start(F.col("rx_ts"), seconds)).groupBy("device_id", "win_start").agg(*rx_aggregates(events, 2 if compat_double_count else 1))


def running_totals(stats: DataFrame) -> DataFrame:
    """stats with total_packets so far and the change against the window before; total_wakes where stats have wakes.

    A device's windows are cut into slices of time (running), so its whole history is many tasks."""
    values = {"total_packets": ("sum", F.col("packets"), False), "__prev": ("last", F.col("packets"), True)}
    if "wakes" in stats.columns:
        values["total_wakes"] = ("sum", F.col("wakes"), False)
    return running(written(stats, "stats"), ["device_id"], ["win_start"], values).withColumn("delta_packets", F.col("packets") - F.coalesce("__prev", F.lit(0))).drop("__prev")


# -- replay -----------------------------------------------------------------------------------


def port_fanout(log: DataFrame, only_port: int | None = None) -> DataFrame:
    """One row per port that a message of log(payload) is replayed to."""
    return log.withColumn("port", F.explode(m.ports_of(F.col("payload"), only_port)))


#: Types of an order by which a session is cut into slices.
NUMBERED = ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "timestamp_ntz")


def numbered(rows: DataFrame, order: str, session: str | None = None) -> DataFrame:
    """rows with n, their 1-based place in a session, or over all rows without one.

    order: a column of any sortable type (numbers, names, times); ties go by a hash of the whole row. Over all
    rows, places are found in two steps: rows are dealt to ranges of `order`, whose bounds come from a random
    sample of 10,000 values, counted and numbered within a range, and the ranges' running total (a row
    per range) is added. No task sees all rows. In sessions, numbers and times go in slices, so a session is
    many tasks; one ordered by names is a single task."""
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() not in ("map", "variant")])
    if session is not None and rows.schema[order].dataType.typeName() in NUMBERED:
        return running(rows.withColumn("__tie", tie), [session], [order, "__tie"], {"n": ("sum", F.lit(1).cast("long"), False)}).drop("__tie")
    if session is not None:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(order, tie)).cast("long"))
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = sorted(r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).orderBy(F.rand(7)).limit(10_000).collect())
    cuts = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    dealt = rows.withColumn("__part", cuts_below([F.lit(c).cast(rows.schema[order].dataType) for c in cuts], F.col(order)))
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row per range
    before, run = [], 0
    for k in range(len(cuts) + 1):
        before.append(run)
        run += counts.get(k, 0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order, tie))
    return dealt.withColumn("n", own + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__part") + 1)).drop("__part")


def systematic_sample(log: DataFrame, every: int = 20, order: str = "arrival_seq") -> DataFrame:
    """Message n of all is kept if every <= 1 or n leaves 1 when divided by it (a sampling operator)."""
    return log if every <= 1 else numbered(log, order).filter(F.col("n") % every == 1).drop("n")


def replay_interval(log: DataFrame, interval_ms: int | None = None, default_s: float = 0.5) -> DataFrame:
    """interval_s between replayed messages: given, or the log's mean gap, or the default."""
    span = F.timestamp_diff("SECOND", F.min("log_ts"), F.max("log_ts"))
    mean = F.when((F.count("log_ts") >= 2) & (span > 0), span / F.count("payload").cast("double"))
    return log.agg((F.lit(interval_ms / 1000) if interval_ms else F.coalesce(mean, F.lit(default_s))).alias("interval_s"))


def replay_schedule(log: DataFrame, interval_ms: int = 500, order: str = "arrival_seq") -> DataFrame:
    """log with offset_s, the time after the start at which a message is sent."""
    return numbered(log, order).withColumn("offset_s", (F.col("n") - 1) * F.lit(interval_ms / 1000)).drop("n")


def half_split(files: DataFrame, order: str = "doc_id") -> DataFrame:
    """files with channel: the first half by order is RGB, the rest BW (the odd one too)."""
    n = files.count()
    return numbered(files, order).withColumn("channel", F.when(F.col("n") <= n // 2, "RGB").otherwise("BW"))


def round_robin_pair(split: DataFrame, ticks: DataFrame, file_id: str = "doc_id") -> DataFrame:
    """ticks(tick) with the colour and the grey file that come up then, each channel in a circle of its own."""
    k = {c: split.filter(F.col("channel") == c).count() for c in ("RGB", "BW")}
    first = split.filter(F.col("channel") == "BW").agg(F.min("n")).first()[0] or 1
    side = lambda c, lo, name: split.filter(F.col("channel") == c).select((F.col("n") - lo).alias(f"__{name}"), F.col(file_id).alias(name))
    at = ticks.withColumn("__colour_id", F.col("tick") % max(1, k["RGB"])).withColumn("__grey_id", F.col("tick") % max(1, k["BW"]))
    return at.join(side("RGB", 1, "colour_id"), "__colour_id").join(side("BW", first, "grey_id"), "__grey_id").select("tick", "colour_id", "grey_id")


# -- commands ---------------------------------------------------------------------------------


def reply_parse(replies: DataFrame) -> DataFrame:
    """replies(reply) with status and the command they answer."""
    return replies.withColumn("status", m.reply_status(F.col("reply"))).withColumn("cmd", m.reply_command(F.col("reply")))


def command_reply_match(commands: DataFrame, replies: DataFrame, limit_s: int = 5) -> DataFrame:
    """Each command with its first reply within limit_s; unanswered commands have nulls.

    Equal on device and command and bucketed by limit_s (a reply looks in its own and the bucket before), so the
    range join is an equi-join whose groups stay small on a busy device."""
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), c) / F.lit(limit_s))
    answered = replies.select("device_id", m.reply_command(F.col("reply")).alias("__cmd"), F.col("ts").alias("reply_ts"))
    answered = answered.withColumn("__b", F.explode(F.array(bucket(F.col("reply_ts")), bucket(F.col("reply_ts")) - 1)))
    asked = commands.withColumn("__b", bucket(F.col("ts"))).withColumn("__cmd", m.command_text(F.col("cmd")))
    late = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("reply_ts"))
    pairs = asked.join(answered, ["device_id", "__cmd", "__b"]).filter((late >= 0) & (late <= limit_s * 1_000_000))
    first = pairs.groupBy("cmd_id").agg(F.min("reply_ts").alias("reply_ts"))
    return commands.join(first, "cmd_id", "left").withColumn("latency_s", F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("reply_ts")) / F.lit(1e6))


def unanswered_commands(commands: DataFrame, replies: DataFrame, limit_s: int = 5) -> DataFrame:
    """Commands without a reply within limit_s."""
    return command_reply_match(commands, replies, limit_s).filter("reply_ts is null").select(*commands.columns)


def device_state(commands: DataFrame) -> DataFrame:
    """commands with is_open after each: opened and not closed since; false before any of the two."""
    said = F.when(F.col("cmd") == "TG_OPEN_DEVICE;", True).when(F.col("cmd") == "TG_CLOSE_DEVICE;", False)
    return running(commands, ["device_id"], ["ts", "cmd_id"], {"is_open": ("last", said, False)}).withColumn("is_open", F.coalesce("is_open", F.lit(False)))


# -- logs -------------------------------------------------------------------------------------


def log_tail(events: DataFrame, keep: int = 1200, clears: DataFrame | None = None) -> DataFrame:
    """The last `keep` entries of each device with rn, 1 for the latest (Spark limits ranks before the shuffle).

    With clears, only entries since the device's last clear event."""
    if clears is not None:
        events = since_clear(events, clears)
    w = Window.partitionBy("device_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def log_throttle(events: DataFrame, gap_ms: int = 15, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Entries at least gap_ms after the last accepted one; important ones always pass and move the clock."""
    from .detect import throttle

    marked = events.withColumn("important", m.is_important(F.col("type")))
    return throttle(marked, list(keys), "ms", gap_ms, ["ms", "event_id"], passes="important")
