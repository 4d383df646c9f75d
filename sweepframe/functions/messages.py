"""Text messages: paths, senders, replies, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_IP = "192.168.4.1"
PORTS = {"paths": 8001, "bw": 8002, "rgb": 8003}


#: Fixed value: what counts as white space around a field.
WHITE = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sender_ip(sender: Column) -> Column:
    """`ip:port` to ip, `[v6]:port` to v6, anything else as it is; null for an empty sender."""
    s = trimmed(sender)
    v6 = F.regexp_extract(s, r"^\[([^\]]+)\]", 1)
    host = F.regexp_extract(s, r"^(.+):[^:]*$", 1)
    return F.when(s == "", None).when(v6 != "", v6).when(host != "", host).otherwise(s)


def device_path_map(path: Column, ip: Column, default_ip: str = DEFAULT_IP) -> Column:
    """A device's /data path to the share it is seen under; `file://` in front goes."""
    p = F.regexp_replace(path, r"^(?i:file://)", "")
    share = F.concat(F.lit("\\\\"), F.coalesce(F.nullif(ip, F.lit("")), F.lit(default_ip)), F.replace(p, F.lit("/"), F.lit("\\")))
    return F.when(p.startswith("/data/"), share).otherwise(p)


def path_type(payload: Column, strict: bool = False) -> Column:
    """Upper-case type before the `;`, null for messages that are rejected."""
    parts = F.split(payload, ";", -1)
    kind, path = F.upper(trimmed(parts[0])), trimmed(F.try_element_at(parts, F.lit(2)))
    ok = (F.size(parts) == 2 if strict else F.size(parts) >= 2) & (kind != "") & (path != "")
    return F.when(ok, kind)


def path_of(payload: Column) -> Column:
    return trimmed(F.try_element_at(F.split(payload, ";", -1), F.lit(2)))


def channel_of(kind: Column) -> Column:
    """RGB, or BW for both grey names; null for other types."""
    return F.when(kind == "RGB", "RGB").when(kind.isin("BW", "GRAY"), "BW")


def ports_of(payload: Column, only_port: int | None = None) -> Column:
    """Ports that a replayed message goes to: always the paths' port, and its channel's own."""
    if only_port is not None:
        return F.array(F.lit(only_port))
    head = F.lower(trimmed(F.split(payload, ";", 2)[0]))
    own = F.when(head == "bw", F.lit(PORTS["bw"])).when(head == "rgb", F.lit(PORTS["rgb"]))
    return F.array_compact(F.array(F.lit(PORTS["paths"]), own))


def command_text(command: Column) -> Column:
    """A command as replies repeat it: without white space around it and with one final `;` at least."""
    c = trimmed(command)
    return F.when(c.endswith(";"), c).otherwise(F.concat(c, F.lit(";")))


def reply_command(reply: Column) -> Column:
    """The command a reply answers: what stands before its status, with the final `;`."""
    return F.regexp_extract(reply, r"^(.*;)\s*[^;]+;$", 1)


def reply_status(reply: Column) -> Column:
    return F.regexp_extract(reply, r"([^;]+);$", 1)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def log_line(ts: Column, kind: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss.SSS"), F.lit("] ["), html_escape(kind), F.lit("] "), html_escape(message))


def is_important(kind: Column) -> Column:
    """Log types that are never throttled (fixed words)."""
    found = kind.startswith("RX(")
    for word in ("错误", "读取失败", "系统", "ROI"):
        found = found | kind.contains(word)
    return found


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%05d.jpg", number)
