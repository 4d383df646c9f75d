"""Binary layouts by built-in expressions: little-endian fields, datagrams, turntable frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_CODE, HEADER_BYTES = 0xFFFF, 20
#: Fixed values of the datagram layout: name, offset, bytes.
HEADER = (("header_code", 0, 2), ("image_type", 2, 2), ("device_ts", 4, 4), ("image_index", 8, 4), ("total_size", 12, 4), ("block_index", 16, 2), ("block_size", 18, 2))
#: Turntable commands by name: cmd1, cmd2, data1, data2; null data is the command's argument (high byte, low byte).
COMMANDS = (
    ("stop", 0x00, 0x00, 0x00, 0x00), ("turnLeft", 0x00, 0x04, None, 0x00), ("turnRight", 0x00, 0x02, None, 0x00),
    ("enableOrtho", 0x01, 0xE9, 0x00, 0x01), ("disableOrtho", 0x01, 0xE9, 0x00, 0x00), ("setOrthoLength", 0x02, 0xE9, None, None),
    ("enableFeedback", 0x00, 0x09, 0x00, 0x06), ("disableFeedback", 0x00, 0x03, 0x00, 0x74),
)


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned number of `size` bytes at a 0-based offset, as BIGINT."""
    swapped = F.concat(*[F.hex(F.substring(data, offset + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("bigint")


def byte_at(data: Column, offset: int) -> Column:
    return little_endian(data, offset, 1)


def is_packet(datagram: Column) -> Column:
    return (F.length(datagram) >= HEADER_BYTES) & (little_endian(datagram, 0, 2) == HEADER_CODE)


def header_fields(datagram: Column) -> list[Column]:
    narrow = {"header_code", "image_type", "block_index", "block_size"}
    return [little_endian(datagram, at, size).cast("int" if name in narrow else "bigint").alias(name) for name, at, size in HEADER]


def checksum(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.bitwiseAND(F.lit(0xFF))


def command_hex(cmd1: Column, cmd2: Column, data1: Column, data2: Column, address: int = 1) -> Column:
    """The seven bytes of a turntable command as hexadecimal text."""
    c = checksum(F.lit(address), cmd1, cmd2, data1, data2)
    return F.format_string("FF%02X%02X%02X%02X%02X%02X", F.lit(address), cmd1.cast("int"), cmd2.cast("int"), data1.cast("int"), data2.cast("int"), c.cast("int"))
