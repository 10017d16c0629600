"""Byte, size and bucket functions. All are Column expressions that stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The slot of a window: its first four bytes and the rest, as little-endian numbers, times these, and its length; modulo a prime, then
#: modulo the table's bits. No step exceeds 63 bits, so that SQL and numpy give the same slots.
SLOT_LOW, SLOT_HIGH, SLOT_PRIME = 637_103_897, 823_117_301, (1 << 31) - 1

#: Buckets of a log2 histogram; the last takes all larger values.
LOG2_BUCKETS = 25

# Names of the chunk types of the container format.
CHUNK_TYPES = {
    0x00: "legacy compressed data",
    0x01: "uncompressed data",
    0x02: "compressed data",
    0x03: "compressed data, separate literals crc",
    0x20: "end of stream",
    0x40: "seek index",
    0x44: "search info",
    0x45: "search table",
    0x46: "compressed search table",
    0x47: "remote block reference",
    0xFE: "padding",
    0xFF: "stream identifier",
}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def as_bytes(x) -> Column:
    """UTF-8 bytes of a text column; bytes stay as they are."""
    return F.encode(_col(x).cast("string"), "UTF-8")


def byte_at(data, i) -> Column:
    """Byte i (from 0) as an int; null outside."""
    return F.conv(F.hex(F.substr(_col(data), _col(i) + 1, F.lit(1))), 16, 10).cast("int")


def little_endian(data, size: int = 8) -> Column:
    """The first `size` (at most 8) bytes as a little-endian number, zero padded. A set top bit gives a negative long."""
    parts = [F.shiftleft(F.coalesce(byte_at(data, F.lit(k)), F.lit(0)).cast("long"), 8 * k) for k in range(min(8, size))]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseOR(p)
    return total


def log2_bucket(v) -> Column:
    """floor(log2(v)), 0 for 0 and 1, at most 24; exact, by the length of the binary form."""
    return F.least(F.lit(LOG2_BUCKETS - 1), F.length(F.bin(F.greatest(_col(v).cast("long"), F.lit(1)))) - 1)


def log2_label(bucket) -> Column:
    """'1-2', '1K-2K', '16M+': the range of a bucket."""
    b = _col(bucket)

    def short(k: Column) -> Column:
        p = F.pow(F.lit(2.0), k)
        unit = lambda n, s: F.concat((p / n).cast("long").cast("string"), F.lit(s))
        return F.when(k >= 20, unit(1 << 20, "M")).when(k >= 10, unit(1 << 10, "K")).otherwise(unit(1, ""))

    return F.when(b >= LOG2_BUCKETS - 1, F.concat(short(b), F.lit("+"))).when(b == 0, F.lit("0-2")).otherwise(F.concat(short(b), F.lit("-"), short(b + 1)))


def ratio_bucket(compressed, uncompressed) -> Column:
    """Tenths of compressed / uncompressed; 10 from 100 % on and where there is nothing to compare with."""
    c, u = _col(compressed).cast("long"), _col(uncompressed).cast("long")
    percent = F.floor(c * 100 / F.when(u > 0, u))
    return F.when((u <= 0) | u.isNull() | (percent >= 100), F.lit(10)).otherwise(F.floor(percent / 10)).cast("int")


def header_clamp(size) -> Column:
    return F.least(F.lit(7), F.greatest(F.lit(0), _col(size)))


def size_parse(text) -> Column:
    """'64KB', '1.5M', '8MiB', '100' as bytes, base 1024; null for anything else and for negative sizes."""
    t = F.upper(F.trim(_col(text)))
    shape = r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$"
    unit = F.regexp_extract(t, shape, 2)
    factor = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return F.when(t.rlike(shape), (F.regexp_extract(t, shape, 1).try_cast("double") * factor).cast("long"))


def parse_size(text: str) -> int:
    """size_parse() of one value, for options; raises ValueError."""
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?", text.strip().upper())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2] or " "))


def human_size(v) -> Column:
    """'12 B', '1.50 KiB', ...: base 1024 with two decimals."""
    x = _col(v).cast("double")
    form = lambda n, s: F.concat(F.format_string("%.2f", x / n), F.lit(f" {s}"))
    return F.when(x >= 2.0**40, form(2.0**40, "TiB")).when(x >= 2.0**30, form(2.0**30, "GiB")).when(x >= 2.0**20, form(2.0**20, "MiB")).when(x >= 2.0**10, form(2.0**10, "KiB")).otherwise(F.format_string("%.0f B", x))


def bar(v, most, width: int = 40) -> Column:
    """A bar of up to `width` blocks; at least one for a value above 0."""
    n = F.floor(_col(v) * width / F.when(_col(most) > 0, _col(most)))
    return F.repeat(F.lit("█"), F.when(_col(v) > 0, F.greatest(F.lit(1), n)).otherwise(0).cast("int"))


def chunk_type_name(kind) -> Column:
    k = _col(kind)
    out = F.when(k == -1, F.lit(""))
    for number, name in CHUNK_TYPES.items():
        out = out.when(k == number, F.lit(name))
    return out.when(k.between(0x80, 0xBF), F.lit("skippable user chunk")).when(k.between(0xC0, 0xFD), F.lit("user chunk")).when(k.between(0x40, 0x7F), F.lit("reserved skippable")).otherwise(F.lit("reserved"))


def popcount(bitmap) -> Column:
    """Set bits of a binary column."""
    return F.aggregate(F.split(F.hex(_col(bitmap)), ""), F.lit(0), lambda acc, h: acc + F.coalesce(F.bit_count(F.conv(h, 16, 10).try_cast("int")), F.lit(0)))


def window_slot(window, base_log2: int) -> Column:
    """The hash slot of a window of 1 to 8 bytes in a table of 2**base_log2 bits: the bit that search tables have for it."""
    w = _col(window)
    total = little_endian(w, 4) * SLOT_LOW + little_endian(F.substr(w, F.lit(5), F.lit(4)), 4) * SLOT_HIGH + F.length(w)
    return total % SLOT_PRIME % (1 << base_log2)


def reduced_slot(slot, base_log2: int, reductions) -> Column:
    """The slot after a table was folded in half `reductions` times."""
    return _col(slot).bitwiseAND(F.pow(F.lit(2.0), F.lit(base_log2) - _col(reductions)).cast("long") - 1)


def auto_table_log2(block_size: int) -> int:
    """One bit for each byte of a block, from 2**8 to 2**23."""
    return max(8, min(23, max(0, block_size - 1).bit_length()))


def url_file_name(url) -> Column:
    """A file name for a URL: without its scheme, _ for what file names can't hold."""
    return F.regexp_replace(F.regexp_replace(_col(url), r"^[a-zA-Z]+://", ""), r'[<>:"/\\|?*]', "_")


def percent(part, whole) -> Column:
    return F.when(_col(whole) != 0, _col(part) * 100.0 / _col(whole))


def speed_mb(size, seconds) -> Column:
    """Megabytes (10**6) a second."""
    return F.when(_col(seconds) > 0, _col(size) / _col(seconds) / 1e6)
