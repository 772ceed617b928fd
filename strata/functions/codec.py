"""Byte formats as column expressions: internal keys, integers, frames, HTTP request lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(number: Column, octets: int) -> Column:
    """A long as so many bytes, the least first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    pairs = [F.substring(digits, 15 - 2 * i, 2) for i in range(octets)]
    return F.unhex(F.concat(*pairs))


def read_little_endian(data: Column, start: int, octets: int) -> Column:
    """The long that stands at a place (from 1) of a binary column."""
    if octets > 4:  # by halves: the value may need all 64 bits
        return F.shiftleft(read_little_endian(data, start + 4, octets - 4), 32).bitwiseOR(read_little_endian(data, start, 4))
    digits = [F.hex(F.substring(data, start + i, 1)) for i in reversed(range(octets))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def internal_key(user_key: Column, seq: Column, vtype: Column) -> Column:
    """user key, then sequence and type in eight little-endian bytes."""
    return F.concat(user_key.cast("binary"), little_endian(F.shiftleft(seq.cast("long"), 8).bitwiseOR(vtype.cast("long")), 8))


def decode_internal_key(data: Column) -> tuple[Column, Column, Column]:
    """(user key, sequence, type); under eight bytes: empty, 0, 0."""
    n = F.octet_length(data)
    tail = F.substring(data, F.greatest(n - 7, F.lit(1)), F.lit(8))
    packed = F.when(n >= 8, read_little_endian(tail, 1, 8)).otherwise(F.lit(0).cast("long"))
    key = F.when(n >= 8, F.substring(data, F.lit(1), F.greatest(n - 8, F.lit(0)))).otherwise(F.lit("").cast("binary"))
    return key.cast("string"), F.shiftrightunsigned(packed, 8), packed.bitwiseAND(F.lit(255))


def ordered_key(user_key: Column, seq: Column, vtype: Column) -> Column:
    """A binary key whose byte order is rule order for prefix-free user keys: key, inverted sequence, type."""
    return F.concat(user_key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(seq.cast("long"))), 16, "0")), F.unhex(F.lpad(F.hex(vtype.cast("long")), 2, "0")))


def varint_length(number: Column) -> Column:
    """Bytes of the base-128 form of an unsigned 32-bit number."""
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(number < (1 << (7 * k)), F.lit(k)).otherwise(out)
    return out


def varint(number: Column) -> Column:
    """The base-128 form itself: seven bits a byte, the high bit says that more follow."""
    octet = lambda k, last: F.shiftrightunsigned(number.cast("long"), 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(0 if last else 128))
    out = None
    for n in (5, 4, 3, 2, 1):
        form = F.unhex(F.concat(*(F.lpad(F.hex(octet(k, k == n - 1)), 2, "0") for k in range(n))))
        out = form if out is None else F.when(number < (1 << (7 * n)), form).otherwise(out)
    return out


# fixed values: the frames' first two bytes, as a little-endian number, and the command numbers
MAGIC = 0x4D4B
COMMANDS = {"put": 1, "get": 2, "del": 3, "scan": 4}


def request_frame(command: str, key: Column, value: Column) -> Column:
    """magic(2) command(1) key length(4) value length(4), then both."""
    k, v = key.cast("binary"), value.cast("binary")
    return F.concat(F.unhex(F.lit(f"{MAGIC & 255:02X}{MAGIC >> 8:02X}{COMMANDS[command]:02X}")), little_endian(F.octet_length(k), 4), little_endian(F.octet_length(v), 4), k, v)


def pair_frame(key: Column, value: Column) -> Column:
    """One pair of a scan payload: lengths in four little-endian bytes, each before its bytes."""
    k, v = key.cast("binary"), value.cast("binary")
    return F.concat(little_endian(F.octet_length(k), 4), k, little_endian(F.octet_length(v), 4), v)


def json_pair(key: Column, value: Column) -> Column:
    return F.to_json(F.struct(key.alias("key"), value.alias("value")))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def request_line(line: Column) -> tuple[Column, Column, Column, Column]:
    """(method, path, query, version) of an HTTP request line."""
    target = F.split_part(line, F.lit(" "), F.lit(2))
    return F.split_part(line, F.lit(" "), F.lit(1)), F.split_part(target, F.lit("?"), F.lit(1)), F.split_part(target, F.lit("?"), F.lit(2)), F.split_part(line, F.lit(" "), F.lit(3))


def header(headers: Column, name: str) -> Column:
    """The last value of a header in an array of (name, value); names compare without case."""
    return F.try_element_at(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"]), F.lit(-1))


def decode_pairs(payload: Column) -> Column:
    """Array of (key, value) of a scan payload: their count in four bytes, then length and bytes of each, in turn."""
    n = read_little_endian(payload, 1, 4)
    start = F.struct(F.lit(5).alias("at"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def field(at: Column) -> Column:
        digits = [F.hex(F.substring(payload, at + i, F.lit(1))) for i in (3, 2, 1, 0)]
        size = F.conv(F.concat(*digits), 16, 10).cast("int")
        return F.struct(F.substring(payload, at + 4, size).cast("string").alias("s"), (at + 4 + size).alias("next"))

    def step(a: Column, _: Column) -> Column:
        both = F.transform(F.transform(F.array(field(a["at"])), lambda k: F.struct(k.alias("k"), field(k["next"]).alias("v"))), lambda p: F.struct(p["v"]["next"].alias("at"), F.concat(a["out"], F.array(F.struct(p["k"]["s"].alias("key"), p["v"]["s"].alias("value")))).alias("out")))
        return both[0]

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), start, step, lambda a: a["out"])).otherwise(start["out"])


def url_escape(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_unescape(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def digits_only(text: Column) -> Column:
    """True for texts of ASCII digits alone; the empty text is none."""
    return text.rlike("^[0-9]+$")
