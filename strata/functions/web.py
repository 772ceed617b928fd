"""Statuses, responses and token claims as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what an HTTP status means to a client
ERRORS = {400: "invalid argument", 401: "unauthorized", 403: "forbidden", 404: "not found", 409: "conflict", 429: "rate limited"}
# fixed values: names of store statuses by their codes
STATUSES = ("OK", "NotFound", "Corruption", "NotSupported", "InvalidArgument", "IOError")


def error_of(status: Column) -> Column:
    """A client's error for an HTTP status; null for success, ``http <code>`` for what has no name."""
    out = F.when(status < 400, F.lit(None).cast("string")).when(status >= 500, F.lit("internal")).otherwise(F.concat(F.lit("http "), status.cast("string")))
    for code, name in ERRORS.items():
        out = F.when(status == code, F.lit(name)).otherwise(out)
    return out


def status_text(code: Column, message: Column) -> Column:
    """``OK``, or a status's name, a colon and its message."""
    name = F.get(F.array(*(F.lit(s) for s in STATUSES)), code)
    return F.when(code == 0, F.concat(name, F.coalesce(message, F.lit("")))).otherwise(F.concat(name, F.lit(": "), F.coalesce(message, F.lit(""))))


def response(status: Column, headers: Column, body: Column) -> Column:
    """An HTTP response; headers is an array of (name, value), and a missing length is added."""
    reason = F.when(status == 200, "OK").when(status == 404, "Not Found").otherwise("Error")
    lines = F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n")))
    known = F.exists(headers, lambda h: F.lower(h["name"]) == "content-length")
    size = F.when(known, "").otherwise(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n")))
    return F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason, F.lit("\r\n"), F.array_join(lines, ""), size, F.lit("\r\n"), body)


def body_kind(headers: Column) -> Column:
    """``stream``, ``chunked``, ``sized`` or ``none`` by the headers, whose names compare without case."""
    has = lambda name, part: F.exists(headers, lambda h: (F.lower(h["name"]) == name) & F.contains(F.lower(h["value"]), F.lit(part)))
    sized = F.exists(headers, lambda h: F.lower(h["name"]) == "content-length")
    return F.when(has("content-type", "text/event-stream"), "stream").when(has("transfer-encoding", "chunked"), "chunked").when(sized, "sized").otherwise("none")


def claims(token: Column) -> Column:
    """(sub, role, jti, exp, iat, iss) of a three-part token's payload; the signature is not looked at."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.from_json(F.unbase64(padded).cast("string"), "sub string, role string, jti string, exp long, iat long, iss string")


def file_number(path: Column) -> Column:
    """The number that a file's name begins with; null if it has none."""
    digits = F.regexp_extract(path, r"([0-9]+)\.[^/]*$", 1)
    return F.when(digits != "", digits.cast("long"))
