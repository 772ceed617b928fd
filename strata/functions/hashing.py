"""Hashes and filters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
# fixed values: constants of the hash functions and the two seeds of the filter
MURMUR_MULTIPLIER = 0x5BD1E995
MURMUR_SHIFT = 24
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
CASTAGNOLI = 0x82F63B78
FILTER_SEEDS = (0xBC9F1D34, 0x9E3779B9)


def _times(a: Column, m: int) -> Column:
    """a * m modulo 2**32 without leaving 64 bits: the product by halves of a."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return (low * F.lit(m) + F.shiftleft((high * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _octets(key: Column) -> Column:
    """The UTF-8 bytes of a string as numbers."""
    digits = F.hex(key.cast("binary"))
    return F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    )


def fnv1a(key: Column) -> Column:
    """FNV-1a of 32 bits over the bytes of a string, as a long."""
    return F.aggregate(_octets(key), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_MASK)))


def murmur2(key: Column, seed: int) -> Column:
    """MurmurHash2 of 32 bits with a seed over the bytes of a string, as a long."""
    state = F.struct(_octets(key).alias("b"), F.lit(0).alias("z"))

    def hashed(s: Column) -> Column:
        octets, n = s["b"], F.size(s["b"])
        words = F.filter(F.sequence(F.lit(0), (n / 4).cast("int")), lambda i: i * 4 + 4 <= n)
        word = lambda i: F.element_at(octets, i * 4 + 1) + F.shiftleft(F.element_at(octets, i * 4 + 2), 8) + F.shiftleft(F.element_at(octets, i * 4 + 3), 16) + F.shiftleft(F.element_at(octets, i * 4 + 4), 24)

        def stirred(k: Column) -> Column:
            k = _times(k, MURMUR_MULTIPLIER)
            return F.transform(F.array(k), lambda x: _times(x.bitwiseXOR(F.shiftrightunsigned(x, MURMUR_SHIFT)), MURMUR_MULTIPLIER))[0]

        start = F.lit(seed).cast("long").bitwiseXOR(n.cast("long"))
        h = F.aggregate(F.transform(words, word), start, lambda a, k: _times(a, MURMUR_MULTIPLIER).bitwiseXOR(stirred(k)))
        done = (n / 4).cast("int") * 4
        rest = F.slice(octets, done + 1, F.lit(3))
        tail = F.aggregate(F.transform(rest, lambda c, i: c * F.pow(F.lit(256), i).cast("long")), F.lit(0).cast("long"), lambda a, c: a + c)
        mixed = F.transform(F.array(F.struct(h.alias("h"), tail.alias("t"), (F.size(rest) > 0).alias("any"))), lambda x: F.when(x["any"], _times(x["h"].bitwiseXOR(x["t"]), MURMUR_MULTIPLIER)).otherwise(x["h"]))
        once = F.transform(mixed, lambda x: _times(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), MURMUR_MULTIPLIER))
        return F.transform(once, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 15)))[0]

    return F.transform(F.array(state), hashed)[0]


def crc32c(data: Column) -> Column:
    """CRC-32C of a string's bytes, as a long: eight shifts a byte."""

    def shifted(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), c, lambda a, _: F.shiftrightunsigned(a, 1).bitwiseXOR(F.when(a.bitwiseAND(F.lit(1)) == 1, F.lit(CASTAGNOLI)).otherwise(F.lit(0)).cast("long")))

    folded = F.aggregate(_octets(data), F.lit(_MASK).cast("long"), lambda a, c: shifted(a.bitwiseXOR(c)))
    return folded.bitwiseXOR(F.lit(_MASK))


def fnv1a_64(text: Column) -> Column:
    """The 64-bit hash as an unsigned decimal. It is held as two words of 32 bits; the prime is 2**40 + 435."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        low = h["lo"].bitwiseXOR(c)
        high = F.shiftright(low * 435, 32) + h["hi"] * 435 + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), (low * 435).bitwiseAND(F.lit(_MASK)).alias("lo"))

    return F.aggregate(octets, start, step, lambda h: h["hi"].cast("decimal(20,0)") * F.lit(1 << 32) + h["lo"])


def filter_size(keys: Column, rate: Column) -> tuple[Column, Column, Column]:
    """(bits, hash functions, false-positive rate) of the textbook filter for a number of keys and a wanted rate."""
    bits = F.ceil(-keys * F.log(rate) / F.pow(F.log(F.lit(2.0)), 2.0))
    hashes = F.round(bits / keys * F.log(F.lit(2.0)))
    return bits, hashes, F.pow(1 - F.exp(-hashes * keys / bits), hashes)


def integer_filter(rate: float) -> tuple[int, int]:
    """(bits a key, hash functions) in whole numbers, truncated at each step."""
    bits = int(-math.log(rate) / math.log(2) / math.log(2))
    return max(1, int(bits / math.log(2))), min(30, max(1, int(bits * math.log(2))))


def filter_positions(key: Column, bits: Column | int, hashes: int) -> Column:
    """The bits that a key sets: double hashing modulo 2**32, then modulo the size."""
    size = F.lit(bits) if isinstance(bits, int) else bits
    pair = F.struct(murmur2(key, FILTER_SEEDS[0]).alias("a"), murmur2(key, FILTER_SEEDS[1]).alias("b"))
    return F.transform(F.array(pair), lambda p: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod((p["a"] + p["b"] * i).bitwiseAND(F.lit(_MASK)), size)))[0]


def build_filter(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The filter's set bits as rows (bucket, bits): bitmaps of fixed size, put together by partial aggregation."""
    places = keys.select(F.explode(filter_positions(F.col(column), bits, hashes)).alias("p")).select((F.col("p") + 1).alias("p"))
    return places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def probe_filter(probes: DataFrame, column: str, filter_rows: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Add ``might_contain``; the filter's rows are bounded by its size in bits."""
    at = probes.select(column, F.explode(filter_positions(F.col(column), bits, hashes)).alias("p")).withColumn("p", F.col("p") + 1)
    at = at.withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("bit", F.bitmap_bit_position("p"))
    joined = at.join(filter_rows, "bucket", "left")
    octet = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(octet, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return joined.groupBy(column).agg(F.bool_and(is_set).alias("might_contain"))
