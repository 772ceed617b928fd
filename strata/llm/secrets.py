"""Secret scan by a battery of randomness tests, in DataFrame expressions alone.

Three fixed kinds of spans are found by pattern and always stay: ``assign`` (a value given to a secret's name),
``access`` (key ids) and ``hex`` (long lower-case hexadecimal runs).  Beside them every other run of token
characters, ``MIN_TOKEN`` or longer, goes through the battery under the encoding that its characters infer:

* chi-squared: how far the characters are from uniform over the encoding's alphabet.  Its null hypothesis is text,
  whose letters are as uneven as ``TEXT_REPEAT`` says (the chance that two letters are equal): under it the
  statistic is noncentral, and the lower tail's p-value shrinks with the token's length.
* runs above and below the alphabet's middle, and serial correlation at lag one: two-sided tests of randomness; a
  token that fails one of them at ``VETO`` (alphabets in order, repeated syllables) has p-value 1.

The Benjamini-Hochberg rule at rate ``RATE`` is applied within bands of length, over all candidates of all rows: it
needs counts of p-values in bins only, a table of fixed size, and a bin counts with its larger edge.

Spans are in code points, end exclusive; within a kind they are leftmost and do not overlap; ``random`` spans do not
overlap others.  Texts of any length are scanned whole, in time that grows with n log n.  Defined cases: null and empty texts have no spans; repeated rows are scanned each; other columns
pass through, but ones named as the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import table

# fixed values: the patterns of the base kinds and their least lengths
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 16
HEX = r"[0-9a-f]+"
HEX_LENGTH = 32
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: encoding: (pattern of its tokens, alphabet), the first that fits is inferred
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="),
    ("base64_url", r"^[0-9A-Za-z+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/="),
)
TEXT_REPEAT = 0.066
DIGIT_REPEAT = 0.1
VETO = 0.001
RATE = 0.01
BIN = 0.05
BINS = 400
#: Code points of the blocks from which a masked text is put together.
BLOCK = 1024


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with the value computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``add``, by doubling: n log n steps, no growing array."""

    def totals(v: Column) -> Column:
        turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)
        return F.when(F.size(v) > 1, F.aggregate(turns, v, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= _power(k), add(F.get(acc, i - _power(k)), x)).otherwise(x)))).otherwise(v)

    return _bound(values, totals)


def _spans(text: Column, pattern: str, kind: int, filters: str, group: int = 0, least: int = 0, words: bool = False) -> Column:
    """Array of (start, kind, end), and the match if ``words``; ``filters`` is a cheap pattern that every text with a span matches."""
    state = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.split(text, pattern, -1).alias("between"),
    )

    def found(m: Column) -> Column:
        ends = _running(F.zip_with(F.slice(m["between"], 1, F.size(m["w"])), m["w"], lambda x, w: F.length(x) + F.length(w)), lambda x, y: x + y)
        return F.arrays_zip(ends.alias("e"), m["w"].alias("w"), m["g"].alias("g"))

    kept = F.filter(_bound(state, found), lambda x: F.length(x["g"]) >= least)
    more = lambda x: [x["w"].alias("word")] if words else []
    spans = F.transform(kept, lambda x: F.struct((x["e"] - F.length(x["w"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), *more(x)))
    return F.when(text.rlike(filters), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int" + (",word:string" if words else "") + ">>"))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": _spans(text, ASSIGN, 0, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, ASSIGN_LENGTH),
        # runs are maximal, so the least length may stand in the pattern
        "access": _spans(text, ACCESS.replace("+", f"{{{ACCESS_LENGTH - 4},}}"), 1, "AKIA"),
        "hex": _spans(text, HEX.replace("+", f"{{{HEX_LENGTH},}}"), 2, f"[0-9a-f]{{{HEX_LENGTH}}}"),
    }


def _below(z: Column) -> Column:
    """The standard normal distribution function; in its lower tail by its asymptotic form."""
    tail = F.exp(-z * z / 2) / (F.sqrt(F.lit(2 * math.pi)) * (-z) * (1 + 1 / (z * z)))
    return F.when(z < -3, tail).otherwise(1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z)))


def p_value(token: Column) -> Column:
    """The battery's p-value of one token: small for what is too even to be text and fails no test of randomness."""
    alphabet, size, unevenness = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for name, pattern, letters in reversed(ENCODINGS):
        repeat = DIGIT_REPEAT if name in ("decimal", "hex", "hex_upper") else TEXT_REPEAT
        fits = token.rlike(pattern)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        size = F.when(fits, F.lit(len(letters))).otherwise(size)
        unevenness = F.when(fits, F.lit(max(0.05, len(letters) * repeat - 1))).otherwise(unevenness)
    state = F.struct(token.alias("t"), alphabet.alias("a"), size.cast("double").alias("k"), unevenness.alias("d"), F.length(token).cast("double").alias("n"))
    letters_of = lambda s: F.filter(F.split(s["t"], ""), lambda c: c != "")

    def tested(s: Column) -> Column:
        squares = F.aggregate(F.array_distinct(letters_of(s)), F.lit(0.0), lambda acc, c: acc + F.pow((s["n"] - F.length(F.replace(s["t"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        chi = s["k"] / s["n"] * squares - s["n"]
        mean, spread = s["k"] - 1 + s["n"] * s["d"], F.sqrt(2 * (s["k"] - 1) + 4 * s["n"] * s["d"])
        even = _below((chi - mean) / spread)
        values = F.transform(letters_of(s), lambda c: F.instr(s["a"], c).cast("double") - (s["k"] + 1) / 2)
        packed = F.struct(values.alias("v"), s["n"].alias("n"), even.alias("even"))
        return F.transform(F.array(packed), _randomness)[0]

    return F.transform(F.array(state), tested)[0]


def _randomness(s: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("up"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"), F.lit(0).alias("i"))
    sums = F.aggregate(
        s["v"],
        zero,
        lambda a, v: F.struct(
            v.alias("last"),
            (a["runs"] + F.when((a["i"] == 0) | ((a["last"] > 0) != (v > 0)), 1.0).otherwise(0.0)).alias("runs"),
            (a["up"] + F.when(v > 0, 1.0).otherwise(0.0)).alias("up"),
            (a["cross"] + F.when(a["i"] == 0, 0.0).otherwise(a["last"] * v)).alias("cross"),
            (a["sum"] + v).alias("sum"),
            (a["square"] + v * v).alias("square"),
            (a["i"] + 1).alias("i"),
        ),
    )
    both = F.transform(F.array(F.struct(sums.alias("m"), s["n"].alias("n"), s["even"].alias("even"))), _combined)
    return both[0]


def _combined(s: Column) -> Column:
    n, m = s["n"], s["m"]
    product = 2 * m["up"] * (n - m["up"])
    spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
    runs = F.abs(m["runs"] - product / n - 1) / spread
    mean = m["sum"] / n
    variance = F.greatest(m["square"] / n - mean * mean, F.lit(1e-9))
    serial = F.abs((m["cross"] / (n - 1) - mean * mean) / variance) * F.sqrt(n)
    veto = (2 * _below(-runs) < VETO) | (2 * _below(-serial) < VETO)
    return F.when(veto, 1.0).otherwise(F.least(F.greatest(s["even"], F.lit(1e-300)), F.lit(1.0)))


def _bins(df: DataFrame, text: str) -> DataFrame:
    """Add arrays of the base spans by kind and of (start, kind, end, band, bin) of every candidate."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("__secret_text", t)
    base = base_spans(F.col("__secret_text"))
    df = df.withColumns({f"__secret_{k}": v for k, v in base.items()})
    tokens = _spans(F.col("__secret_text"), TOKEN, 3, TOKEN, words=True)
    taken = F.array_sort(F.concat("__secret_assign", "__secret_access", "__secret_hex"))

    def apart(s: Column) -> Column:
        """The tokens that no base span reaches into: how many start before a token's end is found by halving."""
        before = lambda x: F.aggregate(F.sequence(F.lit(24), F.lit(0)), F.lit(0), lambda at, k: F.when(F.get(s["taken"], at + _power(k) - 1)["start"] < x["end"], at + _power(k)).otherwise(at))
        return F.filter(s["tokens"], lambda x: ~F.coalesce(F.get(s["reach"], before(x) - 1) > x["start"], F.lit(False)))

    both = _bound(F.struct(tokens.alias("tokens"), taken.alias("taken")), lambda s: F.struct(s["tokens"].alias("tokens"), s["taken"].alias("taken"), _running(F.transform(s["taken"], lambda y: y["end"]), F.greatest).alias("reach")))
    df = df.withColumn("__secret_candidates", _bound(both, lambda s: F.when((F.size(s["tokens"]) > 0) & (F.size(s["taken"]) > 0), apart(s)).otherwise(s["tokens"])))
    level = lambda x: F.least(F.floor(-F.log10(p_value(x["word"])) / BIN), F.lit(BINS - 1)).cast("int")
    band = lambda x: F.floor(2 * F.log2((x["end"] - x["start"]).cast("double"))).cast("int")
    return df.withColumn("__secret_tested", F.transform("__secret_candidates", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), band(x).alias("band"), level(x).alias("bin"))))


def least_bins(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """For each band the lowest bin that the Benjamini-Hochberg rule still rejects; bands without one are left out."""
    out = {}
    for band in {b for b, _ in counts}:
        total, above = sum(n for (b, _), n in counts.items() if b == band), 0
        for k in range(BINS - 1, -1, -1):
            above += counts.get((band, k), 0)
            if above and total * 10 ** (-k * BIN) <= rate * above:
                out[band] = k
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_assign, n_access, n_hex, n_random and ``spans`` (array of start, kind number, end, in order) to every row.

    The counts of p-values cover all rows of ``df``, which is read twice.
    """
    tested = _bins(df, text)
    counts = tested.select(F.explode("__secret_tested").alias("x")).groupBy("x.band", "x.bin").agg(F.count("*").alias("n")).collect()  # bands times bins
    least = least_bins({(r.band, r.bin): int(r.n) for r in counts})
    rule = F.create_map(*[F.lit(v) for pair in least.items() for v in pair]) if least else F.lit(None).cast("map<int,int>")
    random = F.filter("__secret_tested", lambda x: F.coalesce(x["bin"] >= F.element_at(rule, x["band"]), F.lit(False)))
    random = F.transform(random, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = tested.withColumn("__secret_random", random)
    out = out.withColumns({f"n_{k}": F.size(f"__secret_{k}").cast("long") for k in KINDS})
    out = out.withColumn("spans", F.array_sort(F.concat("__secret_assign", "__secret_access", "__secret_hex", "__secret_random")))
    return out.withColumn("base_spans", F.array_sort(F.concat("__secret_assign", "__secret_access", "__secret_hex"))).drop("__secret_text", "__secret_candidates", "__secret_tested", *(f"__secret_{k}" for k in KINDS))


def shown(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: str, spans: str, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced; time is linear in the text."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    state = F.struct(blocks.alias("b"), _running(F.transform(spans, lambda x: x["end"]), F.greatest).alias("r"), F.col(spans).alias("s"))

    def part(b: Column, start: Column, stop: Column) -> Column:
        """Characters from ``start`` to ``stop`` by the blocks that hold them."""
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(b, first + 1, F.floor(stop / BLOCK).cast("int") - first + 1), "")
        return F.substring(some, start - first * BLOCK + 1, stop - start)

    def replaced(s: Column) -> Column:
        last = lambda i: F.coalesce(F.get(s["r"], i - 1), F.lit(0))
        pieces = F.transform(s["s"], lambda x, i: F.when((i == 0) | (x["start"] >= last(i)), F.concat(part(s["b"], last(i), x["start"]), F.lit(mask))).otherwise(F.lit("")))
        rest = part(s["b"], F.element_at(s["r"], -1), F.lit(BLOCK) * F.size(s["b"]))
        return F.concat(F.array_join(pieces, ""), rest)

    return F.when(F.size(spans) > 0, _bound(state, replaced)).otherwise(F.col(text))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan(documents).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown("base_spans").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"), "n_random")
