"""Column builders for ABI words, exact wide integers, hex and names. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 1 << 32
BILLION = 1_000_000_000


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def hex_encode(b: Column) -> Column:
    """Lower-case hex with ``0x``."""
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def hex_decode(s: Column) -> Column:
    """Bytes of hex with or without ``0x``; null where a digit is wrong or one is missing."""
    return F.when(s.rlike("^(0x)?([0-9a-fA-F]{2})*$"), F.unhex(F.regexp_replace(s, "^0x", "")))


def hex_long(s: Column) -> Column:
    """A hex quantity (``0x1f``) of up to 63 bits; null if it is not one."""
    return F.when(s.rlike("^0x[0-9a-fA-F]{1,16}$"), F.conv(F.substring(s, 3, 16), 16, 10).try_cast("bigint"))


def snake_case(name: Column) -> Column:
    """``actionTreeRoot`` to ``action_tree_root``; acronyms stay together, other characters become one underscore."""
    plain = F.regexp_replace(name, "[^A-Za-z0-9]+", "_")
    parted = F.regexp_replace(plain, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.regexp_replace(F.lower(parted), "^_+|_+$", "")


def valid_ident(name: Column) -> Column:
    return name.rlike("^[a-z_][a-z0-9_]{0,62}\\z")


def unframe_selectors(blob: Column) -> Column:
    """Array of the parts of ``[length][bytes]...``; a truncated last part is dropped."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<binary>").alias("out"))
    byte_at = lambda at: F.conv(F.hex(F.substring(blob, at, F.lit(1))), 16, 10).cast("int")

    def step(acc: Column, _: Column) -> Column:
        size = byte_at(acc["at"])
        fits = (acc["at"] <= F.octet_length(blob)) & (acc["at"] + size <= F.octet_length(blob))
        part = F.substring(blob, acc["at"] + 1, size)
        ended = F.octet_length(blob) + 1
        return F.when(fits, F.struct((acc["at"] + size + 1).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))).otherwise(F.struct(ended.alias("at"), acc["out"].alias("out")))

    # Every part takes a byte at least, so the length bounds the steps.
    steps = F.sequence(F.lit(1), F.octet_length(blob))
    return F.when(F.octet_length(blob) == 0, F.array().cast("array<binary>")).otherwise(F.aggregate(steps, start, step, lambda acc: acc["out"]))


def frame_selectors(parts: Column) -> Column:
    one = lambda b: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 2, "0")), b)
    return F.aggregate(parts, F.unhex(F.lit("")), lambda acc, b: F.concat(acc, one(b)))


def word(n: Column) -> Column:
    """A non-negative long as a 32-byte big-endian word."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 64, "0"))


def address_word(n: Column) -> Column:
    """A non-negative long as a 20-byte address."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 40, "0"))


def word_at(data: Column, k: int | Column) -> Column:
    """The k-th word of data."""
    return F.substring(data, F.lit(32 * k + 1) if isinstance(k, int) else k * 32 + 1, F.lit(32))


def to_address(w: Column) -> Column:
    return F.substring(w, 13, 20)


def to_bytes(w: Column, n: int) -> Column:
    return F.substring(w, 1, n)


def to_bool(w: Column) -> Column:
    return F.substring(w, 32, 1) != F.unhex(F.lit("00"))


def _u64(w: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(w, at, 8)), 16, 10).cast("decimal(20,0)")


def to_long(w: Column) -> Column:
    """The low 64 bits where they fit a signed integer; null if they do not."""
    return F.conv(F.hex(F.substring(w, 25, 8)), 16, 10).try_cast("bigint")


def to_decimal(w: Column) -> Column:
    """The low 120 bits as decimal(38,0)."""
    high = F.conv(F.hex(F.substring(w, 18, 7)), 16, 10).cast("decimal(17,0)")
    return (high * F.lit("18446744073709551616").cast("decimal(20,0)") + _u64(w, 25)).cast("decimal(38,0)")


def is_negative(w: Column) -> Column:
    return F.conv(F.hex(F.substring(w, 1, 1)), 16, 10).cast("int") >= 128


def to_signed_long(w: Column) -> Column:
    """Two's complement of up to 64 bits."""
    low = _u64(w, 25)
    return F.when(is_negative(w), low - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(low).try_cast("bigint")


def sort_key(w: Column, signed: bool) -> Column:
    """A word whose byte order is the order of its value: the sign bit of signed ones is flipped."""
    if not signed:
        return w
    first = F.conv(F.hex(F.substring(w, 1, 1)), 16, 10).cast("int")
    return F.concat(F.unhex(F.lpad(F.hex(F.pmod(first + 128, F.lit(256)).cast("bigint")), 2, "0")), F.substring(w, 2, 31))


def bit_length(w: Column) -> Column:
    """Bits of an unsigned word without leading zeros: a long to push down before a wide comparison."""
    digits = F.regexp_replace(F.hex(w), "^0+", "")
    lead = F.conv(F.substring(digits, 1, 1), 16, 2)
    return F.when(digits == "", F.lit(0)).otherwise(4 * (F.length(digits) - 1) + F.length(lead)).cast("bigint")


def limbs(w: Column) -> Column:
    """Eight 32-bit limbs, most significant first."""
    return F.array(*(F.conv(F.hex(F.substring(w, 4 * k + 1, 4)), 16, 10).cast("bigint") for k in range(8)))


def limbs_text(parts: Column, digits: int = 9) -> Column:
    """Decimal text of 32-bit limbs by long division, ``digits`` places of base 10**9."""
    none = F.array().cast("array<bigint>")

    def divide(acc: Column, _: Column) -> Column:
        start = F.struct(none.alias("q"), F.lit(0).cast("bigint").alias("r"))
        step = lambda a, x: F.struct(F.concat(a["q"], F.array(_div(a["r"] * LIMB + x, BILLION))).alias("q"), ((a["r"] * LIMB + x) % BILLION).alias("r"))
        return F.element_at(F.transform(F.array(F.aggregate(acc["x"], start, step)), lambda d: F.struct(d["q"].alias("x"), F.concat(F.array(d["r"]), acc["out"]).alias("out"))), 1)

    start = F.struct(parts.alias("x"), none.alias("out"))
    places = F.aggregate(F.array(*map(F.lit, range(digits))), start, divide, lambda acc: acc["out"])
    text = F.array_join(F.transform(places, lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+(?=[0-9])", "")


def _long_division_text(w: Column) -> Column:
    """Decimal text of any word: four 64-bit limbs divided by 10**18 in decimals, five times."""
    wide, none = "decimal(38,0)", F.array().cast("array<decimal(38,0)>")
    power, base = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(10**18)).cast("decimal(19,0)")
    parts = F.array(*(F.conv(F.hex(F.substring(w, 8 * k + 1, 8)), 16, 10).cast(wide) for k in range(4)))

    def divide(acc: Column, _: Column) -> Column:
        start = F.struct(none.alias("q"), F.lit(0).cast(wide).alias("r"))

        def step(a: Column, x: Column) -> Column:
            whole = (a["r"].cast("decimal(18,0)") * power).cast(wide) + x
            low = (whole % base).cast(wide)
            return F.struct(F.concat(a["q"], F.array(((whole.cast(wide) - low) / base).cast(wide))).alias("q"), low.alias("r"))

        return F.element_at(F.transform(F.array(F.aggregate(acc["x"], start, step)), lambda d: F.struct(d["q"].alias("x"), F.concat(F.array(d["r"]), acc["out"]).alias("out"))), 1)

    places = F.aggregate(F.array(*map(F.lit, range(5))), F.struct(parts.alias("x"), none.alias("out")), divide, lambda acc: acc["out"])
    text = F.array_join(F.transform(places, lambda d: F.lpad(d.cast("string"), 18, "0")), "")
    return F.regexp_replace(text, "^0+(?=[0-9])", "")


def uint256_text(w: Column) -> Column:
    """Exact decimal text. Most values have 64 or 120 bits and need one conversion or one product; only larger ones are divided."""
    zeros = lambda n: F.substring(w, 1, n) == F.lit(bytes(n))
    return F.when(zeros(24), F.conv(F.hex(F.substring(w, 25, 8)), 16, 10)).when(zeros(17), to_decimal(w).cast("string")).otherwise(_long_division_text(w))


def int256_text(w: Column) -> Column:
    """Signed: short negative words by their low half, others with the limbs inverted and one added with carry."""
    low = F.lit(str(1 << 64)).cast("decimal(20,0)") - _u64(w, 25)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(1).cast("bigint").alias("carry"))
    step = lambda a, x: F.struct(F.concat(F.array((LIMB - 1 - x + a["carry"]) % LIMB), a["out"]).alias("out"), _div(LIMB - 1 - x + a["carry"], LIMB).alias("carry"))
    negated = F.aggregate(F.reverse(limbs(w)), start, step, lambda a: a["out"])
    # Twenty-four bytes of ones over a low half of zero stand for -2**64, which the short way gives too.
    short = F.when(F.substring(w, 1, 24) == F.lit(b"\xff" * 24), low.cast("string")).otherwise(limbs_text(negated))
    return F.when(is_negative(w), F.concat(F.lit("-"), short)).otherwise(uint256_text(w))


def limb_sums(w: Column) -> list[Column]:
    """Sums of each limb, for ``sum_text``: partial sums are eight longs, whatever the group's size."""
    return [F.sum(limbs(w)[k]).alias(f"limb_{k}") for k in range(8)]


def sum_text(*sums: Column) -> Column:
    """Exact decimal text of limb sums; the carry runs once a group."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry"))
    step = lambda a, x: F.struct(F.concat(F.array((x + a["carry"]) % LIMB), a["out"]).alias("out"), _div(x + a["carry"], LIMB).alias("carry"))
    parts = F.array(*([*sums][::-1]), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return limbs_text(F.aggregate(parts, start, step, lambda a: a["out"]), 11)
