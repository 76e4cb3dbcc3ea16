"""Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def int_floor_div(value: str, step: int) -> Column:
    """``floor(value / step)`` on bigint columns without going through double."""
    return F.expr(f"(({value}) - pmod(({value}), {step}L)) div {step}L")


def seconds(us: Column) -> Column:
    return us.cast("double") / F.lit(float(MICROS))


def flow_id(src_ip, dst_ip, src_port, dst_port, protocol) -> Column:
    return F.concat(
        src_ip, F.lit(":"), src_port.cast("string"), F.lit("-"),
        dst_ip, F.lit(":"), dst_port.cast("string"), F.lit("-"), protocol,
    )


def characters(text: Column) -> Column:
    """The characters (code points) of ``text``."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of ``text``; 0 for an empty one.

    For names and other short texts; ``functions.text.entropy_by_row`` is for long ones.
    """
    n = F.length(text).cast("double")
    # A character's count is what removing it takes off the length.
    shares = F.transform(
        F.array_distinct(characters(text)),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n,
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def starts_with_any(text: Column, prefixes) -> Column:
    cond = F.lit(False)
    for prefix in prefixes:
        cond = cond | text.startswith(prefix)
    return cond


def joined_reasons(*reasons: Column) -> Column:
    """Non-null reasons joined by ``" and "``."""
    return F.concat_ws(" and ", *reasons)


def parse_double(text: Column) -> Column:
    """Number from text; null where it is not a plain number."""
    trimmed = F.trim(text)
    plain = trimmed.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    special = F.lower(trimmed).rlike(r"^[+-]?(inf|infinity|nan)$")
    word = F.regexp_replace(F.lower(trimmed), r"^[+-]", "")
    negative = trimmed.startswith("-")
    return (
        F.when(plain, F.regexp_replace(trimmed, "_", "").try_cast("double"))
        .when(special & (word == "nan"), F.lit(float("nan")))
        .when(special & negative, F.lit(float("-inf")))
        .when(special, F.lit(float("inf")))
    )


def safe_double(text: Column) -> Column:
    """Number from text; 0.0 for missing, unreadable, NaN or infinite values."""
    value = parse_double(text)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def parse_int(text: Column) -> Column:
    """Integer from text; null unless the text is a whole decimal number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?\d+(_\d+)*$"),
                  F.regexp_replace(trimmed, "_", "").try_cast("int"))


def per_second(amount: Column, duration: Column) -> Column:
    """Rate that is null when the duration is missing or not positive."""
    return F.when(duration > 0, amount / duration)


def byte_ratio(fwd: Column, rev: Column, cap: float = 10000.0) -> Column:
    return F.when(rev > 0, fwd / rev).when(fwd.isNotNull() & rev.isNotNull(), F.lit(cap))


def unidirectional(fwd: Column, rev: Column) -> Column:
    return F.when(fwd.isNotNull() & rev.isNotNull(), F.when(rev == 0, 1.0).otherwise(0.0))


def ipv4_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+\.\d+\.\d+\.\d+)"), F.lit(1))


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor zero, else 0.0."""
    zero = F.lit(0.0)
    return F.coalesce(*[F.when(v != 0, v) for v in values], zero)
