"""Scalar column functions.  All are built-in Spark expressions (JVM side,
inside whole-stage codegen); none is a Python UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
TWO_POW_32_PLUS_1 = 4294967297.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_regex(sep: str) -> str:
    """Literal separator as a Java regex: ``\\Q...\\E``, or for one ASCII character itself
    (escaped, if it has a meaning), which the JVM splits by without compiling a pattern."""
    if len(sep) == 1 and sep.isascii():
        return "\\" + sep if sep in ".$|()[{^?*+\\" else sep
    return "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_keep_java(col, sep: str) -> Column:
    """Split by a literal separator the way the JVM's ``String.split`` does:
    trailing empty pieces are dropped, except that ``''`` stays ``['']``.
    Spark's own ``split`` keeps trailing empties, so they are cut here."""
    c = _col(col)
    parts = F.split(c, quote_regex(sep), -1)
    # 1-based position (in the reversed array) of the first non-empty piece
    first_full = F.array_position(F.transform(F.reverse(parts), lambda x: x != F.lit("")), True)
    keep = F.size(parts) - first_full + F.lit(1)
    stripped = F.when(first_full == 0, F.array().cast("array<string>")).otherwise(
        F.slice(parts, F.lit(1), keep))
    # most text does not end with a separator, so has no empty piece to drop
    return F.when(~F.endswith(c, F.lit(sep)), parts).when(c == F.lit(""), F.array(F.lit(""))).otherwise(stripped)


def split_list(col, sep: str = ",") -> Column:
    """Tokens of a list field (default separator ``,``)."""
    return split_keep_java(col, sep)


def to_number(col) -> Column:
    """Identity numeric transform: the value as a double.  Under ANSI mode a
    malformed number raises, as in the original."""
    return _col(col).cast("double")


def trunc_div(a: Column, b: int) -> Column:
    """Integer division truncating toward zero (the JVM's ``/`` on longs).
    ``a - a % b`` is an exact multiple of ``b`` (``%`` keeps the dividend's
    sign), so the division is exact."""
    a = a.cast("bigint")
    return ((a - a % F.lit(b)) / F.lit(b)).cast("bigint")


def epoch_seconds(col, dtype: str | None = None) -> Column:
    """Whole epoch seconds of a timestamp column, or of a number / numeric
    string (cast, raising on malformed input under ANSI mode)."""
    c = _col(col)
    if dtype == "timestamp_ntz":
        # wall-clock time read as UTC, independent of the session time zone
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        whole = (days * F.lit(86400) + F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)).cast("bigint")
        micros = whole * F.lit(1_000_000) + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
        return trunc_div(micros, 1_000_000)
    if dtype is not None and dtype.startswith("timestamp"):
        return trunc_div(F.unix_micros(c.cast("timestamp")), 1_000_000)
    return c.cast("bigint")


def epoch_to_days(col, dtype: str | None = None) -> Column:
    """Epoch seconds -> whole days (truncating toward zero), as a double."""
    return trunc_div(epoch_seconds(col, dtype), SECONDS_PER_DAY).cast("double")


def list_weights(tokens) -> Column:
    """Each of m tokens gets 1/m (duplicates count in m)."""
    return F.lit(1.0) / F.size(_col(tokens)).cast("double")


def format_compact(col, decimals: int = 3) -> Column:
    """Integral values as ``#``, others as ``#.###`` with at most ``decimals`` places
    (half-even, as the JVM's DecimalFormat does; ``-0.0004`` prints ``-0``)."""
    if not 0 <= decimals <= 17:
        raise ValueError("decimals must be from 0 to 17")
    c = _col(col).cast("double")
    integral = (c == F.floor(c)) & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    pattern = "#." + "#" * decimals if decimals else "#"
    return F.when(integral, F.call_function("format_number", c, F.lit("#"))).otherwise(
        F.call_function("format_number", c, F.lit(pattern)))


def hash_uniform(*parts) -> Column:
    """Deterministic uniform in (0, 1) from the md5 of ``p1:p2:...``.
    Any engine with md5 gives the same number:
    ``(u32(first 8 hex digits) + 1) / (2^32 + 1)``."""
    key = F.concat_ws(":", *[_col(p).cast("string") if not isinstance(p, (int, float, str))
                             else F.lit(str(p)) for p in parts])
    u32 = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (u32 + F.lit(1)).cast("double") / F.lit(TWO_POW_32_PLUS_1)


def hash_gauss(mean: float, stdev: float, *parts) -> Column:
    """Deterministic normal draw (Box-Muller over two md5 uniforms)."""
    u1 = hash_uniform(*parts, "a")
    u2 = hash_uniform(*parts, "b")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(stdev)) * z
