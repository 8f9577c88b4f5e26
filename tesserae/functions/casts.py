"""Casts between element types, and the wrapping that follows an operation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dtypes as D
from ..plans.dtypes import DType

_INT_RANGE = {t.name: (-(1 << (t.bits - 1)), (1 << (t.bits - 1)) - 1) for t in (D.i8, D.i16, D.i32, D.i64)} | {t.name: (0, (1 << t.bits) - 1) for t in (D.u8, D.u16, D.u32, D.u64)}


def int_range(t: DType) -> tuple[int, int]:
    return _INT_RANGE[t.name]


def is_nan(c: Column, t: DType) -> Column:
    return F.isnan(c) if t.rank == D.FLOAT else F.lit(False)


def half(c: Column) -> Column:
    """Round a double to the nearest half-precision value, ties to even; overflow is infinite."""
    x = F.abs(c)
    e = F.floor(F.log2(F.when(x > 0, x).otherwise(1.0)))
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    q = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    r = F.rint(x / q) * q
    r = F.when(r > 65504, float("inf")).otherwise(r)
    keep = F.isnan(c) | (x == float("inf")) | (x == 0)
    return F.when(keep, c).otherwise(F.when(c < 0, -r).otherwise(r))


def wrap(c: Column, t: DType) -> Column:
    """Bring a result back to its type: integers wrap, floats round."""
    if t.rank == D.UINT and t.size < 8:
        return c.cast("bigint").bitwiseAND(F.lit((1 << t.bits) - 1)).cast(t.spark)
    if t == D.f16:
        return half(c.cast("double")).cast("float")
    return c.cast(t.spark)


def unsigned_double(c: Column) -> Column:
    """A u64 bit pattern as the nearest double."""
    odd = F.shiftrightunsigned(c, 1).bitwiseOR(c.bitwiseAND(F.lit(1)))
    return F.when(c >= 0, c.cast("double")).otherwise(odd.cast("double") * 2)


def unsigned_decimal(c: Column) -> Column:
    return F.when(c >= 0, c.cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def decimal_bits(c: Column) -> Column:
    """The u64 bit pattern of a decimal in range."""
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(c < top, c.cast("bigint")).otherwise((c - top).cast("bigint") + F.lit(-(1 << 63)))


def ordered(c: Column, t: DType) -> Column:
    """A column that compares as the type does."""
    return c.bitwiseXOR(F.lit(-(1 << 63))) if t == D.u64 else c


def cast(c: Column, src: DType, dst: DType) -> Column:
    if src == dst:
        return c
    if src.rank == D.OTHER or dst.rank == D.OTHER:
        raise TypeError(f"no cast from {src} to {dst}")
    if src.rank == D.COMPLEX:
        if dst.rank == D.BOOL:
            return (c["re"] != 0) | (c["im"] != 0)
        if dst.rank != D.COMPLEX:
            raise TypeError(f"no cast from {src} to {dst}")
        return pair(c["re"], c["im"], dst)
    if dst.rank == D.COMPLEX:
        return pair(cast(c, src, D.f32 if dst == D.c64 else D.f64), F.lit(0.0), dst)
    if dst.rank == D.BOOL:
        return c != 0
    if src.rank == D.BOOL:
        return c.cast("int").cast(dst.spark)
    if src.rank == D.FLOAT:
        return c.cast(dst.spark) if dst in (D.f32, D.f64) else half(c.cast("double")).cast("float") if dst == D.f16 else _float_to_int(c, dst)
    if dst.rank == D.FLOAT:
        if src == D.u64:
            wide = unsigned_double(c)
            if dst == D.f32:  # one rounding, not two
                odd = F.shiftrightunsigned(c, 1).bitwiseOR(c.bitwiseAND(F.lit(1)))
                return F.when(c >= 0, c.cast("float")).otherwise((odd.cast("float") * 2).cast("float"))
        else:
            wide = c
        return half(wide.cast("double")).cast("float") if dst == D.f16 else wide.cast(dst.spark)
    return wrap(c.cast("bigint"), dst)


def _float_to_int(c: Column, dst: DType) -> Column:
    """Truncate towards zero, saturate, and turn NaN into zero."""
    x = c.cast("double")
    if dst == D.u64:
        top = float(1 << 63)
        big = F.when(x >= 2 * top, F.lit(-1).cast("bigint")).otherwise((x - top).cast("bigint") + F.lit(-(1 << 63)))
        return F.when(F.isnan(x) | (x <= 0), F.lit(0).cast("bigint")).when(x < top, x.cast("bigint")).otherwise(big)
    if dst == D.i64:
        return x.cast("bigint")  # saturates; NaN gives 0
    lo, hi = int_range(dst)
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))).cast("bigint")).cast(dst.spark)


def pair(re: Column, im: Column, t: DType) -> Column:
    part = "float" if t == D.c64 else "double"
    return F.struct(re.cast(part).alias("re"), im.cast(part).alias("im"))


def literal(v, t: DType) -> Column:
    """A Python number as a typed literal; OverflowError if an integer does not fit."""
    if t.rank == D.COMPLEX:
        z = complex(v)
        return pair(F.lit(z.real), F.lit(z.imag), t)
    if t.rank == D.BOOL:
        return F.lit(bool(v))
    if t.rank == D.FLOAT:
        return cast(F.lit(float(v)), D.f64, t)
    lo, hi = int_range(t)
    n = int(v)
    if not lo <= n <= hi:
        raise OverflowError(f"{n} does not fit {t}")
    return F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast(t.spark)
