"""Elementwise kernels.

A kernel takes Columns that were cast to the types of a dispatch row and those
types, and returns (value, type, error); error is a Column that is true where
the element has no result, or None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dtypes as D
from ..plans.dtypes import DType
from .casts import cast, decimal_bits, is_nan, ordered, pair, unsigned_decimal, wrap

Result = tuple[Column, DType, Column | None]
_MIN = -(1 << 63)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


# arithmetic


def add(a, b, t: DType) -> Result:
    return (pair(a["re"] + b["re"], a["im"] + b["im"], t) if t.rank == D.COMPLEX else wrap(_wide(a, t) + _wide(b, t), t)), t, None


def subtract(a, b, t: DType) -> Result:
    return (pair(a["re"] - b["re"], a["im"] - b["im"], t) if t.rank == D.COMPLEX else wrap(_wide(a, t) - _wide(b, t), t)), t, None


def multiply(a, b, t: DType) -> Result:
    if t.rank == D.COMPLEX:
        x, y, u, v = (c.cast("double") if t == D.c128 else c for c in (a["re"], a["im"], b["re"], b["im"]))
        return pair(x * u - y * v, x * v + y * u, t), t, None
    return wrap(_wide(a, t) * _wide(b, t), t), t, None


def _wide(c: Column, t: DType) -> Column:
    """Small integers are computed as longs, halves as doubles."""
    return c.cast("bigint") if t.is_int else c.cast("double") if t == D.f16 else c


def ieee_divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles or floats: Spark has NULL for a zero divisor."""
    zero = a.cast("double") * F.pow(b.cast("double"), F.lit(-1.0))
    return F.when(b == 0, zero).otherwise(a / b)


def divide(a, b, t: DType) -> Result:
    if t.rank == D.COMPLEX:
        x, y, u, v = (c.cast("double") for c in (a["re"], a["im"], b["re"], b["im"]))
        n = u * u + v * v
        return pair(ieee_divide(x * u + y * v, n), ieee_divide(y * u - x * v, n), t), t, None
    return wrap(ieee_divide(_wide(a, t), _wide(b, t)), t), t, None


def _int_parts(a, b, t: DType) -> tuple[Column, Column, Column]:
    """(zero divisor, quotient towards zero, remainder with the dividend's sign) of integers as longs or decimals."""
    zero = b == 0
    if t == D.u64:
        x, y = unsigned_decimal(a), F.when(zero, F.lit(1).cast("decimal(20,0)")).otherwise(unsigned_decimal(b))
        r = (x % y).cast("decimal(20,0)")
        q = F.floor((x - r) / y).cast("decimal(20,0)")
        # the quotient of an exact division, found without rounding
        small = (a >= 0) & (b > 0)
        div = F.call_function("div", a, F.when(small, b).otherwise(_long(1)))
        big = F.when(y > F.lit("9223372036854775807").cast("decimal(20,0)"), F.when(x >= y, 1).otherwise(0).cast("bigint")).otherwise(decimal_bits(q))
        return zero, F.when(small, div).otherwise(big), decimal_bits(r)
    x, y = a.cast("bigint"), F.when(zero, _long(1)).otherwise(b.cast("bigint"))
    return zero, F.call_function("div", x, y), x % y


def _float_rem(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; NaN for a zero or NaN divisor or an infinite dividend."""
    inf = float("inf")
    bad = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == inf)
    return F.when(bad, float("nan")).when(F.abs(b) == inf, a).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def _fix(c: Column) -> Column:
    """Truncation of a double that keeps large and special values."""
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(F.when(c < 0, -F.floor(-c).cast("double")).otherwise(F.floor(c).cast("double")))


def divide_trunc(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        return wrap(_fix(ieee_divide(a.cast("double"), b.cast("double")) if t == D.f64 else ieee_divide(_wide(a, t), _wide(b, t)).cast("double")), t), t, None
    zero, q, _ = _int_parts(a, b, t)
    return wrap(q, t), t, zero


def _float_quotient(a: Column, b: Column, r: Column) -> Column:
    return F.when(b == 0, ieee_divide(a, b)).otherwise(F.when(F.isnan(r), r).otherwise(_round((a - r) / F.when(b == 0, F.lit(1.0)).otherwise(b))))


def divide_floor(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        x, y = a.cast("double"), b.cast("double")
        r = _float_rem(x, y)
        q = _float_quotient(x, y, r)
        return wrap(q - F.when((r != 0) & ~F.isnan(r) & ((r < 0) != (y < 0)), 1.0).otherwise(0.0), t), t, None
    zero, q, r = _int_parts(a, b, t)
    if t.rank == D.INT:
        q = q - F.when((r != 0) & ((r < 0) != (b.cast("bigint") < 0)), 1).otherwise(0)
    return wrap(q, t), t, zero


def divide_euclid(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        x, y = a.cast("double"), b.cast("double")
        r = _float_rem(x, y)
        q = _float_quotient(x, y, r)
        return wrap(F.when(~F.isnan(r) & (r < 0), q - F.signum(y)).otherwise(q), t), t, None
    zero, q, r = _int_parts(a, b, t)
    if t.rank == D.INT:
        q = F.when(r < 0, q - F.when(b > 0, 1).otherwise(-1)).otherwise(q)
    return wrap(q, t), t, zero


def remainder_trunc(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        return wrap(_float_rem(a.cast("double"), b.cast("double")), t), t, None
    zero, _, r = _int_parts(a, b, t)
    return wrap(r, t), t, zero


def remainder_floor(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        x, y = a.cast("double"), b.cast("double")
        r = _float_rem(x, y)
        return wrap(F.when(~F.isnan(r) & (r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), t), t, None
    zero, _, r = _int_parts(a, b, t)
    if t.rank == D.INT:
        y = b.cast("bigint")
        r = F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)
    return wrap(r, t), t, zero


def remainder_euclid(a, b, t: DType) -> Result:
    if t.rank == D.FLOAT:
        x, y = a.cast("double"), b.cast("double")
        r = _float_rem(x, y)
        return wrap(F.when(~F.isnan(r) & (r < 0), r + F.abs(y)).otherwise(r), t), t, None
    zero, _, r = _int_parts(a, b, t)
    if t.rank == D.INT:
        r = F.when(r < 0, r + F.abs(b.cast("bigint"))).otherwise(r)
    return wrap(r, t), t, zero


def power(a, b, ta: DType, tb: DType) -> Result:
    if ta.rank == D.FLOAT:
        return wrap(F.pow(a.cast("double"), b.cast("double")), ta), ta, None
    base, e = a.cast("bigint"), F.greatest(b.cast("bigint"), _long(0)) if tb != D.u64 else b
    # square and multiply over the bits of the exponent, wrapping
    steps = F.sequence(F.lit(0), F.greatest(F.length(F.bin(e)) - 1, F.lit(0)))
    start = F.struct(_long(1).alias("acc"), base.alias("sq"))
    out = F.aggregate(steps, start, lambda s, k: F.struct(F.when(F.expr("1L").bitwiseAND(F.call_function("shiftright", e, k)) == 1, s["acc"] * s["sq"]).otherwise(s["acc"]).alias("acc"), (s["sq"] * s["sq"]).alias("sq")))
    return wrap(out["acc"], ta), ta, (b < 0) if tb.rank == D.INT else None


def negative(a, t: DType) -> Result:
    if t.rank == D.COMPLEX:
        return pair(-a["re"], -a["im"], t), t, None
    if t.rank == D.UINT:
        out = D.SCALARS["i" + t.name[1:]]
        return wrap(-cast(a, t, out).cast("bigint"), out), out, None
    return wrap(-_wide(a, t), t), t, None


def absolute(a, t: DType) -> Result:
    if t.rank == D.COMPLEX:
        out = D.f32 if t == D.c64 else D.f64
        return wrap(F.hypot(a["re"], a["im"]), out), out, None
    return (a, t, None) if t.rank in (D.UINT, D.BOOL) else (wrap(F.abs(_wide(a, t)), t), t, None)


def sign(a, t: DType) -> Result:
    if t.rank == D.UINT:
        return wrap(F.when(a == 0, 0).otherwise(1), t), t, None
    return wrap(F.signum(a.cast("double")), t), t, None


def square(a, t: DType) -> Result:
    return multiply(a, a, t)


# exponential, trigonometric, rounding


def unary_float(f: Callable[[Column], Column]) -> Callable[..., Result]:
    return lambda a, t: (wrap(f(a.cast("double")), t), t, None)


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    nan, inf = float("nan"), float("inf")
    return lambda x: F.when(F.isnan(x) | (x < 0), nan).when(x == 0, -inf).otherwise(f(F.when(x > 0, x).otherwise(1.0)))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def _round(x: Column) -> Column:
    """Half away from zero; the fraction of |x| is exact below 2**52."""
    a = F.abs(x)
    whole = F.floor(a).cast("double")
    near = whole + F.when(a - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.isnan(x) | (a >= 2.0**52), x).otherwise(F.when(x < 0, -near).otherwise(near))


sqrt, exp = unary_float(F.sqrt), unary_float(F.exp)
ln, log2, log10 = unary_float(_log(F.ln)), unary_float(_log(F.log2)), unary_float(_log(F.log10))
sin, cos, tan = unary_float(F.sin), unary_float(F.cos), unary_float(F.tan)
asin, acos, atan = unary_float(F.asin), unary_float(F.acos), unary_float(F.atan)
floor, ceil, round_ = unary_float(_whole(F.floor)), unary_float(_whole(F.ceil)), unary_float(_round)


def isnan(a, t: DType) -> Result:
    return F.isnan(a), D.bool_, None


def isinf(a, t: DType) -> Result:
    return (F.abs(a) == float("inf")) & ~F.isnan(a), D.bool_, None


def isfinite(a, t: DType) -> Result:
    return ~F.isnan(a) & (F.abs(a) != float("inf")), D.bool_, None


# comparison and selection


def _compared(a, b, ta: DType, tb: DType) -> tuple[Column, Column]:
    if {ta, tb} == {D.u64, D.i64}:
        return tuple(unsigned_decimal(c) if t == D.u64 else c.cast("decimal(20,0)") for c, t in ((a, ta), (b, tb)))
    return ordered(a, ta), ordered(b, tb)


def _sane(a, b, ta: DType, tb: DType) -> Column:
    return ~(is_nan(a, ta) | is_nan(b, tb)) if D.FLOAT in (ta.rank, tb.rank) else F.lit(True)


def equal(a, b, ta: DType, tb: DType) -> Result:
    if ta.rank == D.COMPLEX:
        part = D.f32 if ta == D.c64 else D.f64
        return equal(a["re"], b["re"], part, part)[0] & equal(a["im"], b["im"], part, part)[0], D.bool_, None
    x, y = _compared(a, b, ta, tb)
    return (x == y) & _sane(a, b, ta, tb), D.bool_, None


def not_equal(a, b, ta: DType, tb: DType) -> Result:
    return ~equal(a, b, ta, tb)[0], D.bool_, None


def less(a, b, ta: DType, tb: DType) -> Result:
    x, y = _compared(a, b, ta, tb)
    return (x < y) & _sane(a, b, ta, tb), D.bool_, None


def less_equal(a, b, ta: DType, tb: DType) -> Result:
    x, y = _compared(a, b, ta, tb)
    return (x <= y) & _sane(a, b, ta, tb), D.bool_, None


def greater(a, b, ta: DType, tb: DType) -> Result:
    return less(b, a, tb, ta)


def greater_equal(a, b, ta: DType, tb: DType) -> Result:
    return less_equal(b, a, tb, ta)


def isclose(a, b, t: DType, rtol: float, atol) -> Result:
    """|a - b| <= max(atol, rtol * max(|a|, |b|)), infinities only to themselves; complex by part and modulus."""
    inf = float("inf")
    if t.rank == D.COMPLEX:
        d = F.hypot(a["re"] - b["re"], a["im"] - b["im"])
        scale = F.greatest(F.hypot(a["re"], a["im"]), F.hypot(b["re"], b["im"]))
        same = equal(a, b, t, t)[0]
        fine = ~(F.isnan(d) | F.isnan(scale)) & (scale != inf)
        return same | (fine & (d <= F.greatest(F.lit(abs(atol)), rtol * scale))), D.bool_, None
    if t.is_int:
        x, y = (unsigned_decimal(c) if t == D.u64 else c.cast("decimal(20,0)") for c in (a, b))
        d, scale = F.abs(x - y).cast("double"), F.greatest(F.abs(x), F.abs(y)).cast("double")
        return d <= F.greatest(F.lit(float(atol)), rtol * scale), D.bool_, None
    x, y = a.cast("double"), b.cast("double")
    fine = ~(F.isnan(x) | F.isnan(y))
    endless = (F.abs(x) == inf) | (F.abs(y) == inf)
    near = F.abs(x - y) <= F.greatest(F.lit(float(atol)), rtol * F.greatest(F.abs(x), F.abs(y)))
    return fine & F.when(endless, x == y).otherwise(near), D.bool_, None


def maximum(a, b, t: DType) -> Result:
    if t == D.u64:
        return F.when(ordered(a, t) >= ordered(b, t), a).otherwise(b), t, None
    return F.greatest(a, b), t, None  # NaN is the greatest for Spark


def minimum(a, b, t: DType) -> Result:
    if t == D.u64:
        return F.when(ordered(a, t) <= ordered(b, t), a).otherwise(b), t, None
    out = F.least(a, b)
    return (F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan")).cast(t.spark)).otherwise(out) if t.rank == D.FLOAT else out), t, None


# logical and bitwise


def logical_not(a, t: DType) -> Result:
    return ~a, D.bool_, None


def bit_and(a, b, t: DType) -> Result:
    return (a & b if t == D.bool_ else a.bitwiseAND(b)), t, None


def bit_or(a, b, t: DType) -> Result:
    return (a | b if t == D.bool_ else a.bitwiseOR(b)), t, None


def bit_xor(a, b, t: DType) -> Result:
    return (a != b if t == D.bool_ else a.bitwiseXOR(b)), t, None


def bit_not(a, t: DType) -> Result:
    return (~a if t == D.bool_ else wrap(F.bitwise_not(a.cast("bigint")), t)), t, None


def _bits(a: Column, t: DType) -> Column:
    """The element's own bits in the low end of a long."""
    return a.cast("bigint").bitwiseAND(_long((1 << t.bits) - 1)) if t.size < 8 else a.cast("bigint")


def _from_bits(c: Column, t: DType) -> Column:
    return (c.cast("bigint") != 0) if t == D.bool_ else wrap(c, t)


def _shl(c: Column, n: Column) -> Column:
    return F.call_function("shiftleft", c, n.cast("int"))


def _shr(c: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", c, n.cast("int"))


def shift_left(a, b, t: DType) -> Result:
    n = b.cast("bigint")
    out = (n < 0) | (n >= t.bits)
    return F.when(out, wrap(_long(0), t)).otherwise(wrap(_shl(a.cast("bigint"), F.when(out, _long(0)).otherwise(n)), t)), t, None


def shift_right(a, b, t: DType) -> Result:
    n = b.cast("bigint")
    out = (n < 0) | (n >= t.bits)
    if t.rank == D.INT:
        return wrap(F.call_function("shiftright", a.cast("bigint"), F.when(out, t.bits - 1).otherwise(n).cast("int")), t), t, None
    return F.when(out, wrap(_long(0), t)).otherwise(wrap(_shr(_bits(a, t), F.when(out, _long(0)).otherwise(n)), t)), t, None


def rotate_left(a, b, ta: DType, tb: DType) -> Result:
    x, n, w = _bits(a, ta), F.pmod(b.cast("bigint"), _long(ta.bits)), ta.bits
    out = F.when(n == 0, x).otherwise(_shl(x, n).bitwiseOR(_shr(x, w - n)))
    return wrap(out, ta), ta, None


def rotate_right(a, b, ta: DType, tb: DType) -> Result:
    return rotate_left(a, ta.bits - F.pmod(b.cast("bigint"), _long(ta.bits)), ta, tb)


def count_ones(a, t: DType) -> Result:
    return F.bit_count(_bits(a, t)).cast("bigint"), D.u32, None


def count_zeros(a, t: DType) -> Result:
    return (t.bits - F.bit_count(_bits(a, t))).cast("bigint"), D.u32, None


def leading_zeros(a, t: DType) -> Result:
    x = _bits(a, t)
    return F.when(x == 0, t.bits).otherwise(t.bits - F.length(F.bin(x))).cast("bigint"), D.u32, None


def trailing_zeros(a, t: DType) -> Result:
    x = _bits(a, t)
    return F.when(x == 0, t.bits).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("bigint"), D.u32, None


def byteswap(a, t: DType) -> Result:
    if t.size == 1:
        return a, t, None
    x, out = _bits(a, t), _long(0)
    for k in range(t.size):
        out = out.bitwiseOR(_shl(_shr(x, F.lit(8 * k)).bitwiseAND(_long(255)), F.lit(8 * (t.size - 1 - k))))
    return _from_bits(out, t), t, None


_SWAPS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def reverse_bits(a, t: DType) -> Result:
    x = _bits(a, t)
    for n, m in _SWAPS:
        if n < t.bits:
            x = _shr(x, F.lit(n)).bitwiseAND(_long(m)).bitwiseOR(_shl(x.bitwiseAND(_long(m)), F.lit(n)))
    return _from_bits(x, t), t, None
