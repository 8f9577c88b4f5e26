"""Elementwise operators: promotion, broadcasting, and one projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import casts
from ..functions import kernels as K
from ..plans import dtypes as D
from ..plans import shapes as S
from ..plans.dtypes import DType
from ..plans.layout import CONSTANT, Base
from .array import NDArray, asarray, combine, scalar


class Untyped:
    """A plain Python number, which takes the type of what it meets."""

    shape: tuple[int, ...] = ()

    def __init__(self, value):
        self.value = value
        self.operand = (D.COMPLEX if isinstance(value, complex) else D.FLOAT if isinstance(value, float) else D.INT, None)


def operand(x, session=None) -> NDArray | Untyped:
    if isinstance(x, (NDArray, Untyped)):
        return x
    if isinstance(x, (bool, np.generic)) and not isinstance(x, (np.void, np.str_)):
        t = D.dtype(np.asarray(x).dtype)
        return scalar(x.item() if isinstance(x, np.generic) else x, t, session=session)
    if isinstance(x, (int, float, complex)):
        return Untyped(x)
    if x is None or isinstance(x, (str, bytes)):
        raise TypeError(f"not an operand: {x!r}")
    return asarray(x, session=session)


def rank_size(x) -> D.Operand:
    return x.operand if isinstance(x, Untyped) else (x.dtype.rank, x.dtype.size)


def _session(xs):
    return next((x.session for x in xs if isinstance(x, NDArray) and x.session is not None), None)


def typed(x, t: DType, session=None) -> NDArray:
    """An operand as an array of type t."""
    return scalar(x.value, t, session=session) if isinstance(x, Untyped) else cast(x, t)


def _or(*errs: Column | None) -> Column | None:
    own = [e for e in errs if e is not None]
    out = None
    for e in own:
        out = e if out is None else out | e
    return out


def apply(xs: list, types: tuple[DType, ...], kernel) -> NDArray:
    """Cast, broadcast, align and apply a kernel of Columns: kernel(*values) -> (value, type, error)."""
    session = _session(xs)
    arrays = [typed(x, t, session) for x, t in zip(xs, types)]
    shape = S.broadcast([a.shape for a in arrays])
    arrays = _block_by_block(arrays, shape)
    base, coords, cols = combine(arrays, shape)
    value, t, err = kernel(*[c for c, _ in cols])
    out = NDArray(base, coords, value, shape, t, _or(err, *[e for _, e in cols]), session)
    out.lift = _lifted(arrays, base, coords, shape, kernel)
    return out


def _block_by_block(arrays: list[NDArray], shape: tuple[int, ...]) -> list[NDArray]:
    """Elementwise results of different stored arrays of one grid, over a base that pairs their blocks; else the arrays as they are."""
    own = [a for a in arrays if a.base is not CONSTANT]
    plain = lambda a: a.lift is not None and not a.base.stored.region and a.shape == shape and [c.key for c in a.coords] == [("stored", d) for d in range(len(shape))]
    if not shape or len({a.base.key for a in own}) < 2 or any(a.base.stored is None or not plain(a) for a in own) or len({a.base.stored.block for a in own}) > 1:
        return arrays
    both = own[0].base.stored
    for a in own[1:]:
        both = both.paired(a.base.stored)
    over = both.array()

    def moved(a: NDArray) -> NDArray:
        lift = lambda v: a.lift(both.element(a.base.stored, v))
        value, err = lift(over.value)
        out = NDArray(over.base, over.coords, value, shape, a.dtype, err, a.session)
        out.lift = lift
        return out

    return [a if a.base is CONSTANT else moved(a) for a in arrays]


def _lifted(arrays: list[NDArray], base: Base, coords: list, shape: tuple[int, ...], kernel):
    """The result as a function of a stored element, if all operands are that or constants, position for position."""
    st = base.stored
    if st is None or st.region or shape != st.shape or [c.key for c in coords] != [("stored", d) for d in range(len(shape))]:
        return None
    if any(a.base is not CONSTANT and (a.lift is None or a.base.key != base.key or a.shape != shape) for a in arrays):
        return None

    def lift(v: Column):
        own = [(a.value, a.err) if a.base is CONSTANT else a.lift(v) for a in arrays]
        value, _, err = kernel(*[x for x, _ in own])
        return value, _or(err, *[e for _, e in own])

    return lift


def _unary(name: str, kernel, table: list, kind: str):
    def op(array) -> NDArray:
        x = operand(array)
        (t,) = D.resolve(name, [rank_size(x)], table, kind)
        return apply([x], (t,), lambda a: kernel(a, t))

    op.__name__ = op.__qualname__ = name
    return op


def _binary(name: str, kernel, table: list, kind=D.SAFE, two_types: bool = False, float_as_f64: bool = False):
    def op(a, b) -> NDArray:
        a, b = _pair(a, b)
        ta, tb = D.resolve(name, [rank_size(a), rank_size(b)], table, kind, float_as_f64)
        return apply([a, b], (ta, tb), (lambda x, y: kernel(x, y, ta, tb)) if two_types else (lambda x, y: kernel(x, y, ta)))

    op.__name__ = op.__qualname__ = name
    return op


def _pair(a, b):
    session = _session([a, b])
    return operand(a, session), operand(b, session)


_ARITH = [*D.REALS, *D.COMPLEXES]
_SIGNED = [D.i8, D.i16, D.i32, D.i64, *D.FLOATS, *D.COMPLEXES]
_BITS = [D.bool_, *D.INTS]

add = _binary("add", K.add, _ARITH)
subtract = sub = _binary("subtract", K.subtract, [D.i8, D.u8, *D.INTS[2:], *D.FLOATS, *D.COMPLEXES])
_multiply = _binary("multiply", K.multiply, _ARITH)
sign = _unary("sign", K.sign, D.REALS, D.NONE)
square = _unary("square", K.square, _ARITH, D.NONE)


def multiply(a, b) -> NDArray:
    """a * b; an array times itself is its square."""
    if a is b and isinstance(a, NDArray) and a.dtype.rank != D.BOOL:
        return square(a)
    return _multiply(a, b)


mul = multiply
_DIVIDE = {
    None: _binary("divide", K.divide, [*D.FLOATS, *D.COMPLEXES]), "trunc": _binary("divide", K.divide_trunc, D.REALS),
    "floor": _binary("divide", K.divide_floor, D.REALS), "euclid": _binary("divide", K.divide_euclid, D.REALS)}
_REMAINDER = {m: _binary("remainder", k, D.REALS) for m, k in (("trunc", K.remainder_trunc), ("floor", K.remainder_floor), ("euclid", K.remainder_euclid))}


def divide(a, b, *, rounding_mode: str | None = None) -> NDArray:
    """True division, or with a rounding mode ('trunc', 'floor', 'euclid') a whole quotient."""
    if rounding_mode not in _DIVIDE:
        raise ValueError(f"rounding_mode {rounding_mode!r}")
    return _DIVIDE[rounding_mode](a, b)


def remainder(a, b, *, rounding_mode: str = "floor") -> NDArray:
    if rounding_mode not in _REMAINDER:
        raise ValueError(f"rounding_mode {rounding_mode!r}")
    return _REMAINDER[rounding_mode](a, b)


div = divide
_POWER = [(D.u8, D.u8), (D.i8, D.u8), (D.u16, D.u16), (D.i16, D.u16), (D.u32, D.u32), (D.i32, D.u32), (D.u64, D.u32), (D.i64, D.u32), (D.i8, D.i8), (D.i16, D.i16), (D.i32, D.i32), (D.i64, D.i64), *((f, e) for f in D.FLOATS for e in (D.i32, f))]
_power = _binary("power", K.power, _POWER, two_types=True)


def power(a, b) -> NDArray:
    """a ** b; exponents 2 and 0.5 become square and sqrt of the promoted base."""
    own = _pair(a, b)
    if isinstance(own[1], Untyped) and own[1].value in (2, 0.5) and not isinstance(own[1].value, complex):
        half = own[1].value == 0.5
        t = D.resolve("power", [rank_size(x) for x in own], [r for r in _POWER if not half or r[0].rank == D.FLOAT])[0]
        return apply([own[0]], (t,), lambda x: (K.sqrt if half else K.square)(x, t))
    return _power(*own)


pow = power


def negative(array) -> NDArray:
    """-a; an unsigned array becomes the signed one of its width."""
    x = operand(array)
    if rank_size(x)[0] == D.UINT:
        return apply([x], (x.dtype,), lambda a: K.negative(a, x.dtype))
    (t,) = D.resolve("negative", [rank_size(x)], _SIGNED)
    return apply([x], (t,), lambda a: K.negative(a, t))


def absolute(array) -> NDArray:
    x = operand(array)
    if rank_size(x)[0] in (D.UINT, D.BOOL) and isinstance(x, NDArray):
        return x
    (t,) = D.resolve("absolute", [rank_size(x)], _SIGNED, D.NONE)
    return apply([x], (t,), lambda a: K.absolute(a, t))


neg, abs = negative, absolute
sqrt, exp = _unary("sqrt", K.sqrt, D.FLOATS, D.SAFE), _unary("exp", K.exp, D.FLOATS, D.SAFE)
sin, cos, tan = (_unary(n, k, D.FLOATS, D.SAFE) for n, k in (("sin", K.sin), ("cos", K.cos), ("tan", K.tan)))
asin, acos, atan = (_unary(n, k, D.FLOATS, D.SAFE) for n, k in (("asin", K.asin), ("acos", K.acos), ("atan", K.atan)))
_ln, log2, log10 = (_unary("log", k, D.FLOATS, D.SAFE) for k in (K.ln, K.log2, K.log10))
isnan, isinf, isfinite = (_unary(n, k, D.FLOATS, D.NONE) for n, k in (("isnan", K.isnan), ("isinf", K.isinf), ("isfinite", K.isfinite)))


def log(array, base: float | None = None) -> NDArray:
    """Natural logarithm, or to a base; bases 2 and 10 are exact."""
    if base is None:
        return _ln(array)
    if not base > 0 or base == 1:
        raise ValueError(f"bad base {base}")
    if base in (2, 10):
        return (log2 if base == 2 else log10)(array)
    x = _ln(array)
    t, by = x.dtype, float(np.log(base))
    return apply([x], (t,), lambda a: (casts.wrap(a.cast("double") / by, t), t, None))


def _whole(name: str, kernel):
    inner = _unary(name, kernel, D.FLOATS, D.NONE)

    def op(array) -> NDArray:
        x = operand(array)
        return x if rank_size(x)[0] in (D.UINT, D.INT) and isinstance(x, NDArray) else inner(x)

    op.__name__ = op.__qualname__ = name
    return op


floor, ceil, round = _whole("floor", K.floor), _whole("ceil", K.ceil), _whole("round", K.round_)

_CMP = [*D.INTS, (D.u64, D.i64), (D.i64, D.u64), *D.FLOATS]
equal, not_equal = (_binary(n, k, [*_CMP, *D.COMPLEXES, D.bool_], two_types=True, float_as_f64=True) for n, k in (("equal", K.equal), ("not_equal", K.not_equal)))
greater, greater_equal, less, less_equal = (
    _binary(n, k, [*_CMP, D.bool_], two_types=True, float_as_f64=True)
    for n, k in (("greater", K.greater), ("greater_equal", K.greater_equal), ("less", K.less), ("less_equal", K.less_equal)))


def isclose(a, b, rtol: float, atol: float) -> NDArray:
    """|a - b| <= max(atol, rtol * max(|a|, |b|)); symmetric, both tolerances are needed."""
    a, b = _pair(a, b)
    t = D.resolve("isclose", [rank_size(a), rank_size(b)], [*D.REALS, *D.COMPLEXES])[0]
    return apply([a, b], (t, t), lambda x, y: K.isclose(x, y, t, rtol, atol))


def where(cond, x, y) -> NDArray:
    """x where cond, else y; errors of the branch that is not selected surface too."""
    session = _session([cond, x, y])
    c, x, y = operand(cond, session), operand(x, session), operand(y, session)
    if rank_size(c)[0] != D.BOOL:
        raise TypeError("the condition of where must be a bool array")
    t = x.dtype if isinstance(x, NDArray) and isinstance(y, NDArray) and x.dtype == y.dtype else D.promote("where", [rank_size(x), rank_size(y)])
    return apply([c, x, y], (D.bool_, t, t), lambda k, p, q: (F.when(k, p).otherwise(q), t, None))


_ORDERED = [D.bool_, *D.REALS]
maximum, minimum = _binary("maximum", K.maximum, _ORDERED), _binary("minimum", K.minimum, _ORDERED)


def clamp(array, min=None, max=None) -> NDArray:
    """minimum(maximum(x, min), max); a bound may be missing."""
    out = asarray(array)
    if min is not None:
        out = maximum(out, min)
    return out if max is None else minimum(out, max)


clip = clamp
_LOGIC = [D.bool_]
logical_and, logical_or, logical_xor = (_binary(n, k, _LOGIC, D.UNSAFE) for n, k in (("logical_and", K.bit_and), ("logical_or", K.bit_or), ("logical_xor", K.bit_xor)))
logical_not = _unary("logical_not", K.logical_not, _LOGIC, D.UNSAFE)
bitwise_and, bitwise_or, bitwise_xor = (_binary(n, k, _BITS) for n, k in (("bitwise_and", K.bit_and), ("bitwise_or", K.bit_or), ("bitwise_xor", K.bit_xor)))
bitwise_not = _unary("bitwise_not", K.bit_not, _BITS, D.NONE)
bitwise_left_shift, bitwise_right_shift = _binary("bitwise_left_shift", K.shift_left, D.INTS), _binary("bitwise_right_shift", K.shift_right, D.INTS)
_ROTATE = [(t, D.u32) for t in (D.i64, D.u64, D.i32, D.u32, D.i16, D.u16, D.i8, D.u8)]


def _rotate(name: str, kernel):
    inner = _binary(name, kernel, _ROTATE, (D.NONE, D.SAFE), two_types=True)

    def op(a, b) -> NDArray:
        a, b = _pair(a, b)
        if isinstance(b, Untyped) and isinstance(b.value, int):
            b = scalar(b.value, D.u32, session=_session([a]))
        return inner(a, b)

    op.__name__ = op.__qualname__ = name
    return op


bitwise_rotate_left, bitwise_rotate_right = _rotate("bitwise_rotate_left", K.rotate_left), _rotate("bitwise_rotate_right", K.rotate_right)
count_ones, count_zeros, leading_zeros, trailing_zeros = (_unary(n, k, D.INTS, D.NONE) for n, k in (("count_ones", K.count_ones), ("count_zeros", K.count_zeros), ("leading_zeros", K.leading_zeros), ("trailing_zeros", K.trailing_zeros)))
byteswap, reverse_bits = _unary("byteswap", K.byteswap, _BITS, D.NONE), _unary("reverse_bits", K.reverse_bits, _BITS, D.NONE)


def cast(array, dtype) -> NDArray:
    """Convert the elements; a cast to the same type is no operation."""
    a, t = asarray(array), D.dtype(dtype)
    if a.dtype == t:
        return a
    return a.mapped(lambda v: casts.cast(v, a.dtype, t), t)


def real(array) -> NDArray:
    a = asarray(array)
    if a.dtype.rank != D.COMPLEX:
        if a.dtype.rank == D.OTHER:
            raise TypeError(f"real of {a.dtype}")
        return a
    return a.mapped(lambda v: v["re"], D.f32 if a.dtype == D.c64 else D.f64)


def imag(array) -> NDArray:
    a = asarray(array)
    if a.dtype.rank != D.COMPLEX:
        raise TypeError(f"imag of {a.dtype}")
    return a.mapped(lambda v: v["im"], D.f32 if a.dtype == D.c64 else D.f64)


def dtype_sub_field(array, name: str) -> NDArray:
    """A field of a struct array; only its column is read."""
    a = asarray(array)
    if not a.dtype.fields or a.dtype.inner:
        raise TypeError(f"{a.dtype} has no fields")
    of = dict(a.dtype.fields)
    if name not in of:
        raise ValueError(f"{a.dtype} has no field {name!r}")
    return a.mapped(lambda v: v.getField(name), of[name])


def transmute(array, dtype) -> NDArray:
    """Reinterpret the bits of integers as those of another integer type of the same width."""
    a, t = asarray(array), D.dtype(dtype)
    if a.dtype.size != t.size or D.OTHER in (a.dtype.rank, t.rank) or (a.dtype.rank == D.COMPLEX) != (t.rank == D.COMPLEX):
        raise TypeError(f"{a.dtype} and {t} differ in width")
    if a.dtype == t:
        return a
    if a.dtype.is_int and t.is_int:
        return cast(a, t)
    src, dst, back = a.dtype.numpy, t.numpy, t

    @F.pandas_udf(t.spark)
    def view(s):
        import pandas as pd

        x = s.to_numpy().astype(src).view(dst)
        return pd.Series(x.view(np.int64) if back == D.u64 else x)

    return a.replace(value=view(a.value), dtype=t)


def map(array, f, dtype) -> NDArray:
    """A function of one element: Column -> Column, or a pandas UDF."""
    return map_multiple([array], f, dtype)


def map2(a, b, f, dtype) -> NDArray:
    return map_multiple([a, b], f, dtype)


def map_multiple(arrays, f, dtype) -> NDArray:
    """A function of the elements of several arrays of one shape."""
    own, t = [asarray(a) for a in arrays], D.dtype(dtype)
    if len({a.shape for a in own}) != 1:
        raise RuntimeError(f"shapes {[a.shape for a in own]} differ")
    return apply(own, tuple(a.dtype for a in own), lambda *cols: (f(*cols).cast(t.spark), t, None))
