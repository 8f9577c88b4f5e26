"""Reductions: groupBy over the kept dimensions, so Spark aggregates before it shuffles."""

from __future__ import annotations

import builtins

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import casts
from ..plans import dtypes as D
from ..plans import shapes as S
from ..plans.dtypes import DType
from ..plans.layout import WIDE, Base, Coord
from .array import NDArray, Reduced, asarray
from .elementwise import cast

_NUMERIC = [D.bool_, *D.REALS, *D.COMPLEXES]
_ORDERED = [D.bool_, *D.REALS]


def _reduce(a: NDArray, dims: tuple[int, ...], agg, out: DType, keepdim: bool, identity, positional=None) -> NDArray:
    """Aggregate over dims; agg(value, at) gives the aggregate, with at() around every aggregate function in it.

    If a reduced dimension has length zero there is no row to aggregate: every
    position of the result gets the identity, from a grid that the driver's shape
    describes; without an identity the reduction is an error.
    """
    if builtins.any(a.shape[d] == 0 for d in dims) and identity is None:
        raise RuntimeError("reduction of an empty dimension without an identity")
    kept = [d for d in range(a.ndim) if d not in dims]
    shape = tuple(a.shape[d] for d in kept)
    origin = None
    if builtins.any(a.shape[d] == 0 for d in dims):
        spark = a.session
        whole = NDArray(_constant(), [WIDE] * len(kept), identity.cast(out.spark), shape, out, session=spark)
        res = whole._from_range()
    else:
        a = a.spread(dims)
        if a.base.df is None:
            a = a._from_range()
        own = [d for d in kept if a.coords[d].col is not None]
        df = a.base.df.select(*[a.coords[d].col.alias(f"d{d}") for d in [*own, *dims]], a.guarded().alias("v"))
        plain = agg(F.col("v"), lambda x: x).alias("v")
        res_df = df.groupBy(*[f"d{d}" for d in own]).agg(plain) if own else df.agg(plain)
        coords = [Coord(F.col(f"d{d}"), ("own", d)) if d in own else WIDE for d in kept]
        res = NDArray(Base(res_df), coords, casts_back(F.col("v"), out), shape, out)
        if own and len(own) == len(kept) and positional is None:
            value = a.guarded()
            origin = Reduced(a.base, a.coords, list(kept), lambda spec: casts_back(agg(value, lambda x: x.over(spec)), out))
    if keepdim:
        coords = list(res.coords)
        full = list(shape)
        for d in sorted(dims):
            coords.insert(d, WIDE)
            full.insert(d, 1)
            if origin:
                origin.of.insert(d, None)
        res = res.replace(coords=coords, shape=tuple(full))
    res.origin = origin
    return res


def _constant():
    from ..plans.layout import CONSTANT

    return CONSTANT


def casts_back(c: Column, t: DType) -> Column:
    return casts.half(c.cast("double")).cast("float") if t == D.f16 else c.cast(t.spark)


def _start(name: str, array, dim, table) -> tuple[NDArray, tuple[int, ...]]:
    a = asarray(array)
    D.resolve(name, [(a.dtype.rank, a.dtype.size)], table, D.NONE)
    return a, S.dims(dim, a.ndim)


def _complex(f, out: DType):
    part = "float" if out == D.c64 else "double"
    return lambda v, at: F.struct(at(f(v["re"].cast("double"))).cast(part).alias("re"), at(f(v["im"].cast("double"))).cast(part).alias("im"))


def sum(array, dim=None, *, keepdim: bool = False) -> NDArray:
    """Integers add up in 64 bits and wrap; an empty sum is 0."""
    a, dims = _start("sum", array, dim, _NUMERIC)
    t = a.dtype
    if t.rank == D.COMPLEX:
        return _reduce(a, dims, _complex(F.sum, t), t, keepdim, casts.literal(0, t))
    out = t if t.rank == D.FLOAT else D.i64 if t.rank == D.INT else D.u64
    wide = a if t.rank == D.FLOAT else cast(a, out)
    return _reduce(wide, dims, lambda v, at: at(F.sum(v)), out, keepdim, F.lit(0))


def product(array, dim=None, *, keepdim: bool = False) -> NDArray:
    """Integers multiply in 64 bits and wrap, without collecting a group: exponents of a generator modulo 2**64 are added.

    Every odd number modulo 2**64 is +-5**k, so a product is a sign, a count of
    factors two, a zero flag and the sum of logarithms k, all of which sum.
    """
    a, dims = _start("product", array, dim, _NUMERIC[1:])
    t = a.dtype
    if t.rank == D.COMPLEX:
        if S.size(tuple(a.shape[d] for d in dims)) == 0:
            return _reduce(a, dims, None, t, keepdim, casts.literal(1, t))
        # the products of parts of a bounded number of elements, in double precision; whole numbers stay exact
        times = lambda x, y: F.struct((x["re"] * y["re"] - x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] + x["im"] * y["re"]).alias("im"))
        return cast(reduce_unordered(cast(a, D.c128), times, dims, keepdim=keepdim), t)
    if t.rank == D.FLOAT:
        return _reduce(a, dims, lambda v, at: at(F.product(v.cast("double"))), t, keepdim, F.lit(1.0))
    out = D.i64 if t.rank == D.INT else D.u64
    return _reduce(cast(a, out), dims, _int_product, out, keepdim, F.lit(1))


def _int_product(v: Column, at) -> Column:
    zero = v == 0
    x = F.when(zero, F.lit(1).cast("bigint")).otherwise(v)
    twos = F.bit_count(x.bitwiseAND(-x) - 1)
    odd = F.call_function("shiftrightunsigned", x, twos.cast("int"))
    odd = F.when(twos > 0, odd).otherwise(x)
    minus = odd.bitwiseAND(F.lit(3)) == 3
    k = _log5(F.when(minus, -odd).otherwise(odd))
    total, n2 = at(F.sum(k)).bitwiseAND(F.lit((1 << 62) - 1)), at(F.sum(twos.cast("bigint")))
    out = _pow5(total)
    out = F.when(at(F.sum(minus.cast("bigint"))) % 2 == 1, -out).otherwise(out)
    out = F.when(n2 > 63, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", out, F.least(n2, F.lit(63)).cast("int")))
    return F.when(at(F.max(zero)), F.lit(0).cast("bigint")).otherwise(out)


_POW5 = [pow(5, 1 << j, 1 << 64) for j in range(62)]
_INV5 = [pow(x, -1, 1 << 64) for x in _POW5]
_signed = lambda n: n - (1 << 64) if n >> 63 else n


def _log5(x: Column) -> Column:
    """k in [0, 2**62) with 5**k = x modulo 2**64, for x = 1 modulo 4: bit j of k shows in bit j + 2 of what is left."""
    table = F.array(*[F.lit(_signed(p)).cast("bigint") for p in _INV5])
    one = F.lit(1).cast("bigint")
    step = lambda s, j: F.when(F.call_function("shiftright", s["x"], j + 2).bitwiseAND(one) == 1, F.struct((s["x"] * F.get(table, j)).alias("x"), s["k"].bitwiseOR(F.call_function("shiftleft", one, j)).alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.struct(x.alias("x"), F.lit(0).cast("bigint").alias("k")), step)["k"]


def _pow5(k: Column) -> Column:
    table = F.array(*[F.lit(_signed(p)).cast("bigint") for p in _POW5])
    one = F.lit(1).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), one, lambda s, j: F.when(F.call_function("shiftright", k, j).bitwiseAND(one) == 1, s * F.get(table, j)).otherwise(s))


prod = product


def mean(array, dim=None, *, keepdim: bool = False) -> NDArray:
    """Integers and bools average to f64; an empty mean is an error."""
    a, dims = _start("mean", array, dim, _NUMERIC)
    t = a.dtype
    if t.rank == D.COMPLEX:
        return _reduce(a, dims, _complex(F.avg, t), t, keepdim, None)
    out = t if t.rank == D.FLOAT else D.f64
    return _reduce(a if t.rank == D.FLOAT else cast(a, D.f64), dims, lambda v, at: at(F.avg(v.cast("double"))), out, keepdim, None)


def _variance(name: str, array, dim, ddof: float, keepdim: bool, root: bool) -> NDArray:
    a, dims = _start(name, array, dim, _NUMERIC)
    t, nan = a.dtype, F.lit(float("nan"))
    out = (D.f32 if t == D.c64 else D.f64) if t.rank == D.COMPLEX else t if t.rank == D.FLOAT else D.f64
    n = S.size(tuple(a.shape[d] for d in dims))

    def agg(v: Column, at) -> Column:
        own = at(F.var_pop(v["re"].cast("double"))) + at(F.var_pop(v["im"].cast("double"))) if t.rank == D.COMPLEX else at(F.var_pop(v.cast("double")))
        if n - ddof <= 0:
            return F.when(own.isNull(), nan).otherwise(nan)
        own = own if ddof == 0 else own * (n / (n - ddof))
        return F.sqrt(own) if root else own

    wide = cast(a, D.f64) if t.rank in (D.BOOL, D.UINT, D.INT) else a
    return _reduce(wide, dims, agg, out, keepdim, nan)


def var(array, dim=None, *, ddof: float = 0.0, keepdim: bool = False) -> NDArray:
    """Variance; complex arrays use the squared modulus; NaN if there are too few elements for ddof."""
    return _variance("var", array, dim, ddof, keepdim, False)


def std(array, dim=None, *, ddof: float = 0.0, keepdim: bool = False) -> NDArray:
    return _variance("std", array, dim, ddof, keepdim, True)


def _extreme(name: str, array, dim, keepdim: bool, largest: bool) -> NDArray:
    a, dims = _start(name, array, dim, _ORDERED)
    t = a.dtype
    flip = lambda c: casts.ordered(c, t)

    def agg(v: Column, at) -> Column:
        x = flip(v)
        if largest:
            return flip(at(F.max(x)))
        low = flip(at(F.min(x)))
        return F.when(at(F.max(F.isnan(v))), F.lit(float("nan")).cast(t.spark)).otherwise(low) if t.rank == D.FLOAT else low

    return _reduce(a, dims, agg, t, keepdim, None)


def max(array, dim=None, *, keepdim: bool = False) -> NDArray:
    """Largest element; NaN wins; an empty reduction is an error."""
    return _extreme("max", array, dim, keepdim, True)


def min(array, dim=None, *, keepdim: bool = False) -> NDArray:
    return _extreme("min", array, dim, keepdim, False)


def _arg(name: str, array, dim, keepdim: bool, largest: bool) -> NDArray:
    a = asarray(array)
    D.resolve(name, [(a.dtype.rank, a.dtype.size)], _ORDERED, D.NONE)
    if dim is None and a.ndim != 1:
        raise ValueError(f"{name} needs a dim unless the array is 1-D")
    d = S.dim(0 if dim is None else dim, a.ndim)
    t = a.dtype

    def agg(v: Column, at) -> Column:
        x, own = casts.ordered(v, t), F.col(f"d{d}")
        if largest:
            return at(F.max_by(own, F.struct(x.alias("x"), (-own).alias("at"))))
        return at(F.min_by(own, F.struct((~casts.is_nan(v, t)).alias("sane"), x.alias("x"), own.alias("at"))))

    return _reduce(a, (d,), agg, D.u64, keepdim, None, positional=d)


def argmax(array, dim: int | None = None, *, keepdim: bool = False) -> NDArray:
    """Position of the first largest element of a dimension; the first NaN wins."""
    return _arg("argmax", array, dim, keepdim, True)


def argmin(array, dim: int | None = None, *, keepdim: bool = False) -> NDArray:
    return _arg("argmin", array, dim, keepdim, False)


def _logic(array, dim, keepdim: bool, f, identity: bool) -> NDArray:
    a = asarray(array)
    if a.dtype.rank != D.BOOL:
        a = cast(a, D.bool_)
    return _reduce(a, S.dims(dim, a.ndim), lambda v, at: at(f(v)), D.bool_, keepdim, F.lit(identity))


def all(array, dim=None, *, keepdim: bool = False) -> NDArray:
    """Whether every element is nonzero; true over nothing."""
    return _logic(array, dim, keepdim, F.bool_and, True)


def any(array, dim=None, *, keepdim: bool = False) -> NDArray:
    return _logic(array, dim, keepdim, F.bool_or, False)


def reduce_unordered(array, f, dim=None, *, keepdim: bool = False, chunk: int = 4096) -> NDArray:
    """An associative and commutative function of two Columns, in an order of Spark's choosing.

    Groups are folded in parts of about `chunk` elements chosen by hash until a
    part is a whole group, so no task ever holds an unbounded group.
    """
    a = asarray(array)
    dims = S.dims(dim, a.ndim)
    if S.size(tuple(a.shape[d] for d in dims)) == 0:
        raise RuntimeError("reduction of an empty dimension without an identity")
    a = a.spread()
    kept = [d for d in range(a.ndim) if d not in dims]
    df = a.base.df.select(*[a.coords[d].col.alias(f"d{d}") for d in range(a.ndim)], a.guarded().alias("v"))
    keys = [f"d{d}" for d in kept]
    left, df = S.size(tuple(a.shape[d] for d in dims)), df.withColumn("salt", F.xxhash64(*[f"d{d}" for d in dims]))
    fold = lambda v: F.reduce(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, F.lit(0)), lambda x, y: f(x, y).cast(a.dtype.spark))
    while True:
        parts = -(-left // chunk)
        own = df.withColumn("salt", F.pmod("salt", F.lit(parts)))
        df = own.groupBy(*keys, "salt").agg(F.collect_list("v").alias("vs")).select(*keys, F.xxhash64("salt").alias("salt"), fold(F.col("vs")).alias("v"))
        if parts == 1:
            break
        left = parts
    res = NDArray(Base(df), [Coord(F.col(k), ("own", d)) for k, d in zip(keys, kept)], F.col("v"), tuple(a.shape[d] for d in kept), a.dtype)
    if keepdim:
        from .shape_ops import insert_dim

        for d in sorted(dims):
            res = insert_dim(res, d)
    return res
