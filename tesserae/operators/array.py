"""NDArray: a lazy, dense, N-dimensional array over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import ARITHMETIC, translated
from ..functions import casts
from ..plans import dtypes as D
from ..plans import shapes as S
from ..plans.dtypes import DType
from ..plans import layout
from ..plans.layout import CONSTANT, WIDE, Base, Coord, align
from ..session import engine_session


@dataclass
class Reduced:
    """What an array was reduced from, so that it can meet its source again without a join.

    `over(window)` is the reduction as a window expression on the source's base;
    `of[d]` is the source dimension of dimension d, None for one of length one.
    """

    base: Base
    coords: list[Coord]
    of: list[int | None]
    over: Callable[[WindowSpec], Column]


class NDArray:
    """Shape and type on the driver, elements in Spark.

    `coords` has a coordinate for each dimension, `value` the element and `err`
    a Column that is true where reading the element must fail, or None.
    """

    __array_ufunc__ = None  # so that NumPy leaves mixed operators to us
    __hash__ = None

    def __init__(self, base: Base, coords: list[Coord], value: Column, shape: tuple[int, ...], dtype: DType, err: Column | None = None, session: SparkSession | None = None):
        self.base, self.coords, self.value, self.err = base, coords, value, err
        self.shape, self.dtype = tuple(shape), dtype
        self.session = session or (base.df.sparkSession if base.df is not None else None)
        self.origin: Reduced | None = None
        # value and err as functions of a stored element, while every step since a stored array was elementwise
        self.lift: Callable[[Column], tuple[Column, Column | None]] | None = None
        self.untouched = False  # exactly a stored array

    # metadata: no job runs

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return S.size(self.shape)

    @property
    def T(self) -> "NDArray":
        from .shape_ops import permute_dims

        return permute_dims(self)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a 0-d array has no length")
        return self.shape[0]

    def __repr__(self) -> str:
        return f"NDArray(shape={self.shape}, dtype={self.dtype})"

    def __bool__(self):
        raise ValueError("the truth of an array is ambiguous")

    def __iter__(self):
        raise TypeError("an array cannot be iterated over")

    def __contains__(self, x):
        raise TypeError("an array does not support `in`")

    # plumbing

    def guarded(self) -> Column:
        """The value, failing where err is true."""
        if self.err is None:
            return self.value
        return F.when(self.err, F.raise_error(F.lit(ARITHMETIC)).cast(self.dtype.spark)).otherwise(self.value)

    def replace(self, **kw) -> "NDArray":
        own = {"base": self.base, "coords": self.coords, "value": self.value, "shape": self.shape, "dtype": self.dtype, "err": self.err, "session": self.session} | kw
        return NDArray(**own)

    def mapped(self, f: Callable[[Column], Column], dtype: DType) -> "NDArray":
        """A function of the value alone."""
        out = self.replace(value=f(self.value), dtype=dtype)
        if (lift := self.lift) is not None:
            out.lift = lambda v: (f((own := lift(v))[0]), own[1])
        return out

    def spread(self, dims: tuple[int, ...] | None = None) -> "NDArray":
        """Carry out the broadcast of WIDE dimensions (all, or those given), so that every position has a row."""
        own = [d for d in (range(self.ndim) if dims is None else dims) if self.coords[d].col is None]
        if not own or self.base is CONSTANT:
            return self if self.base is not CONSTANT else self._from_range()
        a, coords = self, list(self.coords)
        for d in own:
            if self.shape[d] == 1:
                coords[d] = Coord(F.lit(0).cast("bigint"), ("zero",))
        own = [d for d in own if self.shape[d] != 1]
        if not own:
            return self.replace(coords=coords)
        cols = [c.col.alias(f"d{d}") for d, c in enumerate(coords) if c.col is not None]
        df = a.base.df.select(*cols, a.guarded().alias("v"))
        for d in own:
            n = self.shape[d]
            seq = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n else F.array().cast("array<bigint>")
            df = df.withColumn(f"d{d}", F.explode(seq))
            coords[d] = Coord(F.col(f"d{d}"), ("own", d))
        coords = [c if c.col is None else Coord(F.col(f"d{d}"), ("own", d)) for d, c in enumerate(coords)]
        return NDArray(Base(df), coords, F.col("v"), self.shape, self.dtype, session=self.session)

    def _from_range(self) -> "NDArray":
        """A constant as one row for each position."""
        spark = self.session or engine_session()
        df = spark.range(self.size)
        coords = [Coord(F.floor(F.col("id") / st).cast("bigint") % max(n, 1), ("own", d)) for d, (st, n) in enumerate(zip(S.strides(self.shape), self.shape))]
        cols = [c.col.alias(f"d{d}") for d, c in enumerate(coords)]
        df = df.select(*cols, self.guarded().cast(self.dtype.spark).alias("v"))
        return NDArray(Base(df), [Coord(F.col(f"d{d}"), ("own", d)) for d in range(self.ndim)], F.col("v"), self.shape, self.dtype, session=spark)

    def cells(self) -> DataFrame:
        """The cell layout: d0 .. d{n-1} and v, one row for each position, in no order."""
        a = self.spread()
        return a.base.df.select(*[c.col.cast("bigint").alias(f"d{d}") for d, c in enumerate(a.coords)], a.guarded().alias("v"))

    # materialisation

    def numpy(self, index=None, *, out: np.ndarray | None = None) -> np.ndarray:
        """The array, or the region of an index, as a NumPy array; the driver must hold it."""
        from .shape_ops import slice_

        a = self if index is None else slice_(self, index)
        if out is None:
            out = np.zeros(a.shape, a.dtype.numpy)
        elif out.shape != a.shape or out.dtype != np.zeros((), a.dtype.numpy).dtype:
            raise ValueError("out has another shape or type")
        if not a.size:
            return out
        df = a.cells()
        with translated():
            table = df.toArrow()
        if table.num_rows != a.size:
            raise RuntimeError(f"{table.num_rows} cells for shape {a.shape}")
        at = tuple(table.column(d).to_numpy() for d in range(a.ndim))
        vals = _to_numpy(table.column(a.ndim).combine_chunks(), a.dtype)
        if a.ndim:
            out[at] = vals
        else:
            out[()] = vals[0]
        return out

    def __array__(self, dtype=None, copy=None):
        x = self.numpy()
        return x if dtype is None else x.astype(dtype)

    def __getitem__(self, index):
        return self.numpy(index)

    def item(self):
        if self.ndim:
            raise ValueError("item() needs a 0-d array")
        return self.numpy().item()

    def plain(self, index=None) -> "NDArray":
        """Cut recomputation: the cells are kept by the executors until unpersisted."""
        from .shape_ops import slice_

        a = self if index is None else slice_(self, index)
        df = a.cells().persist()
        return NDArray(Base(df), [Coord(F.col(f"d{d}"), ("own", d)) for d in range(a.ndim)], F.col("v"), a.shape, a.dtype, session=self.session)

    def compact(self, params: dict | None = None) -> "NDArray":
        """Materialise into the block layout, written to the shared folder; lineage ends there."""
        from ..sources.blocks import compact

        return compact(self, params=params)

    def write_to(self, path: str, *, append: bool = False, name: str = "array", params: dict | None = None) -> None:
        from ..sources.blocks import write_array

        write_array(self, path, append=append, name=name, params=params)


def _to_numpy(col, t: DType) -> np.ndarray:
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if t.inner:
        flat = col
        for _ in t.inner:
            flat = flat.flatten()
        return _to_numpy(flat, D.element_of(t)).reshape((len(col), *t.inner))
    if t.fields:
        out = np.zeros(len(col), t.numpy)
        for n, f in t.fields:
            out[n] = _to_numpy(col.field(n), f)
        return out
    if t.rank == D.COMPLEX:
        part = np.float32 if t == D.c64 else np.float64
        return (col.field("re").to_numpy(zero_copy_only=False).astype(part) + 1j * col.field("im").to_numpy(zero_copy_only=False).astype(part)).astype(t.numpy)
    x = col.to_numpy(zero_copy_only=False)
    return x.view(np.uint64) if t == D.u64 else x.astype(t.numpy)


def to_spark_values(x: np.ndarray, t: DType):
    """An Arrow array with the physical values of a flat NumPy array."""
    import pyarrow as pa

    if t.inner:
        k = t.inner[0]
        rest = t.inner[1:]
        e = D.element_of(t)
        below = DType(e.name + (f"{list(rest)}" if rest else ""), e.rank if not rest else D.OTHER, e.size, e.fields, rest) if rest else e
        vals = to_spark_values(x.reshape((len(x) * k, *rest)), below)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), vals)
    if t.fields:
        return pa.StructArray.from_arrays([to_spark_values(np.ascontiguousarray(x[n]), f) for n, f in t.fields], names=[n for n, _ in t.fields])
    if t.rank == D.COMPLEX:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x.real)), pa.array(np.ascontiguousarray(x.imag))], names=["re", "im"])
    if t == D.bool_:
        return pa.array(x.astype(bool))
    if t == D.u64:
        return pa.array(np.ascontiguousarray(x).view(np.int64))
    physical = {"u8": np.int16, "u16": np.int32, "u32": np.int64, "f16": np.float32}.get(t.name)
    return pa.array(np.ascontiguousarray(x) if physical is None else x.astype(physical))


def scalar(value, t: DType, shape: tuple[int, ...] = (), session: SparkSession | None = None) -> NDArray:
    """One value for every position; nothing is stored."""
    return NDArray(CONSTANT, [WIDE] * len(shape), casts.literal(value, t), shape, t, session=session)


def asarray(value, *, dtype=None, session: SparkSession | None = None) -> NDArray:
    """An NDArray from an array-like; an NDArray is returned as it is, cast lazily if a dtype is given."""
    from .elementwise import cast

    if isinstance(value, NDArray):
        return value if dtype is None else cast(value, dtype)
    x = np.asarray(value)
    t = D.dtype(x.dtype)
    S.check_shape(x.shape)
    import pyarrow as pa

    spark = engine_session(session)
    flat = np.ascontiguousarray(x).reshape(-1)
    if t.inner:
        flat = flat.reshape((S.size(x.shape), *t.inner))
    grid = np.indices(x.shape).reshape(x.ndim, -1) if x.ndim else np.zeros((0, 1), np.int64)
    table = pa.table([pa.array(g.astype(np.int64)) for g in grid] + [to_spark_values(flat, t)], names=[f"d{d}" for d in range(x.ndim)] + ["v"])
    schema = ", ".join([f"d{d} bigint" for d in range(x.ndim)] + [f"v {t.spark}"])
    df = spark.createDataFrame(table, schema) if len(flat) else spark.createDataFrame([], schema)
    out = NDArray(Base(df), [Coord(F.col(f"d{d}"), ("own", d)) for d in range(x.ndim)], F.col("v"), x.shape, t)
    return out if dtype is None else cast(out, dtype)


def from_dataframe(df: DataFrame, coords: list[str | Column], value: str | Column, shape, dtype) -> NDArray:
    """Adopt a DataFrame that has exactly one row for each position; coordinates are zero-based longs."""
    cols = [F.col(c) if isinstance(c, str) else c for c in coords]
    v = F.col(value) if isinstance(value, str) else value
    t = D.dtype(dtype)
    df = df.select(*[c.cast("bigint").alias(f"d{d}") for d, c in enumerate(cols)], v.cast(t.spark).alias("v"))
    return NDArray(Base(df), [Coord(F.col(f"d{d}"), ("own", d)) for d in range(len(cols))], F.col("v"), S.check_shape(shape), t)


def from_function(shape, f, dtype, session: SparkSession | None = None) -> NDArray:
    """Build from a function of the coordinate Columns."""
    shape, t = S.check_shape(shape), D.dtype(dtype)
    spark = engine_session(session)
    cols = [F.floor(F.col("id") / st).cast("bigint") % max(n, 1) for st, n in zip(S.strides(shape), shape)]
    df = spark.range(S.size(shape)).select(*[c.alias(f"d{d}") for d, c in enumerate(cols)])
    df = df.select("*", f(*[F.col(f"d{d}") for d in range(len(shape))]).cast(t.spark).alias("v"))
    return NDArray(Base(df), [Coord(F.col(f"d{d}"), ("own", d)) for d in range(len(shape))], F.col("v"), shape, t)


def broadcast_to(a: NDArray, shape: tuple[int, ...]) -> NDArray:
    """NumPy broadcasting as WIDE coordinates; no row is added."""
    lead = len(shape) - a.ndim
    coords = [WIDE] * lead + [WIDE if n == 1 and m != 1 else c for c, n, m in zip(a.coords, a.shape, shape[lead:])]
    return a.replace(coords=coords, shape=shape)


def _windowed(a: NDArray, others: list[NDArray], shape: tuple[int, ...]) -> NDArray | None:
    """A reduction that meets its source: one window over the source, where it is too large to broadcast."""
    o = a.origin
    if o is None or a.size <= layout.BROADCAST_CELLS:
        return None
    lead = len(shape) - a.ndim
    for b in others:
        wide = broadcast_to(b, shape)
        if b is a or b.base is CONSTANT or b.base.key != o.base.key:
            continue
        if all(s is None or wide.coords[lead + d].key == o.coords[s].key for d, s in enumerate(o.of)):
            spec = Window.partitionBy(*[o.coords[s].col for s in o.of if s is not None])
            return NDArray(b.base, wide.coords, o.over(spec), shape, a.dtype, session=a.session)
    return None


def combine(arrays: list[NDArray], shape: tuple[int, ...]) -> tuple[Base, list[Coord], list[tuple[Column, Column | None]]]:
    """Arrays broadcast to `shape` over one base, with the value and error Column of each."""
    parts = []
    for a in arrays:
        b = _windowed(a, arrays, shape)
        b = broadcast_to(a, shape) if b is None else b
        own = tuple(n if c.col is not None else 1 for n, c in zip(shape, b.coords))
        parts.append((b.base, b.coords, [b.value] + ([b.err] if b.err is not None else []), own))
    base, coords, cols = align(parts)
    return base, coords, [(c[0], c[1] if len(c) > 1 else None) for c in cols]
