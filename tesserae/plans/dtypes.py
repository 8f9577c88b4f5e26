"""Element types: names, Spark representation, promotion.

Unsigned types up to 32 bits live in the next wider signed type; u64 holds its
bit pattern in a long; f16 is a float that every operation rounds to half;
complex types are structs (re, im); struct types and inner shapes map to STRUCT
and ARRAY.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BOOL, UINT, INT, FLOAT, COMPLEX, OTHER = range(6)


@dataclass(frozen=True, eq=False)
class DType:
    """An element type; `size` is the byte width of a component, as promotion counts it."""

    name: str
    rank: int
    size: int
    fields: tuple[tuple[str, "DType"], ...] = field(default=())
    inner: tuple[int, ...] = field(default=())

    @property
    def bits(self) -> int:
        return 8 * self.size

    @property
    def spark(self) -> str:
        if self.inner:
            out = element_of(self).spark
            for _ in self.inner:
                out = f"array<{out}>"
            return out
        if self.fields:
            return "struct<" + ",".join(f"{n}:{t.spark}" for n, t in self.fields) + ">"
        return _SPARK[self.name]

    @property
    def numpy(self) -> np.dtype:
        if self.inner:
            return np.dtype((element_of(self).numpy, self.inner))
        if self.fields:
            return np.dtype([(n, t.numpy) for n, t in self.fields])
        return np.dtype(_NUMPY[self.name])

    @property
    def is_int(self) -> bool:
        return self.rank in (UINT, INT)

    def __repr__(self) -> str:
        return self.name

    def __eq__(self, other) -> bool:
        """Equal to the same type, also if it is written as a NumPy type or a name."""
        if not isinstance(other, DType):
            try:
                other = dtype(other)
            except TypeError:
                return False
        return (self.name, self.inner, self.fields) == (other.name, other.inner, other.fields)

    def __hash__(self) -> int:
        return hash(self.name)


_SPARK = {"bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "bigint", "f16": "float", "f32": "float", "f64": "double", "c64": "struct<re:float,im:float>", "c128": "struct<re:double,im:double>"}
_NUMPY = {"bool": "?", "i8": "i1", "i16": "i2", "i32": "i4", "i64": "i8", "u8": "u1", "u16": "u2", "u32": "u4", "u64": "u8", "f16": "f2", "f32": "f4", "f64": "f8", "c64": "c8", "c128": "c16"}
_RANK = {"b": BOOL, "u": UINT, "i": INT, "f": FLOAT, "c": COMPLEX}
SCALARS = {n: DType(n, _RANK[n[0]], 1 if n == "bool" else int(n[1:]) // (16 if n[0] == "c" else 8)) for n in _SPARK}
bool_, i8, i16, i32, i64 = (SCALARS[n] for n in ("bool", "i8", "i16", "i32", "i64"))
u8, u16, u32, u64 = (SCALARS[n] for n in ("u8", "u16", "u32", "u64"))
f16, f32, f64, c64, c128 = (SCALARS[n] for n in ("f16", "f32", "f64", "c64", "c128"))
_FROM_NUMPY = {np.dtype(v): SCALARS[k] for k, v in _NUMPY.items()}
_WORDS = {"bool8": "bool", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64", "float16": "f16", "float32": "f32", "float64": "f64", "complex64": "c64", "complex128": "c128"}


def dtype(x) -> DType:
    """A DType from a DType, a name or anything numpy.dtype takes; big-endian and padded layouts are rejected.

    Short names that NumPy has too mean what NumPy means: 'i8' and 'u8' have eight bytes.
    """
    if isinstance(x, DType):
        return x
    if isinstance(x, str) and x not in ("i8", "u8", "b", "c8", "c16") and (name := _WORDS.get(x, x)) in SCALARS:
        return SCALARS[name]
    d = np.dtype(x)
    if d.subdtype:
        base, inner = d.subdtype
        if len(inner) > 4:
            raise TypeError("an inner shape has at most 4 dimensions")
        b = dtype(base)
        return DType(f"{b.name}{list(inner)}", OTHER, b.size, b.fields, tuple(inner))
    if d.fields:
        own = tuple((n, dtype(d.fields[n][0])) for n in d.names)
        if sum(d.fields[n][0].itemsize for n in d.names) != d.itemsize:
            raise TypeError("a struct type has no padding")
        return DType("{" + ", ".join(f"{n}: {t.name}" for n, t in own) + "}", OTHER, d.itemsize, own)
    if d.byteorder == ">" and d.itemsize > 1:
        raise TypeError("big-endian types are not supported")
    if d not in _FROM_NUMPY:
        raise TypeError(f"unsupported element type {d}")
    return _FROM_NUMPY[d]


def element_of(t: DType) -> DType:
    """The scalar type below an inner shape."""
    base = t.name[: t.name.rindex("[")]
    return SCALARS[base] if base in SCALARS else DType(base, OTHER, t.size, t.fields)


#: rank and byte width of an operand; the width of a plain Python number is None
Operand = tuple[int, int | None]
NONE, SAFE, UNSAFE = "none", "safe", "unsafe"


def castable(src: Operand, dst: DType, kind: str) -> bool:
    """Whether an operand may be cast to dst under a cast kind."""
    rank, size = src
    if size is None and rank == INT and dst.rank == UINT:
        rank = UINT  # a Python int fits either
    if kind == NONE:
        return rank == dst.rank and size in (None, dst.size)
    if kind == UNSAFE:
        return rank != COMPLEX or dst.rank in (BOOL, COMPLEX)
    if rank > dst.rank or dst.rank == OTHER:
        return False
    if rank == BOOL:
        return True
    if rank == dst.rank or (rank, dst.rank) == (FLOAT, COMPLEX):
        return size is None or size <= dst.size
    if dst.rank in (FLOAT, COMPLEX) and dst.size == 8:
        return True
    return size is None or size < dst.size


def _settle(ops: list[Operand]) -> list[Operand]:
    if all(s is None for _, s in ops):
        return [(r, 1 if r == BOOL else 8) for r, _ in ops]
    return ops


def resolve(name: str, ops: list[Operand], table: list, kind=SAFE, float_as_f64: bool = False) -> tuple[DType, ...]:
    """The first row of an ordered table that every operand reaches; TypeError if none.

    A row is a type for all operands or a tuple of types; `kind` is one cast kind
    or one for each operand.  Rows with f16 count only if an operand is f16.
    """
    ops = _settle(list(ops))
    if float_as_f64 and not any(r in (FLOAT, COMPLEX) and s for r, s in ops):
        ops = [(r, 8 if r in (FLOAT, COMPLEX) and s is None else s) for r, s in ops]
    half = any(r in (FLOAT, COMPLEX) and s == 2 for r, s in ops)
    kinds = (kind,) * len(ops) if isinstance(kind, str) else kind
    if all(r != OTHER for r, _ in ops):
        for row in table:
            row = row if isinstance(row, tuple) else (row,) * len(ops)
            if f16 in row and not half:
                continue
            if all(castable(o, d, k) for o, d, k in zip(ops, row, kinds)):
                return row
    raise TypeError(f"{name} does not support operands of {[_say(o) for o in ops]}")


def _say(o: Operand) -> str:
    return f"{'bool uint int float complex other'.split()[o[0]]}{'' if o[1] is None else 8 * o[1]}"


INTS = [u8, i8, u16, i16, u32, i32, u64, i64]
FLOATS = [f16, f32, f64]
REALS = INTS + FLOATS
COMPLEXES = [c64, c128]
COMMON = [bool_, *REALS, *COMPLEXES]


def promote(name: str, ops: list[Operand]) -> DType:
    """The common type of concatenate, stack and where."""
    return resolve(name, ops, [bool_, u8, i8, u16, i16, u32, i32, u64, i64, f16, f32, f64, c64, c128])[0]
