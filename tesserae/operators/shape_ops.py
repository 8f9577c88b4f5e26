"""Shape operators: coordinate algebra, no data moves unless positions multiply."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import dtypes as D
from ..plans import shapes as S
from ..plans.layout import CONSTANT, WIDE, Base, Coord
from .array import NDArray, asarray, broadcast_to
from .elementwise import cast, operand, rank_size, typed


def _moved(c: Coord, col, *key) -> Coord:
    return Coord(col, (*key, c.key))


def slice_(array, index) -> NDArray:
    """A region; an integer drops its dimension.  On a stored array only blocks that meet the region are read."""
    a = asarray(array)
    parts = S.parse_index(index, a.shape)
    if all(keep and lo == 0 and hi == n for (lo, hi, keep), n in zip(parts, a.shape)):
        return a
    cond, coords, shape, region = None, [], [], {}
    for d, ((lo, hi, keep), n) in enumerate(zip(parts, a.shape)):
        c = a.coords[d]
        if c.col is not None and (lo, hi) != (0, n):
            hit = (c.col >= lo) & (c.col < hi)
            cond = hit if cond is None else cond & hit
            if c.key[0] == "stored":
                region[c.key[1]] = (lo, hi)
        if keep:
            shape.append(hi - lo)
            coords.append(c if c.col is None or lo == 0 else _moved(c, c.col - lo, "shift", -lo))
    base = a.base
    if cond is not None:
        if base.stored is not None and region:
            base = base.stored.pruned(region)
        base = Base(base.df.where(cond))
    return a.replace(base=base, coords=coords, shape=tuple(shape))


def permute_dims(array, dims=None) -> NDArray:
    a = asarray(array)
    order = tuple(reversed(range(a.ndim))) if dims is None else tuple(S.dim(d, a.ndim) for d in dims)
    if sorted(order) != list(range(a.ndim)):
        raise ValueError(f"{dims} is no permutation for rank {a.ndim}")
    return a.replace(coords=[a.coords[d] for d in order], shape=tuple(a.shape[d] for d in order))


def swapdims(array, d0: int, d1: int) -> NDArray:
    a = asarray(array)
    order = list(range(a.ndim))
    x, y = S.dim(d0, a.ndim), S.dim(d1, a.ndim)
    order[x], order[y] = order[y], order[x]
    return permute_dims(a, order)


def insert_dim(array, dim: int) -> NDArray:
    a = asarray(array)
    d = S.dim(dim, a.ndim + 1)
    if a.ndim == S.MAX_RANK:
        raise ValueError(f"at most {S.MAX_RANK} dimensions")
    return a.replace(coords=[*a.coords[:d], WIDE, *a.coords[d:]], shape=(*a.shape[:d], 1, *a.shape[d:]))


unsqueeze = insert_dim


def remove_dim(array, dim: int) -> NDArray:
    a = asarray(array)
    d = S.dim(dim, a.ndim)
    if a.shape[d] != 1:
        raise ValueError(f"dimension {dim} has length {a.shape[d]}")
    return a.replace(coords=[*a.coords[:d], *a.coords[d + 1 :]], shape=(*a.shape[:d], *a.shape[d + 1 :]))


def squeeze(array, dim=None) -> NDArray:
    a = asarray(array)
    own = [d for d in range(a.ndim) if a.shape[d] == 1] if dim is None else S.dims(dim, a.ndim)
    for d in sorted(own, reverse=True):
        a = remove_dim(a, d)
    return a


def broadcast(array, shape) -> NDArray:
    """NumPy broadcasting to a shape; -1 keeps a length.  Nothing is copied until positions are asked for."""
    a = asarray(array)
    shape = tuple(shape)
    lead = len(shape) - a.ndim
    if lead < 0 or any(n == -1 for n in shape[:lead]):
        raise ValueError(f"cannot broadcast {a.shape} to {shape}")
    own = shape[:lead] + tuple(m if n == -1 else n for n, m in zip(shape[lead:], a.shape))
    own = S.check_shape(own)
    if any(m not in (1, n) for n, m in zip(own[lead:], a.shape)):
        raise RuntimeError(f"cannot broadcast {a.shape} to {own}")
    return a if own == a.shape else broadcast_to(a, own)


def reshape(array, shape) -> NDArray:
    """Same elements in C order; one length may be -1."""
    a = asarray(array)
    new = S.reshaped(a.shape, shape)
    if new == a.shape:
        return a
    if [n for n in new if n != 1] == [n for n in a.shape if n != 1]:  # only lengths of one come or go
        own = iter([c for c, n in zip(a.coords, a.shape) if n != 1])
        return a.replace(coords=[WIDE if n == 1 else next(own) for n in new], shape=new)
    a = a.spread()
    old_key = tuple(c.key for c in a.coords)
    linear = None
    for c, st, n in zip(a.coords, S.strides(a.shape), a.shape):
        if n != 1:
            term = c.col * st if st != 1 else c.col
            linear = term if linear is None else linear + term
    linear = F.lit(0).cast("bigint") if linear is None else linear
    coords, lead = [], True
    for d, (st, n) in enumerate(zip(S.strides(new), new)):
        col = F.call_function("div", linear, F.lit(st).cast("bigint")) if st > 1 else linear
        coords.append(WIDE if n == 1 else Coord(col if lead else col % n, ("reshape", new, d, a.shape, old_key)))
        lead = lead and n == 1
    return a.replace(coords=coords, shape=new)


def flatten(array) -> NDArray:
    return reshape(array, (-1,) if asarray(array).size else (0,))


def _common(name: str, arrays) -> list[NDArray]:
    xs = [operand(a) for a in arrays]
    if not xs:
        raise ValueError(f"{name} of no arrays")
    if all(isinstance(x, NDArray) for x in xs) and len({x.dtype for x in xs}) == 1:
        return xs
    t = D.promote(name, [rank_size(x) for x in xs])
    return [typed(x, t) for x in xs]


def concatenate(arrays, dim: int = 0) -> NDArray:
    """Arrays one after another along a dimension; a union of projections."""
    own = _common("concatenate", arrays)
    if not own[0].ndim:
        raise ValueError("0-d arrays cannot be concatenated")
    d = S.dim(dim, own[0].ndim)
    if any(a.ndim != own[0].ndim or a.shape[:d] + a.shape[d + 1 :] != own[0].shape[:d] + own[0].shape[d + 1 :] for a in own):
        raise RuntimeError(f"shapes {[a.shape for a in own]} do not concatenate along {dim}")
    if len(own) == 1:
        return own[0]
    df, at = None, 0
    for a in own:
        part = a.cells()
        if at:
            part = part.withColumn(f"d{d}", F.col(f"d{d}") + at)
        df = part if df is None else df.unionByName(part)
        at += a.shape[d]
    shape = (*own[0].shape[:d], at, *own[0].shape[d + 1 :])
    return NDArray(Base(df), [Coord(F.col(f"d{k}"), ("own", k)) for k in range(len(shape))], F.col("v"), shape, own[0].dtype)


concat = concatenate


def stack(arrays, dim: int = 0) -> NDArray:
    """Arrays of one shape along a new dimension."""
    own = _common("stack", arrays)
    if len({a.shape for a in own}) != 1:
        raise RuntimeError(f"shapes {[a.shape for a in own]} differ")
    d = S.dim(dim, own[0].ndim + 1)
    return concatenate([insert_dim(a, d) for a in own], d)


def _one_dim(a: NDArray, dim, what: str) -> int:
    if dim is None:
        if a.ndim != 1:
            raise ValueError(f"{what} needs a dim unless the array is 1-D")
        return 0
    return S.dim(dim, a.ndim)


def _multiplied(a: NDArray, d: int, length: int, positions, key: tuple) -> NDArray:
    """Every row at several positions of dimension d."""
    a = a.spread((d,))
    if a.base is CONSTANT:
        a = a._from_range()
    cols = [c.col.alias(f"d{k}") for k, c in enumerate(a.coords) if c.col is not None and k != d]
    df = a.base.df.select(*cols, a.guarded().alias("v"), F.explode(positions(a.coords[d].col.cast("bigint"))).alias(f"d{d}"))
    coords = [WIDE if c.col is None else Coord(F.col(f"d{k}"), ("own", k)) for k, c in enumerate(a.coords)]
    return NDArray(Base(df), coords, F.col("v"), (*a.shape[:d], length, *a.shape[d + 1 :]), a.dtype)


def repeat(array, repeats: int, dim: int | None = None) -> NDArray:
    """Each element `repeats` times in a row."""
    a = asarray(array)
    if repeats < 0:
        raise ValueError("repeats is negative")
    d, n = _one_dim(a, dim, "repeat"), repeats
    if n == 1:
        return a
    if not n:
        return _empty(a, d)
    return _multiplied(a, d, a.shape[d] * n, lambda c: F.sequence(c * n, c * n + (n - 1)), ("repeat", n))


def tile(array, repeats: int, dim: int | None = None) -> NDArray:
    """The whole dimension `repeats` times."""
    a = asarray(array)
    if repeats < 0:
        raise ValueError("repeats is negative")
    d, n = _one_dim(a, dim, "tile"), repeats
    if n == 1:
        return a
    if not n:
        return _empty(a, d)
    length = a.shape[d]
    if not length:
        return a
    return _multiplied(a, d, length * n, lambda c: F.sequence(c, c + length * (n - 1), F.lit(length).cast("bigint")), ("tile", n))


def _empty(a: NDArray, d: int) -> NDArray:
    a = a.spread((d,))
    return a.replace(base=Base(a.base.df.limit(0)), shape=(*a.shape[:d], 0, *a.shape[d + 1 :]))


def flip(array, dim=None) -> NDArray:
    a = asarray(array)
    own = S.dims(dim, a.ndim)
    coords = [c if k not in own or c.col is None else _moved(c, (a.shape[k] - 1) - c.col, "flip", a.shape[k]) for k, c in enumerate(a.coords)]
    return a.replace(coords=coords)


def roll(array, shift: int, dim: int | None = None) -> NDArray:
    """Shift cyclically along a dimension."""
    a = asarray(array)
    d = _one_dim(a, dim, "roll")
    n, c = a.shape[d], a.coords[d]
    if not n or shift % n == 0 or c.col is None:
        return a
    coords = list(a.coords)
    coords[d] = _moved(c, F.pmod(c.col + shift % n, F.lit(n).cast("bigint")), "roll", shift % n, n)
    return a.replace(coords=coords)


__all__ = ["broadcast", "cast", "concat", "concatenate", "flatten", "flip", "insert_dim", "permute_dims", "remove_dim", "repeat", "reshape", "roll", "slice_", "squeeze", "stack", "swapdims", "tile", "unsqueeze"]
