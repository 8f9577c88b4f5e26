"""Shapes, dimension arguments and index parsing."""

from __future__ import annotations

import math
from operator import index as as_int

MAX_RANK = 8


def check_shape(shape) -> tuple[int, ...]:
    out = tuple(as_int(n) for n in ((shape,) if not hasattr(shape, "__iter__") else shape))
    if any(n < 0 for n in out):
        raise ValueError(f"negative length in shape {out}")
    if len(out) > MAX_RANK:
        raise ValueError(f"at most {MAX_RANK} dimensions")
    return out


def size(shape: tuple[int, ...]) -> int:
    return math.prod(shape)


def dim(d: int, rank: int) -> int:
    n = as_int(d)
    if not -rank <= n < rank:
        raise ValueError(f"dimension {n} is out of range for rank {rank}")
    return n % rank


def dims(d, rank: int) -> tuple[int, ...]:
    """Normalised, distinct dimensions; None stands for all."""
    if d is None:
        return tuple(range(rank))
    own = [dim(x, rank) for x in (d if hasattr(d, "__iter__") else (d,))]
    if len(set(own)) != len(own):
        raise ValueError(f"repeated dimension in {d}")
    return tuple(sorted(own))


def broadcast(shapes: list[tuple[int, ...]]) -> tuple[int, ...]:
    """The common shape, aligned at the right; RuntimeError if there is none."""
    rank, out = max(map(len, shapes)), []
    for k in range(rank):
        lengths = {s[k - rank + len(s)] for s in shapes if k - rank + len(s) >= 0}
        if len(lengths - {1}) > 1:
            raise RuntimeError(f"shapes {shapes} do not broadcast")
        out.append(next(iter(lengths - {1}), 1))
    return tuple(out)


def strides(shape: tuple[int, ...]) -> list[int]:
    out, n = [], 1
    for k in reversed(shape):
        out.insert(0, n)
        n *= k
    return out


def reshaped(old: tuple[int, ...], new) -> tuple[int, ...]:
    new = tuple(as_int(n) for n in ((new,) if not hasattr(new, "__iter__") else new))
    if sum(n == -1 for n in new) > 1 or any(n < -1 for n in new):
        raise ValueError(f"bad shape {new}")
    if -1 in new:
        rest = size(tuple(n for n in new if n != -1))
        if not rest or size(old) % rest:
            raise ValueError(f"cannot infer a length of {new} from {old}")
        new = tuple(size(old) // rest if n == -1 else n for n in new)
    if size(new) != size(old):
        raise ValueError(f"cannot reshape {old} to {new}")
    return check_shape(new)


def parse_index(idx, shape: tuple[int, ...]) -> list[tuple[int, int, bool]]:
    """(start, stop, keep) of every dimension; bounds are strict, steps are 1."""
    idx = idx if isinstance(idx, tuple) else (idx,)
    if sum(x is Ellipsis for x in idx) > 1:
        raise IndexError("at most one ellipsis")
    if Ellipsis in [x for x in idx if x is Ellipsis]:
        k = next(i for i, x in enumerate(idx) if x is Ellipsis)
        idx = idx[:k] + (slice(None),) * (len(shape) - len(idx) + 1) + idx[k + 1 :]
    if len(idx) > len(shape):
        raise IndexError(f"{len(idx)} indices for rank {len(shape)}")
    out = []
    for x, n in zip(idx + (slice(None),) * (len(shape) - len(idx)), shape):
        if isinstance(x, slice):
            if x.step not in (None, 1):
                raise ValueError("only step 1 is supported")
            a, b = (0 if x.start is None else as_int(x.start)), (n if x.stop is None else as_int(x.stop))
            a, b = a + n * (a < 0), b + n * (b < 0)
            if not (0 <= a <= n and 0 <= b <= n):
                raise IndexError(f"slice {x.start}:{x.stop} is out of bounds for length {n}")
            out.append((a, max(a, b), True))
            continue
        if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
            raise TypeError("a boolean is not an index")
        try:
            i = as_int(x)
        except TypeError:
            raise TypeError(f"unsupported index {x!r}") from None
        if not -n <= i < n:
            raise IndexError(f"index {i} is out of bounds for length {n}")
        out.append((i % n, i % n + 1, False))
    return out
