"""Where an array's elements live: a base DataFrame, coordinate Columns, and how bases meet.

A coordinate is a Column over the base, or WIDE: the element is the same for
every position of that dimension (a broadcast that is not carried out), which
also covers dimensions of length one.  Every coordinate has an identity, a plain
value that tells whether two arrays over one base map rows to positions alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shapes import size

#: An operand of at most this many cells may be broadcast; its size is known from its shape.
BROADCAST_CELLS = 1 << 18
_fresh = itertools.count()


@dataclass(frozen=True)
class Coord:
    col: Column | None  # None: WIDE
    key: tuple


WIDE = Coord(None, ("wide",))


class Base:
    """A DataFrame with one row for each stored element, or none at all for a constant."""

    def __init__(self, df: DataFrame | None, stored=None):
        self.df, self.stored = df, stored

    @property
    def key(self):
        return self.stored.key if self.stored is not None else id(self)


CONSTANT = Base(None)


def align(parts: list[tuple[Base, list[Coord], list[Column], tuple[int, ...]]]) -> tuple[Base, list[Coord], list[list[Column]]]:
    """Bring several arrays of one rank to a common base.

    Each part has a base, coordinates, the Columns it needs, and its own shape
    (1 where it is WIDE).  Arrays over the same base with the same coordinates
    are combined in one projection; others meet in an equi-join on the
    coordinates both have.
    """
    real = [p for p in parts if p[0] is not CONSTANT]
    if not real:
        rank = len(parts[0][1])
        return CONSTANT, [WIDE] * rank, [p[2] for p in parts]
    groups: dict[tuple, list[int]] = {}
    for i, (base, coords, _, _) in enumerate(parts):
        if base is not CONSTANT:
            groups.setdefault((base.key,), []).append(i)
    merged: list[list[int]] = []
    for ids in groups.values():
        for i in ids:
            for g in merged:
                if parts[g[0]][0].key == parts[i][0].key and _agree(parts[g[0]][1], parts[i][1]):
                    g.append(i)
                    break
            else:
                merged.append([i])
    if len(merged) == 1:
        coords = _union([parts[i][1] for i in merged[0]])
        return parts[merged[0][0]][0], coords, [p[2] for p in parts]
    rank = len(real[0][1])
    current, have, cells = None, [], 0
    where: dict[int, list[Column]] = {i: p[2] for i, p in enumerate(parts) if p[0] is CONSTANT}
    order = sorted(merged, key=lambda g: -sum(c.col is not None for c in _union([parts[i][1] for i in g])))
    for g in order:
        coords = _union([parts[i][1] for i in g])
        tag = f"j{next(_fresh)}"
        names = {d: f"{tag}_d{d}" for d in range(rank) if coords[d].col is not None}
        cols = [coords[d].col.alias(n) for d, n in names.items()]
        for i in g:
            own = [f"{tag}_v{i}_{k}" for k in range(len(parts[i][2]))]
            cols += [c.alias(n) for c, n in zip(parts[i][2], own)]
            where[i] = [F.col(n) for n in own]
        df = parts[g[0]][0].df.select(*cols)
        n = size(tuple(max((parts[i][3][d] for i in g), default=1) for d in names))
        if current is None:
            current, have, cells = df, dict(names), n
            continue
        both = [d for d in names if d in have]
        lacking = [d for d in names if d not in have]
        if not both and names:  # an outer product: spread this side over the other's positions
            d = next(iter(have))
            length = max(p[3][d] for p in parts)
            df = df.withColumn(f"{tag}_d{d}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))))
            names[d], both, n = f"{tag}_d{d}", [d], n * length
        right = F.broadcast(df) if n <= BROADCAST_CELLS else df
        if both:
            cond = None
            for d in both:
                c = F.col(have[d]) == F.col(names[d])
                cond = c if cond is None else cond & c
            current = current.join(right, cond)
        else:  # a single row
            current = current.crossJoin(F.broadcast(df))
        for d in lacking:
            have[d] = names[d]
        cells = max(cells, n)
    base = Base(current)
    coords = [Coord(F.col(have[d]), ("own", d)) if d in have else WIDE for d in range(rank)]
    return base, coords, [where[i] for i in range(len(parts))]


def _agree(a: list[Coord], b: list[Coord]) -> bool:
    """Rows of one base can be combined: every dimension is mapped alike, or neither side needs the other's rows."""
    return all(x.key == y.key for x, y in zip(a, b))


def _union(coords: list[list[Coord]]) -> list[Coord]:
    return [next((c for c in cs if c.col is not None), WIDE) for cs in zip(*coords)]
