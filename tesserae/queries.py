"""One query for each array operator over the driver's tables, with its DuckDB SQL.

Tables as arrays: `emb` [n, 64] f32 from embeddings; `part`, `ord`, `cust` and
`evt` 1-D arrays over dense keys.  Floats are rounded to six decimals on both
sides, integers are longs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tesserae as ts

from .operators.array import NDArray
from .plans import dtypes as D
from .plans.layout import Base, Coord


class Tables:
    """The arrays of a data directory; columns of one table share a base."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.bases = ts.engine_session(spark), sf_dir, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _column(self, table: str, key: str, value: str, dtype: str) -> NDArray:
        if table not in self.bases:
            df = self.read(table)
            self.bases[table] = (Base(df), df.count())  # a count reads Parquet footers only
        base, n = self.bases[table]
        t = D.dtype(dtype)
        return NDArray(base, [Coord(F.col(key).cast("bigint"), ("own", 0))], F.col(value).cast(t.spark), (n,), t)

    def part(self, col="p_size", dtype="i32"):
        return self._column("part", "p_partkey", col, dtype)

    def ord(self, col="o_totalprice", dtype="f64"):
        return self._column("orders", "o_orderkey", col, dtype)

    def cust(self):
        return self._column("customer", "c_custkey", "c_acctbal", "f64")

    def evt(self):
        return self._column("events", "event_id", "value", "f64")

    @property
    def emb(self) -> NDArray:
        if "emb" not in self.bases:
            df = self.read("embeddings")
            n = df.count()
            cells = df.select(F.col("vec_id").cast("bigint").alias("d0"), F.posexplode("embedding").alias("d1", "v"))
            self.bases["emb"] = ts.from_dataframe(cells, ["d0", "d1"], "v", (n, 64), "f32")
        return self.bases["emb"]


def result(a: NDArray) -> DataFrame:
    """Cells with comparable values."""
    v = F.col("v")
    if a.dtype.rank == D.FLOAT:
        v = F.round(v.cast("double"), 6) + F.lit(0.0)
    elif a.dtype.is_int:
        v = v.cast("bigint")
    return a.cells().withColumn("v", v)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_EMB = "a AS (SELECT vec_id::BIGINT AS d0, (generate_subscripts(embedding, 1) - 1)::BIGINT AS d1, unnest(embedding)::FLOAT AS v FROM embeddings)"
_PART = "a AS (SELECT p_partkey::BIGINT AS d0, p_size::BIGINT AS s, p_retailprice AS r FROM part)"
_ORD = "a AS (SELECT o_orderkey::BIGINT AS d0, o_totalprice AS v, o_custkey::BIGINT AS c FROM orders)"
_CUST = "a AS (SELECT c_custkey::BIGINT AS d0, c_acctbal AS v FROM customer)"
_EVT = "a AS (SELECT event_id::BIGINT AS d0, value AS v FROM events)"


def _f(x: str) -> str:
    return f"ROUND(({x})::DOUBLE, 6) + 0.0"


def _i(x: str) -> str:
    return f"({x})::BIGINT"


def register(name: str, build: Callable[[Tables], NDArray], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: result(build(Tables(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = sql


def _each(name: str, build, src: str, expr: str) -> None:
    """An elementwise query over a 1-D table, or over emb."""
    dims = "d0, d1" if src is _EMB else "d0"
    register(name, build, f"WITH {src} SELECT {dims}, {expr} AS v FROM a")


# arithmetic
_each("add", lambda t: t.ord() + t.ord("o_custkey", "i64"), _ORD, _f("v + c"))
_each("subtract", lambda t: t.ord() - t.ord("o_custkey", "i64"), _ORD, _f("v - c"))
_each("multiply", lambda t: t.part() * t.part("p_retailprice", "f64"), _PART, _f("s * r"))
_each("divide", lambda t: t.part("p_retailprice", "f64") / t.part(), _PART, _f("r / s"))


def _dividend(t: Tables) -> NDArray:
    return t.ord("o_custkey", "i64") - 700


def _divisor(t: Tables) -> NDArray:
    key = t.ord("o_orderkey", "i64")
    return (key % 5 + 1) * ts.where(key % 2 == 0, 1, -1)


_X, _Y = "(c - 700)", "((d0 % 5 + 1) * (CASE WHEN d0 % 2 = 0 THEN 1 ELSE -1 END))"
_MOD = {
    "trunc": f"({_X} % {_Y})",
    "floor": f"({_X} - {_Y} * FLOOR({_X}::DOUBLE / {_Y}))",
    "euclid": f"(({_X} % abs({_Y}) + abs({_Y})) % abs({_Y}))",
}
for _mode, _r in _MOD.items():
    _each(f"divide_{_mode}", lambda t, m=_mode: ts.divide(_dividend(t), _divisor(t), rounding_mode=m), _ORD, _i(f"ROUND(({_X} - {_r})::DOUBLE / {_Y})"))
    _each(f"remainder_{_mode}", lambda t, m=_mode: ts.remainder(_dividend(t), _divisor(t), rounding_mode=m), _ORD, _i(_r))
_each("power", lambda t: t.part() ** (t.part() % 4), _PART, _i("ROUND(pow(s, s % 4))"))
_each("power_float", lambda t: t.part("p_retailprice", "f64") ** 0.5, _PART, _f("sqrt(r)"))
_each("negative", lambda t: -t.cust(), _CUST, _f("-v"))
_each("absolute", lambda t: abs(t.cust()), _CUST, _f("abs(v)"))
_each("sign", lambda t: ts.sign(t.part() - 25), _PART, _i("sign(s - 25)"))
_each("square", lambda t: ts.square(t.part()), _PART, _i("s * s"))
_each("reflected", lambda t: 100 - t.part(), _PART, _i("100 - s"))

# exponential, trigonometric, rounding
_each("sqrt", lambda t: ts.sqrt(t.ord()), _ORD, _f("sqrt(v)"))
_each("exp", lambda t: ts.exp(t.cust() / 1000), _CUST, _f("exp(v / 1000)"))
_each("log", lambda t: ts.log(t.ord()), _ORD, _f("ln(v)"))
_each("log_base", lambda t: ts.log(t.ord(), 3), _ORD, _f("ln(v) / ln(3)"))
_each("log2", lambda t: ts.log2(t.ord()), _ORD, _f("log2(v)"))
_each("log10", lambda t: ts.log10(t.ord()), _ORD, _f("log10(v)"))
for _n in ("sin", "cos", "tan", "atan"):
    _each(_n, lambda t, n=_n: getattr(ts, n)(t.part() / 10.0), _PART, _f(f"{_n}(s / 10.0::DOUBLE)"))
for _n in ("asin", "acos"):
    _each(_n, lambda t, n=_n: getattr(ts, n)((t.part() - 25) / 26.0), _PART, _f(f"{_n}((s - 25) / 26.0::DOUBLE)"))
_each("floor", lambda t: ts.floor(t.cust() / 7), _CUST, _f("floor(v / 7)"))
_each("ceil", lambda t: ts.ceil(t.cust() / 7), _CUST, _f("ceil(v / 7)"))
_each("round", lambda t: ts.round((t.part() - 25) / 2.0), _PART, _f("round((s - 25) / 2.0::DOUBLE)"))
_special = lambda t: (t.part() - 24) / (t.part() % 3)
_each("isnan", lambda t: ts.isnan(_special(t)), _PART, "s = 24")
_each("isinf", lambda t: ts.isinf(_special(t)), _PART, "s % 3 = 0 AND s <> 24")
_each("isfinite", lambda t: ts.isfinite(_special(t)), _PART, "s % 3 <> 0")

# comparison and selection
for _n, _op in (("equal", "="), ("not_equal", "<>"), ("greater", ">"), ("greater_equal", ">="), ("less", "<"), ("less_equal", "<=")):
    _each(_n, lambda t, n=_n: getattr(ts, n)(t.part(), 25), _PART, f"s {_op} 25")
_each("isclose", lambda t: ts.isclose(t.part(), 25, rtol=0.1, atol=1.5), _PART, "abs(s - 25) <= greatest(1.5, 0.1 * greatest(s, 25))")
_each("where", lambda t: ts.where(t.cust() > 0, t.cust(), -1), _CUST, _f("CASE WHEN v > 0 THEN v ELSE -1 END"))
_each("maximum", lambda t: ts.maximum(t.cust(), 100), _CUST, _f("greatest(v, 100)"))
_each("minimum", lambda t: ts.minimum(t.cust(), 100), _CUST, _f("least(v, 100)"))
_each("clamp", lambda t: ts.clamp(t.cust(), -100, 5000), _CUST, _f("least(greatest(v, -100), 5000)"))

# logical, bitwise, bit counting
for _n, _e in (("and", "s % 2 <> 0 AND s % 3 <> 0"), ("or", "s % 2 <> 0 OR s % 3 <> 0"), ("xor", "(s % 2 <> 0) <> (s % 3 <> 0)")):
    _each(f"logical_{_n}", lambda t, n=_n: getattr(ts, f"logical_{n}")(t.part() % 2, t.part() % 3), _PART, _e)
_each("logical_not", lambda t: ts.logical_not(t.part() % 3), _PART, "s % 3 = 0")
for _n, _e in (("and", "s & 12"), ("or", "s | 12"), ("xor", "xor(s, 12)")):
    _each(f"bitwise_{_n}", lambda t, n=_n: getattr(ts, f"bitwise_{n}")(t.part(), 12), _PART, _i(_e))
_each("bitwise_not", lambda t: ~t.part(), _PART, _i("-s - 1"))
_each("bitwise_left_shift", lambda t: t.part() << (t.part() % 5), _PART, _i("s * (1 << (s % 5)::INT)"))
_each("bitwise_right_shift", lambda t: (t.part() - 25) >> 2, _PART, _i("floor((s - 25) / 4.0::DOUBLE)"))
_each("bitwise_rotate_left", lambda t: ts.bitwise_rotate_left(t.part().cast("uint8"), 3), _PART, _i("((s << 3) | (s >> 5)) & 255"))
_each("bitwise_rotate_right", lambda t: ts.bitwise_rotate_right(t.part().cast("uint8"), 3), _PART, _i("((s >> 3) | (s << 5)) & 255"))
_each("count_ones", lambda t: ts.count_ones(t.part()), _PART, _i("bit_count(s)"))
_each("count_zeros", lambda t: ts.count_zeros(t.part()), _PART, _i("32 - bit_count(s)"))
_each("leading_zeros", lambda t: ts.leading_zeros(t.part()), _PART, _i("31 - floor(log2(s))"))
_each("trailing_zeros", lambda t: ts.trailing_zeros(t.part()), _PART, _i("bit_count((s & -s) - 1)"))
_each("byteswap", lambda t: ts.byteswap(t.part()), _PART, _i("s * 16777216"))
_each("reverse_bits", lambda t: ts.reverse_bits(t.part().cast("uint8")), _PART, _i(" + ".join(f"((s >> {k}) & 1) * {1 << (7 - k)}" for k in range(8))))

# types
_each("cast", lambda t: t.cust().cast("i32"), _CUST, _i("trunc(v)"))
_each("cast_wrap", lambda t: (t.part() * 10).cast("uint8"), _PART, _i("(s * 10) % 256"))
_each("cast_f32", lambda t: t.emb.cast("f64"), _EMB, _f("v"))
_each("real", lambda t: ts.real(t.cust().cast("c128") * (2 + 1j)), _CUST, _f("2 * v"))
_each("imag", lambda t: ts.imag(t.cust().cast("c128") * (2 + 1j)), _CUST, _f("v"))
_each("transmute", lambda t: ts.transmute(t.part() - 25, "u32"), _PART, _i("CASE WHEN s < 25 THEN s - 25 + 4294967296 ELSE s - 25 END"))


def _struct(t: Tables) -> NDArray:
    df = t.read("part")
    kind = D.dtype([("size", "i4"), ("price", "f8")])
    return ts.from_dataframe(df, ["p_partkey"], F.struct(F.col("p_size").cast("int").alias("size"), F.col("p_retailprice").alias("price")), (df.count(),), kind)


_each("dtype_sub_field", lambda t: ts.dtype_sub_field(_struct(t), "price"), _PART, _f("r"))

# shape
_grid = lambda t: t.part().reshape((-1, 10))
register("reshape", _grid, f"WITH {_PART} SELECT d0 // 10 AS d0, d0 % 10 AS d1, s AS v FROM a")
register("flatten", lambda t: t.emb.flatten(), f"WITH {_EMB} SELECT d0 * 64 + d1 AS d0, {_f('v')} AS v FROM a")
register("slice", lambda t: ts.slice(t.emb, (slice(10, 20), slice(3, -1))), f"WITH {_EMB} SELECT d0 - 10 AS d0, d1 - 3 AS d1, {_f('v')} AS v FROM a WHERE d0 BETWEEN 10 AND 19 AND d1 BETWEEN 3 AND 62")
register("slice_int", lambda t: ts.slice(t.emb, (..., 5)), f"WITH {_EMB} SELECT d0, {_f('v')} AS v FROM a WHERE d1 = 5")
register("permute_dims", lambda t: t.emb.T, f"WITH {_EMB} SELECT d1 AS d0, d0 AS d1, {_f('v')} AS v FROM a")
register("swapdims", lambda t: t.emb.swapdims(0, 1), f"WITH {_EMB} SELECT d1 AS d0, d0 AS d1, {_f('v')} AS v FROM a")
register("insert_dim", lambda t: t.part().insert_dim(0), f"WITH {_PART} SELECT 0::BIGINT AS d0, d0 AS d1, s AS v FROM a")
register("remove_dim", lambda t: t.part().insert_dim(0).remove_dim(0), f"WITH {_PART} SELECT d0, s AS v FROM a")
register("squeeze", lambda t: t.part().insert_dim(1).insert_dim(0).squeeze(), f"WITH {_PART} SELECT d0, s AS v FROM a")
register("broadcast", lambda t: t.part().broadcast((3, -1)), f"WITH {_PART} SELECT k::BIGINT AS d0, d0 AS d1, s AS v FROM a, range(3) AS x(k)")
register("concatenate", lambda t: ts.concatenate([t.part(), t.part() * 2]), f"WITH {_PART}, n AS (SELECT COUNT(*) AS n FROM a) SELECT d0, s AS v FROM a UNION ALL SELECT d0 + n, 2 * s FROM a, n")
register("stack", lambda t: ts.stack([t.part(), -t.part()], 1), f"WITH {_PART} SELECT d0, 0::BIGINT AS d1, s AS v FROM a UNION ALL SELECT d0, 1, -s FROM a")
register("repeat", lambda t: ts.repeat(t.part(), 3), f"WITH {_PART} SELECT d0 * 3 + k AS d0, s AS v FROM a, range(3) AS x(k)")
register("tile", lambda t: ts.tile(t.part(), 3), f"WITH {_PART}, n AS (SELECT COUNT(*) AS n FROM a) SELECT d0 + k * n AS d0, s AS v FROM a, n, range(3) AS x(k)")
register("flip", lambda t: t.emb.flip(), f"WITH {_EMB}, n AS (SELECT MAX(d0) AS n FROM a) SELECT n - d0 AS d0, 63 - d1 AS d1, {_f('v')} AS v FROM a, n")
register("roll", lambda t: ts.roll(t.emb, 5, 1), f"WITH {_EMB} SELECT d0, (d1 + 5) % 64 AS d1, {_f('v')} AS v FROM a")

# reductions
_e64 = lambda t: t.emb.cast("f64")
_G = "g AS (SELECT d0 // 10 AS d0, d0 % 10 AS d1, s AS v FROM a)"
register("sum_dim0", lambda t: _e64(t).sum(0), f"WITH {_EMB} SELECT d1 AS d0, {_f('SUM(v::DOUBLE)')} AS v FROM a GROUP BY d1")
register("sum_dim1", lambda t: _e64(t).sum(1), f"WITH {_EMB} SELECT d0, {_f('SUM(v::DOUBLE)')} AS v FROM a GROUP BY d0")
register("sum", lambda t: t.part().sum(), f"WITH {_PART} SELECT SUM(s)::BIGINT AS v FROM a")
register("sum_keepdim", lambda t: _grid(t).sum(1, keepdim=True), f"WITH {_PART}, {_G} SELECT d0, 0::BIGINT AS d1, SUM(v)::BIGINT AS v FROM g GROUP BY d0")
register("product", lambda t: (_grid(t) % 4 + 1).prod(1), f"WITH {_PART}, {_G} SELECT d0, PRODUCT(v % 4 + 1)::BIGINT AS v FROM g GROUP BY d0")
register("mean", lambda t: _e64(t).mean(0), f"WITH {_EMB} SELECT d1 AS d0, {_f('AVG(v::DOUBLE)')} AS v FROM a GROUP BY d1")
register("var", lambda t: _e64(t).var(1), f"WITH {_EMB} SELECT d0, {_f('VAR_POP(v::DOUBLE)')} AS v FROM a GROUP BY d0")
register("var_ddof", lambda t: _e64(t).var(1, ddof=1), f"WITH {_EMB} SELECT d0, {_f('VAR_SAMP(v::DOUBLE)')} AS v FROM a GROUP BY d0")
register("std", lambda t: _e64(t).std(0), f"WITH {_EMB} SELECT d1 AS d0, {_f('STDDEV_POP(v::DOUBLE)')} AS v FROM a GROUP BY d1")
register("max", lambda t: t.emb.max(1), f"WITH {_EMB} SELECT d0, {_f('MAX(v)')} AS v FROM a GROUP BY d0")
register("min", lambda t: t.emb.min(0), f"WITH {_EMB} SELECT d1 AS d0, {_f('MIN(v)')} AS v FROM a GROUP BY d1")
register("argmax", lambda t: _grid(t).argmax(1), f"WITH {_PART}, {_G}, m AS (SELECT d0, MAX(v) AS m FROM g GROUP BY d0) SELECT g.d0, MIN(d1)::BIGINT AS v FROM g JOIN m ON g.d0 = m.d0 AND g.v = m.m GROUP BY g.d0")
register("argmin", lambda t: _grid(t).argmin(1), f"WITH {_PART}, {_G}, m AS (SELECT d0, MIN(v) AS m FROM g GROUP BY d0) SELECT g.d0, MIN(d1)::BIGINT AS v FROM g JOIN m ON g.d0 = m.d0 AND g.v = m.m GROUP BY g.d0")
register("all", lambda t: (_grid(t) > 5).all(1), f"WITH {_PART}, {_G} SELECT d0, BOOL_AND(v > 5) AS v FROM g GROUP BY d0")
register("any", lambda t: (_grid(t) > 45).any(1), f"WITH {_PART}, {_G} SELECT d0, BOOL_OR(v > 45) AS v FROM g GROUP BY d0")
register("reduce_unordered", lambda t: _grid(t).reduce_unordered(lambda x, y: F.greatest(x, y), 1), f"WITH {_PART}, {_G} SELECT d0, MAX(v)::BIGINT AS v FROM g GROUP BY d0")

# functions of elements
_each("map", lambda t: ts.map(t.part(), lambda x: x * x + 1, "i32"), _PART, _i("s * s + 1"))
_each("map2", lambda t: ts.map2(t.part(), t.part(), lambda x, y: x * 100 + y, "i32"), _PART, _i("s * 101"))
_each("map_multiple", lambda t: ts.map_multiple([t.part(), t.part(), t.part()], lambda x, y, z: x + y - z, "i32"), _PART, _i("s"))

# alignment of arrays over different bases
register("align_join", lambda t: t.ord() - ts.slice(ts.concatenate([t.ord("o_custkey", "i64"), t.ord("o_custkey", "i64")]), slice(0, t.ord().shape[0])), f"WITH {_ORD} SELECT d0, {_f('v - c')} AS v FROM a")
_SHORT = f"b AS (SELECT d1 AS d0, SUM((v > 0)::INT)::BIGINT AS c FROM (WITH {_EMB} SELECT * FROM a) GROUP BY d1)"
register("outer_product", lambda t: t.part().insert_dim(1) * (t.emb > 0).sum(0).cast("i64"), f"WITH {_PART}, {_SHORT} SELECT a.d0, b.d0 AS d1, (a.s * b.c)::BIGINT AS v FROM a, b")
register("normalize", lambda t: (_e64(t) - _e64(t).mean(0)) / _e64(t).std(1, keepdim=True), f"WITH {_EMB} SELECT d0, d1, {_f('(v::DOUBLE - AVG(v::DOUBLE) OVER (PARTITION BY d1)) / STDDEV_POP(v::DOUBLE) OVER (PARTITION BY d0)')} AS v FROM a")
register("elementwise_pipeline", lambda t: ts.log(ts.exp(_e64(t)) * 0.5 + 1), f"WITH {_EMB} SELECT d0, d1, {_f('ln(exp(v::DOUBLE) * 0.5 + 1)')} AS v FROM a")
register("reduction_pipeline", lambda t: ts.exp(_e64(t)).sum(0), f"WITH {_EMB} SELECT d1 AS d0, {_f('SUM(exp(v::DOUBLE))')} AS v FROM a GROUP BY d1")
_each("evt_scale", lambda t: t.evt() * 2 - 1, _EVT, _f("v * 2 - 1"))

# sources, sinks, materialisation
register("asarray", lambda t: ts.asarray([[1, 2, 3], [4, 5, 6]], session=t.spark), "SELECT (i // 3)::BIGINT AS d0, (i % 3)::BIGINT AS d1, (i + 1)::BIGINT AS v FROM range(6) AS x(i)")
register("from_function", lambda t: ts.from_function((20, 30), lambda i, j: i * 100 + j, "i64", session=t.spark), "SELECT (i // 30)::BIGINT AS d0, (i % 30)::BIGINT AS d1, ((i // 30) * 100 + i % 30)::BIGINT AS v FROM range(600) AS x(i)")
register("compact", lambda t: (t.part() + 1).compact({"block_shape": (64,)}), f"WITH {_PART} SELECT d0, s + 1 AS v FROM a")
register("plain", lambda t: (t.part() + 1).plain() * 2, f"WITH {_PART} SELECT d0, (s + 1) * 2 AS v FROM a")
register("write_read", lambda t: t.emb.compact({"block_shape": (32, 64)}), f"WITH {_EMB} SELECT d0, d1, {_f('v')} AS v FROM a")
register("region_read", lambda t: ts.slice(t.emb.compact({"block_shape": (16, 16)}), (slice(40, 60), slice(20, 36))), f"WITH {_EMB} SELECT d0 - 40 AS d0, d1 - 20 AS d1, {_f('v')} AS v FROM a WHERE d0 BETWEEN 40 AND 59 AND d1 BETWEEN 20 AND 35")
register("scalar", lambda t: ts.scalar(math.pi, D.f64, (2, 2), session=t.spark), "SELECT i::BIGINT AS d0, j::BIGINT AS d1, ROUND(pi(), 6) + 0.0 AS v FROM range(2) AS x(i), range(2) AS y(j)")


def _appended(t: Tables) -> NDArray:
    """Two arrays written to one folder by name and read back, added block by block."""
    import uuid

    from .sources.blocks import _own_folder

    path = f"{t.spark.conf.get('spark.checkpoint.dir', None) or _own_folder()}/tesserae/pair-{uuid.uuid4().hex}"
    ts.write_array(t.part(), path, name="size", params={"block_shape": (128,)})
    ts.write_array(t.part() * 2, path, append=True, name="double", params={"block_shape": (128,)})
    size, double = (ts.read_array(path, name=n, validation="strict", session=t.spark) for n in ("size", "double"))
    return size + double


# indexing, elements and the rest of the array protocol
register("getitem", lambda t: ts.asarray(t.emb[2:5, 7], session=t.spark), f"WITH {_EMB} SELECT d0 - 2 AS d0, {_f('v')} AS v FROM a WHERE d0 BETWEEN 2 AND 4 AND d1 = 7")
register("get", lambda t: ts.asarray([int(t.part()[3])], session=t.spark), f"WITH {_PART} SELECT 0::BIGINT AS d0, s AS v FROM a WHERE d0 = 3")
register("item", lambda t: ts.asarray([t.part().sum().item()], session=t.spark), f"WITH {_PART} SELECT 0::BIGINT AS d0, SUM(s)::BIGINT AS v FROM a")
register("maybe_compact", lambda t: ts.compact(ts.compact(t.part())), f"WITH {_PART} SELECT d0, s AS v FROM a")
register("unary_plus", lambda t: +t.part(), f"WITH {_PART} SELECT d0, s AS v FROM a")
register("numpy_operand", lambda t: np.arange(64, dtype="f8") + _e64(t), f"WITH {_EMB} SELECT d0, d1, {_f('v::DOUBLE + d1')} AS v FROM a")
register("read_append_strict", _appended, f"WITH {_PART} SELECT d0, 3 * s AS v FROM a")
register("product_complex", lambda t: (_grid(t) % 3 + 1).cast("c128").prod(1).real(), f"WITH {_PART}, {_G} SELECT d0, PRODUCT(v % 3 + 1) AS v FROM g GROUP BY d0")
