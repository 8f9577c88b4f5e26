"""The block layout: Parquet rows (b0 .. b{n-1}, vals), one for each block of an array.

`vals` holds a block's elements in C order; blocks at the edge are clipped.  A
directory holds one or several arrays by name, each with its blocks and a
one-line JSON description.  Reading a region filters on the block coordinates,
which reach the Parquet scan as row-group predicates, and only then takes blocks
apart.
"""

from __future__ import annotations

import atexit
import json
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ARITHMETIC, translated
from ..operators.array import NDArray, asarray
from ..plans import dtypes as D
from ..plans import shapes as S
from ..plans.dtypes import DType
from ..plans.layout import WIDE, Base, Coord
from ..session import engine_session

BLOCK_BYTES = 1 << 20
MAX_BLOCK_BYTES = 1 << 30
PART_BYTES = 128 << 20  # of an array in a partition that is written
RUNS = 8  # of blocks in a partition
_PARAMS = {"block_shape", "block_shape_fixed_dims", "block_size", "read_size", "codec", "compression_level", "filters"}


def check_params(params: dict | None) -> dict:
    """Known keys only; the codec is zstd, filters and read_size are accepted and left to Parquet and Spark."""
    params = dict(params or {})
    if unknown := set(params) - _PARAMS:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    if params.get("codec", "zstd") != "zstd":
        raise ValueError(f"unknown codec {params['codec']!r}")
    for f in params.get("filters") or ():
        if f not in ("byte-shuffle",):
            raise ValueError(f"unknown filter {f!r}")
    return params


def choose_block_shape(shape: tuple[int, ...], dtype: DType, params: dict, preferred: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The given block shape, or the last dimensions whole and the first ones cut to about BLOCK_BYTES."""
    limit = max(1, params.get("block_size", BLOCK_BYTES) // max(1, dtype.size))
    if "block_shape" in params:
        own = tuple(params["block_shape"])
        if len(own) != len(shape) or any(b < 1 for b in own):
            raise ValueError(f"bad block shape {own}")
        own = tuple(min(b, max(1, n)) for b, n in zip(own, shape))
    elif preferred:
        own = preferred
    else:
        own, left = [], limit
        for n in reversed(shape):
            b = max(1, min(n, left))
            own.insert(0, b)
            left = max(1, left // b)
        own = tuple(own)
    if math.prod(own) * dtype.size > MAX_BLOCK_BYTES:
        raise ValueError("a block has at most 1 GiB")
    return own


def to_blocks(a: NDArray, block: tuple[int, ...]) -> DataFrame:
    """Gather cells into blocks; a block bounds what a task holds.

    Elementwise work on a stored array of the same block shape is done inside the
    blocks, with no shuffle.
    """
    st = a.base.stored
    if a.lift is not None and st is not None and st.block == block:

        def element(v):
            value, err = a.lift(v)
            return value if err is None else F.when(err, F.raise_error(F.lit(ARITHMETIC)).cast(a.dtype.spark)).otherwise(value)

        return st.blocks.select(*[f"b{d}" for d in range(a.ndim)], F.transform("vals", element).alias("vals"))
    df = a.cells()
    bs = [F.call_function("div", F.col(f"d{d}"), F.lit(b).cast("bigint")).alias(f"b{d}") for d, b in enumerate(block)]
    off = F.lit(0).cast("bigint")
    for d, (b, n) in enumerate(zip(block, a.shape)):
        start = F.call_function("div", F.col(f"d{d}"), F.lit(b).cast("bigint")) * b
        width = F.least(F.lit(b).cast("bigint"), F.lit(n).cast("bigint") - start)
        off = off * width + (F.col(f"d{d}") - start)
    keyed = df.select(*bs, F.struct(off.alias("o"), F.col("v")).alias("c"))
    keys = [f"b{d}" for d in range(a.ndim)]
    # offsets differ, so the natural order of (offset, value) is that of the offsets
    vals = F.transform(F.array_sort(F.collect_list("c")), lambda x: x["v"]).alias("vals")
    if not keys:
        return keyed.agg(vals)
    return _in_place(keyed, a, block).groupBy("run", *keys).agg(vals).drop("run")


class Stored:
    """An array in block layout, and the cells of the blocks that meet a region."""

    def __init__(self, blocks: DataFrame, shape: tuple[int, ...], dtype: DType, block: tuple[int, ...], region: dict | None = None, uid: str | None = None, sides: tuple | None = None):
        self.blocks, self.shape, self.dtype, self.block = blocks, shape, dtype, block
        self.region, self.uid, self.sides = region or {}, uid or uuid.uuid4().hex, sides

    @property
    def key(self):
        return (self.uid, tuple(sorted(self.region.items())))

    def base(self) -> Base:
        df = self.blocks
        for d, (lo, hi) in sorted(self.region.items()):
            b = self.block[d]
            df = df.where((F.col(f"b{d}") >= lo // b) & (F.col(f"b{d}") <= (max(hi, lo + 1) - 1) // b))
        df = df.select(*[f"b{d}" for d in range(len(self.shape))], F.posexplode("vals").alias("o", "v"))
        rest, cols = F.col("o").cast("bigint"), []
        widths = [F.least(F.lit(b).cast("bigint"), F.lit(n).cast("bigint") - F.col(f"b{d}") * b) for d, (b, n) in enumerate(zip(self.block, self.shape))]
        for d in reversed(range(len(self.shape))):
            pos = rest % widths[d] if d else rest
            cols.insert(0, (F.col(f"b{d}") * self.block[d] + pos).alias(f"d{d}"))
            rest = F.call_function("div", rest, widths[d])
        return Base(df.select(*cols, "v"), stored=self)

    def pruned(self, region: dict[int, tuple[int, int]]) -> Base:
        own = dict(self.region)
        for d, (lo, hi) in region.items():
            a, b = own.get(d, (0, self.shape[d]))
            own[d] = (max(lo, a), min(hi, b))
        return Stored(self.blocks, self.shape, self.dtype, self.block, own, self.uid, self.sides).base()

    def paired(self, other: "Stored") -> "Stored":
        """Both arrays of one grid, block by block: an element is the struct (x, y) of theirs.  Blocks are joined, not cells."""
        if other.element(self, F.lit(None)) is not None:
            return other
        if self.element(other, F.lit(None)) is not None:
            return self
        keys = [f"b{d}" for d in range(len(self.shape))]
        right = other.blocks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("vals").alias("__vals"))
        both = self.blocks.join(right, [F.col(k) == F.col(f"__{k}") for k in keys])
        vals = F.zip_with("vals", "__vals", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("vals")
        return Stored(both.select(*keys, vals), self.shape, self.dtype, self.block, uid=f"({self.uid}*{other.uid})", sides=(self, other))

    def element(self, of: "Stored", v):
        """The element of another array as part of v, an element of this one; None if it is no part."""
        if of.uid == self.uid:
            return v
        for name, side in zip("xy", self.sides or ()):
            if side.element(of, F.lit(None)) is not None:
                return side.element(of, v.getField(name))
        if of.sides and all(self.element(x, v) is not None for x in of.sides):
            return F.struct(*[self.element(x, v).alias(n) for n, x in zip("xy", of.sides)])
        return None

    def array(self) -> NDArray:
        coords = [Coord(F.col(f"d{d}"), ("stored", d)) for d in range(len(self.shape))]
        out = NDArray(self.base(), coords, F.col("v"), self.shape, self.dtype)
        out.lift = lambda v: (v, None)
        out.untouched = True
        return out


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _in_place(cells: DataFrame, a: NDArray, block: tuple[int, ...]) -> DataFrame:
    """Cells keyed by block, dealt to partitions by runs of blocks (column `run`): the one exchange of a write, without sampling."""
    grid = [-(-n // b) for n, b in zip(a.shape, block)]
    whole = max(1, math.prod(grid))
    parts = min(whole, max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-a.size * a.dtype.size // PART_BYTES)))
    place = F.lit(0).cast("bigint")
    for d, n in enumerate(grid):
        place = place * n + F.col(f"b{d}")
    run = F.floor(place.cast("double") * (min(whole, RUNS * parts) / whole)).cast("int")  # several for a partition, so that their hashes even out
    return cells.withColumn("run", run).repartition(parts, "run")


def write_array(array, path: str, *, append: bool = False, name: str = "array", params: dict | None = None) -> None:
    """Write in block layout; an existing directory is an error unless append adds another name to it.

    An array that is stored and unchanged has its blocks copied as they are.
    """
    params = check_params(params)
    a = asarray(array)
    spark = a.session
    if _exists(spark, path) and not append:
        raise FileExistsError(path)
    if _exists(spark, f"{path}/{name}"):
        raise FileExistsError(f"{path}/{name}")
    same = a.base.stored if is_stored(a) or a.lift is not None else None
    block = choose_block_shape(a.shape, a.dtype, params, same.block if same else None)
    blocks = same.blocks if is_stored(a) and same.block == block else to_blocks(a, block)
    keys = [f"b{d}" for d in range(a.ndim)]
    if keys and not (same and same.sides is None and same.block == block):  # else a scan of sorted blocks
        blocks = blocks.sortWithinPartitions(*keys)
    level = {"parquet.compression.codec.zstd.level": str(params["compression_level"])} if "compression_level" in params else {}
    new = not _exists(spark, path)
    about = {"shape": list(a.shape), "block": list(block), "dtype": _describe(a.dtype)}
    try:
        with translated():
            blocks.write.options(compression="zstd", **level).mode("errorifexists").parquet(f"{path}/{name}/blocks")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/{name}/about")
    except BaseException:  # a failed write leaves nothing behind
        fs, own = _file_system(spark, path if new else f"{path}/{name}")
        fs.delete(own, True)
        raise


def _describe(t: DType):
    if t.inner:
        return {"inner": list(t.inner), "of": _describe(D.element_of(t))}
    return [[n, _describe(f)] for n, f in t.fields] if t.fields else t.name


def _described(x) -> DType:
    if isinstance(x, dict):
        b = _described(x["of"])
        return DType(f"{b.name}{x['inner']}", D.OTHER, b.size, b.fields, tuple(x["inner"]))
    if isinstance(x, list):
        own = tuple((n, _described(f)) for n, f in x)
        return DType("{" + ", ".join(f"{n}: {t.name}" for n, t in own) + "}", D.OTHER, sum(t.numpy.itemsize for _, t in own), own)
    return D.SCALARS[x]


def read_array(path: str, *, name: str = "array", validation: str = "minimal", params: dict | None = None, session: SparkSession | None = None) -> NDArray:
    """A lazy array over stored blocks; 'strict' validation counts blocks and elements first."""
    check_params(params)
    if validation not in ("minimal", "strict"):
        raise ValueError(f"validation {validation!r}")
    spark = engine_session(session)
    if not _exists(spark, f"{path}/{name}/about"):
        raise FileNotFoundError(f"{path}/{name}")
    about = json.loads(spark.read.text(f"{path}/{name}/about").first()["value"])
    shape, block, t = tuple(about["shape"]), tuple(about["block"]), _described(about["dtype"])
    schema = ", ".join([f"b{d} bigint" for d in range(len(shape))] + [f"vals array<{t.spark}>"])
    blocks = spark.read.schema(schema).parquet(f"{path}/{name}/blocks")
    if validation == "strict":
        keys = [f"b{d}" for d in range(len(shape))]
        grid = math.prod(-(-n // b) for n, b in zip(shape, block))
        got = blocks.select(F.struct(*keys).alias("k") if keys else F.lit(0).alias("k"), F.size("vals").alias("n")).groupBy("k").agg(F.count("*").alias("c"), F.sum("n").alias("n")).agg(F.count("*").alias("k"), F.max("c").alias("c"), F.sum("n").alias("n")).first()
        if S.size(shape) and (got["k"], got["c"], got["n"]) != (grid, 1, S.size(shape)):
            raise RuntimeError(f"{path}/{name}: {got['k']} of {grid} blocks, {got['n']} of {S.size(shape)} elements")
    return Stored(blocks, shape, t, block).array()


def is_stored(a: NDArray) -> bool:
    """Whether an array is an unmodified stored one."""
    return a.base.stored is not None and a.untouched


_OWN: list[str] = []


def _own_folder() -> str:
    """A folder of this process for a local session, which names no shared one; removed at exit."""
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tesserae-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def compact(array, *, dtype=None, params: dict | None = None, session: SparkSession | None = None) -> NDArray:
    """Materialise an array-like into blocks in the folder of spark.checkpoint.dir; an unmodified stored array is returned."""
    from ..operators.elementwise import cast

    check_params(params)
    a = asarray(array, session=session)
    a = a if dtype is None else cast(a, dtype)
    if is_stored(a) and not params:
        return a
    spark = a.session or engine_session(session)
    if a.session is None:
        a = a.replace(session=spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    path = f"{folder}/tesserae/array-{uuid.uuid4().hex}"
    write_array(a, path, params=params)
    return read_array(path, session=spark)


__all__ = ["WIDE", "Stored", "check_params", "compact", "is_stored", "read_array", "to_blocks", "write_array"]
