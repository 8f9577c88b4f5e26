"""Plumbing shared by the operators: tables, materialised steps and the packed shuffle."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import WORD

BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
BUCKET_BYTES = 32 << 20
_OWN: dict[str, str] = {}
_CREATED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset (a local session) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tesserae-')}")
    return base


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tesserae/{label}-{uuid.uuid4().hex}"
    _CREATED.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and continue from the written table.

    Lineage ends there, so a lost executor costs at most a reread.  The tables
    are removed when the session ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """materialize(), after which the files of the step's exchanges go at once, not when the driver's JVM next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def forget(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        names = {f.split("/")[-2] for f in df.inputFiles()}
        for made in [x for x in _CREATED if x[1].rpartition("/")[2] in names]:
            _CREATED.remove(made)
            _delete(*made)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove() -> None:
    for spark, path in _CREATED:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES or one row, so that texts of any length fit a worker."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = (conf.get(key, None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame, text: str = "text") -> int:
    """Buckets of a packed exchange over the texts: spark.sql.shuffle.partitions, and more where a bucket would stand for over BUCKET_BYTES of text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


_SCANS = {"Project", "Filter", "LogicalRelation", "LocalRelation", "DataSourceV2ScanRelation", "RelationV2", "SubqueryAlias"}


def repeatable(df: DataFrame) -> DataFrame:
    """df if its rows come in the same partitions and order whenever a task is run again, as a table's scan does; else df written and read.

    Row numbers of task and place need that: a task that is recomputed after a lost executor must give each row its old number.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _SCANS and not node.nodeName().startswith("Relation"):
            return materialize(df, "rows")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


def plain_names(df: DataFrame):
    """(df with columns c0, c1, ..., the new name of each column, the way back), so that no name can clash."""
    own = df.columns
    names = [f"c{i}" for i in range(len(own))]
    return df.toDF(*names), dict(zip(own, names)), lambda x: x.select(*names).toDF(*own)


def fresh_names(taken: list[str], names: list[str]) -> list[str]:
    """The names, each with underscores until it is not among those taken."""
    out = []
    for n in names:
        while n in taken or n in out:
            n += "_"
        out.append(n)
    return out


def n_words(col) -> "F.Column":
    """Words of a text, none for a null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


BLOB_FIELDS = [("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
BLOB_SCHEMA = "bucket int, kind tinyint, a binary, b binary, c binary, d binary"
_ARROW = pa.schema(BLOB_FIELDS)


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, up to four blobs) as a record batch."""
    cols = [[r[j] if j < len(r) else b"" for r in rows] for j in range(len(BLOB_FIELDS))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, BLOB_FIELDS)], schema=_ARROW)


def deal(keys: np.ndarray, n_buckets: int, kind: int, *arrays: np.ndarray) -> list[tuple]:
    """Split parallel arrays by key bucket into one blob row per bucket: the map side of a packed shuffle."""
    if not len(keys):
        return []
    bucket = bucket_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(order)]])
    arrays = [a[order] for a in arrays]
    return [(int(bucket[x]), kind, *(a[x:y].tobytes() for a in arrays)) for x, y in zip(bounds[:-1], bounds[1:])]


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)


def regroup(df: DataFrame, n: int) -> DataFrame:
    """The shuffle of a packed exchange: bucket b becomes partition b of n, its blobs ordered by kind."""
    return df.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")


def by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple[bytes, bytes, bytes, bytes]]]:
    """(bucket, kind, blobs) of a partition in order."""
    for batch in batches:
        d = batch.to_pydict()
        yield from zip(d["bucket"], d["kind"], zip(d["a"], d["b"], d["c"], d["d"]))


def row_keys(task: int, first: int, n: int) -> np.ndarray:
    """Numbers for n rows of a task from its row `first` on, unique over all tasks."""
    return (np.uint64(task) << np.uint64(40)) + np.arange(first, first + n, dtype=np.uint64)


def id_bytes(doc_id: int | None) -> bytes:
    """A nullable 64-bit id in 9 bytes."""
    return b"\0" * 9 if doc_id is None else b"\1" + int(doc_id).to_bytes(8, "little", signed=True)


def id_value(raw: bytes) -> int | None:
    return int.from_bytes(raw[1:9], "little", signed=True) if raw[0] else None


def joined(parts: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype)
