"""Shared helpers of the training-data operators: tables, work folders, row maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to Python at once, unless the session says otherwise; long texts would make larger batches than workers have room for.
BATCH_BYTES = 2 << 20
#: Bytes of a side that is broadcast, at most; beyond it the join is a shuffle.
BROADCAST_BYTES = 32 << 20

_own_root: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Holds the rows that go to Python at once to ``BATCH_BYTES``."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(limit):
        spark.conf.set(limit, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and all of
    Spark is this one process (local tests); elsewhere its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="quillframe-"))
    return "file://" + _own_root[0]


class Workspace:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation.

    Intermediate tables can be dropped early; what a returned DataFrame still
    reads is removed when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        bound_batches(spark)
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the JVM may be gone by now
            pass


_held: dict[str, Callable[[], object]] = {}
#: glibc's ``mallopt`` parameters of malloc.h (trim threshold, mmap threshold, arenas) and what a worker sets them to: large blocks go back to the system when they are freed.
MALLOPT = {-1: 256 << 10, -3: 256 << 10, -8: 1}
_thrifty: list[bool] = []


def thrifty() -> None:
    """Makes this process give large blocks back to the system as they are freed, those of Arrow too."""
    if _thrifty:
        return
    _thrifty.append(True)
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        for parameter, value in MALLOPT.items():
            mallopt(parameter, value)
        pa.set_memory_pool(pa.system_memory_pool())


def claim(name: str, clear: Callable[[], object] = lambda: None) -> None:
    """Called where an operator's Python work begins on an executor: what other operators remember there goes.

    Spark uses Python workers again for later stages; without this the caches
    of all operators that ran before would add up in them.
    """
    thrifty()
    if name not in _held:
        while _held:
            _held.popitem()[1]()
        release()
        _held[name] = clear


def release() -> None:
    """Gives memory that Python no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A stored table, to be broadcast if its rows, of ``row_bytes`` each and some overhead, come to ``BROADCAST_BYTES`` at most."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.coalesce(F.sum(size + F.lit(48)), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to some batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def some(texts: pa.Array, step: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """A batch's texts in runs of about ``step`` bytes, with the place of the first of each, so that no more of them become Python objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        yield at, texts.slice(at, after - at)
        at = after


def utf8(col: Column) -> Column:
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(col.cast("binary"), F.lit(b""))


def salted(key: Column, parts: int, *salt: Column) -> Column:
    """A partition number that spreads equal keys by the salt columns."""
    return F.pmod(F.xxhash64(key, *salt), F.lit(parts))
