"""What the operators share: the shared folder, tables written there, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is only made for a local session; a cluster's
    executors would each write to a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="parlance-")
        _LOCAL[spark.sparkContext.applicationId] = folder
    return folder


_LOCAL: dict[str, str] = {}


class Stash:
    """Intermediate tables as Parquet in the shared folder, so that lost executors cost no more than one stage.

    ``put`` writes a frame and returns it as read back. ``drop`` deletes tables that no later step reads; the
    others go when the application ends, because results are lazy and may read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/parlance-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is gone: nothing can be deleted through it
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A column's UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def size_column(text: str = "text"):
    """Words of a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


_KEPT: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """Has a worker keep what ``drop`` would drop, for as long as its tasks name it (``parts``)."""
    _KEPT[name] = drop


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Batches in smaller slices, which bounds what a task derives from one at once. What earlier tasks kept under another
    name than ``keeps`` is dropped first. At the end, what the worker has freed goes back to the system: the worker stays
    for later tasks and stages."""
    others = [x for x in _KEPT if x != keeps]
    for name in others:
        _KEPT.pop(name)()
    if others:
        release()
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of one key after another, of batches that are sorted by their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in parts(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
