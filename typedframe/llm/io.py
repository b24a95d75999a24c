"""Reading inputs, the shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Python handles slices of an Arrow batch of at most so many rows, and of about so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Tables of up to so many bytes may be dealt over the cores before they are worked on.
SMALL = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer file splits than cores, and of at most SMALL bytes, dealt over the cores: its file may be a single row group, which is one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= SMALL and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``). Where none is set, a local session gets one; a cluster is refused."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="typedframe-")
        spark.sparkContext.setCheckpointDir(conf)
    return f"{conf.rstrip('/')}/tf-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """While rows are written, Arrow batches towards Python are small; the session's settings come back."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables in the shared folder: rows written and read again cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return _written(df, f"{self.path}/{self.made}")

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``keep``, and the number of rows, found while they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return kept, seen.get["n"]

    def finish(self, df: DataFrame) -> DataFrame:
        """The result in a folder of its own; the intermediate tables are deleted."""
        out = persisted(df)
        self.drop()
        return out

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def persisted(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    return _written(df, shared_dir(df.sparkSession))


#: What a worker has learnt and may forget: called when a task ends, as workers live on through later stages.
FORGET: list[Callable[[], None]] = []


def release() -> None:
    """Forgets caches and gives freed memory back to the system, where its allocator can."""
    for forget in FORGET:
        forget()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, whatever the session's batch size; afterwards the worker's memory is released."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    release()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str, arrow: pa.Schema) -> DataFrame:
    """``df.mapInArrow`` of a function from a batch to the columns of its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(batch), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
