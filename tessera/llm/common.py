"""What the operators share: word rules, bounded Arrow slices and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a word is a maximal run of anything but the six ASCII white-space characters;
# `bytes.split()` cuts at exactly these
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
# text handled by one vectorised step inside a task; longer texts form a step of their own
SLICE_BYTES = 4 << 20
# text handed to a task at once, a row less than a slice: by default it is 10,000 rows however long, held by the JVM and by Python
BATCH_BYTES = SLICE_BYTES * 15 // 16
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows holding at most about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
    batch = None
    pa.default_memory_pool().release_unused()  # the worker outlives its task


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of about BATCH_BYTES, longer rows alone, unless the session has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; all of them go when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, as executors outside the JVM need it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def table_of(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
