"""Governed tables stored so that one owner's rows are found without reading the others.

One folder per app, rows in order of their owner, and a Bloom filter of the owners in every row group: the
pushed-down ``owner = <caller>`` of ``access.governed_now`` then opens one app's folder, skips the files and row
groups whose owner range leaves the caller out, and of the rest those whose Bloom filter does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import access as acc

ROW_GROUP_BYTES = 32 << 20


def write_governed(df: DataFrame, path: str, app_col: str = "app", owner_col: str = "owner_id", ranges: int | None = None,
                   row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Write ``df`` by app and owner. Null owners stand first in each app; a null app has a folder of its own.

    Rows are dealt by range of (app, owner, hash of the row), so that an app, or an owner, with a third of all rows is
    several ranges and files. ``ranges`` is their number (default: the shuffle partitions).
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(*df.columns)
    (df.withColumn("_spread", spread).repartitionByRange(n, app_col, owner_col, "_spread")
     .sortWithinPartitions(app_col, owner_col).drop("_spread")
     .write.mode(mode).partitionBy(app_col)
     .option(f"parquet.bloom.filter.enabled#{owner_col}", "true")
     .option("parquet.block.size", row_group_bytes).parquet(path))


def read_governed(spark: SparkSession, path: str, grants: DataFrame, shape: str, app: str, caller,
                  app_col: str = "app", owner_col: str = "owner_id", columns=None, schema=None) -> DataFrame:
    """The rows of ``app`` that ``caller`` may read of a table written by ``write_governed``.

    ``schema`` keeps the type of apps that are named by numbers, as folder names have none.
    """
    table = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    rows = acc.governed_now(table, grants, shape, app, caller, owner_col, app_col)
    return rows.select(*columns) if columns else rows
