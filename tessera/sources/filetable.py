"""Tables kept as lists of files, so that a change rewrites only the files it touches.

A version is a manifest that names a listing: one Parquet row per data file with its rows and its least and
greatest key. A change finds the files that hold its keys, reads and rewrites those, and commits a
listing in which the new files stand for the old ones; all others are shared by both versions. The
manifest is committed exclusively (``publish.commit_manifest``). Each version also keeps the keys it changed: a writer
that finds another version committed meanwhile goes on where their keys differ, and fails where they
meet. It joins its files to the newer listing if that still has the files it read, and computes its change
anew from the newer version if not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.sources import publish as pub


class KeyConflict(pub.StaleVersion):
    """Another writer changed some of the same keys since the version a change was computed from."""


@dataclass(frozen=True)
class Version:
    """One committed state of a table: its number, key columns, schema and the path of its listing."""
    root: str
    number: int
    key: tuple[str, ...]
    schema: StructType
    listing: str
    keys: str | None

    def key_type(self) -> StructType:
        return StructType([StructField(k, self.schema[k].dataType) for k in self.key])

    def listing_type(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("rows", LongType()),
                           StructField("low", self.key_type()), StructField("high", self.key_type())])

    def files(self, spark: SparkSession) -> DataFrame:
        """(path, rows, low, high): the version's data files."""
        return spark.read.schema(self.listing_type()).parquet(self.listing)

    def key_of(self, df: DataFrame) -> Column:
        """The key of ``df``'s rows as one value of the table's types; in it a null equals a null."""
        return F.struct(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.key])


@dataclass(frozen=True)
class Change:
    """What a change did: the version it made, and how many files it replaced, kept and added."""
    version: int
    rewritten: int
    kept: int
    added: int


def _folder(root: str) -> str:
    return f"{root}/_versions"


def current(spark: SparkSession, root: str) -> Version:
    m = pub.newest_manifest(spark, _folder(root))
    if m is None:
        raise FileNotFoundError(f"no table under {root}")
    return _version(root, m)


def _version(root: str, m: dict) -> Version:
    return Version(root, m["version"], tuple(m["key"]), StructType.fromJson(m["schema"]), m["listing"], m["keys"])


def at_version(spark: SparkSession, root: str, number: int) -> Version:
    return _version(root, json.loads(pub.read_text(spark, f"{_folder(root)}/v={number}.json")))


def read(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """All rows of the newest (or a given) version."""
    v = version or current(spark, root)
    return _rows_of(spark, v, [r.path for r in v.files(spark).select("path").collect()])


def _rows_of(spark: SparkSession, v: Version, paths: list[str]) -> DataFrame:
    return spark.read.schema(v.schema).parquet(*paths) if paths else spark.createDataFrame([], v.schema)


def _write_files(df: DataFrame, v: Version, files: int) -> DataFrame:
    """Write ``df`` in key order to ``files`` files or fewer; returns their listing."""
    spark, path = df.sparkSession, f"{v.root}/data/{uuid.uuid4().hex}"
    spread = F.xxhash64(*df.columns)
    (df.withColumn("_spread", spread).repartitionByRange(files, *v.key, "_spread")
     .sortWithinPartitions(*v.key).drop("_spread").write.parquet(path))
    rows = spark.read.schema(v.schema).parquet(path)
    # the reader's own names of the files, as they are met again when files are looked for
    return (rows.select(F.col("_metadata.file_path").alias("path"), v.key_of(rows).alias("k"))
            .groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high")))


def _commit(spark: SparkSession, v: Version, number: int, listing: DataFrame, keys: str | None) -> bool:
    path = f"{v.root}/_listings/{number}-{uuid.uuid4().hex}"
    listing.select("path", "rows", "low", "high").write.parquet(path)
    done = pub.commit_manifest(spark, _folder(v.root), {"version": number, "key": list(v.key), "schema": json.loads(v.schema.json()),
                                                        "listing": path, "keys": keys})
    if not done:
        pub.remove(spark, path)
    return done


def create(df: DataFrame, root: str, key, files: int | None = None) -> Version:
    """Write ``df`` as the first version: ``files`` files (default: the shuffle partitions), each a range of the key.

    Rows of one key are spread over several files where they fill more than one; keys may be null and may repeat.
    """
    spark, key = df.sparkSession, (key,) if isinstance(key, str) else tuple(key)
    v = Version(root, 0, key, df.schema, "", None)
    listing = _write_files(df, v, files or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not _commit(spark, v, 1, listing, None):
        raise pub.StaleVersion(f"a table is under {root} already")
    return current(spark, root)


def files_holding(spark: SparkSession, v: Version, keys: DataFrame) -> list[str]:
    """The files that hold any of ``keys`` (column ``k``, as ``Version.key_of`` makes it).

    Files whose key range lies outside that of all the keys are left out by the listing; of the others only the key columns
    are read, and met with the keys in a semi join.
    """
    span = keys.agg(F.min("k").alias("from"), F.max("k").alias("to"))
    near = [r.path for r in v.files(spark).join(F.broadcast(span), (F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
            .select("path").collect()]
    if not near:
        return []
    rows = _rows_of(spark, v, near)
    held = rows.select(v.key_of(rows).alias("k"), F.col("_metadata.file_path").alias("path"))
    return [r.path for r in held.join(keys, "k", "left_semi").select("path").distinct().collect()]


def change(spark: SparkSession, root: str, keys: Callable[[DataFrame], DataFrame] | DataFrame,
           rewrite: Callable[[DataFrame], DataFrame], base: Version | None = None) -> Change:
    """Replace the files that hold ``keys`` by ``rewrite`` of their rows.

    ``keys`` are the keys the change sets, adds or removes (with the key columns), or a function that gives them from
    the table's rows. ``rewrite`` gets all rows of the files that hold any of them and returns what stands in their
    place, with rows of new keys added to it. It must leave rows of other keys as they are. Without a key to change nothing is
    committed. ``base`` is the version that the keys and new values were computed from (default: the newest); a
    version committed since then that changed one of the keys raises ``KeyConflict``.
    """
    v = base or current(spark, root)
    now, key_column = v, StructType([StructField("k", v.key_type())])
    while True:
        kept_keys = f"{root}/_keys/{uuid.uuid4().hex}"
        of = keys(read(spark, root, now)) if callable(keys) else keys
        of.select(v.key_of(of).alias("k")).distinct().write.parquet(kept_keys)
        own = spark.read.schema(key_column).parquet(kept_keys)
        _refuse_shared_keys(spark, v, now, own)
        before = now.files(spark).count()
        if own.isEmpty():
            return Change(now.number, 0, before, 0)
        touched = files_holding(spark, now, own)
        added = spark.createDataFrame(
            _write_files(rewrite(_rows_of(spark, now, touched)).select(*v.schema.names), v, max(1, len(touched))).collect(), v.listing_type())
        gone = spark.createDataFrame([(p,) for p in touched], "path string")
        while True:
            listing = now.files(spark).join(gone, "path", "left_anti").unionByName(added)
            if _commit(spark, v, now.number + 1, listing, kept_keys):
                return Change(now.number + 1, len(touched), before - len(touched), added.count())
            # another writer was first: its keys must be others than these
            later = current(spark, root)
            _refuse_shared_keys(spark, v, later, own)
            still = later.files(spark).join(gone, "path", "left_semi").count() == len(touched)
            now, before = later, later.files(spark).count()
            if not still:
                break  # it rewrote a file that was read here: compute the change from its version


def _refuse_shared_keys(spark: SparkSession, since: Version, until: Version, own: DataFrame) -> None:
    """Fail if a version after ``since``, up to ``until``, changed one of the keys."""
    paths = [at_version(spark, since.root, n).keys for n in range(since.number + 1, until.number + 1)]
    if paths and not own.join(spark.read.schema(own.schema).parquet(*paths), "k", "left_semi").isEmpty():
        raise KeyConflict(f"computed from version {since.number}; version {until.number} holds other changes of some of its keys")
