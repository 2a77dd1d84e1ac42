"""Versioned table directories with a manifest committed last.

Spark file tables cannot be overwritten while being read and have no MERGE.
A change is therefore written as a new version directory; a manifest naming
the versions of every table in the change is written after all data. Readers
resolve the newest manifest, so they see all of a change or none of it, and a
failed or lost writer leaves only unreferenced directories behind.

A manifest is one file, written whole under another name and then given the name of its
version by an operation that fails where that name exists: a hard link on a local file
system, a rename elsewhere (HDFS refuses to rename onto a file). So of several writers of one version exactly
one commits, and nobody reads a part of a manifest. An object store whose rename replaces
files gives no such promise; there one writer at a time must be arranged outside.

All IO goes through Spark and the Hadoop FileSystem, so the same code works
on a local folder, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def _manifest_versions(spark: SparkSession, folder: str) -> list[int]:
    names = list_names(spark, folder)
    return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    src = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
    finally:
        src.close()


def claim(spark: SparkSession, written: str, name: str) -> bool:
    """Give a written file the ``name``, unless a file has it; of several callers one succeeds."""
    fs, source = _fs(spark, written)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(name)
    if fs.getScheme() != "file":
        return bool(fs.rename(source, target))
    link, held = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, source))
    try:
        jvm.java.nio.file.Files.createLink(link, held)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def commit_manifest(spark: SparkSession, folder: str, manifest: dict) -> bool:
    """Make ``manifest`` the one of its version in ``folder``; False where another already is."""
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps(manifest))
    try:
        return claim(spark, draft, f"{folder}/v={manifest['version']}.json")
    finally:
        remove(spark, draft)


def newest_manifest(spark: SparkSession, folder: str) -> dict | None:
    versions = _manifest_versions(spark, folder)
    return json.loads(read_text(spark, f"{folder}/v={versions[-1]}.json")) if versions else None


def rename_into(spark: SparkSession, folder: str, target: str) -> None:
    """Move the data files of a folder into another, under names of their own."""
    fs, p = _fs(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(target))
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), path(f"{target}/{uuid.uuid4().hex[:8]}-{name}"))


class StaleVersion(RuntimeError):
    """The tables were published anew after the version that a change was computed from."""


class WrongCount(ValueError):
    """A written table hasn't the number of rows it must have."""


def current_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest committed manifest: {version, tables: {name: data path}, notes}."""
    return newest_manifest(spark, f"{root}/_manifests")


def current_version(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 before the first."""
    return (current_manifest(spark, root) or {"version": 0})["version"]


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(tables: dict[str, DataFrame], root: str, base_version: int | None = None,
            expected_rows: dict[str, int] | None = None, notes: dict | None = None) -> dict:
    """Write each table to a new version directory, then the manifest.

    Nothing is visible until the manifest is committed; it keeps the unchanged tables
    of the version before. With ``base_version``, the version that the change was computed
    from, a newer one refuses the change, also one that another writer commits
    while this one writes its tables; what was written then goes. Without it, the
    tables replace whatever is published when they are ready. With ``expected_rows``, rows are
    counted as they are written, and a table with another number refuses the whole
    change. ``notes`` are kept in the manifest; ``rows`` in the result has the counted numbers.
    """
    spark = next(iter(tables.values())).sparkSession
    prev = current_manifest(spark, root) or {"version": 0}
    if base_version is not None and prev["version"] != base_version:
        raise StaleVersion(f"computed from version {base_version}; version {prev['version']} is published")
    written: dict[str, str] = {}
    rows: dict[str, int] = {}
    for name, df in tables.items():
        written[name] = f"{root}/{name}/v={prev['version'] + 1}-{uuid.uuid4().hex[:8]}"
        seen = Observation(f"publish-{uuid.uuid4().hex}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(written[name])
        rows[name] = seen.get["rows"]
    wrong = {n: (rows[n], want) for n, want in (expected_rows or {}).items() if rows[n] != want}
    if wrong:
        for path in written.values():
            remove(spark, path)
        raise WrongCount("nothing published: " + ", ".join(f"{n} has {got} rows, not {want}" for n, (got, want) in wrong.items()))
    while True:
        manifest = {"version": prev["version"] + 1, "tables": prev.get("tables", {}) | written, "notes": notes or {}}
        if commit_manifest(spark, f"{root}/_manifests", manifest):
            return manifest | {"rows": rows}
        prev = current_manifest(spark, root)
        if base_version is not None:
            for path in written.values():
                remove(spark, path)
            raise StaleVersion(f"computed from version {base_version}; version {prev['version']} was published meanwhile")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a table as of the newest committed manifest."""
    m = current_manifest(spark, root)
    if not m or name not in m["tables"]:
        raise FileNotFoundError(f"no published table {name} under {root}")
    return spark.read.parquet(m["tables"][name])


# S3
def import_into_empty(df: DataFrame, root: str, name: str, expected_rows: int | None = None) -> DataFrame:
    """Refuse when the target already has rows; otherwise write, publish, and
    verify the count afterwards. Files follow the input's partitions.

    Returns one row (expected, written, ok): the rows counted while they were
    written and those that a reader of the published table finds.
    """
    spark = df.sparkSession
    m = current_manifest(spark, root)
    if m and name in m["tables"] and spark.read.parquet(m["tables"][name]).limit(1).count():
        raise ValueError(f"{name} has rows; an import needs an empty table")
    done = publish({name: df}, root, base_version=m["version"] if m else 0,
                   expected_rows=None if expected_rows is None else {name: expected_rows})
    return (read_published(spark, root, name)
            .agg(F.lit(done["rows"][name]).cast("long").alias("expected"), F.count(F.lit(1)).alias("written"))
            .withColumn("ok", F.col("expected") == F.col("written")))


# S4
def guarded_copy(src: DataFrame, root: str, name: str, expected_rows: int) -> DataFrame:
    """Copy only if the source has exactly ``expected_rows`` rows and the target
    is empty; values (nulls, ids) are written unchanged. The source is read once:
    its rows are counted while they are written, before anything is visible."""
    return import_into_empty(src, root, name, expected_rows)


# S5
def copy_tables(tables: dict[str, DataFrame], root: str) -> dict:
    """Copy every selected table and publish them together (all or nothing)."""
    return publish(tables, root)
