"""Hash trees over tables: which keys differ between two copies, read from the differing branches only (A3, A4).

Every row's line (the format of A3) gets a SHA-256 digest; the digest's first hexadecimal digits are the
row's leaf, so leaves are even whatever the keys are, and rows of one hot key are spread. A leaf's digest is
that of its sorted row digests with their numbers, a node's that of its sixteen children. Unlike a sum of row
hashes, no set of made-up rows can keep a digest as it was. The tree and the row digests are written once per copy; a
comparison starts at the two roots and follows the nodes that differ, and opens only those files of the
row digests that hold a differing leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.session import checkpoint_dir
from tessera.sources.publish import list_names, scratch_path

DIGITS = 5  # of a leaf's name: about a million leaves. A leaf is one aggregate of its rows' digests
COARSE = 3  # digits by which files are looked up
ROW = "row string, key string, n long"
NODE = "prefix string, rows long, digest string"
FILE = "path string, low string, high string"


def _combined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ","), 256)


def build(df: DataFrame, path: str, cols, key: str, ts_cols=(), digits: int = DIGITS, ranges: int | None = None) -> None:
    """Write the tree of ``df`` below ``path``: ``rows`` (in order of their digest), ``files`` and ``nodes/<level>``.

    Null fields count as ``~NULL~``, a null key as one key; equal rows are one with their number. An empty table has a root
    without rows. ``ranges`` is the number of files of row digests (default: the shuffle partitions).
    """
    spark = df.sparkSession
    line = sx.checksum_line(list(cols), tuple(ts_cols))
    rows = (df.select(F.sha2(line, 256).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit(sx.NULL_MARK)).alias("key"))
            .groupBy("row", "key").agg(F.count(F.lit(1)).alias("n")))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "row").sortWithinPartitions("row").write.parquet(f"{path}/rows")
    kept = spark.read.schema(ROW).parquet(f"{path}/rows")
    (kept.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("row").alias("low"), F.max("row").alias("high"))
     .write.parquet(f"{path}/files"))
    nodes = kept.groupBy(F.substring("row", 1, digits).alias("prefix")).agg(
        F.sum("n").alias("rows"), _combined(F.concat_ws(":", "row", "key", "n")).alias("digest"))
    for level in range(digits, -1, -1):
        nodes.write.parquet(f"{path}/nodes/{level}")
        done = spark.read.schema(NODE).parquet(f"{path}/nodes/{level}")
        nodes = done.groupBy(F.substring("prefix", 1, max(0, level - 1)).alias("prefix")).agg(
            F.sum("rows").alias("rows"), _combined(F.concat_ws(":", "prefix", "digest")).alias("digest"))


def _nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(NODE).parquet(f"{path}/nodes/{level}")


def root(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(rows, digest) of the whole table; the digest is null for an empty one."""
    found = _nodes(spark, path, 0).first()
    return (found.rows, found.digest) if found else (0, None)


def depth(spark: SparkSession, path: str) -> int:
    return max(int(n) for n in list_names(spark, f"{path}/nodes"))


def differing_leaves(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(prefix): the leaves whose digests differ, found level by level from the roots.

    Of every level only children of differing nodes are compared; each level's result is written to the shared folder.
    """
    digits = depth(spark, a)
    if depth(spark, b) != digits:
        raise ValueError("the two trees have different depths")
    checkpoint_dir(spark)
    found = spark.createDataFrame([("",)] if root(spark, a) != root(spark, b) else [], "prefix string")
    for level in range(1, digits + 1):
        above = found.withColumnRenamed("prefix", "parent")
        one, two = (_nodes(spark, path, level).withColumn("parent", F.substring("prefix", 1, level - 1))
                    .join(above, "parent", "left_semi").select("prefix", F.struct("rows", "digest").alias(name))
                    for path, name in ((a, "one"), (b, "two")))
        path = scratch_path(spark, "hashtree")
        one.join(two, "prefix", "full_outer").where("not one <=> two").select("prefix").write.parquet(path)
        found = spark.read.schema("prefix string").parquet(path)
    return found


def _coarse(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, min(COARSE, digits)), 16, 10).cast("int")


def files_of(spark: SparkSession, path: str, leaves: DataFrame) -> list[str]:
    """The files of row digests that may hold a row of the leaves."""
    digits = depth(spark, path)
    files = spark.read.schema(FILE).parquet(f"{path}/files")
    covered = files.select("path", F.explode(F.sequence(_coarse(F.col("low"), digits), _coarse(F.col("high"), digits))).alias("at"))
    wanted = leaves.select(_coarse(F.col("prefix"), digits).alias("at")).distinct()
    return [r.path for r in covered.join(wanted, "at", "left_semi").select("path").distinct().collect()]


def differing_keys(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(key, state, rows_a, rows_b): the keys whose rows differ between the trees at ``a`` and ``b``.

    state is ``lost`` (rows of the key only in a differ), ``added`` (only in b) or ``changed``; the numbers are those of rows
    that the other copy hasn't. Equal copies are told by their roots alone.
    """
    digits = depth(spark, a)
    leaves = differing_leaves(spark, a, b)

    def rows_of(path: str, name: str) -> DataFrame:
        paths = files_of(spark, path, leaves)
        rows = spark.read.schema(ROW).parquet(*paths) if paths else spark.createDataFrame([], ROW)
        return (rows.withColumn("prefix", F.substring("row", 1, digits)).join(leaves, "prefix", "left_semi")
                .select("row", "key", F.col("n").alias(name)))
    both = rows_of(a, "n_a").join(rows_of(b, "n_b"), ["row", "key"], "full_outer")
    more = F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))
    out = both.groupBy("key").agg(F.sum(F.greatest(more, F.lit(0))).alias("rows_a"), F.sum(F.greatest(-more, F.lit(0))).alias("rows_b"))
    return out.where("rows_a + rows_b > 0").select("key", F.when(F.col("rows_b") == 0, "lost").when(F.col("rows_a") == 0, "added")
                                                   .otherwise("changed").alias("state"), "rows_a", "rows_b")


def compare(a: DataFrame, b: DataFrame, cols, key: str, ts_cols=(), digits: int = DIGITS) -> DataFrame:
    """``differing_keys`` of two tables whose trees are built for it in the shared folder."""
    spark = a.sparkSession
    base = scratch_path(spark, "trees")
    for df, name in ((a, "a"), (b, "b")):
        build(df, f"{base}/{name}", cols, key, ts_cols, digits)
    return differing_keys(spark, f"{base}/a", f"{base}/b")
