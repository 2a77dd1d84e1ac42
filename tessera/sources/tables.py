"""Reads, paged exports and page reads.

Pages are the reference's transport (a REST API capped at 1,000 rows). Here
they are only an interchange format; everything else moves as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.session import checkpoint_dir

PAGE_SIZE = 1000


# S1
def read_table(spark: SparkSession, path: str, columns=None, where=None, fmt: str = "parquet") -> DataFrame:
    """Named-column read. Selecting the columns (and filtering) right after the
    scan lets Catalyst prune the columns it reads and push the filter into
    the Parquet reader (see ``ReadSchema`` / ``PushedFilters`` in explain)."""
    df = spark.read.format(fmt).load(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


# O2 ---------------------------------------------------------------------------

def page(df: DataFrame, key: str, size: int = PAGE_SIZE, after=None) -> DataFrame:
    """One stable page: rows with key > ``after`` in key order, at most ``size``.

    Keyset paging (never a deep offset): the filter is pushed to the scan and
    the ordered limit is a distributed top-k.
    """
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(F.col(key).asc_nulls_last()).limit(size)


def page_numbers(df: DataFrame, key: str, size: int = PAGE_SIZE, partitions: int | None = None) -> DataFrame:
    """Assign ``_page`` = rank-by-key // size without a single-partition window.

    Rows are range-partitioned by the key and sorted within each range, where the low
    bits of ``monotonically_increasing_id`` are a row's position and the high bits its
    range. Per-range counts (one small row each) give prefix offsets, which are
    joined back by broadcast (one row per range: bounded by the partition count).
    A distributed zipWithIndex with one shuffle.
    """
    spark = df.sparkSession
    # as many ranges as the cluster's shuffle width: each range is one sort
    n = partitions or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions")))
    mid = F.monotonically_increasing_id()
    # Range bounds come from a sample: materialise once (reliable checkpoint in
    # the shared checkpoint folder) so the counts and the rows agree.
    checkpoint_dir(spark)
    local = (df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_mid", mid).checkpoint(eager=True)
             .withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_i", F.col("_mid") - F.shiftleft("_pid", 33)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn("_page", F.floor((F.col("_off") + F.col("_i")) / size).cast("long"))
            .drop("_mid", "_pid", "_i", "_off"))


def export_pages(df: DataFrame, key: str, path: str, size: int = PAGE_SIZE, files: int | None = None) -> None:
    """Write ``df`` as pages of ``size`` rows ordered by ``key``, one page per
    line: ``{"page": n, "rows": [...]}`` (JSON Lines; null fields kept).

    A page is one group of at most ``size`` rows. Pages are range-partitioned
    by number into ``files`` files (default: the shuffle partition count)
    and sorted within each, so the files hold consecutive pages in order and
    their number does not grow with the row count.
    """
    cols = df.columns
    numbered = page_numbers(df, key, size)
    row_json = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    pages = (numbered.groupBy("_page")
             .agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), row_json.alias("_j")))).alias("_rows"))
             .select("_page", F.concat(F.lit('{"page":'), F.col("_page").cast("string"), F.lit(',"rows":['),
                                       F.array_join(F.transform("_rows", lambda r: r["_j"]), ","),
                                       F.lit("]}")).alias("value")))
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (pages.repartitionByRange(n, "_page").sortWithinPartitions("_page").select("value")
     .write.mode("errorifexists").text(path))


def read_pages(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of pages written by ``export_pages``, with their ``_page`` number.

    A line whose ``rows`` is not a JSON array is an error (checked on the
    text first, as a lone object would otherwise parse as one row).
    """
    bad = (spark.read.text(path)
           .filter(~F.coalesce(F.ltrim(F.get_json_object("value", "$.rows")).startswith("["), F.lit(False)))
           .limit(1).collect())
    if bad:
        raise ValueError(f"unexpected page (rows is not a JSON array): {bad[0]['value'][:200]}")
    env = StructType([StructField("page", LongType()), StructField("rows", ArrayType(schema))])
    pages = spark.read.schema(env).option("mode", "FAILFAST").json(path)
    return pages.select(F.col("page").alias("_page"), F.explode("rows").alias("_r")).select("_page", "_r.*")


def page_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(page, rows) for exported pages, without parsing the rows."""
    return spark.read.text(path).select(F.get_json_object("value", "$.page").cast("long").alias("page"),
                                        F.json_array_length(F.get_json_object("value", "$.rows")).alias("rows"))


def read_paged_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Union of page files that each hold one JSON array (as a paging REST client saves them), with
    a ``_page_file`` column.

    Each page is read once, as a whole (a response is at most a page of rows): a page that is not a JSON array,
    or not JSON, fails the whole read and so whatever would be written from it. A lone object would parse as one row, and
    columns that aren't asked for aren't parsed, so a filter that no pruning removes looks at every page as an array.
    A file without a byte is no page and is left out, as Spark does with empty files.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    pages = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("_page_file"), "value"))
    refused = F.raise_error(F.concat(F.lit("unexpected response page (not a JSON array): "), "_page_file")).cast("boolean")
    arrays = pages.filter(F.when(F.json_array_length("value").isNotNull(), F.lit(True)).otherwise(refused))
    rows = arrays.select("_page_file", F.explode(F.from_json("value", ArrayType(kind), {"mode": "FAILFAST"})).alias("_row"))
    return rows.select("_row.*", "_page_file")


def page_report(pages: DataFrame) -> DataFrame:
    """Rows per page file, as the export loop printed them."""
    return pages.groupBy("_page_file").agg(F.count(F.lit(1)).alias("rows"))


def columns_seen(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first row of the first page (column names are read from
    the first row only). Works for both page layouts."""
    txt = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("v"), F.input_file_name().alias("f"))
    first_row = F.when(F.col("v").startswith("["), F.get_json_object("v", "$[0]")) \
        .otherwise(F.get_json_object(F.substring_index("v", "\n", 1), "$.rows[0]"))
    first = (txt.select(F.when(F.col("v").startswith("["), F.lit(-1))
                        .otherwise(F.get_json_object(F.substring_index("v", "\n", 1), "$.page").cast("long"))
                        .alias("p"), "f", first_row.alias("r"))
             .orderBy("p", "f").limit(1).select(F.json_object_keys("r").alias("k")).collect())
    return sorted(first[0]["k"]) if first and first[0]["k"] else []


# O3
def row_existence(df: DataFrame) -> DataFrame:
    """(has_rows, row_count): the cheap existence probe and the exact count."""
    return df.select(F.count(F.lit(1)).alias("row_count")).select(
        (F.col("row_count") > 0).alias("has_rows"), "row_count")
