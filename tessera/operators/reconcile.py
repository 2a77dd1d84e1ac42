"""Row differences of two large copies that differ little, by invertible Bloom lookup tables.

Every row is summed into three cells of its bucket's table, rows of the first copy with +1, of the second with -1, as
number, digest and check value. Rows that both copies have cancel out, so only sums are shuffled, and what is left
in the cells are the differing rows: a cell with one kind of row tells that row's digest, which is
taken out of its other cells, and so on. The rows with those digests are then read from the copies and
compared exactly. A bucket with more differences than its table can tell is compared row by row.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import integrity as ig
from tessera.session import checkpoint_dir
from tessera.sources.publish import scratch_path

BUCKETS = 1024
CELLS = 48  # of each of a bucket's three parts; together they tell about a hundred different rows
PARTS = 3
_SUMS = ("n", "a_hi", "a_lo", "b_hi", "b_lo", "check")


def _digests(df: DataFrame) -> DataFrame:
    """``df`` with two 64-bit digests of the row; nulls count by their place."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in cols]
    return df.withColumns({"_a": F.xxhash64(*cols, *nulls), "_b": F.xxhash64(F.lit("b"), *nulls, *cols)})


def _bucket(buckets: int) -> Column:
    return F.pmod("_a", F.lit(buckets)).cast("int")


def _cells(cells: int) -> list[Column]:
    return [F.pmod(F.shiftright("_b", 21 * i), F.lit(cells)).cast("int") + i * cells for i in range(PARTS)]


def sketch(df: DataFrame, sign: int, buckets: int = BUCKETS, cells: int = CELLS) -> DataFrame:
    """(bucket, cell, sums): the signed rows of one copy in each cell, before the other's are added."""
    low = F.lit(0xFFFFFFFF).cast("long")

    def half(name: str, shift: int) -> Column:
        return F.shiftright(name, shift).bitwiseAND(low)
    # the check is no linear function of the digests: sums of several rows don't pass for one
    check = F.crc32(F.encode(F.concat_ws("|", F.hex("_a"), F.hex("_b")), "UTF-8"))
    rows = _digests(df).select(_bucket(buckets).alias("bucket"), F.lit(1).cast("long").alias("n"), half("_a", 32).alias("a_hi"), half("_a", 0).alias("a_lo"),
                               half("_b", 32).alias("b_hi"), half("_b", 0).alias("b_lo"), check.alias("check"),
                               F.explode(F.array(*_cells(cells))).alias("cell"))
    return rows.select("bucket", "cell", *[(F.col(c) * sign).alias(c) for c in _SUMS])


def _signed(hi: int, lo: int) -> int:
    v = hi << 32 | lo
    return v - (1 << 64) if v >> 63 else v


def decode(cells: dict[int, list[int]], bucket: int, buckets: int, width: int) -> tuple[list[tuple[int, int, int]], bool]:
    """([(a, b, n)], whether all cells came to nothing): the rows left in a bucket's cells, as digests and numbers."""
    found, todo = [], list(cells)
    while todo:
        at = todo.pop()
        sums = cells.get(at)
        if sums is None or sums[0] == 0:
            continue
        n = sums[0]
        if any(v % n for v in sums[1:]):
            continue
        a_hi, a_lo, b_hi, b_lo, check = (v // n for v in sums[1:])
        if not all(0 <= v < 1 << 32 for v in (a_hi, a_lo, b_hi, b_lo)):
            continue
        a, b = _signed(a_hi, a_lo), _signed(b_hi, b_lo)
        places = [(b >> 21 * i) % width + i * width for i in range(PARTS)]
        if at not in places or a % buckets != bucket or check != zlib.crc32(f"{a_hi << 32 | a_lo:X}|{b_hi << 32 | b_lo:X}".encode()):
            continue
        found.append((a, b, n))
        for p in places:
            held = cells.setdefault(p, [0] * len(_SUMS))
            for i, v in enumerate((n, a_hi * n, a_lo * n, b_hi * n, b_lo * n, check * n)):
                held[i] -= v
            todo.append(p)
    return found, not any(any(v) for v in cells.values())


def reconcile(a: DataFrame, b: DataFrame, buckets: int = BUCKETS, cells: int = CELLS) -> DataFrame:
    """``integrity.row_diff`` of two copies: rows lost (in a, not b) or added, each once with its number ``n``.

    Both copies are read twice, for the sums and for the rows that differ. What is shuffled are sums, at most buckets x 3 x cells of
    each task, and the differing rows with those of buckets that hold too many. The digests found are no more than the cells.
    """
    spark = a.sparkSession
    b = b.select(*a.columns)
    sums = (sketch(a, 1, buckets, cells).unionByName(sketch(b, -1, buckets, cells)).groupBy("bucket", "cell")
            .agg(*[F.sum(c).alias(c) for c in _SUMS]).where(" or ".join(f"{c} <> 0" for c in _SUMS)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        held = {int(cell): [int(v) for v in values] for cell, *values in group[["cell", *_SUMS]].itertuples(index=False, name=None)}
        found, whole = decode(held, bucket, buckets, cells)
        out = [(bucket, x, y) for x, y, _ in found] if whole else [(bucket, None, None)]
        return pd.DataFrame(out, columns=["bucket", "a", "b"]).astype({"a": "Int64", "b": "Int64"})
    checkpoint_dir(spark)
    path = scratch_path(spark, "reconcile")
    sums.groupBy("bucket").applyInPandas(run, "bucket int, a long, b long").write.parquet(path)
    differing = spark.read.schema("bucket int, a long, b long").parquet(path)
    rows, full = differing.where("a is not null"), differing.where("a is null").select("bucket")

    def chosen(df: DataFrame) -> DataFrame:
        known = _digests(df).withColumn("_bucket", _bucket(buckets))
        one = known.join(F.broadcast(rows.select(F.col("a").alias("_a"), F.col("b").alias("_b"))), ["_a", "_b"], "left_semi")
        many = known.join(F.broadcast(full.select(F.col("bucket").alias("_bucket"))), "_bucket", "left_semi")
        return one.select(*df.columns).unionByName(many.select(*df.columns))
    return ig.row_diff(chosen(a), chosen(b))
