"""Integrity of copies and shared tables: constraints, vocabularies, counts,
checksums, duplicates, orphans and erasure impact (S10, S11, A1-A5, J5-J7,
A11, U3, M13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.session import checkpoint_dir

# Buckets of the distributed checksum. Fixed, so digests of two copies are
# always comparable; each bucket is a sum, so a bucket never holds rows.
CHECKSUM_BUCKETS = 64


# S10
def check_constraints(df: DataFrame, pk=(), not_null=(), domains: dict | None = None,
                      key_cols=None) -> DataFrame:
    """Violations as (constraint, key, column, value).

    ``key`` identifies the offending row by ``key_cols`` (default: the pk).
    Duplicate keys come from a partially aggregated count (one row per
    offending key, with its multiplicity). Every row-level rule (not null,
    domain) is evaluated in one pass: each row yields an array of its
    violations, filtered and exploded, so the table is read once for all
    rules rather than once per rule.
    """
    key_cols = tuple(key_cols) if key_cols else tuple(pk)
    keytext = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(sx.NULL_MARK)) for k in key_cols]) \
        if key_cols else F.lit(None).cast("string")
    not_null = tuple(not_null) + tuple(k for k in pk if k not in not_null)

    def violation(kind, col, value):
        return F.struct(F.lit(kind).alias("constraint"), F.lit(col).alias("column"),
                        value.cast("string").alias("value"))
    checks = [F.when(F.col(c).isNull(), violation("not_null", c, F.lit(None))) for c in not_null]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), violation("domain", c, F.col(c)))
               for c, allowed in (domains or {}).items()]
    out = None
    if checks:
        out = (df.select(keytext.alias("key"),
                         F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("_v"))
               .select("_v.constraint", "key", "_v.column", "_v.value"))
    if pk:
        dup = (df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
               .select(F.lit("duplicate_key").alias("constraint"), keytext.alias("key"),
                       F.lit(",".join(pk)).alias("column"), F.col("_n").cast("string").alias("value")))
        out = dup if out is None else dup.unionByName(out)
    if out is None:
        raise ValueError("no constraint to check")
    return out


# S11
def vocabulary_profile(df: DataFrame, cols, known: DataFrame) -> DataFrame:
    """Counts of each value of ``cols``, marking values not in ``known``
    (column, value). Reports, never rejects; null is counted as a value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("_kv")).select("_kv.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    k = known.select(F.col("column").alias("_c"), F.col("value").alias("_v")).distinct() \
        .withColumn("_k", F.lit(True))
    # null-safe, since null can be a listed value
    cond = (counts["column"] == k["_c"]) & counts["value"].eqNullSafe(k["_v"])
    return (counts.join(k, cond, "left")
            .select("column", "value", "n", F.coalesce("_k", F.lit(False)).alias("listed")))


# A1
def exact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact ``count(*)`` per table (not a statistics estimate), as (tbl, n)."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# A2
def diff_counts(old: DataFrame, new: DataFrame, key: str = "tbl", n: str = "n") -> DataFrame:
    """Tables whose counts differ, including a table present on one side only."""
    o = old.select(key, F.col(n).alias("old_n"))
    w = new.select(key, F.col(n).alias("new_n"))
    return o.join(w, key, "full_outer").filter(~F.col("old_n").eqNullSafe(F.col("new_n")))


def diff_verdict(diff: DataFrame) -> DataFrame:
    """One row: PASS when no table differs, else FAIL with the count."""
    return diff.agg(F.count(F.lit(1)).alias("differing")).select(
        F.when(F.col("differing") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"), "differing")


# A3
def digest_columns(line: Column) -> list[Column]:
    """The two 64-bit halves of the row's md5, as numbers to be summed."""
    h = F.md5(line)
    return [F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)").alias(f"_h{i}") for i in range(2)]


def _digest() -> Column:
    """The sums of both halves: an order-free digest of all 128 bits."""
    return F.concat_ws(":", *[F.coalesce(F.sum(f"_h{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(2)])


def bucket_of(key: Column, buckets: int = CHECKSUM_BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def bucket_checksums(df: DataFrame, cols, key: str, ts_cols=(), buckets: int = CHECKSUM_BUCKETS,
                     guard=None) -> DataFrame:
    """(bucket, rows, digest) per hash bucket of the key.

    Each row's text is the reference line format (fields joined by '|',
    nulls as ~NULL~, timestamps as UTC text with microseconds); the halves of its
    md5 become numbers and a bucket's digest is their sums. Sums are
    independent of row order and partitioning, and a bucket is one
    partial aggregate, so the work is fully parallel and never gathers rows.
    """
    line = sx.checksum_line(list(cols), tuple(ts_cols), guard)
    return (df.select(bucket_of(F.col(key), buckets).alias("bucket"), *digest_columns(line))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), _digest().alias("digest")))


def table_checksum(df: DataFrame, cols, key: str, ts_cols=(), guard=None) -> DataFrame:
    """One row (rows, digest): the multiset digest of the whole table."""
    line = sx.checksum_line(list(cols), tuple(ts_cols), guard)
    return df.select(*digest_columns(line)).agg(F.count(F.lit(1)).alias("rows"), _digest().alias("digest"))


# A4
def compare_checksums(a: DataFrame, b: DataFrame, cols, key: str, ts_cols=(),
                      buckets: int = CHECKSUM_BUCKETS, guard=None) -> DataFrame:
    """Buckets whose (rows, digest) differ between two copies."""
    ca = bucket_checksums(a, cols, key, ts_cols, buckets, guard).select(
        "bucket", F.col("rows").alias("rows_a"), F.col("digest").alias("digest_a"))
    cb = bucket_checksums(b, cols, key, ts_cols, buckets, guard).select(
        "bucket", F.col("rows").alias("rows_b"), F.col("digest").alias("digest_b"))
    return (ca.join(cb, "bucket", "full_outer")
            .filter(~(F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("digest_a").eqNullSafe(F.col("digest_b")))))


# A5
def duplicate_groups(df: DataFrame, keys) -> DataFrame:
    """Groups on exactly ``keys`` with more than one row, and their size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def suspected_duplicates(df: DataFrame, keys) -> DataFrame:
    """The rows of those groups (semi join back on the keys; null keys never match)."""
    return df.join(duplicate_groups(df, keys).select(*keys), list(keys), "left_semi")


# J5
def new_emails_only(requests: DataFrame, accounts: DataFrame, email_col: str = "target_email") -> DataFrame:
    """Requests whose normalised address is not an account's (lower-case) address."""
    r = requests.withColumn("_e", sx.normalize_email(email_col))
    # accounts reduced to the requested addresses first (broadcastable semi join)
    acct = accounts.select(F.lower("email").alias("_e")).join(r.select("_e").distinct(), "_e", "left_semi")
    return r.join(acct, "_e", "left_anti").drop("_e")


# J6, J7
def orphan_rows(df: DataFrame, owner_col: str, accounts: DataFrame) -> DataFrame:
    """Rows whose owner no longer exists (a null owner is not an orphan)."""
    acct = accounts.select(F.col("user_id").alias(owner_col))
    return df.filter(F.col(owner_col).isNotNull()).join(acct, owner_col, "left_anti")


def orphan_counts(tables: dict[str, tuple[DataFrame, str]], accounts: DataFrame) -> DataFrame:
    """(tbl, column, orphans) per table, unioned."""
    out = None
    for name, (df, col) in sorted(tables.items()):
        part = orphan_rows(df, col, accounts).agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(name).alias("tbl"), F.lit(col).alias("column"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


# A11
def erasure_impact(targets: DataFrame, tables: list[tuple[str, DataFrame, str, str]],
                   target_col: str = "target_id") -> DataFrame:
    """Rows per (table, column, action) that deleting the targets would
    delete (c), null (n), reassign (d) or that would block it (r/a).

    ``tables`` is the foreign-key spec: (name, df, owner column, action).
    The targets are kept once in the shared checkpoint folder; all keys of
    one table are tested in one scan of it.
    """
    effect = {"c": "deleted", "n": "nulled", "d": "reassigned", "r": "blocks", "a": "blocks"}
    checkpoint_dir(targets.sparkSession)
    t = targets.select(F.col(target_col).alias("_t")).filter(F.col("_t").isNotNull()).distinct().checkpoint(eager=True)
    scans: dict[tuple[str, int], tuple[DataFrame, list]] = {}
    for name, df, col, action in tables:
        scans.setdefault((name, id(df)), (df, []))[1].append((col, action))
    out = None
    for (name, _), (df, keys) in scans.items():
        hit = df.select(*dict.fromkeys(col for col, _ in keys))
        for i, (col, _) in enumerate(keys):
            hit = hit.join(t.select(F.col("_t").alias(f"_t{i}")), F.col(col) == F.col(f"_t{i}"), "left")
        found = hit.agg(*[F.count(f"_t{i}").alias(f"_n{i}") for i in range(len(keys))])
        part = found.select(F.inline(F.array(*[F.struct(
            F.lit(name).alias("tbl"), F.lit(col).alias("column"), F.lit(action).alias("action"),
            F.lit(effect[action]).alias("effect"), F.col(f"_n{i}").alias("rows")) for i, (col, action) in enumerate(keys)])))
        out = part if out is None else out.unionByName(part)
    return out


# U3
def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows lost (in a, not b) or added (in b, not a), each once with its number ``n``.

    One pass: rows are tagged +1 (a) / -1 (b) and grouped on every column
    (nulls group together, as in EXCEPT ALL) with map-side partial sums. Two
    ``exceptAll`` calls would scan and shuffle both copies twice.
    """
    cols = a.columns
    tagged = (a.select(*cols, F.lit(1).alias("_n"))
              .unionByName(b.select(*cols, F.lit(-1).alias("_n"))))
    net = tagged.groupBy(*cols).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    return (net.withColumn("side", F.when(F.col("_n") > 0, F.lit("lost")).otherwise(F.lit("added")))
            .withColumn("n", F.abs("_n")).drop("_n"))


# M13
def cleanup_probe(before: DataFrame, during: DataFrame, predicate: Column, cols, key: str, ts_cols=()) -> DataFrame:
    """Remove probe rows by content and prove nothing else changed: one row
    with counts and digests before and after, and ``match``."""
    after = during.filter(~F.coalesce(predicate, F.lit(False)))
    b = table_checksum(before, cols, key, ts_cols)
    a = table_checksum(after, cols, key, ts_cols)
    probes = during.filter(F.coalesce(predicate, F.lit(False))).select(F.count(F.lit(1)))
    out = before.sparkSession.range(1).select(
        b.select("rows").scalar().alias("rows_before"), b.select("digest").scalar().alias("digest_before"),
        probes.scalar().alias("probe_rows"),
        a.select("rows").scalar().alias("rows_after"), a.select("digest").scalar().alias("digest_after"))
    return out.withColumn("match", (F.col("rows_before") == F.col("rows_after"))
                          & (F.col("digest_before") == F.col("digest_after")))
