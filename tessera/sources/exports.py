"""Migration exports and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Schemas that belong to the hosting platform, never copied,
# counted or audited; `pg_` prefixes are excluded as a wildcard.
PLATFORM_SCHEMAS = (
    "auth", "storage", "realtime", "vault", "graphql", "graphql_public", "extensions",
    "pgbouncer", "supabase_functions", "supabase_migrations", "cron", "net",
    "information_schema",
)
PLATFORM_PREFIX = "pg_"


# S6
def filter_user_schemas(tables: DataFrame, schema_col: str = "schemaname") -> DataFrame:
    """Drop platform schemas (one list for dumps, counts and audits)."""
    s = F.col(schema_col)
    return tables.filter(~s.isin(*PLATFORM_SCHEMAS) & ~s.startswith(PLATFORM_PREFIX))


# S7
def export_account_list(accounts: DataFrame) -> DataFrame:
    """One line per account: `email  (created D, last sign-in D|never)`, by created_at."""
    line = F.concat(F.col("email"), F.lit("  (created "), F.col("created_at").cast("date").cast("string"),
                    F.lit(", last sign-in "),
                    F.coalesce(F.col("last_sign_in_at").cast("date").cast("string"), F.lit("never")), F.lit(")"))
    return accounts.select(line.alias("value"), "created_at").orderBy(
        F.col("created_at").asc_nulls_last(), "value").select("value")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").text(path)


# S8
def export_counts(counts: DataFrame, path: str) -> None:
    """Counts as CSV (exact counts from A1, not statistics estimates)."""
    counts.orderBy(F.col("tbl").asc_nulls_last()).write.mode("errorifexists").option("header", True).csv(path)


def schema_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, position, column, type, nullable, rows, filled) for every column of every table.

    ``filled`` counts the rows whose value isn't null, in one aggregate per table, so that the inventories of two copies
    tell a column that arrived empty from one that arrived.
    """
    out = None
    for name, df in sorted(tables.items()):
        held = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
        each = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                         F.lit(f.nullable).alias("nullable"), F.col("rows"), F.col(f"_n{i}").alias("filled"))
                for i, f in enumerate(df.schema.fields)]
        part = held.select(F.lit(name).alias("tbl"), F.inline(F.array(*each)))
        out = part if out is None else out.unionByName(part)
    return out
