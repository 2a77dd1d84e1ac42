"""Audits over catalog snapshots (C1-C9) and foreign-key impact.

Inputs are exported snapshot tables, so any warehouse can be audited:

* relations: relname, relkind (r, p, v, m), relrowsecurity, security_invoker
  (option text or null), anon_can_read, optionally owner
* policies: tablename, policyname, cmd, qual, with_check, optionally roles
* functions: proname, prosecdef, anon_execute, proconfig (array), optionally args
* foreign keys: conrelid, confrelid, conkey (array) or conkey_csv, confdeltype
* columns: conrelid, attnum, attname

All may have ``schemaname``; the checks then look at one schema (``public``
unless told otherwise, None for all) and names meet only within a schema.

Each check is a filter/projection: one scan of the snapshot, no shuffle
except the anti/semi joins of C6/J9, which run on keys. Listings sort once, at
the end; the combined audit doesn't sort.
"""

from __future__ import annotations

from pyspark.errors import PySparkException, UnknownException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.session import checkpoint_dir

# Option values that make a view defer to its caller, the
# owner-column names checked by J9, and the text per foreign-key action.
INVOKER_ON = ("true", "on")
OWNER_COLUMNS = ("user_id", "owner_id", "created_by", "granted_by")
FK_ACTION_TEXT = {
    "c": "CASCADE — these rows are DELETED with the account",
    "n": "SET NULL — these rows survive, owned by nobody",
    "d": "SET DEFAULT — these rows survive, reassigned",
    "r": "RESTRICT — the deletion FAILS while rows exist",
    "a": "NO ACTION — the deletion FAILS while rows exist",
}
PUBLIC = "public"
WHY_RLS_OFF = "table with RLS disabled"
WHY_VIEW = "view without security_invoker"
WHY_ANON = "callable by anon"
WHY_PATH = "search_path not pinned"


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def bypasses(rel_invoker: Column) -> Column:
    """A view reads with its owner's rights unless security_invoker is true/on."""
    return ~F.coalesce(rel_invoker, F.lit("false")).isin(*INVOKER_ON)


def scoped(df: DataFrame, schema: str | None) -> DataFrame:
    """The rows of one schema; all rows of a snapshot without schemas or for None."""
    return df if schema is None or "schemaname" not in df.columns else df.filter(F.col("schemaname") == schema)


def _schema_key(*dfs: DataFrame) -> list[str]:
    return ["schemaname"] if all("schemaname" in d.columns for d in dfs) else []


# C1
def _rls_off(relations: DataFrame) -> DataFrame:
    return relations.filter((F.col("relkind") == "r") & ~F.col("relrowsecurity")).select(
        F.col("relname").alias("table_without_rls"))


def tables_without_rls(relations: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    """Plain tables with row security off (partitioned `p` tables are not
    checked, as in the original audit)."""
    return _rls_off(scoped(relations, schema)).orderBy(*sx.ordered("table_without_rls"))


# C2
def _open_policies(policies: DataFrame, strict: bool = False) -> DataFrame:
    q, w = F.col("qual"), F.col("with_check")
    cond = ((F.coalesce(q, w, F.lit("true")) == "true")
            | F.concat(F.coalesce(q, F.lit("")), F.coalesce(w, F.lit(""))).contains("auth.role()"))
    if strict:
        cond = cond | (w == "true") | (F.coalesce(q, F.lit("true")) == "true")
    return policies.filter(cond).select("tablename", "policyname", "cmd", F.coalesce(q, w).alias("expr"))


def open_policies(policies: DataFrame, strict: bool = False, schema: str | None = PUBLIC) -> DataFrame:
    """Policies open to every signed-in account.

    Default: both expressions absent or the effective one literally `true`,
    or either mentions `auth.role()`. ``strict`` also flags a policy whose
    with_check alone is `true` behind a restricted qual.
    """
    return _open_policies(scoped(policies, schema), strict).orderBy(*sx.ordered("tablename", "policyname"))


# C3
def _bypassing(relations: DataFrame) -> DataFrame:
    return (relations.filter(F.col("relkind").isin("v", "m") & bypasses(F.col("security_invoker")))
            .select(F.col("relname").alias("view_bypassing_rls"), _opt(relations, "owner").alias("owner")))


def bypassing_views(relations: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    return _bypassing(scoped(relations, schema)).orderBy(*sx.ordered("view_bypassing_rls"))


# C4
def _anon_unprotected(relations: DataFrame) -> DataFrame:
    rls_off = (F.col("relkind") == "r") & ~F.col("relrowsecurity")
    view_open = F.col("relkind").isin("v", "m") & bypasses(F.col("security_invoker"))
    return (relations.filter(F.col("anon_can_read") & (rls_off | view_open))
            .select(F.col("relname").alias("unprotected_and_readable_by_anon"),
                    F.when(F.col("relkind") == "r", F.lit(WHY_RLS_OFF)).otherwise(F.lit(WHY_VIEW)).alias("why")))


def anon_unprotected(relations: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    """Readable by anon with nothing behind the grant, and why."""
    return _anon_unprotected(scoped(relations, schema)).orderBy(*sx.ordered("unprotected_and_readable_by_anon"))


# C5
def _unsafe_definers(functions: DataFrame) -> DataFrame:
    pinned = F.exists(F.coalesce("proconfig", F.array().cast("array<string>")),
                      lambda c: c.startswith("search_path="))
    return (functions.filter(F.col("prosecdef") & (F.col("anon_execute") | ~pinned))
            .select(F.col("proname").alias("definer_function"), _opt(functions, "args").alias("args"),
                    F.when(F.col("anon_execute"), F.lit(WHY_ANON)).otherwise(F.lit(WHY_PATH)).alias("why")))


def unsafe_definer_functions(functions: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    """Definer functions callable by anon or without a pinned search_path;
    the anon reason wins when both apply."""
    return _unsafe_definers(scoped(functions, schema)).orderBy(*sx.ordered("definer_function"))


# C6
def _definers(functions: DataFrame) -> DataFrame:
    return functions.filter(F.col("prosecdef")).select(
        "proname", _opt(functions, "args").alias("args"), F.array_join("proconfig", ", ").alias("config"))


def definer_listing(functions: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    return _definers(scoped(functions, schema)).orderBy(*sx.ordered("proname"))


def unexpected_definers(functions: DataFrame, expected: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    """Definer functions not on the expected list (column ``proname``)."""
    return (_definers(scoped(functions, schema)).join(expected.select("proname"), "proname", "left_anti")
            .orderBy(*sx.ordered("proname")))


# C7
def view_listing(relations: DataFrame, schema: str | None = PUBLIC) -> DataFrame:
    rel = scoped(relations, schema)
    return (rel.filter(F.col("relkind").isin("v", "m"))
            .select("relname", F.coalesce("security_invoker", F.lit("NOT SET")).alias("invoker"),
                    "anon_can_read", _opt(rel, "owner").alias("owner"))
            .orderBy(*sx.ordered("relname")))


# C8
def policy_listing(policies: DataFrame) -> DataFrame:
    """Policies of all schemas, with their schema."""
    return (policies.select(_opt(policies, "schemaname").alias("schemaname"), "tablename",
                            "policyname", "cmd", _opt(policies, "roles").alias("roles"))
            .orderBy(*sx.ordered("schemaname", "tablename", "policyname")))


# C9
def run_audit(relations: DataFrame, policies: DataFrame, functions: DataFrame,
              schema: str | None = PUBLIC) -> DataFrame:
    """All five checks as (check, object, reason); the audit passes when empty.

    Each check runs by itself and its (few) findings are kept in the shared
    checkpoint folder: one that fails, be it at analysis (a missing snapshot column) or
    while it runs, is reported as a row and hides no other.
    """
    rel, pol, fns = scoped(relations, schema), scoped(policies, schema), scoped(functions, schema)
    builders = [
        ("tables_without_rls", lambda: _rls_off(rel)
         .select(F.col("table_without_rls").alias("object"), F.lit(WHY_RLS_OFF).alias("reason"))),
        ("open_policies", lambda: _open_policies(pol)
         .select(F.concat_ws(".", "tablename", "policyname").alias("object"),
                 F.coalesce("expr", F.lit("true")).alias("reason"))),
        ("bypassing_views", lambda: _bypassing(rel)
         .select(F.col("view_bypassing_rls").alias("object"), F.lit(WHY_VIEW).alias("reason"))),
        ("anon_unprotected", lambda: _anon_unprotected(rel)
         .select(F.col("unprotected_and_readable_by_anon").alias("object"), F.col("why").alias("reason"))),
        ("unsafe_definer_functions", lambda: _unsafe_definers(fns)
         .select(F.col("definer_function").alias("object"), F.col("why").alias("reason"))),
    ]
    spark = relations.sparkSession
    checkpoint_dir(spark)
    out = None
    for name, build in builders:
        try:
            part = build().select(F.lit(name).alias("check"), "object", "reason").checkpoint(eager=True)
        except PySparkException as e:  # a broken check must not hide the others; a lost cluster is no broken check
            if isinstance(e, UnknownException):
                raise
            part = spark.range(1).select(F.lit(name).alias("check"), F.lit(None).cast("string").alias("object"),
                                         F.lit(f"check failed: {type(e).__name__}").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def with_conkey(fks: DataFrame) -> DataFrame:
    if "conkey" in fks.columns:
        return fks
    return fks.withColumn("conkey", F.transform(F.split("conkey_csv", ","), lambda x: x.cast("int")))


# J8
def fk_effects(fks: DataFrame, columns: DataFrame, target: str) -> DataFrame:
    """One row per foreign-key column pointing at ``target`` with what a
    deletion there does to it, in every schema."""
    f = with_conkey(fks).filter(F.col("confrelid") == target)
    scope = _schema_key(fks, columns)
    ex = f.select(*scope, "conrelid", "confdeltype", F.posexplode("conkey").alias("ord", "attnum"))
    action = F.coalesce(*[F.when(F.col("confdeltype") == k, F.lit(v)) for k, v in FK_ACTION_TEXT.items()])
    return (ex.join(columns.select(*scope, "conrelid", "attnum", "attname"), [*scope, "conrelid", "attnum"])
            .select(*scope, F.col("conrelid").alias("referencing_table"), F.col("attname").alias("column_name"),
                    action.alias("what_happens"))
            .orderBy(*sx.ordered(*scope, "referencing_table", "column_name")))


# J9
def unlinked_owner_columns(columns: DataFrame, fks: DataFrame, relations: DataFrame | None,
                           target: str, schema: str | None = PUBLIC) -> DataFrame:
    """Owner-like columns of plain tables that no foreign key to ``target`` covers:
    their rows would survive (orphaned) when the owner is deleted."""
    cols = scoped(columns, schema).filter(F.col("attname").isin(*OWNER_COLUMNS))
    if relations is not None:
        scope = _schema_key(columns, relations)
        plain = relations.filter(F.col("relkind") == "r").select(*scope, F.col("relname").alias("conrelid"))
        cols = cols.join(plain, [*scope, "conrelid"], "left_semi")
    scope = _schema_key(columns, fks)
    covered = (with_conkey(fks).filter(F.col("confrelid") == target)
               .select(*scope, "conrelid", F.explode("conkey").alias("attnum")).distinct())
    return (cols.join(covered, [*scope, "conrelid", "attnum"], "left_anti")
            .select(F.col("conrelid").alias("table_name"), F.col("attname").alias("column_name"))
            .orderBy(*sx.ordered("table_name", "column_name")))
