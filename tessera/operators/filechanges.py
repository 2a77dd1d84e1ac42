"""The changes of ``changes`` on tables of ``sources.filetable``: only files that hold a changed key are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.sources import filetable as ft


# M1, M2, M16
def upsert(spark: SparkSession, root: str, new: DataFrame, update_cols, insert_defaults: dict | None = None,
           base: ft.Version | None = None) -> ft.Change:
    """Insert ``new``, or set ``update_cols`` where its key exists; a key twice in ``new`` is an error."""
    key = (base or ft.current(spark, root)).key
    return ft.change(spark, root, new.select(*key),
                     lambda rows: ch.upsert(rows, new, key, update_cols, insert_defaults, "upsert"), base)


# M3, M13, M17
def delete(spark: SparkSession, root: str, keys: DataFrame, base: ft.Version | None = None) -> ft.Change:
    """Remove the rows of ``keys``; keys without a row are ignored, null keys match nothing."""
    key = list((base or ft.current(spark, root)).key)
    gone = keys.select(*key).dropna().distinct()
    return ft.change(spark, root, gone, lambda rows: rows.join(gone, key, "left_anti"), base)


# M14
def mark(spark: SparkSession, root: str, keys: DataFrame, status: str, status_col: str = "status",
         base: ft.Version | None = None) -> ft.Change:
    """Set ``status`` on the rows of ``keys`` (the table's one key column) instead of deleting them."""
    key, = (base or ft.current(spark, root)).key
    marked = keys.select(key).dropna().distinct()
    return ft.change(spark, root, marked, lambda rows: ch.mark_instead_of_delete(rows, marked, key, status, status_col), base)


# M12
def governed_update(spark: SparkSession, root: str, grants: DataFrame, shape: str, app: str, caller, where: Column,
                    set_values: dict, policies: DataFrame, table: str, owner_col: str = "user_id") -> ft.Change:
    """UPDATE ... WHERE under the write policy (``changes.governed_update``): rows out of reach are skipped, and a
    new row that the caller may not write fails the job before anything is committed."""
    def hit(rows: DataFrame) -> DataFrame:
        return rows.filter(where & ch.may_change(grants, shape, app, caller, F.col(owner_col), policies, table, "UPDATE"))
    return ft.change(spark, root, hit, lambda rows: ch.governed_update(
        rows, grants, shape, app, caller, where, set_values, policies, table, owner_col)[0])


def governed_delete(spark: SparkSession, root: str, grants: DataFrame, shape: str, app: str, caller, where: Column,
                    policies: DataFrame, table: str, owner_col: str = "user_id") -> ft.Change:
    """DELETE ... WHERE under the policy (``changes.governed_delete``)."""
    def hit(rows: DataFrame) -> DataFrame:
        return rows.filter(where & ch.may_change(grants, shape, app, caller, F.col(owner_col), policies, table, "DELETE"))
    return ft.change(spark, root, hit, lambda rows: ch.governed_delete(
        rows, grants, shape, app, caller, where, policies, table, owner_col)[0])
