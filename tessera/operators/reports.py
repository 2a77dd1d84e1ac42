"""Reports over grants and accounts: who reaches what, the access grid, app
lists, invitation reports (J1-J4, A6-A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators.access import ADMIN, PLATFORM

UNLISTED_NOTE = "not listed in this page"
LINE_DASH = " — "


# J1
def who_reaches_what(grants: DataFrame, accounts: DataFrame) -> DataFrame:
    """email, app, role, granted_at by app then email."""
    return (grants.join(accounts.select("user_id", "email"), "user_id")
            .select("email", "app", "role", "granted_at")
            .orderBy(*sx.ordered("app", "email")))


# J3
def app_list(catalog: DataFrame, grants: DataFrame, order_col: str | None = None) -> DataFrame:
    """Catalog apps in catalog order, then apps seen only in grants (never
    ``platform``), by id, noted as unlisted. Columns: position, app, name, url, note.

    Both inputs are reduced to distinct app ids before the (tiny) numbering
    window, so the single-partition window only sees the app dimension.
    """
    known = catalog.select("app", "name", "url",
                           (F.col(order_col) if order_col else F.lit(None)).alias("_o"),
                           F.lit(0).alias("_grp"), F.lit(None).cast("string").alias("note"))
    extra = (grants.select("app").filter(F.col("app") != PLATFORM).distinct()
             .join(catalog.select("app"), "app", "left_anti")
             .select("app", F.col("app").alias("name"), F.lit(None).cast("string").alias("url"),
                     F.lit(None).alias("_o"), F.lit(1).alias("_grp"), F.lit(UNLISTED_NOTE).alias("note")))
    both = known.unionByName(extra, allowMissingColumns=False)
    w = Window.orderBy("_grp", F.col("_o").asc_nulls_last(), "app")
    return both.select(F.row_number().over(w).alias("position"), "app", "name", "url", "note")


# J4
def resolve_apps(df: DataFrame, catalog: DataFrame, app_col: str = "app") -> DataFrame:
    """Add app_name (fallback: the raw id) and app_url (null when unknown).

    A left join: a grant on an app missing from the catalog is never dropped.
    """
    cat = catalog.select(F.col("app").alias("_cat_app"), F.col("name").alias("_cat_name"),
                         F.col("url").alias("app_url"))
    return (df.join(cat, F.col(app_col) == F.col("_cat_app"), "left")
            .withColumn("app_name", F.coalesce("_cat_name", F.col(app_col)))
            .drop("_cat_app", "_cat_name"))


# J2
def access_grid(accounts: DataFrame, apps: DataFrame, grants: DataFrame) -> DataFrame:
    """Every account with its roles in the listed apps, as a map app -> role.

    An app missing from the map is an empty cell of the grid, so the output grows with
    accounts and grants and never with accounts times apps. One join of accounts
    with their grants on user_id; the app list is a semi join.
    """
    held = (grants.join(apps.select("app").distinct(), "app", "left_semi").groupBy("user_id")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("app", "role")))).alias("roles")))
    none = F.create_map().cast("map<string,string>")
    return accounts.select("user_id", "email").join(held, "user_id", "left").select(
        "user_id", "email", F.coalesce("roles", none).alias("roles"))


def access_columns(accounts: DataFrame, grants: DataFrame, apps: list[str]) -> DataFrame:
    """Every account with one column per app asked for, holding its role or null."""
    roles = grants.filter(F.col("app").isin(apps)).groupBy("user_id").pivot("app", apps).agg(F.first("role"))
    return accounts.select("user_id", "email").join(roles, "user_id", "left")


# A6
def account_summary(accounts: DataFrame, grants: DataFrame) -> DataFrame:
    """Per account: apps held (excluding platform), admin badge, and the one-line
    summary `n apps · last sign-in YYYY-MM-DD` / `no access · never signed in`."""
    per_user = (grants.groupBy("user_id")
                .agg(F.count(F.when(F.col("app") != PLATFORM, 1)).alias("n_apps"),
                     F.max(F.when((F.col("app") == PLATFORM) & (F.col("role") == ADMIN), True)
                           .otherwise(False)).alias("is_admin")))
    j = accounts.select("user_id", "email", "last_sign_in_at").join(per_user, "user_id", "left")
    n = F.coalesce("n_apps", F.lit(0))
    return j.select("user_id", "email", n.alias("n_apps"),
                    F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
                    F.concat_ws(" · ", sx.plural_apps(n), sx.last_sign_in_text("last_sign_in_at"))
                    .alias("summary"))


def _sorted_agg_text(arr_col, fmt, sep):
    """Text of an array of structs already sorted; null for an empty array."""
    txt = F.array_join(F.transform(arr_col, fmt), sep)
    return F.when(F.size(arr_col) > 0, txt)


# A7
def invite_report(accounts: DataFrame, grants: DataFrame) -> DataFrame:
    """Per invited account: email, invited_at, accepted, and `app:role` list by
    app (null without grants); newest invitation first."""
    inv = accounts.filter(F.col("invited_at").isNotNull())
    g = (grants.groupBy("user_id")
         .agg(F.sort_array(F.collect_list(F.struct("app", "role"))).alias("_g")))
    j = inv.join(g, "user_id", "left")
    access = F.when(F.col("_g").isNotNull(),
                    _sorted_agg_text(F.col("_g"), lambda s: F.concat(s["app"], F.lit(":"), s["role"]), ", "))
    return (j.select("email", "invited_at", F.col("confirmed_at").isNotNull().alias("accepted"),
                     access.alias("access"))
            .orderBy(*sx.ordered(F.col("invited_at").desc_nulls_first(), "email")))


# A8
def flatten_apps(requests: DataFrame, catalog: DataFrame, key: str = "request_id",
                 grants_col: str = "grants") -> DataFrame:
    """Per request: ``apps`` JSON array of {name,url,role} and ``app_list``
    lines `name — url`, both ordered by name. No apps gives `[]` and a null list;
    a list that is no well-formed array gives null for both.

    The grant list is exploded, resolved against the catalog by a join, and
    regrouped per request; each group holds one request's few grants.
    """
    parsed = requests.select(key, sx.grant_entries(grants_col).alias("_arr"), F.col(grants_col).alias("_text"))
    parsed = parsed.withColumn("_malformed", F.col("_text").isNotNull() & F.col("_arr").isNull())
    ex = parsed.select(key, "_malformed", F.explode_outer("_arr").alias("_g"))
    res = resolve_apps(ex.select(key, "_malformed", F.col("_g.app").alias("app"), F.col("_g.role").alias("role")),
                       catalog)
    res = res.withColumn("_item", F.when(F.col("app").isNotNull() | F.col("role").isNotNull(),
                                         F.struct(F.col("app_name").alias("name"),
                                                  F.col("app_url").alias("url"), "role")))
    agg = res.groupBy(key).agg(F.sort_array(F.collect_list("_item")).alias("_items"),
                               F.bool_or("_malformed").alias("_malformed"))
    apps_json = F.to_json("_items", {"ignoreNullFields": "false"})
    lines = _sorted_agg_text(F.col("_items"),
                             lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit(LINE_DASH), s["url"]), F.lit(""))),
                             "\n")
    return agg.select(key, F.when(~F.col("_malformed"), apps_json).alias("apps"), lines.alias("app_list"))
