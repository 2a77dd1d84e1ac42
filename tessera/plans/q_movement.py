"""Registered movement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import access as acc
from tessera.operators import integrity as ig
from tessera.plans.fixtures import BASE_TABLES, Workspace, duckdb_ctes
from tessera.plans.registry import register
from tessera.sources import exports as ex
from tessera.sources import publish as pub
from tessera.sources import tables as tb

PAGE = tb.PAGE_SIZE

# A mix of user and platform schema names, assigned to the
# relations of `part` by p_partkey % 16 to build a table list.
SCHEMA_NAMES = ("public", "app", "auth", "storage", "pg_catalog", "pg_toast", "cron", "information_schema",
                "net", "vault", "graphql", "extensions", "analytics", "realtime", "supabase_migrations",
                "pgbouncer")


@register("s1_read_table", """
select o_orderkey, o_custkey, o_orderdate from orders where o_orderpriority = '1-URGENT'""")
def s1_read_table(spark, sf_dir):
    return tb.read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"],
                         F.col("o_orderpriority") == "1-URGENT")


def _claims_schema(ws: Workspace):
    return ws.fx_claims.schema


def _exported(spark, ws: Workspace):
    path = pub.scratch_path(spark, "pages")
    tb.export_pages(ws.fx_claims, "id", path, PAGE)
    return path


@register("s2_read_paged_json", duckdb_ctes("fx_claims") + "select * from fx_claims")
def s2_read_paged_json(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    path = _exported(spark, ws)
    return tb.read_pages(spark, path, _claims_schema(ws)).drop("_page")


@register("s2_page_report", duckdb_ctes("fx_claims") + f"""
select page, count(*) as rows from (
  select cast(floor((row_number() over (order by id) - 1) / {PAGE}) as bigint) as page from fx_claims)
group by page""")
def s2_page_report(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return tb.page_sizes(spark, _exported(spark, ws)).select("page", F.col("rows").cast("bigint").alias("rows"))


def _array_pages(ws: Workspace, size: int):
    """The claims as a paging client saves them: one file per page, each a JSON array."""
    path = pub.scratch_path(ws.spark, "array-pages")
    row = F.to_json(F.struct(*ws.fx_claims.columns), {"ignoreNullFields": "false"})
    (tb.page_numbers(ws.fx_claims, "id", size).groupBy("_page")
     .agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]")).alias("value"))
     .repartition("_page").write.partitionBy("_page").text(path))
    return path


@register("s2_read_array_pages", duckdb_ctes("fx_claims") + "select * from fx_claims")
def s2_read_array_pages(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    pages = tb.read_paged_json(spark, _array_pages(ws, PAGE), _claims_schema(ws))
    return pages.select(*ws.fx_claims.columns)


@register("s2_array_page_report", duckdb_ctes("fx_claims") + f"""
select rows, count(*) as pages from (
  select count(*) as rows from (select (row_number() over (order by id) - 1) // {PAGE} as page from fx_claims) group by page)
group by rows""")
def s2_array_page_report(spark, sf_dir):
    """How many pages hold how many rows, from the page files."""
    ws = Workspace(spark, sf_dir)
    report = tb.page_report(tb.read_paged_json(spark, _array_pages(ws, PAGE), _claims_schema(ws)))
    return report.groupBy("rows").agg(F.count(F.lit(1)).alias("pages"))


@register("o1_listing_order", duckdb_ctes("fx_accounts") + """
select row_number() over (order by last_sign_in_at desc nulls first, email, user_id) as position, user_id, email from (
  select user_id, case when user_id % 37 <> 5 then email end as email, last_sign_in_at from fx_accounts)""")
def o1_listing_order(spark, sf_dir):
    """The stated order (newest first, nulls first; then email, nulls last), as the rows come out of the sort."""
    ws = Workspace(spark, sf_dir)
    listed = (ws.fx_accounts.withColumn("email", F.when(F.col("user_id") % 37 != 5, F.col("email")))
              .orderBy(*sx.ordered(F.col("last_sign_in_at").desc_nulls_first(), "email", "user_id")))
    came = listed.select(F.monotonically_increasing_id().alias("came"), "user_id", "email")
    return tb.page_numbers(came, "came", size=1).select((F.col("_page") + 1).alias("position"), "user_id", "email")


@register("s3_import_into_empty", duckdb_ctes("fx_claims") + """
select count(*) as expected, count(*) as written, true as ok from fx_claims""")
def s3_import_into_empty(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return pub.import_into_empty(ws.fx_claims, pub.scratch_path(spark, "import"), "claims")


@register("s4_guarded_copy", duckdb_ctes("fx_claims") + """
select count(*) as expected, count(*) as written, true as ok from fx_claims""")
def s4_guarded_copy(spark, sf_dir):
    """Claims are one per order: the order count is the expected size."""
    ws = Workspace(spark, sf_dir)
    expected = ws.orders.count()
    return pub.guarded_copy(ws.fx_claims, pub.scratch_path(spark, "copy"), "claims", expected)


@register("s5_copy_tables", duckdb_ctes("fx_accounts", "fx_grants", "fx_personal") + """
select 'accounts' as tbl, count(*) as n from fx_accounts
union all select 'grants', count(*) from fx_grants
union all select 'personal', count(*) from fx_personal""")
def s5_copy_tables(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    root = pub.scratch_path(spark, "publish")
    pub.copy_tables({"accounts": ws.fx_accounts, "grants": ws.fx_grants, "personal": ws.fx_personal}, root)
    return ig.exact_counts({n: pub.read_published(spark, root, n) for n in ("accounts", "grants", "personal")})


def _schema_tables(ws: Workspace):
    names = F.array(*[F.lit(s) for s in SCHEMA_NAMES])
    return ws.part.select(F.element_at(names, (F.col("p_partkey") % len(SCHEMA_NAMES) + 1).cast("int"))
                          .alias("schemaname"),
                          F.concat(F.lit("rel_"), F.col("p_partkey").cast("string")).alias("relname"))


_SCHEMA_SQL = f"""
, st as (select ({list(SCHEMA_NAMES)!r})[cast(p_partkey % {len(SCHEMA_NAMES)} + 1 as integer)] as schemaname,
                'rel_' || cast(p_partkey as varchar) as relname from part)"""


@register("s6_filter_user_schemas", "WITH x AS (select 1)" + _SCHEMA_SQL + f"""
select * from st
where schemaname not in {ex.PLATFORM_SCHEMAS!r} and not starts_with(schemaname, 'pg_')""")
def s6_filter_user_schemas(spark, sf_dir):
    return ex.filter_user_schemas(_schema_tables(Workspace(spark, sf_dir)))


@register("s7_export_account_list", duckdb_ctes("fx_accounts") + """
select email || '  (created ' || cast(cast(created_at as date) as varchar) || ', last sign-in '
       || coalesce(cast(cast(last_sign_in_at as date) as varchar), 'never') || ')' as value
from fx_accounts order by created_at""")
def s7_export_account_list(spark, sf_dir):
    return ex.export_account_list(Workspace(spark, sf_dir).fx_accounts)


_TYPE_MAP = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int",
             "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>", "BOOLEAN": "boolean", "DATE": "date"}


@register("s8_schema_inventory", f"""
with n as ({" union all ".join(f"select '{t}' as tbl, count(*) as rows from {t}" for t in sorted(BASE_TABLES))}),
     f as ({" union all ".join(f"select '{t}' as tbl, name, filled from (unpivot (select count(columns(*)) as '\\0' from {t}) on columns(*) into name name value filled)" for t in sorted(BASE_TABLES))})
select table_name as tbl, cast(ordinal_position as integer) as position, column_name as "column",
       case data_type {" ".join(f"when '{k}' then '{v}'" for k, v in _TYPE_MAP.items())} else lower(data_type) end
       as type, is_nullable = 'YES' as nullable
       , n.rows, f.filled
from information_schema.columns c join n on n.tbl = c.table_name
join f on f.tbl = c.table_name and f.name = c.column_name""")
def s8_schema_inventory(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ex.schema_inventory({t: ws.table(t) for t in BASE_TABLES})


@register("s8_export_counts", "\nunion all\n".join(
    f"select '{t}' as tbl, count(*) as n from {t}" for t in sorted(BASE_TABLES)))
def s8_export_counts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    path = pub.scratch_path(spark, "counts")
    ex.export_counts(ig.exact_counts({t: ws.table(t) for t in BASE_TABLES}), path)
    return spark.read.schema("tbl string, n bigint").option("header", True).csv(path)


@register("o2_page_after", duckdb_ctes("fx_claims") + f"""
select * from fx_claims where id > '5000' order by id limit {PAGE}""")
def o2_page_after(spark, sf_dir):
    return tb.page(Workspace(spark, sf_dir).fx_claims, "id", PAGE, after="5000")


@register("o2_page_numbers", duckdb_ctes("fx_claims") + f"""
select id, cast(floor((row_number() over (order by id) - 1) / {PAGE}) as bigint) as _page from fx_claims""")
def o2_page_numbers(spark, sf_dir):
    return tb.page_numbers(Workspace(spark, sf_dir).fx_claims.select("id"), "id", PAGE)


@register("o3_row_existence", duckdb_ctes("fx_claims") + """
select count(*) > 0 as has_rows, count(*) as row_count from fx_claims""")
def o3_row_existence(spark, sf_dir):
    return tb.row_existence(Workspace(spark, sf_dir).fx_claims)


@register("o3_row_existence_empty", duckdb_ctes("fx_claims") + """
select count(*) > 0 as has_rows, count(*) as row_count from fx_claims where person = 'RLS PROBE'""")
def o3_row_existence_empty(spark, sf_dir):
    return tb.row_existence(Workspace(spark, sf_dir).fx_claims.filter(F.col("person") == "RLS PROBE"))


# The listing check of the account function, appended as one ordered table
LIST_CHECKS = [(1, "platform admin sees users (want all)", 0),
               (2, "ordinary account sees users (want 0)", 6),
               (3, "nobody signed in sees users (want 0)", None)]


@register("u1_append_results", duckdb_ctes("fx_accounts", "fx_grants") + " " + " union all ".join(
    f"""select {s} as seq, '{label}' as label, cast((select count(*) from fx_accounts
        where exists (select 1 from fx_grants g where g.user_id = {('null' if c is None else c)}
                      and g.app = 'platform' and g.role = 'app_admin')) as varchar) as result"""
    for s, label, c in LIST_CHECKS))
def u1_append_results(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    out = None
    for seq, label, caller in LIST_CHECKS:
        n = acc.list_accounts(ws.fx_accounts, ws.fx_grants, caller).select(F.count(F.lit(1)).cast("string"))
        part = spark.range(1).select(F.lit(seq).alias("seq"), F.lit(label).alias("label"),
                                     n.scalar().alias("result"))
        out = part if out is None else out.unionByName(part)
    return out
