"""Derived views over the driver's tables (FIXTURES.md §3).

Each view is SQL in the common subset of Spark SQL and DuckDB. Base tables are
written as ``{name}`` placeholders: Spark binds them to DataFrames through
``spark.sql(text, name=df)``, DuckDB to its registered views. Literal braces
are doubled, as in ``str.format``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

FIXTURES: dict[str, str] = {
    "fx_accounts": """
select c.c_custkey as user_id,
       concat('user', cast(c.c_custkey as string), '@example.com') as email,
       o.created_at, e.last_sign_in_at
from {customer} c
left join (select o_custkey, min(o_orderdate) as created_at from {orders} group by o_custkey) o
  on o.o_custkey = c.c_custkey
left join (select user_id, max(ts) as last_sign_in_at from {events} group by user_id) e
  on e.user_id = c.c_custkey""",
    "fx_grants": """
select user_id, event_type as app,
       case when (user_id + length(event_type)) % 10 = 0 then 'app_admin' else 'member' end as role,
       min(ts) as granted_at,
       case when user_id % 4 = 0 then null else (user_id % 3) * 5 end as granted_by
from {events}
where (user_id + length(event_type)) % 3 <> 0
group by user_id, event_type
union all
select user_id, 'platform' as app, 'app_admin' as role, min(ts) as granted_at,
       cast(null as bigint) as granted_by
from {events} where user_id in (0, 5, 10) group by user_id""",
    "fx_app_catalog": """
select event_type as app,
       concat(upper(substring(event_type, 1, 1)), substring(event_type, 2)) as name,
       concat('https://', event_type, '.example.com') as url
from (select distinct event_type from {events} where event_type <> 'error') t""",
    "fx_personal": """
select event_id as row_id, event_type as app,
       case when event_id % 50 = 0 then null else user_id end as owner_id, value
from {events}""",
    "fx_sessions": """
select event_id as session_id, user_id, cast(user_id as string) as user_id_text, ts as started_at
from {events} where event_type = 'view'""",
    "fx_revocations": """
select user_id, event_type as app, max(ts) as revoked_at
from {events} where event_type in ('click', 'purchase') and user_id % 5 = 1
group by user_id, event_type""",
    # accounts invited by one another: a chain of references within one table, and one account that references itself
    "fx_people": """
select c_custkey as user_id,
       case when c_custkey % 6 = 5 then null when c_custkey = 3 then 3
            else cast(floor(c_custkey / 4) as bigint) end as invited_by, c_mktsegment as segment
from {customer}""",
    "fx_people_orders": """
select o_orderkey as order_id, o_custkey as user_id, o_totalprice as price from {orders}""",
    "fx_people_lines": """
select l_orderkey as order_id, l_linenumber as line, l_quantity as quantity from {lineitem}""",
    "fx_people_events": """
select event_id, user_id, event_type, value from {events}""",
    # open disputes hold orders back
    "fx_people_disputes": """
select o_orderkey as dispute_id, case when o_orderkey % 40 = 7 then null else o_orderkey end as order_id
from {orders} where o_orderkey % 211 = 5 or o_orderkey % 40 = 7""",
    "fx_claims": """
select cast(o_orderkey as string) as id, cast(o_custkey as string) as person,
       o_orderpriority as service, cast(o_orderdate as date) as service_date,
       cast(year(o_orderdate) as int) as tax_year,
       cast(o_totalprice as decimal(10,2)) as amount_submitted,
       cast(0 as decimal(10,2)) as amount_paid,
       case when o_orderkey % 3 = 0 then null else concat('ins', cast(o_orderkey % 9 as string)) end as insurer,
       case o_orderstatus when 'F' then 'active' when 'O' then 'duplicate' else 'excluded' end as status,
       case when o_orderkey % 11 = 0 then 'suspected' else null end as flag_status,
       cast(null as string) as note, o_orderdate as created_at
from {orders}""",
    "fx_claim_lines": """
select l_suppkey as person, cast(l_quantity as decimal(10,2)) as amount_submitted,
       cast(l_shipdate as date) as service_date, l_orderkey, l_linenumber
from {lineitem}""",
    "fx_requests": """
select c_custkey as request_id,
       case c_custkey % 7 when 0 then 'not-an-address'
            when 1 then concat('user', cast(c_custkey as string), '@example.com')
            else concat(' New', cast(c_custkey as string), '@Example.com ') end as target_email,
       case c_custkey % 43 when 10 then '[oops' when 11 then '[{{"app":"view","role":"member"}}'
            when 12 then '[1]' when 13 then '{{"app":"view","role":"member"}}'
            when 20 then '[{{"app":"view","role":"member"}},{{"app":"view","role":"app_admin"}}]'
            when 21 then null
            else case c_custkey % 7 when 2 then '[{{"app":"platform","role":"app_admin"}}]'
            when 3 then '[{{"app":"click","role":"owner"}}]'
            when 4 then '[{{"app":"click"}}]'
            when 5 then '[]'
            else '[{{"app":"view","role":"member"}},{{"app":"error","role":"app_admin"}}]' end end as grants
from {customer}""",
    # every tenth name exists in a platform schema as well, with other properties
    "fx_relations": """
select p_partkey as oid, case when p_partkey % 17 = 3 then 'platform' else 'public' end as schemaname,
       concat('rel_', cast(p_partkey as string)) as relname,
       case p_size % 3 when 0 then 'r' when 1 then 'v' else 'm' end as relkind,
       p_partkey % 13 <> 0 as relrowsecurity,
       case p_partkey % 5 when 0 then null when 1 then 'false' when 2 then 'on' else 'true' end as security_invoker,
       p_partkey % 4 = 0 as anon_can_read
from {part}
union all
select p_partkey + 1000000000 as oid, 'auth' as schemaname, concat('rel_', cast(p_partkey as string)) as relname,
       'r' as relkind, false as relrowsecurity, cast(null as string) as security_invoker, true as anon_can_read
from {part} where p_partkey % 10 = 0""",
    "fx_policies": """
select case when p_partkey % 17 = 3 then 'platform' else 'public' end as schemaname,
       concat('rel_', cast(p_partkey as string)) as tablename,
       concat('policy_', cast(p_partkey as string)) as policyname,
       case p_partkey % 2 when 0 then 'SELECT' else 'ALL' end as cmd,
       case p_partkey % 6 when 0 then null when 1 then 'true' when 2 then 'auth.role() = authenticated'
            else 'has_app_access(view)' end as qual,
       case p_partkey % 5 when 0 then null when 1 then 'true' else 'has_app_access(view)' end as with_check
from {part}""",
    "fx_functions": """
select case when p_partkey % 11 = 5 then 'ext' else 'public' end as schemaname,
       concat('fn_', cast(p_partkey as string)) as proname, p_partkey % 3 = 0 as prosecdef,
       p_partkey % 8 = 0 as anon_execute,
       split(case p_partkey % 7 when 0 then null when 1 then 'work_mem=1MB'
                  else 'work_mem=1MB;search_path=public, pg_temp' end, ';') as proconfig
from {part}""",
    "fx_foreign_keys": """
select p_partkey as fk_id, case when p_partkey % 17 = 3 then 'platform' else 'public' end as schemaname,
       concat('rel_', cast(p_partkey as string)) as conrelid,
       case p_partkey % 2 when 0 then 'users' else 'other' end as confrelid,
       case p_partkey % 3 when 0 then '1' else '1,2' end as conkey_csv,
       case p_partkey % 5 when 0 then 'c' when 1 then 'n' when 2 then 'd' when 3 then 'r' else 'a' end as confdeltype
from {part}""",
    "fx_columns": """
select case when p_partkey % 17 = 3 then 'platform' else 'public' end as schemaname,
       concat('rel_', cast(p_partkey as string)) as conrelid, 1 as attnum,
       case p_partkey % 4 when 0 then 'user_id' when 1 then 'owner_id' when 2 then 'created_by' else 'title' end as attname
from {part}
union all
select case when p_partkey % 17 = 3 then 'platform' else 'public' end as schemaname,
       concat('rel_', cast(p_partkey as string)) as conrelid, 2 as attnum, 'granted_by' as attname
from {part} where p_partkey % 3 = 1
union all
select 'auth' as schemaname, concat('rel_', cast(p_partkey as string)) as conrelid, 1 as attnum, 'owner_id' as attname
from {part} where p_partkey % 10 = 0""",
    "fx_counts_old": """
select o_orderpriority as tbl, count(*) as n
from {orders}
group by o_orderpriority""",
    "fx_counts_new": """
select o_orderpriority as tbl, count(*) as n
from {orders} where o_orderkey % 1000 <> 7 and o_orderpriority <> '5-LOW'
group by o_orderpriority""",
    "fx_matches": """
select posting_id, user_id, (posting_id * 31 + user_id * 17) % 101 as score
from (select distinct e.event_id % (select count(*) from {documents}) as posting_id, e.user_id
      from {events} e join {customer} c on c.c_custkey = e.user_id) v""",
    "fx_dismissed": """
select distinct event_id % (select count(*) from {documents}) as posting_id, user_id
from {events} where event_type = 'error'""",
    "fx_invite_attempts": """
select event_id as attempt_id, case when user_id % 3 = 0 then 0 else user_id end as inviter, ts as attempted_at
from {events}""",
    "fx_responses": """
select event_id as response_id,
       case event_id % 2 when 0 then 'invite' else 'delete' end as op,
       case event_id % 9 when 0 then 429 when 1 then 422 when 2 then 401 when 3 then 403
            when 4 then 500 when 5 then 409 when 6 then 404 when 7 then 418 else 200 end as status,
       case event_id % 5 when 0 then '{{"error_code":"email_exists","msg":"m"}}'
            when 1 then '{{"message":"other"}}' when 2 then 'not json' when 3 then '{{"id":"u1"}}' else null end as content
from {events}""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def base_tables_of(sql: str) -> list[str]:
    """Base-table placeholders used by a fixture text."""
    return sorted(set(_PLACEHOLDER.findall(sql)))


class Workspace:
    """The driver's parquet tables at one scale and the views derived from them.

    Every access re-reads the files (lazily): grants must never be served
    from a cache, because a revocation has to show in the next query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._fx: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # one DataFrame per table and query: lazy, so nothing is cached but
        # the file listing, and the next Workspace reads the files again
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def fx(self, name: str) -> DataFrame:
        if name not in self._fx:
            sql = FIXTURES[name]
            self._fx[name] = self.spark.sql(sql, **{t: self.table(t) for t in base_tables_of(sql)})
        return self._fx[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return self.fx(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)


def duckdb_ctes(*names: str) -> str:
    """``WITH`` clause defining the named fixtures for a DuckDB oracle query."""
    parts = []
    for n in names:
        sql = FIXTURES[n]
        parts.append(f"{n} AS ({sql.format(**{t: t for t in base_tables_of(sql)})})")
    return "WITH " + ",\n".join(parts) + "\n"
