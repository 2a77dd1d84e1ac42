"""Registered access-decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import access as acc
from tessera.plans.fixtures import Workspace, duckdb_ctes
from tessera.plans.registry import register
from tessera.sources import governed_store as store
from tessera.sources import publish as pub

APP = "view"          # the app whose tables are probed
ADMIN_CALLER = 6      # app_admin of `view`
MEMBER_CALLER = 0     # member of `view`, platform admin
UNGRANTED_CALLER = 2  # no grant on `view`


def _personal(ws: Workspace, app: str = APP):
    return ws.fx_personal.filter(F.col("app") == app)


@register("f1_has_app_access", duckdb_ctes("fx_accounts", "fx_grants") + f"""
select a.user_id, g.user_id is not null as has_access
from fx_accounts a left join fx_grants g on g.user_id = a.user_id and g.app = '{APP}'""")
def f1_has_app_access(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.access_by_caller(ws.fx_accounts, ws.fx_grants, APP).select("user_id", "has_access")


@register("f1_has_app_access_one", duckdb_ctes("fx_grants") + f"""
select c.caller, exists(select 1 from fx_grants g where g.user_id = c.caller and g.app = '{APP}') as has_access
from (values ({ADMIN_CALLER}), ({MEMBER_CALLER}), ({UNGRANTED_CALLER}), (null)) c(caller)""")
def f1_has_app_access_one(spark, sf_dir):
    """The single-caller form: one uncorrelated EXISTS per caller."""
    ws = Workspace(spark, sf_dir)
    g = ws.fx_grants
    rows = None
    for c in (ADMIN_CALLER, MEMBER_CALLER, UNGRANTED_CALLER, None):
        one = spark.range(1).select(F.lit(c).cast("bigint").alias("caller"),
                                    acc.has_app_access(g, F.lit(c).cast("bigint"), APP).alias("has_access"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register("f2_app_role", duckdb_ctes("fx_accounts", "fx_grants") + f"""
select a.user_id, g.role
from fx_accounts a left join fx_grants g on g.user_id = a.user_id and g.app = '{APP}'""")
def f2_app_role(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.access_by_caller(ws.fx_accounts, ws.fx_grants, APP).select("user_id", "role")


@register("f3_is_platform_admin", duckdb_ctes("fx_accounts", "fx_grants") + """
select a.user_id, exists(select 1 from fx_grants g where g.user_id = a.user_id
                          and g.app = 'platform' and g.role = 'app_admin') as is_platform_admin
from fx_accounts a""")
def f3_is_platform_admin(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.platform_admin_flags(ws.fx_accounts, ws.fx_grants)


_SHARED_SQL = """
select o_orderkey, o_custkey, o_totalprice from orders
where exists (select 1 from fx_grants g where g.user_id = {caller} and g.app = '{app}')"""


@register("f4_governed_shared", duckdb_ctes("fx_grants") + _SHARED_SQL.format(caller=ADMIN_CALLER, app=APP))
def f4_governed_shared(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed(ws.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                        ws.fx_grants, "shared", APP, ADMIN_CALLER)


@register("f4_governed_shared_refused",
          duckdb_ctes("fx_grants") + _SHARED_SQL.format(caller=UNGRANTED_CALLER, app=APP))
def f4_governed_shared_refused(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed(ws.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                        ws.fx_grants, "shared", APP, UNGRANTED_CALLER)


_PERSONAL_SQL = """
select p.* from fx_personal p
where p.app = '{app}'
  and exists (select 1 from fx_grants g where g.user_id = {caller} and g.app = '{app}')
  and ((select role from fx_grants g where g.user_id = {caller} and g.app = '{app}') = 'app_admin'
       or p.owner_id = {caller})"""


@register("f5_governed_personal_admin",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=ADMIN_CALLER, app=APP))
def f5_governed_personal_admin(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed(_personal(ws), ws.fx_grants, "personal", APP, ADMIN_CALLER, "owner_id")


@register("f5_governed_personal_member",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=MEMBER_CALLER, app=APP))
def f5_governed_personal_member(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed(_personal(ws), ws.fx_grants, "personal", APP, MEMBER_CALLER, "owner_id")


@register("f5_governed_personal_ungranted",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=UNGRANTED_CALLER, app=APP))
def f5_governed_personal_ungranted(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed(_personal(ws), ws.fx_grants, "personal", APP, UNGRANTED_CALLER, "owner_id")


def _pruned(spark, sf_dir, caller):
    ws = Workspace(spark, sf_dir)
    path = pub.scratch_path(spark, "governed")
    store.write_governed(ws.fx_personal, path)
    return store.read_governed(spark, path, ws.fx_grants, "personal", APP, caller, columns=["row_id", "app", "owner_id", "value"])


@register("f5_pruned_member",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=MEMBER_CALLER, app=APP))
def f5_pruned_member(spark, sf_dir):
    """The table stored by app and owner; the member's filter reaches the scan."""
    return _pruned(spark, sf_dir, MEMBER_CALLER)


@register("f5_pruned_admin",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=ADMIN_CALLER, app=APP))
def f5_pruned_admin(spark, sf_dir):
    return _pruned(spark, sf_dir, ADMIN_CALLER)


@register("f5_pruned_ungranted",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=UNGRANTED_CALLER, app=APP))
def f5_pruned_ungranted(spark, sf_dir):
    return _pruned(spark, sf_dir, UNGRANTED_CALLER)


@register("f6_writable_personal", duckdb_ctes("fx_grants", "fx_personal") + f"""
select p.* from fx_personal p
where p.app = '{APP}'
  and exists (select 1 from fx_grants g where g.user_id = {ADMIN_CALLER} and g.app = '{APP}')
  and p.owner_id = {ADMIN_CALLER}""")
def f6_writable_personal(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.writable(_personal(ws), ws.fx_grants, "personal", APP, ADMIN_CALLER, "owner_id")


_GRANTS_READ_SQL = """
select * from fx_grants
where user_id = {caller}
   or exists (select 1 from fx_grants g where g.user_id = {caller} and g.app = 'platform' and g.role = 'app_admin')"""


@register("f7_governed_grants", duckdb_ctes("fx_grants") + _GRANTS_READ_SQL.format(caller=ADMIN_CALLER))
def f7_governed_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed_grants(ws.fx_grants, ADMIN_CALLER)


@register("f7_governed_grants_admin", duckdb_ctes("fx_grants") + _GRANTS_READ_SQL.format(caller=MEMBER_CALLER))
def f7_governed_grants_admin(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.governed_grants(ws.fx_grants, MEMBER_CALLER)


_GRANTS_WRITE_SQL = """
select * from fx_grants
where exists (select 1 from fx_grants g where g.user_id = {caller} and g.app = 'platform' and g.role = 'app_admin')"""


@register("f8_writable_grants", duckdb_ctes("fx_grants") + _GRANTS_WRITE_SQL.format(caller=MEMBER_CALLER))
def f8_writable_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.writable_grants(ws.fx_grants, MEMBER_CALLER)


@register("f8_writable_grants_refused", duckdb_ctes("fx_grants") + _GRANTS_WRITE_SQL.format(caller=ADMIN_CALLER))
def f8_writable_grants_refused(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.writable_grants(ws.fx_grants, ADMIN_CALLER)


@register("f9_allowed_verbs", duckdb_ctes("fx_relations", "fx_policies") + """
select r.schemaname, r.relname, v.verb,
       exists (select 1 from fx_policies p where p.tablename = r.relname and p.schemaname = r.schemaname
               and (upper(p.cmd) = 'ALL' or upper(p.cmd) = v.verb)) as allowed
from fx_relations r
cross join (values ('SELECT'), ('INSERT'), ('UPDATE'), ('DELETE')) v(verb)""")
def f9_allowed_verbs(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.allowed_verbs(ws.fx_relations, ws.fx_policies)


_LIST_SQL = """
select user_id as id, email, created_at, last_sign_in_at from fx_accounts
where exists (select 1 from fx_grants g where g.user_id = {caller} and g.app = 'platform' and g.role = 'app_admin')
order by email"""


@register("f10_list_accounts", duckdb_ctes("fx_accounts", "fx_grants") + _LIST_SQL.format(caller=MEMBER_CALLER))
def f10_list_accounts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.list_accounts(ws.fx_accounts, ws.fx_grants, MEMBER_CALLER)


@register("f10_list_accounts_refused",
          duckdb_ctes("fx_accounts", "fx_grants") + _LIST_SQL.format(caller=ADMIN_CALLER))
def f10_list_accounts_refused(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.list_accounts(ws.fx_accounts, ws.fx_grants, ADMIN_CALLER)


@register("f10_list_accounts_nobody", duckdb_ctes("fx_accounts", "fx_grants") + _LIST_SQL.format(caller="null"))
def f10_list_accounts_nobody(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.list_accounts(ws.fx_accounts, ws.fx_grants, None)


@register("f11_own_grants", duckdb_ctes("fx_grants") + f"""
select app, role from fx_grants where user_id = {MEMBER_CALLER} order by app""")
def f11_own_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.own_grants(ws.fx_grants, MEMBER_CALLER)


@register("f12_deletable_accounts", duckdb_ctes("fx_accounts", "fx_grants") + f"""
select a.* from fx_accounts a
where a.user_id is distinct from {MEMBER_CALLER}
  and not exists (select 1 from fx_grants g where g.user_id = a.user_id
                  and g.app = 'platform' and g.role = 'app_admin')""")
def f12_deletable_accounts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.deletable_accounts(ws.fx_accounts, ws.fx_grants, MEMBER_CALLER)


@register("f13_pending_invitations", duckdb_ctes("fx_accounts") + """
select user_id, email, created_at as invited_at from fx_accounts
where created_at is not null and last_sign_in_at is null""")
def f13_pending_invitations(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    inv = sx.as_invitations(ws.fx_accounts)
    return sx.pending_invitations(inv).select("user_id", "email", "invited_at")


NOW = "2024-01-15 00:00:00"


@register("f14_expiring_sessions", duckdb_ctes("fx_sessions") + f"""
select session_id, user_id, started_at + interval 3600 second as expires_at from fx_sessions
where started_at + interval 3600 second - interval 60 second <= timestamp '{NOW}'""")
def f14_expiring_sessions(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    s = ws.fx_sessions
    return (sx.expiring_sessions(s, F.expr(f"TIMESTAMP_NTZ '{NOW}'"), start_col="started_at")
            .select("session_id", "user_id", "expires_at"))


@register("f15_rows_with_json_key", """
select event_id, props from events where list_contains(json_keys(props), 'k')""")
def f15_rows_with_json_key(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return sx.rows_with_json_key(ws.events.select("event_id", "props"), "props", "k")


@register("a10_visibility", duckdb_ctes("fx_accounts", "fx_grants", "fx_personal") + f"""
, p as (select * from fx_personal where app = '{APP}'),
     own as (select owner_id, count(*) as n from p where owner_id is not null group by owner_id)
select a.user_id, g.role is not null as has_access, g.role,
       coalesce(own.n, 0) as own_rows, (select count(*) from p) as total_rows,
       case when g.role is null then 0 when g.role = 'app_admin' then (select count(*) from p)
            else coalesce(own.n, 0) end as visible_rows
from fx_accounts a
left join fx_grants g on g.user_id = a.user_id and g.app = '{APP}'
left join own on own.owner_id = a.user_id""")
def a10_visibility(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return acc.visibility(_personal(ws), ws.fx_grants, ws.fx_accounts, APP, "owner_id")


PROBES = [
    (1, "A. admin reads (want all)", ADMIN_CALLER, "all"),
    (2, "B. member reads own (want own)", MEMBER_CALLER, "own"),
    (3, "C. ungranted reads (want 0)", UNGRANTED_CALLER, "none"),
    (4, "D. nobody reads (want 0)", None, "none"),
    (5, "E. ungranted as owner (want own)", UNGRANTED_CALLER, "own"),
]


def _probe_sql(probes) -> str:
    rows = ", ".join(f"({s}, '{l}', {('null' if c is None else c)}, '{e}')" for s, l, c, e in probes)
    return duckdb_ctes("fx_grants", "fx_personal") + f"""
, p as (select * from fx_personal where app = '{APP}'),
  probes as (select * from (values {rows}) pr(seq, label, caller, expect)),
  calc as (
    select pr.seq, pr.label, pr.expect,
           g.role is not null as has_access,
           (select count(*) from p where p.owner_id = pr.caller) as own_rows,
           case when g.role is null then 0 when g.role = 'app_admin' then (select count(*) from p)
                else (select count(*) from p where p.owner_id = pr.caller) end as got
    from probes pr left join fx_grants g on g.user_id = pr.caller and g.app = '{APP}'),
  w as (select *, case expect when 'all' then (select count(*) from p) when 'own' then own_rows
                              when 'none' then 0 else cast(expect as bigint) end as want from calc)
select seq, label, cast(got as varchar) as result, want as expected,
       case when got = 0 and not (select bool_or(got > 0 and want > 0) from w) then 'inconclusive'
            when got = want then 'pass'
            when want > 0 and got = 0 and not has_access then 'inconclusive' else 'fail' end as verdict
from w"""


def _probe(spark, sf_dir, probes):
    ws = Workspace(spark, sf_dir)
    rows = spark.createDataFrame(probes, "seq int, label string, caller bigint, expect string")
    return acc.probe(_personal(ws), ws.fx_grants, rows, APP, "owner_id")


@register("a10_probe", _probe_sql(PROBES))
def a10_probe(spark, sf_dir):
    return _probe(spark, sf_dir, PROBES)


@register("a10_probe_nothing_reads", _probe_sql(PROBES[2:]))
def a10_probe_nothing_reads(spark, sf_dir):
    """A run in which no caller reads a row: nothing it shows counts."""
    return _probe(spark, sf_dir, PROBES[2:])


# §2.12: the same decisions as native SQL functions over a session variable

@register("sql_governed_personal",
          duckdb_ctes("fx_grants", "fx_personal") + _PERSONAL_SQL.format(caller=ADMIN_CALLER, app=APP))
def sql_governed_personal(spark, sf_dir):
    from tessera.functions import sql as fsql
    ws = Workspace(spark, sf_dir)
    fsql.register_access_functions(spark, ws.fx_grants, ws.fx_accounts)
    fsql.set_caller(spark, ADMIN_CALLER)
    return spark.sql(f"""SELECT * FROM {{p}} WHERE app = '{APP}' AND has_app_access('{APP}')
                         AND (app_role('{APP}') = 'app_admin' OR owner_id = caller)""", p=ws.fx_personal)


@register("sql_list_app_users", duckdb_ctes("fx_accounts", "fx_grants") + _LIST_SQL.format(caller=MEMBER_CALLER))
def sql_list_app_users(spark, sf_dir):
    from tessera.functions import sql as fsql
    ws = Workspace(spark, sf_dir)
    fsql.register_access_functions(spark, ws.fx_grants, ws.fx_accounts)
    fsql.set_caller(spark, MEMBER_CALLER)
    return spark.sql("SELECT * FROM list_app_users()")
