"""Registered change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import access as acc
from tessera.operators import cascade as cas
from tessera.operators import changes as ch
from tessera.operators import filechanges as fc
from tessera.plans.fixtures import Workspace, duckdb_ctes
from tessera.plans.registry import register
from tessera.sources import filetable as ft
from tessera.sources import publish as pub

NOW = "2024-01-15 00:00:00"
CALLER = 0            # platform admin
APP = "view"
OWNER = 6             # app_admin of `view`
MEMBER = 0            # member of `view`


def _now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def _batch(ws: Workspace):
    """Grant batch: every account that has signed in gets `view` as app_admin."""
    return (ws.fx_accounts.filter(F.col("last_sign_in_at").isNotNull())
            .select("user_id", F.lit(APP).alias("app"), F.lit("app_admin").alias("role"),
                    F.lit(CALLER).cast("bigint").alias("granted_by")))


_BATCH_SQL = f"""
, batch as (select user_id, '{APP}' as app, 'app_admin' as role, cast({CALLER} as bigint) as granted_by
            from fx_accounts where last_sign_in_at is not null)"""


@register("s9_apply_defaults", duckdb_ctes("fx_accounts") + f"""
select user_id, '{APP}' as app, 'member' as role, timestamp '{NOW}' as granted_at,
       cast({CALLER} as bigint) as granted_by
from fx_accounts where last_sign_in_at is not null""")
def s9_apply_defaults(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    b = _batch(ws).select("user_id", "app")
    return ch.apply_defaults(b, ch.grant_defaults(_now(), CALLER)).select(
        "user_id", "app", "role", "granted_at", "granted_by")


_UPSERT_SQL = duckdb_ctes("fx_accounts", "fx_grants") + _BATCH_SQL + """
select coalesce(g.user_id, b.user_id) as user_id, coalesce(g.app, b.app) as app,
       case when g.user_id is null then b.role when b.user_id is null then g.role else b.role end as role,
       case when g.user_id is null then timestamp '{now}' else g.granted_at end as granted_at,
       case when g.user_id is null then b.granted_by when b.user_id is null then g.granted_by
            else {conflict_by} end as granted_by
from fx_grants g full outer join batch b on g.user_id = b.user_id and g.app = b.app"""


@register("m1_upsert_role_only", _UPSERT_SQL.format(now=NOW, conflict_by="g.granted_by"))
def m1_upsert_role_only(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.upsert_grants(ws.fx_grants, _batch(ws), "role_only", now=_now(), caller=CALLER)


@register("m2_upsert_merge_all", _UPSERT_SQL.format(now=NOW, conflict_by="b.granted_by"))
def m2_upsert_merge_all(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.upsert_grants(ws.fx_grants, _batch(ws), "merge_all", now=_now(), caller=CALLER)


@register("m3_revoke", duckdb_ctes("fx_grants", "fx_revocations") + """
select g.* from fx_grants g
where not exists (select 1 from fx_revocations r where r.user_id = g.user_id and r.app = g.app)""")
def m3_revoke(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.revoke(ws.fx_grants, ws.fx_revocations)


@register("m3_revoke_report", duckdb_ctes("fx_grants", "fx_revocations") + """
select distinct r.user_id, r.app,
       exists (select 1 from fx_grants g where g.user_id = r.user_id and g.app = r.app) as removed
from fx_revocations r""")
def m3_revoke_report(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.revoke_report(ws.fx_grants, ws.fx_revocations)


def _decisions(ws: Workspace, caller=CALLER):
    return ch.validate_invites(ws.fx_requests, sx.as_invitations(ws.fx_accounts), ws.fx_grants,
                               caller, _now())


_INVITE_CTES = ("fx_requests", "fx_accounts", "fx_grants")
_VALIDATE_SQL = """
, admin as (select exists (select 1 from fx_grants where user_id = {caller} and app = 'platform'
                           and role = 'app_admin') as ok),
  r0 as (select r.*, lower(trim(r.target_email)) as email_clean,
                r.grants is null or coalesce(json_type(case when json_valid(r.grants) then r.grants end), '') = 'ARRAY'
                as is_array
         from fx_requests r),
  ls as (select request_id, case when is_array then coalesce(grants, '[]') else '[]' end as list from r0),
  el0 as (select ls.request_id, x.i, json_extract(ls.list, '$[' || x.i || ']')::varchar as v
          from ls, (select unnest(range(cast(json_array_length(ls.list) as bigint))) as i) x),
  el as (select *, json_extract_string(v, '$.app') as app, json_extract_string(v, '$.role') as role from el0),
  el2 as (select request_id, i,
                 case when app is null or role is null then 'missing_field'
                      when role not in ('member', 'app_admin') then 'unknown_role'
                      when app = 'platform' then 'platform' end as code,
                 case when app is null or role is null then 'each grant needs an app and a role, got ' || v
                      when role not in ('member', 'app_admin') then 'unknown role ' || role
                      when app = 'platform' then 'platform admin cannot be granted by invitation — invite them first, then promote them from the grid'
                 end as reason
          from el),
  firstbad as (select request_id, arg_min(code, i) as ecode, arg_min(reason, i) as ereason
               from el2 where code is not null group by request_id),
  twice as (select distinct request_id from el group by request_id, app having count(*) > 1),
  acct as (select distinct lower(email) as email_clean from fx_accounts),
  pre as (
    select r0.request_id, r0.email_clean, r0.grants,
      case when not (select ok from admin) then 'not_admin'
           when r0.email_clean is null or not regexp_matches(r0.email_clean, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'bad_email'
           when not r0.is_array then 'not_array'
           when fb.ecode is not null then fb.ecode
           when a.email_clean is not null then 'exists'
           when count(*) over (partition by r0.email_clean) > 1 then 'duplicate'
           when r0.request_id in (select request_id from twice) then 'repeated_app' end as reason_code,
      case when not (select ok from admin) then 'not authorised to invite users'
           when r0.email_clean is null or not regexp_matches(r0.email_clean, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'not an email address: ' || r0.target_email
           when not r0.is_array then 'grants must be a json array of {{app, role}}'
           when fb.ecode is not null then fb.ereason
           when a.email_clean is not null then r0.email_clean || ' already has an account — set their access from the grid instead'
           when count(*) over (partition by r0.email_clean) > 1 then 'the same address appears more than once in this batch'
           when r0.request_id in (select request_id from twice) then 'a request may name each app once' end as reason
    from r0 left join firstbad fb on fb.request_id = r0.request_id
            left join acct a on a.email_clean = r0.email_clean),
  recent as (select count(*) as n from fx_accounts where created_at > timestamp '{now}' - interval 1 hour),
  ranked as (select request_id, row_number() over (order by request_id) as rk from pre where reason_code is null),
  fin as (select pre.*, reason_code is null and coalesce(rk, 11) > greatest(10 - (select n from recent), 0) as over_cap
          from pre left join ranked using (request_id))
select request_id, email_clean as email, grants,
       case when over_cap then 'rate_cap' else reason_code end as reason_code,
       case when over_cap then 'too many invitations in the last hour (limit 10) — wait, or send it from the dashboard'
            else reason end as reason,
       reason_code is null and not over_cap as accepted
from fin"""


@register("m4_validate_invites", duckdb_ctes(*_INVITE_CTES) + _VALIDATE_SQL.format(caller=CALLER, now=NOW))
def m4_validate_invites(spark, sf_dir):
    return _decisions(Workspace(spark, sf_dir))


@register("m4_validate_invites_not_admin",
          duckdb_ctes(*_INVITE_CTES) + _VALIDATE_SQL.format(caller=OWNER, now=NOW))
def m4_validate_invites_not_admin(spark, sf_dir):
    return _decisions(Workspace(spark, sf_dir), caller=OWNER)


_APPLY_SQL = _VALIDATE_SQL.replace("\nselect request_id, email_clean as email, grants,", """
, decided as (select request_id, email_clean as email, grants,""", 1) + """
  ), ok as (select d.*, (select max(user_id) from fx_accounts)
                        + row_number() over (order by request_id) as user_id
           from decided d where accepted),
  ng as (select ok.user_id, unnest(from_json(coalesce(ok.grants, '[]'),
                                             '[{{"app":"VARCHAR","role":"VARCHAR"}}]')) as g from ok)
"""


@register("m5_apply_invites_report", duckdb_ctes(*_INVITE_CTES) + _APPLY_SQL.format(caller=CALLER, now=NOW) + """
select ok.user_id, ok.email, cast((select count(*) from ng where ng.user_id = ok.user_id) as integer) as granted
from ok""")
def m5_apply_invites_report(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    report, _, _ = ch.apply_invites(_decisions(ws), ws.fx_accounts, ws.fx_grants, CALLER, _now())
    return report


@register("m5_apply_invites_grants", duckdb_ctes(*_INVITE_CTES) + _APPLY_SQL.format(caller=CALLER, now=NOW) + f"""
, nb as (select user_id, g.app as app, g.role as role, cast({CALLER} as bigint) as granted_by from ng)
select coalesce(o.user_id, b.user_id) as user_id, coalesce(o.app, b.app) as app,
       case when o.user_id is null then b.role when b.user_id is null then o.role else b.role end as role,
       case when o.user_id is null then timestamp '{NOW}' else o.granted_at end as granted_at,
       case when o.user_id is null then b.granted_by else o.granted_by end as granted_by
from fx_grants o full outer join nb b on o.user_id = b.user_id and o.app = b.app""")
def m5_apply_invites_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    _, _, table = ch.apply_invites(_decisions(ws), ws.fx_accounts, ws.fx_grants, CALLER, _now())
    return table


def _targets(ws: Workspace, spark):
    edge = spark.createDataFrame([(None,), (-1,)], "target_id bigint")
    return (ws.fx_sessions.select(F.col("user_id").alias("target_id")).distinct().unionByName(edge))


_TARGETS_SQL = """
, targets as (select distinct user_id as target_id from fx_sessions
              union all select cast(null as bigint) union all select cast(-1 as bigint))"""

_DELETE_BODY = _TARGETS_SQL + """
, admin as (select exists (select 1 from fx_grants where user_id = {caller} and app = 'platform'
                           and role = 'app_admin') as ok),
  padm as (select distinct user_id from fx_grants where app = 'platform' and role = 'app_admin'),
  dec as (
select t.target_id, a.email,
       case when not (select ok from admin) then 'not_admin'
            when t.target_id is null then 'no_id'
            when t.target_id = {caller} then 'self'
            when a.email is null then 'missing'
            when p.user_id is not null then 'admin' end as reason_code,
       case when not (select ok from admin) then 'not authorised to delete accounts'
            when t.target_id is null then 'no account given'
            when t.target_id = {caller} then 'you cannot delete the account you are signed in as'
            when a.email is null then 'no account with that id — reload the page before trying again'
            when p.user_id is not null then a.email || ' administers access rights — remove that first, then delete the account'
       end as reason
from targets t left join (select user_id, case when user_id % 37 <> 5 then email end as email from fx_accounts) a
  on a.user_id = t.target_id
left join padm p on p.user_id = t.target_id)"""


def _delete_sql(caller, *extra):
    return duckdb_ctes("fx_sessions", "fx_accounts", "fx_grants", *extra) + _DELETE_BODY.format(caller=caller)


@register("m6_delete_decisions", _delete_sql(CALLER) + """
select *, reason_code is null as accepted from dec""")
def m6_delete_decisions(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.delete_decisions(_targets(ws, spark), _accounts(ws), ws.fx_grants, CALLER)


def _accounts(ws: Workspace):
    """Accounts of which some have no email."""
    return ws.fx_accounts.withColumn("email", F.when(F.col("user_id") % 37 != 5, F.col("email")))


def _accepted_targets(ws, spark):
    d = ch.delete_decisions(_targets(ws, spark), _accounts(ws), ws.fx_grants, CALLER)
    return d.filter("accepted").select("target_id")


@register("m7_clear_attribution", duckdb_ctes("fx_grants") + f"""
, t as (select distinct user_id as target_id from fx_grants
        where app = 'platform' and role = 'app_admin' and user_id <> {CALLER})
select g.user_id, g.app, g.role, g.granted_at,
       case when t.target_id is not null and g.user_id <> t.target_id then null else g.granted_by end as granted_by
from fx_grants g left join t on g.granted_by = t.target_id""")
def m7_clear_attribution(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    t = acc.platform_admins(ws.fx_grants).filter(F.col("user_id") != CALLER) \
        .select(F.col("user_id").alias("target_id"))
    return ch.clear_attribution(ws.fx_grants, t)


@register("m8_cascade_delete", _delete_sql(CALLER, "fx_personal") + """
, acc_t as (select target_id from dec where reason_code is null)
select p.* from fx_personal p
where not exists (select 1 from acc_t where acc_t.target_id = p.owner_id)""")
def m8_cascade_delete(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.cascade_delete(ws.fx_personal, "owner_id", "c", _accepted_targets(ws, spark))


@register("m8_set_null", _delete_sql(CALLER, "fx_personal") + """
, acc_t as (select target_id from dec where reason_code is null)
select p.row_id, p.app,
       case when exists (select 1 from acc_t where acc_t.target_id = p.owner_id) then null else p.owner_id end as owner_id,
       p.value
from fx_personal p""")
def m8_set_null(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.cascade_delete(ws.fx_personal, "owner_id", "n", _accepted_targets(ws, spark))


@register("m8_blocking_targets", duckdb_ctes("fx_grants", "fx_sessions") + """
select distinct s.user_id as target_id from fx_sessions s
where exists (select 1 from fx_grants g where g.granted_by = s.user_id)""")
def m8_blocking_targets(spark, sf_dir):
    """Targets a no-action key on grants.granted_by would block (before M7 clears it)."""
    ws = Workspace(spark, sf_dir)
    t = ws.fx_sessions.select(F.col("user_id").alias("target_id"))
    return ch.blocking_targets(ws.fx_grants, "granted_by", t)


# deletions along the whole foreign-key graph: people invited by one another, their orders, those orders' lines
_PEOPLE_FKS = [cas.ForeignKey("people", "invited_by", "people", "c"), cas.ForeignKey("orders", "user_id", "people", "c"),
               cas.ForeignKey("lines", "order_id", "orders", "c"), cas.ForeignKey("events", "user_id", "people", "n"),
               cas.ForeignKey("disputes", "order_id", "orders", "r")]
_CASCADE_SQL = duckdb_ctes("fx_people", "fx_people_orders", "fx_people_lines", "fx_people_events",
                           "fx_people_disputes").replace("WITH ", "WITH RECURSIVE ", 1) + """
, asked as (select user_id as root from fx_people where user_id % 9 in (3, 7)),
  walk as (select root, root as user_id from asked
           union select w.root, p.user_id from walk w join fx_people p on p.invited_by = w.user_id),
  refused as (select distinct w.root from walk w join fx_people_orders o on o.user_id = w.user_id
              join fx_people_disputes d on d.order_id = o.order_id),
  gone as (select distinct user_id from walk where root not in (select root from refused)),
  gone_orders as (select order_id from fx_people_orders where user_id in (select user_id from gone))"""


def _cascade(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    tables = {"people": (ws.fx_people, "user_id"), "orders": (ws.fx_people_orders, "order_id"), "lines": (ws.fx_people_lines, None),
              "events": (ws.fx_people_events, None), "disputes": (ws.fx_people_disputes, None)}
    targets = ws.fx_people.filter("user_id % 9 in (3, 7)").select(F.col("user_id").alias("target_id"))
    return cas.cascade_delete(tables, _PEOPLE_FKS, targets, "people")


@register("m8_transitive_decisions", _CASCADE_SQL + """
select root as target_id, root not in (select root from refused) as accepted from asked""")
def m8_transitive_decisions(spark, sf_dir):
    """Targets that a restricting key two levels below refuses, and the others."""
    done = _cascade(spark, sf_dir)
    return (done.accepted.select(F.col("key").alias("target_id"), F.lit(True).alias("accepted"))
            .unionByName(done.refused.select(F.col("key").alias("target_id"), F.lit(False).alias("accepted"))))


@register("m8_transitive_impact", _CASCADE_SQL + """
select 'people' as tbl, 'invited_by' as "column", 'c' as action, 'deleted' as effect,
       (select count(*) from fx_people where invited_by in (select user_id from gone) and invited_by <> user_id) as "rows"
union all select 'orders', 'user_id', 'c', 'deleted', (select count(*) from gone_orders)
union all select 'lines', 'order_id', 'c', 'deleted',
       (select count(*) from fx_people_lines where order_id in (select order_id from gone_orders))
union all select 'events', 'user_id', 'n', 'nulled', (select count(*) from fx_people_events where user_id in (select user_id from gone))
union all select 'disputes', 'order_id', 'r', 'blocks', 0""")
def m8_transitive_impact(spark, sf_dir):
    """Rows each key deletes or clears, at any level, for the accepted targets."""
    return _cascade(spark, sf_dir).impact


@register("m8_transitive_people", _CASCADE_SQL + """
select * from fx_people where user_id not in (select user_id from gone)""")
def m8_transitive_people(spark, sf_dir):
    return _cascade(spark, sf_dir).tables["people"]


@register("m8_transitive_lines", _CASCADE_SQL + """
select * from fx_people_lines where order_id not in (select order_id from gone_orders)""")
def m8_transitive_lines(spark, sf_dir):
    """Three levels below the deleted accounts."""
    return _cascade(spark, sf_dir).tables["lines"]


@register("m8_transitive_events", _CASCADE_SQL + """
select event_id, case when user_id in (select user_id from gone) then null else user_id end as user_id, event_type, value
from fx_people_events""")
def m8_transitive_events(spark, sf_dir):
    """Set null stops the cascade: the rows stay without their owner."""
    return _cascade(spark, sf_dir).tables["events"]


_SIGN_OUT_SQL = duckdb_ctes("fx_sessions", "fx_revocations", "fx_grants") + """
, admin as (select exists (select 1 from fx_grants where user_id = {caller} and app = 'platform'
                           and role = 'app_admin') as ok),
  t as (select distinct user_id from fx_revocations union all select cast(null as bigint)),
  d as (select user_id, case when not (select ok from admin) then 'not_admin'
                             when user_id is null then 'no_id' end as reason_code from t)"""


@register("m9_end_sessions_report", _SIGN_OUT_SQL.format(caller=CALLER) + """
select d.user_id,
       case when reason_code is null then (select count(*) from fx_sessions s where s.user_id = d.user_id)
            else 0 end as sessions_ended,
       case when reason_code is null then (select count(*) from fx_sessions s
                                           where s.user_id_text = cast(d.user_id as varchar)) else 0 end as tokens_revoked,
       reason_code,
       case reason_code when 'not_admin' then 'not authorised to sign other people out'
                        when 'no_id' then 'no account given' end as reason
from d""")
def m9_end_sessions_report(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    report, _, _ = ch.end_sessions(*_sign_out_inputs(ws, spark), grants=ws.fx_grants, caller=CALLER)
    return report


@register("m9_end_sessions_not_admin", _SIGN_OUT_SQL.format(caller=OWNER) + """
select d.user_id, 0 as sessions_ended, 0 as tokens_revoked, reason_code,
       case reason_code when 'not_admin' then 'not authorised to sign other people out'
                        when 'no_id' then 'no account given' end as reason
from d""")
def m9_end_sessions_not_admin(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    report, _, _ = ch.end_sessions(*_sign_out_inputs(ws, spark), grants=ws.fx_grants, caller=OWNER)
    return report


def _sign_out_inputs(ws: Workspace, spark):
    s = ws.fx_sessions
    t = ws.fx_revocations.select(F.col("user_id").alias("target_id")).unionByName(
        spark.createDataFrame([(None,)], "target_id bigint"))
    return s, s.select("session_id", "user_id_text"), t


@register("m9_remaining_sessions", duckdb_ctes("fx_sessions", "fx_revocations") + """
select s.* from fx_sessions s where s.user_id not in (select user_id from fx_revocations)""")
def m9_remaining_sessions(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    _, rest, _ = ch.end_sessions(*_sign_out_inputs(ws, spark), grants=ws.fx_grants, caller=CALLER)
    return rest


def _changes(ws: Workspace):
    g = ws.fx_grants
    flips = g.select(F.concat(F.lit("g:"), F.col("user_id").cast("string"), F.lit(":"), "app").alias("change_id"),
                     "user_id", "app",
                     F.when(F.col("role") == "member", F.lit("app_admin")).alias("role"))
    revs = ws.fx_revocations.select(
        F.concat(F.lit("r:"), F.col("user_id").cast("string"), F.lit(":"), "app").alias("change_id"),
        "user_id", "app", F.lit(None).cast("string").alias("role"))
    promos = ws.fx_accounts.filter(F.col("last_sign_in_at").isNull()).select(
        F.concat(F.lit("p:"), F.col("user_id").cast("string")).alias("change_id"),
        "user_id", F.lit(acc.PLATFORM).alias("app"), F.lit(acc.ADMIN).alias("role"))
    return flips.unionByName(revs).unionByName(promos)


_CHANGES_SQL = duckdb_ctes("fx_grants", "fx_revocations", "fx_accounts") + """
, changes as (
  select 'g:' || cast(user_id as varchar) || ':' || app as change_id, user_id, app,
         case when role = 'member' then 'app_admin' end as role from fx_grants
  union all
  select 'r:' || cast(user_id as varchar) || ':' || app, user_id, app, cast(null as varchar) from fx_revocations
  union all
  select 'p:' || cast(user_id as varchar), user_id, 'platform', 'app_admin' from fx_accounts
  where last_sign_in_at is null),
  admin as (select count(*) > 0 as ok from fx_grants where user_id = {caller} and app = 'platform' and role = 'app_admin'),
  j as (select c.*, g.role as current_role, count(*) over (partition by c.user_id, c.app) as times
        from changes c left join fx_grants g on g.user_id = c.user_id and g.app = c.app),
  o as (select *, case when not (select ok from admin) then 'not_admin'
                       when times > 1 then 'duplicate'
                       when role is not distinct from current_role then 'no-op'
                       when user_id = {caller} and app = 'platform' and role is null then 'refused'
                       when app = 'platform' and role = 'app_admin' and user_id <> {caller} then 'needs_confirmation'
                       else 'apply' end as outcome from j)
select change_id, user_id, app, role, current_role, outcome,
       outcome = 'apply' and role is null and user_id <> {caller} as end_sessions
from o"""


@register("m10_decide_changes", _CHANGES_SQL.format(caller=CALLER))
def m10_decide_changes(spark, sf_dir):
    """Some (user, app) are both changed and revoked: all of those are duplicates."""
    ws = Workspace(spark, sf_dir)
    return ch.decide_changes(_changes(ws), ws.fx_grants, CALLER)


@register("m10_decide_changes_not_admin", _CHANGES_SQL.format(caller=OWNER))
def m10_decide_changes_not_admin(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.decide_changes(_changes(ws), ws.fx_grants, OWNER)


def _probe_rows(ws: Workspace):
    """Rows caller 6 inserts into the `view` table: their own `signup` rows, re-keyed."""
    return (ws.fx_personal.filter((F.col("app") == "signup") & (F.col("owner_id") == OWNER))
            .select((F.col("row_id") + 1_000_000_000).alias("row_id"), F.lit(APP).alias("app"),
                    "owner_id", "value"))


@register("m11_governed_insert", duckdb_ctes("fx_personal") + f"""
select * from fx_personal where app = '{APP}'
union all
select row_id + 1000000000, '{APP}', owner_id, value from fx_personal
where app = 'signup' and owner_id = {OWNER}""")
def m11_governed_insert(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    return ch.governed_insert(base, _probe_rows(ws), ws.fx_grants, "personal", APP, OWNER, "owner_id")


@register("m11_insert_violations", duckdb_ctes("fx_personal", "fx_grants") + f"""
select row_id + 1000000000 as row_id, '{APP}' as app, owner_id, value from fx_personal
where app = 'signup' and owner_id = {OWNER}
  and not (exists (select 1 from fx_grants where user_id = {MEMBER} and app = '{APP}')
           and owner_id is not distinct from {MEMBER})""")
def m11_insert_violations(spark, sf_dir):
    """Caller 0 trying to insert caller 6's rows: every one would be refused."""
    ws = Workspace(spark, sf_dir)
    return ch.governed_insert_violations(_probe_rows(ws), ws.fx_grants, "personal", APP, MEMBER, "owner_id")


_UPD_WHERE = "value > 10"


@register("m12_governed_update", duckdb_ctes("fx_personal", "fx_grants") + f"""
select row_id, app, owner_id,
       case when value > 10 and exists (select 1 from fx_grants where user_id = {MEMBER} and app = '{APP}')
                 and owner_id is not distinct from {MEMBER} then value * 2 else value end as value
from fx_personal where app = '{APP}'""")
def m12_governed_update(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    out, _ = ch.governed_update(base, ws.fx_grants, "personal", APP, MEMBER, F.expr(_UPD_WHERE),
                                {"value": F.col("value") * 2}, ws.fx_policies, "rel_1", "owner_id")
    return out


@register("m12_update_affected", duckdb_ctes("fx_personal", "fx_grants") + f"""
select count(*) as affected from fx_personal
where app = '{APP}' and value > 10 and owner_id = {MEMBER}
  and exists (select 1 from fx_grants where user_id = {MEMBER} and app = '{APP}')""")
def m12_update_affected(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    _, n = ch.governed_update(base, ws.fx_grants, "personal", APP, MEMBER, F.expr(_UPD_WHERE),
                              {"value": F.col("value") * 2}, ws.fx_policies, "rel_1", "owner_id")
    return n


@register("m12_update_violations", duckdb_ctes("fx_personal", "fx_grants") + f"""
select row_id, app, cast({OWNER} as bigint) as owner_id, value from fx_personal
where app = '{APP}' and value > 10 and owner_id = {MEMBER}
  and exists (select 1 from fx_grants where user_id = {MEMBER} and app = '{APP}')""")
def m12_update_violations(spark, sf_dir):
    """Caller 0 giving their rows to caller 6: every new row would be refused."""
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    return ch.governed_update_violations(base, ws.fx_grants, "personal", APP, MEMBER, F.expr(_UPD_WHERE),
                                         {"owner_id": F.lit(OWNER)}, ws.fx_policies, "rel_1", "owner_id")


@register("m12_update_no_policy", duckdb_ctes("fx_personal") + f"""
select row_id, app, owner_id, value from fx_personal where app = '{APP}'""")
def m12_update_no_policy(spark, sf_dir):
    """Table rel_2 has only a SELECT policy: the update changes nothing."""
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    out, _ = ch.governed_update(base, ws.fx_grants, "personal", APP, MEMBER, F.expr(_UPD_WHERE),
                                {"value": F.col("value") * 2}, ws.fx_policies, "rel_2", "owner_id")
    return out


@register("m12_update_files", duckdb_ctes("fx_personal", "fx_grants") + f"""
select row_id, app, owner_id,
       case when value > 10 and exists (select 1 from fx_grants where user_id = {MEMBER} and app = '{APP}')
                 and owner_id is not distinct from {MEMBER} then value * 2 else value end as value
from fx_personal where app = '{APP}'""")
def m12_update_files(spark, sf_dir):
    """The governed update on a table of files in order of row_id: only files with a changed row are rewritten."""
    ws = Workspace(spark, sf_dir)
    root = pub.scratch_path(spark, "files")
    ft.create(ws.fx_personal.filter(F.col("app") == APP), root, "row_id", files=16)
    fc.governed_update(spark, root, ws.fx_grants, "personal", APP, MEMBER, F.expr(_UPD_WHERE),
                       {"value": F.col("value") * 2}, ws.fx_policies, "rel_1", "owner_id")
    return ft.read(spark, root)


_DEL_SQL = duckdb_ctes("fx_personal", "fx_grants", "fx_policies") + f"""
select count(*) as affected from fx_personal
where app = '{APP}' and value > 10
  and exists (select 1 from fx_grants where user_id = {OWNER} and app = '{APP}')
  and owner_id = {OWNER}
  and exists (select 1 from fx_policies where tablename = '{{table}}' and upper(cmd) in ('DELETE', 'ALL'))"""


@register("m12_delete_blocked", _DEL_SQL.replace("{table}", "rel_2"))
def m12_delete_blocked(spark, sf_dir):
    """Table rel_2 has only a SELECT policy: the delete affects nothing."""
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    _, n = ch.governed_delete(base, ws.fx_grants, "personal", APP, OWNER, F.expr(_UPD_WHERE),
                              ws.fx_policies, "rel_2", "owner_id")
    return n


@register("m12_delete_allowed", _DEL_SQL.replace("{table}", "rel_1"))
def m12_delete_allowed(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    base = ws.fx_personal.filter(F.col("app") == APP)
    _, n = ch.governed_delete(base, ws.fx_grants, "personal", APP, OWNER, F.expr(_UPD_WHERE),
                              ws.fx_policies, "rel_1", "owner_id")
    return n


@register("m14_mark_instead_of_delete", duckdb_ctes("fx_claims") + """
select id, person, service, service_date, tax_year, amount_submitted, amount_paid, insurer,
       case when flag_status = 'suspected' then 'duplicate' else status end as status,
       flag_status, note, created_at
from fx_claims""")
def m14_mark_instead_of_delete(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    c = ws.fx_claims
    return ch.mark_instead_of_delete(c, c.filter(F.col("flag_status") == "suspected"), "id", "duplicate")


@register("m14_mark_files", duckdb_ctes("fx_claims") + """
select id, person, service, service_date, tax_year, amount_submitted, amount_paid, insurer,
       case when flag_status = 'suspected' then 'duplicate' else status end as status,
       flag_status, note, created_at
from fx_claims""")
def m14_mark_files(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    root = pub.scratch_path(spark, "files")
    ft.create(ws.fx_claims, root, "id", files=16)
    fc.mark(spark, root, ws.fx_claims.filter(F.col("flag_status") == "suspected"), "duplicate")
    return ft.read(spark, root)


@register("m15_backfill_owner", duckdb_ctes("fx_personal") + f"""
select row_id, app, coalesce(owner_id, {CALLER}) as owner_id, value from fx_personal""")
def m15_backfill_owner(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.backfill_owner(ws.fx_personal, "owner_id", CALLER)


def _new_verdicts(ws: Workspace):
    m = ws.fx_matches
    rescored = m.filter(F.col("user_id") == 1).select(
        "posting_id", "user_id", ((F.col("score") + 7) % 101).alias("score"))
    fresh = ws.documents.filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("posting_id"), F.lit(2).cast("bigint").alias("user_id"),
        (F.col("doc_id") % 101).alias("score"))
    return rescored.unionByName(fresh)


@register("m16_upsert_verdicts", duckdb_ctes("fx_matches") + """
, nv as (select posting_id, user_id, (score + 7) % 101 as score from fx_matches where user_id = 1
         union all select doc_id, 2, doc_id % 101 from documents where doc_id % 3 = 0)
select coalesce(m.posting_id, n.posting_id) as posting_id, coalesce(m.user_id, n.user_id) as user_id,
       case when n.posting_id is null then m.score else n.score end as score
from fx_matches m full outer join nv n on m.posting_id = n.posting_id and m.user_id = n.user_id""")
def m16_upsert_verdicts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ch.upsert(ws.fx_matches, _new_verdicts(ws), ("posting_id", "user_id"), ["score"], what="verdict")


@register("m16_upsert_files", duckdb_ctes("fx_matches") + """
, nv as (select posting_id, user_id, (score + 7) % 101 as score from fx_matches where user_id = 1
         union all select doc_id, 2, doc_id % 101 from documents where doc_id % 3 = 0)
select coalesce(m.posting_id, n.posting_id) as posting_id, coalesce(m.user_id, n.user_id) as user_id,
       case when n.posting_id is null then m.score else n.score end as score
from fx_matches m full outer join nv n on m.posting_id = n.posting_id and m.user_id = n.user_id""")
def m16_upsert_files(spark, sf_dir):
    """The same upsert on a table of files in order of (user_id, posting_id)."""
    ws = Workspace(spark, sf_dir)
    root = pub.scratch_path(spark, "files")
    ft.create(ws.fx_matches, root, ("user_id", "posting_id"), files=16)
    fc.upsert(spark, root, _new_verdicts(ws), ["score"])
    return ft.read(spark, root)


@register("m17_dismiss", duckdb_ctes("fx_dismissed", "fx_matches") + """
select distinct posting_id, user_id from (
  select posting_id, user_id from fx_dismissed
  union all select posting_id, user_id from fx_matches where score < 5)""")
def m17_dismiss(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    new = ws.fx_matches.filter(F.col("score") < 5).select("posting_id", "user_id")
    return ch.dismiss(ws.fx_dismissed, new)
