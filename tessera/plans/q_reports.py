"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import reports as rp
from tessera.plans.fixtures import Workspace, duckdb_ctes
from tessera.plans.registry import register


@register("j1_who_reaches_what", duckdb_ctes("fx_accounts", "fx_grants") + """
select u.email, a.app, a.role, a.granted_at
from fx_grants a join fx_accounts u on u.user_id = a.user_id
order by a.app, u.email""")
def j1_who_reaches_what(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.who_reaches_what(ws.fx_grants, ws.fx_accounts)


@register("j2_access_grid", duckdb_ctes("fx_accounts", "fx_grants") + """
select a.user_id, a.email, '{' || coalesce(string_agg('"' || g.app || '":"' || g.role || '"', ',' order by g.app), '') || '}'
       as roles
from fx_accounts a left join fx_grants g on g.user_id = a.user_id and g.app <> 'platform'
group by a.user_id, a.email""")
def j2_access_grid(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    apps = rp.app_list(ws.fx_app_catalog, ws.fx_grants)
    return rp.access_grid(ws.fx_accounts, apps, ws.fx_grants).withColumn("roles", F.to_json("roles"))


@register("j2_access_grid_wide", duckdb_ctes("fx_accounts", "fx_grants") + """
select a.user_id, a.email,
       max(case when g.app = 'click' then g.role end) as click,
       max(case when g.app = 'error' then g.role end) as error,
       max(case when g.app = 'purchase' then g.role end) as purchase,
       max(case when g.app = 'signup' then g.role end) as signup,
       max(case when g.app = 'view' then g.role end) as view
from fx_accounts a left join fx_grants g on g.user_id = a.user_id
group by a.user_id, a.email""")
def j2_access_grid_wide(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.access_columns(ws.fx_accounts, ws.fx_grants, ["click", "error", "purchase", "signup", "view"])


@register("j3_app_list", duckdb_ctes("fx_grants", "fx_app_catalog") + """
, both_ as (
  select app, name, url, 0 as grp, cast(null as varchar) as note from fx_app_catalog
  union all
  select distinct app, app as name, cast(null as varchar) as url, 1 as grp, 'not listed in this page' as note
  from fx_grants where app <> 'platform' and app not in (select app from fx_app_catalog))
select row_number() over (order by grp, app) as position, app, name, url, note from both_""")
def j3_app_list(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.app_list(ws.fx_app_catalog, ws.fx_grants)


@register("j4_resolve_apps", duckdb_ctes("fx_grants", "fx_app_catalog") + """
select g.user_id, g.app, g.role, coalesce(c.name, g.app) as app_name, c.url as app_url
from fx_grants g left join fx_app_catalog c on c.app = g.app""")
def j4_resolve_apps(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.resolve_apps(ws.fx_grants.select("user_id", "app", "role"), ws.fx_app_catalog)


@register("j4_link_labels", duckdb_ctes("fx_app_catalog") + """
select app, regexp_replace(url, '^https?://', '') as link_label from fx_app_catalog""")
def j4_link_labels(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ws.fx_app_catalog.select("app", sx.strip_scheme("url").alias("link_label"))


@register("a6_account_summary", duckdb_ctes("fx_accounts", "fx_grants") + """
, per as (select user_id, count(case when app <> 'platform' then 1 end) as n_apps,
                 bool_or(app = 'platform' and role = 'app_admin') as is_admin
          from fx_grants group by user_id)
select a.user_id, a.email, coalesce(p.n_apps, 0) as n_apps, coalesce(p.is_admin, false) as is_admin,
       (case when coalesce(p.n_apps, 0) = 0 then 'no access'
             when p.n_apps = 1 then '1 app' else cast(p.n_apps as varchar) || ' apps' end)
       || ' · ' ||
       (case when a.last_sign_in_at is null then 'never signed in'
             else 'last sign-in ' || substr(cast(a.last_sign_in_at as varchar), 1, 10) end) as summary
from fx_accounts a left join per p on p.user_id = a.user_id""")
def a6_account_summary(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.account_summary(ws.fx_accounts, ws.fx_grants)


@register("a7_invite_report", duckdb_ctes("fx_accounts", "fx_grants") + """
select u.email, u.created_at as invited_at, u.last_sign_in_at is not null as accepted,
       string_agg(a.app || ':' || a.role, ', ' order by a.app) as access
from fx_accounts u
left join fx_grants a on a.user_id = u.user_id
where u.created_at is not null
group by u.user_id, u.email, u.created_at, u.last_sign_in_at
order by u.created_at desc""")
def a7_invite_report(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.invite_report(sx.as_invitations(ws.fx_accounts), ws.fx_grants)


@register("a8_flatten_apps", duckdb_ctes("fx_requests", "fx_app_catalog") + """
, ls as (select request_id, grants, grants is null or coalesce(
              json_type(case when json_valid(grants) then grants end), '') = 'ARRAY' as well from fx_requests),
  ex as (select request_id, unnest(json_extract(grants, '$[*]')) as g from ls where well and grants is not null),
  res as (select ex.request_id, coalesce(c.name, ex.app) as name, c.url as url, ex.role as role
          from (select request_id, json_extract_string(g, '$.app') as app, json_extract_string(g, '$.role') as role from ex) ex
          left join fx_app_catalog c on c.app = ex.app where ex.app is not null or ex.role is not null)
select r.request_id,
       case when r.well then coalesce((select to_json(list({'name': res.name, 'url': res.url, 'role': res.role}
                                    order by res.name, res.url, res.role))
                 from res where res.request_id = r.request_id)::varchar, '[]') end as apps,
       (select string_agg(res.name || coalesce(' — ' || res.url, ''), chr(10) order by res.name, res.url, res.role)
        from res where res.request_id = r.request_id) as app_list
from ls r""")
def a8_flatten_apps(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return rp.flatten_apps(ws.fx_requests, ws.fx_app_catalog)


@register("link_params", """
, parts as (select page_id,
                   regexp_extract(url, '#(.*)$', 1) as frag,
                   regexp_extract(url, '^[^#?]*[?]([^#]*)', 1) as q from pages),
  items as (select page_id, 0 as priority, unnest(string_split(frag, '&')) as kv,
                   unnest(generate_series(1, len(string_split(frag, '&')))) as pos from parts
            union all
            select page_id, 1, unnest(string_split(q, '&')), unnest(generate_series(1, len(string_split(q, '&'))))
            from parts),
  kv as (select page_id, priority, pos,
                url_decode(replace(split_part(kv, '=', 1), '+', ' ')) as key,
                url_decode(replace(case when strpos(kv, '=') > 0 then substr(kv, strpos(kv, '=') + 1) else '' end,
                                   '+', ' ')) as value
         from items where kv <> '')
select page_id, key, arg_min(value, priority * 1000000 + pos) as value from kv group by page_id, key""".replace(
    "\n, parts as", "WITH parts as", 1))
def link_params(spark, sf_dir):
    """Link parameters as the invitation landing page reads them (R)."""
    return sx.link_params(Workspace(spark, sf_dir).pages, "page_id", "url")


@register("invite_links", """
select page_id, 'https://auth.example.com/invite?redirect_to=' || url_encode(url) as link from pages""")
def invite_links(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ws.pages.select("page_id", sx.invite_link("https://auth.example.com/invite", "url").alias("link"))
