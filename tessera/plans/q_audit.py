"""Registered audit queries.

The twins don't read the snapshot views: they state, from the numbers that each
fixture row is made of (``p_partkey`` as p, ``p_size`` as z), which rows a
correct audit must report. Facts used below: p % 17 = 3 is a platform schema; z % 3 = 0 is a
plain table, else a view; p % 13 = 0 has row security off; p % 5 below 2 has no
(or a false) invoker option; p % 4 = 0 is readable by anon.
"""

from __future__ import annotations

from tessera.operators import audit as au
from tessera.plans.fixtures import Workspace
from tessera.plans.registry import register

TARGET = "users"

_P = "WITH f as (select p_partkey as p, p_size as z, 'rel_' || p_partkey as rel from part)\n"
_OWN = "p % 17 <> 3"                          # in the audited schema
_TABLE_OFF = "z % 3 = 0 and p % 13 = 0"       # plain table, row security off
_VIEW_OPEN = "z % 3 > 0 and p % 5 < 2"        # view that reads as its owner


@register("c1_tables_without_rls", _P + f"select rel as table_without_rls from f where {_OWN} and {_TABLE_OFF}")
def c1_tables_without_rls(spark, sf_dir):
    return au.tables_without_rls(Workspace(spark, sf_dir).fx_relations)


# A policy's USING text is absent for p % 6 = 0, `true` for 1, a role test for 2; its check text is
# absent for p % 5 = 0 and `true` for 1. What is left is the ordinary access test.
_CMD = "if(p % 2 = 0, 'SELECT', 'ALL')"
_USING = "['has_app_access(view)', 'true', 'auth.role() = authenticated']"
_EXPR = (f"if(p % 6 > 0, {_USING}[if(p % 6 > 2, 0, p % 6) + 1], if(p % 5 = 0, null, {_USING}[if(p % 5 = 1, 1, 0) + 1]))")
_OPEN = "(p % 6 in (1, 2) or (p % 6 = 0 and p % 5 < 2))"


@register("c2_open_policies", _P + f"""select rel as tablename, 'policy_' || p as policyname, {_CMD} as cmd,
       {_EXPR} as expr from f where {_OWN} and {_OPEN}""")
def c2_open_policies(spark, sf_dir):
    return au.open_policies(Workspace(spark, sf_dir).fx_policies)


@register("c2_open_policies_strict", _P + f"""select rel as tablename, 'policy_' || p as policyname, {_CMD} as cmd,
       {_EXPR} as expr from f where {_OWN} and (p % 6 < 3 or p % 5 = 1)""")
def c2_open_policies_strict(spark, sf_dir):
    return au.open_policies(Workspace(spark, sf_dir).fx_policies, strict=True)


@register("c3_bypassing_views", _P + f"""select rel as view_bypassing_rls, null::varchar as owner
from f where {_OWN} and {_VIEW_OPEN}""")
def c3_bypassing_views(spark, sf_dir):
    return au.bypassing_views(Workspace(spark, sf_dir).fx_relations)


@register("c3_bypassing_views_all_schemas", _P + f"""select rel as view_bypassing_rls, null::varchar as owner
from f where {_VIEW_OPEN}""")
def c3_bypassing_views_all_schemas(spark, sf_dir):
    return au.bypassing_views(Workspace(spark, sf_dir).fx_relations, schema=None)


_WHY = f"if(z % 3 = 0, '{au.WHY_RLS_OFF}', '{au.WHY_VIEW}')"


@register("c4_anon_unprotected", _P + f"""select rel as unprotected_and_readable_by_anon, {_WHY} as why
from f where {_OWN} and p % 4 = 0 and if(z % 3 = 0, p % 13 = 0, p % 5 < 2)""")
def c4_anon_unprotected(spark, sf_dir):
    return au.anon_unprotected(Workspace(spark, sf_dir).fx_relations)


# Functions: every third runs as its owner, every eighth is open to anon, p % 7 below 2 has no pinned
# path, and p % 11 = 5 is in another schema.
_FN = "p % 3 = 0 and p % 11 <> 5"
_FN_WHY = f"if(p % 8 = 0, '{au.WHY_ANON}', '{au.WHY_PATH}')"
_CONFIG = "if(p % 7 = 0, null, 'work_mem=1MB' || if(p % 7 = 1, '', ', search_path=public, pg_temp'))"


@register("c5_unsafe_definer_functions", _P + f"""select 'fn_' || p as definer_function, null::varchar as args,
       {_FN_WHY} as why from f where {_FN} and (p % 8 = 0 or p % 7 < 2)""")
def c5_unsafe_definer_functions(spark, sf_dir):
    return au.unsafe_definer_functions(Workspace(spark, sf_dir).fx_functions)


@register("c6_definer_listing", _P + f"""select 'fn_' || p as proname, null::varchar as args, {_CONFIG} as config
from f where {_FN}""")
def c6_definer_listing(spark, sf_dir):
    return au.definer_listing(Workspace(spark, sf_dir).fx_functions)


EXPECTED_DEFINERS = ["fn_3", "fn_6", "fn_9", "fn_12"]


@register("c6_unexpected_definers", _P + f"""select 'fn_' || p as proname, null::varchar as args, {_CONFIG} as config
from f where {_FN} and p not in (3, 6, 9, 12)""")
def c6_unexpected_definers(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    expected = spark.createDataFrame([(x,) for x in EXPECTED_DEFINERS], "proname string")
    return au.unexpected_definers(ws.fx_functions, expected)


@register("c7_view_listing", _P + f"""select rel as relname, ['NOT SET', 'false', 'on', 'true', 'true'][p % 5 + 1] as invoker,
       p % 4 = 0 as anon_can_read, null::varchar as owner from f where {_OWN} and z % 3 > 0""")
def c7_view_listing(spark, sf_dir):
    return au.view_listing(Workspace(spark, sf_dir).fx_relations)


@register("c8_policy_listing", _P + f"""select if({_OWN}, 'public', 'platform') as schemaname, rel as tablename,
       'policy_' || p as policyname, {_CMD} as cmd, null::varchar as roles from f""")
def c8_policy_listing(spark, sf_dir):
    return au.policy_listing(Workspace(spark, sf_dir).fx_policies)


@register("c9_run_audit", _P + f""", checks as (
  select unnest([
    if({_OWN} and {_TABLE_OFF}, {{'check': 'tables_without_rls', 'object': rel, 'reason': '{au.WHY_RLS_OFF}'}}, null),
    if({_OWN} and {_OPEN}, {{'check': 'open_policies', 'object': rel || '.policy_' || p,
                             'reason': coalesce({_EXPR}, 'true')}}, null),
    if({_OWN} and {_VIEW_OPEN}, {{'check': 'bypassing_views', 'object': rel, 'reason': '{au.WHY_VIEW}'}}, null),
    if({_OWN} and p % 4 = 0 and if(z % 3 = 0, p % 13 = 0, p % 5 < 2),
       {{'check': 'anon_unprotected', 'object': rel, 'reason': {_WHY}}}, null),
    if({_FN} and (p % 8 = 0 or p % 7 < 2),
       {{'check': 'unsafe_definer_functions', 'object': 'fn_' || p, 'reason': {_FN_WHY}}}, null)]) as c from f)
select c.check as "check", c.object as object, c.reason as reason from checks where c is not null""")
def c9_run_audit(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return au.run_audit(ws.fx_relations, ws.fx_policies, ws.fx_functions)


# Keys: even p refer to the accounts, always by column 1, and by column 2 unless p % 3 = 0. Column 1 is
# called user_id, owner_id, created_by, title in turn; column 2 exists for p % 3 = 1 and is granted_by.
_ACTIONS = "[" + ", ".join(f"'{au.FK_ACTION_TEXT[k]}'" for k in "cndra") + "]"
_COLUMN = "['user_id', 'owner_id', 'created_by', 'title'][p % 4 + 1]"


@register("j8_fk_effects", _P + f"""
select if({_OWN}, 'public', 'platform') as schemaname, rel as referencing_table, unnest(
         if(p % 3 = 1, [{_COLUMN}, 'granted_by'], [{_COLUMN}])) as column_name, {_ACTIONS}[p % 5 + 1] as what_happens
from f where p % 2 = 0""")
def j8_fk_effects(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return au.fk_effects(ws.fx_foreign_keys, ws.fx_columns, TARGET)


_UNLINKED = """select rel as table_name, 'owner_id' as column_name from f where {own} and p % 4 = 1
union all
select rel, 'granted_by' from f where {own} and p % 6 = 1"""


@register("j9_unlinked_owner_columns", _P + _UNLINKED.format(own=_OWN))
def j9_unlinked_owner_columns(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return au.unlinked_owner_columns(ws.fx_columns, ws.fx_foreign_keys, None, TARGET)


@register("j9_unlinked_owner_columns_plain", _P + _UNLINKED.format(own=f"{_OWN} and z % 3 = 0"))
def j9_unlinked_owner_columns_plain(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return au.unlinked_owner_columns(ws.fx_columns, ws.fx_foreign_keys, ws.fx_relations, TARGET)
