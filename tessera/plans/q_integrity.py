"""Registered integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import changes as ch
from tessera.operators import hashtree as ht
from tessera.operators import integrity as ig
from tessera.operators import reconcile as rec
from tessera.plans.fixtures import BASE_TABLES, Workspace, duckdb_ctes
from tessera.plans.registry import register

# The claims vocabularies (not enforced, only profiled).
STATUS_VOCAB = ("active", "duplicate", "excluded")
FLAG_VOCAB = ("suspected", "confirmed_duplicate", "rejected_not_duplicate")  # and NULL
CLAIM_COLS = ("id", "person", "service", "service_date", "tax_year", "amount_submitted", "amount_paid",
              "insurer", "status", "flag_status", "note", "created_at")
CLAIM_TS = ("created_at",)
DUP_KEYS = ("person", "amount_submitted", "service_date")
CALLER = 0


def _line_sql(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    parts = []
    for c in CLAIM_COLS:
        v = f"strftime({p}{c}, '%Y-%m-%d %H:%M:%S.%f')" if c in CLAIM_TS else f"cast({p}{c} as varchar)"
        parts.append(f"coalesce({v}, '~NULL~')")
    return "concat_ws('|', " + ", ".join(parts) + ")"


def _digest_sql(line: str) -> str:
    halves = [f"cast(coalesce(sum(('0x' || substr(md5({line}), {at}, 16))::ubigint), 0) as varchar)" for at in (1, 17)]
    return f"{halves[0]} || ':' || {halves[1]}"


def _bucket_sql(key: str) -> str:
    return f"(('0x' || substr(md5(cast({key} as varchar)), 1, 8))::BIGINT % {ig.CHECKSUM_BUCKETS})"


@register("s10_check_grants", duckdb_ctes("fx_grants") + """
select 'duplicate_key' as "constraint", cast(user_id as varchar) || '|' || app as key, 'user_id,app' as "column",
       cast(count(*) as varchar) as value
from fx_grants group by user_id, app having count(*) > 1
union all
select 'not_null', coalesce(cast(user_id as varchar), '~NULL~') || '|' || coalesce(app, '~NULL~'), c, null
from fx_grants, (values ('role'), ('granted_at'), ('user_id'), ('app')) t(c)
where (c = 'role' and role is null) or (c = 'granted_at' and granted_at is null)
   or (c = 'user_id' and user_id is null) or (c = 'app' and app is null)
union all
select 'domain', cast(user_id as varchar) || '|' || app, 'role', role from fx_grants
where role is not null and role not in ('member', 'app_admin')""")
def s10_check_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.check_constraints(ws.fx_grants, pk=("user_id", "app"), not_null=("role", "granted_at"),
                                domains={"role": ("member", "app_admin")})


@register("s10_check_request_grants", duckdb_ctes("fx_requests") + """
, ls as (select request_id, grants, coalesce(json_type(case when json_valid(grants) then grants end), '') = 'ARRAY' as well
         from fx_requests where grants is not null),
  ex as (select request_id, unnest(json_extract(grants, '$[*]')) as g from ls where well),
  e as (select request_id, json_extract_string(g, '$.app') as app, json_extract_string(g, '$.role') as role from ex)
select 'not_null' as "constraint", cast(request_id as varchar) as key, 'role' as "column",
       cast(null as varchar) as value
from e where role is null
union all
select 'not_null', cast(request_id as varchar), 'app', null from e where app is null
union all
select 'domain', cast(request_id as varchar), 'role', role from e
where role is not null and role not in ('member', 'app_admin')
union all
select 'not_null', cast(request_id as varchar), 'grant_list', null from ls where not well""")
def s10_check_request_grants(spark, sf_dir):
    """Entries against their rules; a list that is no well-formed array is a missing list."""
    ws = Workspace(spark, sf_dir)
    given = ws.fx_requests.filter(F.col("grants").isNotNull()).select(
        "request_id", sx.grant_entries("grants").alias("grant_list"))
    e = given.select("request_id", F.explode("grant_list").alias("g")).select("request_id", "g.app", "g.role")
    return ig.check_constraints(e, key_cols=("request_id",), not_null=("role", "app"),
                                domains={"role": ("member", "app_admin")}).unionByName(
        ig.check_constraints(given, key_cols=("request_id",), not_null=("grant_list",)))


@register("s10_duplicate_line_keys", duckdb_ctes("fx_claim_lines") + """
select 'duplicate_key' as "constraint", coalesce(cast(l_orderkey as varchar), '~NULL~') || '|' || coalesce(cast(l_linenumber as varchar), '~NULL~') as key,
       'l_orderkey,l_linenumber' as "column", cast(count(*) as varchar) as value
from fx_claim_lines group by l_orderkey, l_linenumber having count(*) > 1
union all
select 'not_null', coalesce(cast(l_orderkey as varchar), '~NULL~') || '|' || coalesce(cast(l_linenumber as varchar), '~NULL~'), c, null
from fx_claim_lines, (values ('l_orderkey'), ('l_linenumber')) t(c)
where (c = 'l_orderkey' and l_orderkey is null) or (c = 'l_linenumber' and l_linenumber is null)""")
def s10_duplicate_line_keys(spark, sf_dir):
    """Every violation of the lines' key."""
    return ig.check_constraints(Workspace(spark, sf_dir).fx_claim_lines, pk=("l_orderkey", "l_linenumber"))


@register("s11_vocabulary_profile", duckdb_ctes("fx_claims") + f"""
, long as (select 'status' as "column", status as value from fx_claims
           union all select 'flag_status', flag_status from fx_claims)
select "column", value, count(*) as n,
       ("column" = 'status' and value in {STATUS_VOCAB!r})
       or ("column" = 'flag_status' and (value is null or value in {FLAG_VOCAB!r})) as listed
from long group by "column", value""")
def s11_vocabulary_profile(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    known = spark.createDataFrame([("status", v) for v in STATUS_VOCAB]
                                  + [("flag_status", v) for v in FLAG_VOCAB + (None,)],
                                  "column string, value string")
    return ig.vocabulary_profile(ws.fx_claims, ["status", "flag_status"], known)


@register("a1_exact_counts", "\nunion all\n".join(
    f"select '{t}' as tbl, count(*) as n from {t}" for t in sorted(BASE_TABLES)))
def a1_exact_counts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.exact_counts({t: ws.table(t) for t in BASE_TABLES})


_DIFF_SQL = duckdb_ctes("fx_counts_old", "fx_counts_new") + """
, d as (select coalesce(o.tbl, w.tbl) as tbl, o.n as old_n, w.n as new_n
        from fx_counts_old o full outer join fx_counts_new w on o.tbl = w.tbl
        where o.n is distinct from w.n)"""


@register("a2_diff_counts", _DIFF_SQL + "\nselect * from d")
def a2_diff_counts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.diff_counts(ws.fx_counts_old, ws.fx_counts_new)


@register("a2_diff_verdict", _DIFF_SQL + """
select case when count(*) = 0 then 'PASS' else 'FAIL' end as verdict, count(*) as differing from d""")
def a2_diff_verdict(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.diff_verdict(ig.diff_counts(ws.fx_counts_old, ws.fx_counts_new))


@register("a2_diff_verdict_same", duckdb_ctes("fx_counts_old") + """
select 'PASS' as verdict, cast(0 as bigint) as differing from fx_counts_old limit 1""")
def a2_diff_verdict_same(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.diff_verdict(ig.diff_counts(ws.fx_counts_old, ws.fx_counts_old))


@register("a3_table_checksum", duckdb_ctes("fx_claims") + f"""
select count(*) as rows, {_digest_sql(_line_sql())} as digest from fx_claims""")
def a3_table_checksum(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.table_checksum(ws.fx_claims, CLAIM_COLS, "id", CLAIM_TS)


@register("a3_bucket_checksums", duckdb_ctes("fx_claims") + f"""
select {_bucket_sql('id')} as bucket, count(*) as rows,
       {_digest_sql(_line_sql())} as digest
from fx_claims group by 1""")
def a3_bucket_checksums(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.bucket_checksums(ws.fx_claims, CLAIM_COLS, "id", CLAIM_TS)


def _copy(ws: Workspace):
    """The migrated copy: one order in 1,000 lost, one in 997 with a note."""
    c = ws.fx_claims
    return (c.filter(F.col("id").cast("bigint") % 1000 != 7)
            .withColumn("note", F.when(F.col("id").cast("bigint") % 997 == 0, F.lit("edited"))
                        .otherwise(F.col("note"))))


_COPY_SQL = """
, copy as (select id, person, service, service_date, tax_year, amount_submitted, amount_paid, insurer,
                  status, flag_status,
                  case when cast(id as bigint) % 997 = 0 then 'edited' else note end as note, created_at
           from fx_claims where cast(id as bigint) % 1000 <> 7)"""


@register("a4_compare_checksums", duckdb_ctes("fx_claims") + _COPY_SQL + f"""
, a as (select {_bucket_sql('id')} as bucket, count(*) as rows_a,
               {_digest_sql(_line_sql())} as digest_a from fx_claims group by 1),
  b as (select {_bucket_sql('id')} as bucket, count(*) as rows_b,
               {_digest_sql(_line_sql())} as digest_b from copy group by 1)
select coalesce(a.bucket, b.bucket) as bucket, rows_a, digest_a, rows_b, digest_b
from a full outer join b on a.bucket = b.bucket
where not (rows_a is not distinct from rows_b and digest_a is not distinct from digest_b)""")
def a4_compare_checksums(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.compare_checksums(ws.fx_claims, _copy(ws), CLAIM_COLS, "id", CLAIM_TS)


@register("a4_differing_keys", duckdb_ctes("fx_claims") + _COPY_SQL + f"""
, a as (select id, {_line_sql()} as line from fx_claims), b as (select id, {_line_sql()} as line from copy)
select coalesce(a.id, b.id) as key, case when b.id is null then 'lost' when a.id is null then 'added' else 'changed' end as state,
       (a.id is not null)::bigint as rows_a, (b.id is not null)::bigint as rows_b
from a full outer join b on a.id = b.id where a.line is distinct from b.line""")
def a4_differing_keys(spark, sf_dir):
    """The keys behind differing digests, through two hash trees."""
    ws = Workspace(spark, sf_dir)
    return ht.compare(ws.fx_claims, _copy(ws), CLAIM_COLS, "id", CLAIM_TS, digits=3)


@register("a5_duplicate_groups", duckdb_ctes("fx_claim_lines") + """
select person, amount_submitted, service_date, count(*) as n from fx_claim_lines
group by person, amount_submitted, service_date having count(*) > 1""")
def a5_duplicate_groups(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.duplicate_groups(ws.fx_claim_lines, DUP_KEYS)


@register("a5_suspected_duplicates", duckdb_ctes("fx_claim_lines") + """
select l.* from fx_claim_lines l
where exists (select 1 from (select person, amount_submitted, service_date from fx_claim_lines
                             group by 1, 2, 3 having count(*) > 1) g
              where g.person = l.person and g.amount_submitted = l.amount_submitted
                and g.service_date = l.service_date)""")
def a5_suspected_duplicates(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.suspected_duplicates(ws.fx_claim_lines, DUP_KEYS)


@register("j5_new_emails_only", duckdb_ctes("fx_requests", "fx_accounts") + """
select r.* from fx_requests r
where not exists (select 1 from fx_accounts a where lower(a.email) = lower(trim(r.target_email)))""")
def j5_new_emails_only(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.new_emails_only(ws.fx_requests, ws.fx_accounts)


def _surviving_accounts(ws: Workspace):
    """Accounts after some were deleted: every 20th (user_id % 20 = 3) is gone."""
    return ws.fx_accounts.filter(F.col("user_id") % 20 != 3)


@register("j6_orphan_grants", duckdb_ctes("fx_grants", "fx_accounts") + """
select g.* from fx_grants g
where not exists (select 1 from fx_accounts a where a.user_id = g.user_id and a.user_id % 20 <> 3)""")
def j6_orphan_grants(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.orphan_rows(ws.fx_grants, "user_id", _surviving_accounts(ws))


@register("j6_orphan_grants_intact", duckdb_ctes("fx_grants", "fx_accounts") + """
select g.* from fx_grants g where not exists (select 1 from fx_accounts a where a.user_id = g.user_id)""")
def j6_orphan_grants_intact(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.orphan_rows(ws.fx_grants, "user_id", ws.fx_accounts)


@register("j7_orphan_rows", duckdb_ctes("fx_personal", "fx_accounts") + """
select p.* from fx_personal p
where p.owner_id is not null
  and not exists (select 1 from fx_accounts a where a.user_id = p.owner_id and a.user_id % 20 <> 3)""")
def j7_orphan_rows(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.orphan_rows(ws.fx_personal, "owner_id", _surviving_accounts(ws))


@register("j7_orphan_counts", duckdb_ctes("fx_personal", "fx_sessions", "fx_grants", "fx_accounts") + """
, acc as (select user_id from fx_accounts where user_id % 20 <> 3)
select 'fx_grants' as tbl, 'user_id' as "column", count(*) as orphans from fx_grants
where user_id is not null and user_id not in (select user_id from acc)
union all
select 'fx_personal', 'owner_id', count(*) from fx_personal
where owner_id is not null and owner_id not in (select user_id from acc)
union all
select 'fx_sessions', 'user_id', count(*) from fx_sessions
where user_id is not null and user_id not in (select user_id from acc)""")
def j7_orphan_counts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.orphan_counts({"fx_personal": (ws.fx_personal, "owner_id"),
                             "fx_sessions": (ws.fx_sessions, "user_id"),
                             "fx_grants": (ws.fx_grants, "user_id")}, _surviving_accounts(ws))


@register("a11_erasure_impact", duckdb_ctes("fx_personal", "fx_sessions", "fx_grants", "fx_accounts") + f"""
, padm as (select user_id from fx_grants where app = 'platform' and role = 'app_admin'),
  t as (select distinct s.user_id as target_id from fx_sessions s
        join fx_accounts a on a.user_id = s.user_id
        where s.user_id <> {CALLER} and s.user_id not in (select user_id from padm))
select 'fx_grants' as tbl, 'granted_by' as "column", 'a' as action, 'blocks' as effect, count(*) as rows
from fx_grants where granted_by in (select target_id from t)
union all
select 'fx_grants', 'user_id', 'c', 'deleted', count(*) from fx_grants where user_id in (select target_id from t)
union all
select 'fx_personal', 'owner_id', 'c', 'deleted', count(*) from fx_personal where owner_id in (select target_id from t)
union all
select 'fx_sessions', 'user_id', 'c', 'deleted', count(*) from fx_sessions where user_id in (select target_id from t)""")
def a11_erasure_impact(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    t = ws.fx_sessions.select(F.col("user_id").alias("target_id")).distinct()
    dec = ch.delete_decisions(t, ws.fx_accounts, ws.fx_grants, CALLER).filter("accepted").select("target_id")
    g = ws.fx_grants
    return ig.erasure_impact(dec, [("fx_grants", g, "granted_by", "a"), ("fx_grants", g, "user_id", "c"),
                                   ("fx_personal", ws.fx_personal, "owner_id", "c"),
                                   ("fx_sessions", ws.fx_sessions, "user_id", "c")])


@register("u3_row_diff", duckdb_ctes("fx_claims") + _COPY_SQL + """
select *, 'lost' as side, count(*) as n from (select * from fx_claims except all select * from copy) group by all
union all
select *, 'added' as side, count(*) as n from (select * from copy except all select * from fx_claims) group by all""")
def u3_row_diff(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.row_diff(ws.fx_claims, _copy(ws))


@register("u3_reconciled", duckdb_ctes("fx_claims") + _COPY_SQL + """
select *, 'lost' as side, count(*) as n from (select * from fx_claims except all select * from copy) group by all
union all
select *, 'added' as side, count(*) as n from (select * from copy except all select * from fx_claims) group by all""")
def u3_reconciled(spark, sf_dir):
    """The same differences through invertible Bloom lookup tables: only sums and differing rows are shuffled."""
    ws = Workspace(spark, sf_dir)
    return rec.reconcile(ws.fx_claims, _copy(ws))


def _with_probes(ws: Workspace):
    c = ws.fx_claims
    probes = (c.filter(F.col("tax_year") == 1995)
              .withColumn("id", F.concat(F.lit("probe-"), F.col("id")))
              .withColumn("person", F.lit("RLS PROBE")))
    return c.unionByName(probes)


@register("m13_cleanup_probe", duckdb_ctes("fx_claims") + f"""
, b as (select count(*) as rows_before, {_digest_sql(_line_sql())} as digest_before
        from fx_claims),
  p as (select count(*) as probe_rows from fx_claims where tax_year = 1995)
select rows_before, digest_before, probe_rows, rows_before as rows_after, digest_before as digest_after,
       true as match
from b, p""")
def m13_cleanup_probe(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return ig.cleanup_probe(ws.fx_claims, _with_probes(ws), F.col("person") == "RLS PROBE",
                            CLAIM_COLS, "id", CLAIM_TS)
