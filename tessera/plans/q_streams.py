"""Registered time-based and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as hi
from tessera.plans.fixtures import Workspace, duckdb_ctes
from tessera.plans.registry import register
from tessera.sources import publish as pub
from tessera.streaming import streams as st

NOW = "2024-01-15 12:00:00"
APP = "view"


def _access(ws: Workspace):
    return ws.events.select("event_id", "user_id", "event_type", "ts")


_J13_SQL = duckdb_ctes("fx_revocations") + """
select e.event_id, e.user_id, e.event_type, e.ts, r.app as revoked_app, r.revoked_at
from events e join fx_revocations r
  on e.user_id = r.user_id and e.ts > r.revoked_at and e.ts <= r.revoked_at + interval 1 hour"""


@register("j13_stale_token_exposure", _J13_SQL)
def j13_stale_token_exposure(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return hi.stale_token_exposure(_access(ws), ws.fx_revocations)


_W2_SQL = duckdb_ctes("fx_invite_attempts") + """
select attempt_id, inviter, attempted_at,
       count(*) over (partition by inviter order by attempted_at
                      range between interval '59 minutes 59.999999 seconds' preceding and current row) as trailing_count
from fx_invite_attempts"""


@register("w2_trailing_hour_counts", _W2_SQL)
def w2_trailing_hour_counts(spark, sf_dir):
    return hi.trailing_hour_counts(Workspace(spark, sf_dir).fx_invite_attempts)


@register("w2_windows_over_cap", f"select count(*) as windows_over_cap from ({_W2_SQL}) where trailing_count > 10")
def w2_windows_over_cap(spark, sf_dir):
    t = hi.trailing_hour_counts(Workspace(spark, sf_dir).fx_invite_attempts)
    return t.filter(F.col("trailing_count") > hi.HOURLY_CAP).agg(F.count(F.lit(1)).alias("windows_over_cap"))


def _change_log(ws: Workspace):
    """Grant changes from events: low values revoke, high values grant admin."""
    return ws.events.select(
        F.col("event_id").alias("change_id"), "user_id", F.col("event_type").alias("app"),
        F.col("ts").alias("changed_at"),
        F.when(F.col("value") < 5, F.lit("revoke")).otherwise(F.lit("grant")).alias("action"),
        F.when(F.col("value") >= 40, F.lit("app_admin")).otherwise(F.lit("member")).alias("role"))


_W3_SQL = """
, log as (select event_id as change_id, user_id, event_type as app, ts as changed_at,
                 case when value < 5 then 'revoke' else 'grant' end as action,
                 case when value >= 40 then 'app_admin' else 'member' end as role from events),
  latest as (select *, row_number() over (partition by user_id, app order by changed_at desc, change_id desc) as rn
             from log)
select user_id, app, role, changed_at as granted_at from latest where rn = 1 and action <> 'revoke'"""


@register("w3_current_grants", "WITH x AS (select 1)" + _W3_SQL)
def w3_current_grants(spark, sf_dir):
    return hi.current_grants(_change_log(Workspace(spark, sf_dir)))


@register("a9_rate_cap_hit", duckdb_ctes("fx_invite_attempts") + f"""
select count(*) as recent, count(*) >= 10 as cap_hit from fx_invite_attempts
where attempted_at > timestamp '{NOW}' - interval 1 hour""")
def a9_rate_cap_hit(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return hi.rate_cap_hit(ws.fx_invite_attempts, F.expr(f"TIMESTAMP_NTZ '{NOW}'"), ts_col="attempted_at")


_FOLD_SQL = """WITH RECURSIVE
 base as (select case when user_id % 3 = 0 then 0 else user_id end as inviter, event_id as attempt_id, ts as attempted_at,
                 row_number() over (partition by case when user_id % 3 = 0 then 0 else user_id end order by ts, event_id)
                 as rn from events),
 r(inviter, rn, attempt_id, attempted_at, accepted, st) as (
   select inviter, rn, attempt_id, attempted_at, true, [attempted_at] from base where rn = 1
   union all
   select b.inviter, b.rn, b.attempt_id, b.attempted_at,
          len(list_filter(r.st, lambda x: x > b.attempted_at - interval 1 hour)) < 10,
          case when len(list_filter(r.st, lambda x: x > b.attempted_at - interval 1 hour)) < 10
               then list_append(list_filter(r.st, lambda x: x > b.attempted_at - interval 1 hour), b.attempted_at)
               else list_filter(r.st, lambda x: x > b.attempted_at - interval 1 hour) end
   from r join base b on b.inviter = r.inviter and b.rn = r.rn + 1)
select inviter, attempt_id, attempted_at, accepted from r"""


@register("a9_rate_cap_history", _FOLD_SQL)
def a9_rate_cap_history(spark, sf_dir):
    return hi.rate_cap_history(Workspace(spark, sf_dir).fx_invite_attempts)


@register("a12_admin_count", duckdb_ctes("fx_grants") + """
select count(distinct user_id) as admins, count(distinct user_id) > 1 as self_removal_allowed
from fx_grants where app = 'platform' and role = 'app_admin'""")
def a12_admin_count(spark, sf_dir):
    return hi.admin_count(Workspace(spark, sf_dir).fx_grants)


_A15_SQL = duckdb_ctes("fx_responses") + """
, c as (select *, coalesce(case when json_valid(content) then json_extract_string(content, '$.error_code') end, '')
                  as error_code from fx_responses)
select response_id, op, status, content, error_code,
       case when op = 'invite' then
              case when status = 200 and (case when json_valid(content) then json_extract_string(content, '$.id') end) is not null
                   then 'ok'
                   when status = 200 then 'no_user_id'
                   when status = 429 or error_code = 'over_email_send_rate_limit' then 'rate_limited'
                   when status = 422 or error_code in ('email_exists', 'user_already_exists') then 'already_exists'
                   when status = 401 then 'bad_key'
                   when status = 403 then 'forbidden'
                   when status >= 500 then 'server_error'
                   else 'other' end
            else
              case when status in (200, 404) then 'ok'
                   when status = 401 then 'bad_key'
                   when status in (409, 500) then 'blocked_by_reference'
                   else 'other' end end as outcome
from c"""


@register("a15_classify_responses", _A15_SQL)
def a15_classify_responses(spark, sf_dir):
    return hi.classify_responses(Workspace(spark, sf_dir).fx_responses)


@register("a15_response_counts", f"select op, outcome, count(*) as n from ({_A15_SQL}) group by op, outcome")
def a15_response_counts(spark, sf_dir):
    return hi.response_counts(hi.classify_responses(Workspace(spark, sf_dir).fx_responses))


# Streams -------------------------------------------------------------------------

def _stage_files(df, path: str, ts_col: str, pieces: int = 4, mixed: bool = False):
    """Write ``df`` in ``pieces`` folders in time order; a stream over ``path/*`` reads them
    as files come. Pieces are cut on zone-free epoch microseconds (no datetime literals).
    ``mixed`` swaps the halves of every half hour between neighbouring pieces' files."""
    us = hi.epoch_micros(df, ts_col)
    lo, top = df.select(F.min(us), F.max(us)).first()
    piece = F.least(F.floor((us - lo) * pieces / (top - lo + 1)), F.lit(pieces - 1))
    if mixed:  # rows of 15 minutes in two change places with the piece before: late, but within the watermark
        piece = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), F.floor(
            (us - lo + F.when(F.floor(us / 900_000_000) % 2 == 0, 900_000_000).otherwise(-900_000_000)) * pieces / (top - lo + 1))))
    for i in range(pieces):
        df.filter(piece == i).write.mode("append").parquet(f"{path}/piece={i}")


def _drain_pieces(spark, path: str, schema, pieces: int, run) -> None:
    """Feed one staged piece after the other: each is at least one micro-batch of its own."""
    for i in range(pieces):
        pub.rename_into(spark, f"{path}/piece={i}", f"{path}-live")
        run(st.file_stream(spark, f"{path}-live", schema))


@register("t1_governed_stream", duckdb_ctes("fx_personal", "fx_grants") + f"""
select p.* from fx_personal p
where p.app = '{APP}' and exists (select 1 from fx_grants g where g.user_id = p.owner_id and g.app = '{APP}'
                                  and (p.row_id % 2 = 0 or g.user_id % 2 = 1))""")
def t1_governed_stream(spark, sf_dir):
    """Two micro-batches; between them every user of even id loses their grant."""
    ws = Workspace(spark, sf_dir)
    base = pub.scratch_path(spark, "t1")
    personal = ws.fx_personal
    for odd, grants in ((0, ws.fx_grants), (1, ws.fx_grants.filter(F.col("user_id") % 2 == 1))):
        pub.publish({"grants": grants}, f"{base}/grants")
        personal.filter(F.col("row_id") % 2 == odd).write.mode("append").parquet(f"{base}/in")
        src = st.file_stream(spark, f"{base}/in", personal.schema)
        st.governed_stream(src, f"{base}/grants", APP, "owner_id", f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select(*personal.columns)


@register("t2_stream_rate_cap", _FOLD_SQL)
def t2_stream_rate_cap(spark, sf_dir):
    """Files out of order within the watermark; a last row far ahead lets every attempt be decided."""
    ws = Workspace(spark, sf_dir)
    base = pub.scratch_path(spark, "t2")
    att = ws.fx_invite_attempts
    _stage_files(att, f"{base}/in", "attempted_at", pieces=3, mixed=True)
    last = att.select(F.lit(-1).cast("long").alias("attempt_id"), F.lit(-1).cast(att.schema["inviter"].dataType).alias("inviter"),
                      "attempted_at").agg(F.first("attempt_id").alias("attempt_id"), F.first("inviter").alias("inviter"),
                                          (F.max("attempted_at") + F.expr("interval 3 hours")).alias("attempted_at"))
    last.write.parquet(f"{base}/in/piece=3")
    _drain_pieces(spark, f"{base}/in", att.schema, 4, lambda src: st.run_to_parquet(
        st.stream_rate_cap(src), f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out").filter("inviter >= 0").select("inviter", "attempt_id", "attempted_at", "accepted")


@register("t3_stream_stale_token", _J13_SQL)
def t3_stream_stale_token(spark, sf_dir):
    """Three micro-batches: revocations of an earlier one meet accesses of a later one."""
    ws = Workspace(spark, sf_dir)
    base = pub.scratch_path(spark, "t3")
    acc, rev = _access(ws), ws.fx_revocations
    us = hi.epoch_micros(acc, "ts")
    lo, top = acc.select(F.min(us), F.max(us)).first()
    pieces = 3
    for i in range(pieces):
        for df, col, name in ((acc, "ts", "access"), (rev, "revoked_at", "revocations")):
            t = hi.epoch_micros(df, col)
            piece = F.greatest(F.lit(0), F.least(F.floor((t - lo) * pieces / (top - lo + 1)), F.lit(pieces - 1)))
            df.filter(piece == i).write.mode("append").parquet(f"{base}/{name}")
        a = st.file_stream(spark, f"{base}/access", acc.schema)
        r = st.file_stream(spark, f"{base}/revocations", rev.schema)
        st.run_to_parquet(st.stream_stale_token(a, r), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "event_type", "ts",
                                                    "revoked_app", "revoked_at")


@register("t4_stream_current_grants", "WITH x AS (select 1)" + _W3_SQL)
def t4_stream_current_grants(spark, sf_dir):
    """Four micro-batches with two compactions between them, the second pruning the log."""
    ws = Workspace(spark, sf_dir)
    base = pub.scratch_path(spark, "t4")
    log = _change_log(ws)
    _stage_files(log, f"{base}/in", "changed_at")
    fed = iter(range(4))

    def run(src):
        st.stream_current_grants(src, f"{base}/state", f"{base}/ckpt")
        if next(fed) in (0, 2):
            st.compact(spark, f"{base}/state", prune=True)
    _drain_pieces(spark, f"{base}/in", log.schema, 4, run)
    return st.current_from_state(spark, f"{base}/state")
