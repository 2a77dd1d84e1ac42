"""Time-based operators over logs (J13, W2, W3, A9, A12, A15): the batch twins
of the streaming operators in ``tessera.streaming``."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.access import platform_admins
from tessera.session import checkpoint_dir

HOUR_SECONDS = 3600
HOURLY_CAP = 10
# The trailing hour is (t - 1h, t]: 59:59.999999 back from t, so an event
# exactly one hour earlier is outside, as with `invited_at > now() - 1 hour`.
TRAILING_HOUR = "INTERVAL '59:59.999999' MINUTE TO SECOND"


def _trailing_count(partition_cols, ts_col: str) -> Column:
    """count(*) over the trailing hour (a RANGE frame on the timestamp)."""
    parts = ", ".join(f"`{c}`" for c in partition_cols)
    return F.expr(f"count(1) over (partition by {parts} order by `{ts_col}` "
                  f"range between {TRAILING_HOUR} preceding and current row)")


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone.

    A TIMESTAMP_NTZ is measured from the NTZ epoch directly: casting it to
    TIMESTAMP would pass through the session zone and, under daylight saving,
    move or merge wall-clock times around the switch.
    """
    c = F.col(col)
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        # field extraction from a local date-time involves no zone at all
        return (F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
                + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000
                + (F.expr(f"extract(SECOND FROM `{col}`)") * 1_000_000).cast("long"))
    return F.unix_micros(c)


def event_time(df: DataFrame, col: str) -> Column:
    """A TIMESTAMP for watermarks: the NTZ wall clock read as UTC, zone-free."""
    return F.timestamp_micros(epoch_micros(df, col))


def _epoch_s(df: DataFrame, col: str) -> Column:
    return epoch_micros(df, col) / 1_000_000


# J13
def stale_token_exposure(access: DataFrame, revocations: DataFrame, ttl_seconds: int = HOUR_SECONDS,
                         ts_col: str = "ts", revoked_col: str = "revoked_at") -> DataFrame:
    """Accesses by a user after one of their revocations but while a token
    issued before it could still be valid: revoked_at < ts <= revoked_at + ttl.

    A range join made an equi-join: each revocation is listed under the
    time buckets (of ``ttl`` width) its interval touches, each access under
    its own bucket, and the join key is (user, bucket). A busy user's
    accesses are thus spread over their buckets instead of meeting every
    revocation of that user; the exact interval test runs after the join.
    """
    b = F.floor(_epoch_s(access, ts_col) / ttl_seconds).cast("long")
    a = access.withColumn("_b", b)
    start = F.floor(_epoch_s(revocations, revoked_col) / ttl_seconds).cast("long")
    r = (revocations.select(F.col("user_id").alias("_ru"), F.col("app").alias("revoked_app"), revoked_col,
                            F.explode(F.sequence(start, start + 1)).alias("_b")))
    j = a.join(r, (a["user_id"] == r["_ru"]) & (a["_b"] == r["_b"]))
    within = (F.col(ts_col) > F.col(revoked_col)) & (
        F.col(ts_col) <= F.col(revoked_col) + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return j.filter(within).drop("_b", "_ru")


# W2
def trailing_hour_counts(requests: DataFrame, key: str = "inviter", ts_col: str = "attempted_at",
                         chunk_hours: int = 1) -> DataFrame:
    """Attempts in the hour up to and including each one, per ``key``.

    A per-key window over all of history would put a hot key (one inviter
    with a third of all rows) in a single task. Rows are therefore windowed
    in (key, hour) chunks; each chunk also receives the previous chunk's last
    hour as context rows, which feed the counts but are not emitted.
    """
    chunk_s = chunk_hours * HOUR_SECONDS
    t = _epoch_s(requests, ts_col)
    chunk = F.floor(t / chunk_s).cast("long")
    base = requests.withColumn("_chunk", chunk).withColumn("_ctx", F.lit(False))
    # a row within the last hour of its chunk also serves the next chunk
    ctx = (requests.filter(t >= (chunk + 1) * chunk_s - HOUR_SECONDS)
           .withColumn("_chunk", chunk + 1).withColumn("_ctx", F.lit(True)))
    trailing = _trailing_count([key, "_chunk"], ts_col)
    return (base.unionByName(ctx).withColumn("trailing_count", trailing)
            .filter(~F.col("_ctx")).drop("_chunk", "_ctx"))


# A9
def rate_cap_hit(invites: DataFrame, now: Column, cap: int = HOURLY_CAP, ts_col: str = "invited_at") -> DataFrame:
    """One row: invitations in the hour before ``now`` and whether the cap is hit."""
    n = invites.filter(F.col(ts_col) > now - F.expr("INTERVAL 1 HOUR")).agg(F.count(F.lit(1)).alias("recent"))
    return n.select("recent", (F.col("recent") >= cap).alias("cap_hit"))


def fold_rate_cap(times_us, cap: int = HOURLY_CAP, window_us: int = HOUR_SECONDS * 1_000_000, state=None):
    """Sequential decisions for one key's attempts in time order.

    An attempt is accepted iff fewer than ``cap`` accepted attempts lie in
    the hour before it (strictly later than t - 1h). ``state`` (a deque of
    accepted times) carries over between calls. Returns (decisions, state).
    """
    acc = state if state is not None else deque()
    out = []
    for t in times_us:
        while acc and acc[0] <= t - window_us:
            acc.popleft()
        ok = len(acc) < cap
        if ok:
            acc.append(t)
        out.append(ok)
    return out, acc


def rate_cap_history(requests: DataFrame, key: str = "inviter", ts_col: str = "attempted_at",
                     id_col: str = "attempt_id", cap: int = HOURLY_CAP, chunk_hours: int = 4) -> DataFrame:
    """Accepted/refused for every attempt over history, per ``key``.

    Refused attempts create nothing, so each decision depends on earlier
    accepted ones. Work is split where no state can survive: an attempt with
    no other attempt of its key in the hour before it starts a fresh "run".
    Everything up to the fold is computed in (key, few hours) chunks, so a hot key
    is never sorted as one history:

    1. trailing-hour counts per chunk (W2, with context rows);
    2. a count of 1 marks a run start; inside a chunk a row's run is the
       latest start so far, and a row before the chunk's first start takes
       the last start of earlier chunks (a running max over the small
       per-(key, chunk) table);
    3. a run whose counts never exceed ``cap`` is accepted outright in SQL;
       only dense runs are folded, by a streaming ``mapInPandas`` over rows
       sorted by (key, run, time) whose memory holds at most ``cap`` times.

    A key with no hour-long pause is one run, and its fold one sequential
    task: the rule itself is sequential there.
    """
    chunk_us = chunk_hours * HOUR_SECONDS * 1_000_000
    t = epoch_micros(requests, ts_col)
    base = requests.select(key, id_col, ts_col)
    rows = (trailing_hour_counts(base, key, ts_col, chunk_hours)
            .withColumn("_t", t).withColumn("_chunk", F.floor(F.col("_t") / chunk_us).cast("long"))
            .withColumn("_start", F.when(F.col("trailing_count") == 1, F.col("_t"))))
    wc = (Window.partitionBy(key, "_chunk").orderBy("_t", id_col)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_local", F.max("_start").over(wc))
    # three branches read these rows (carry, run ids, dense screen): materialise
    # the chunked windows once, with a reliable checkpoint in the shared folder
    checkpoint_dir(requests.sparkSession)
    rows = rows.checkpoint(eager=True)
    per_chunk = rows.groupBy(key, "_chunk").agg(F.max("_start").alias("_last"))
    wk = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, "_chunk", F.max("_last").over(wk).alias("_carry"))
    runs = (rows.join(carry, [key, "_chunk"], "left")
            .withColumn("_run", F.coalesce("_local", "_carry", F.lit(-1).cast("long"))))
    dense = (runs.groupBy(key, "_run").agg(F.max("trailing_count").alias("_mx"))
             .filter(F.col("_mx") > cap).select(key, "_run", F.lit(True).alias("_dense")))
    marked = runs.join(dense, [key, "_run"], "left")
    easy = marked.filter(F.col("_dense").isNull()).select(key, id_col, ts_col, F.lit(True).alias("accepted"))
    hard = marked.filter(F.col("_dense").isNotNull()).select(key, "_run", id_col, ts_col, "_t")
    key_type = requests.schema[key].dataType.simpleString()
    id_type = requests.schema[id_col].dataType.simpleString()
    ts_type = requests.schema[ts_col].dataType.simpleString()
    schema = f"{key} {key_type}, {id_col} {id_type}, {ts_col} {ts_type}, accepted boolean"

    def fold(batches):
        cur, st = None, None
        for pdf in batches:
            # rows arrive sorted by (key, run, time): fold each contiguous
            # (key, run) segment in one call, carrying state across batches
            group = (pdf[key].ne(pdf[key].shift()) | pdf["_run"].ne(pdf["_run"].shift())).cumsum()
            dec = []
            for _, seg in pdf.groupby(group, sort=False):
                k = (seg[key].iat[0], seg["_run"].iat[0])
                if k != cur:
                    cur, st = k, deque()
                ok, st = fold_rate_cap(seg["_t"].tolist(), cap, state=st)
                dec.extend(ok)
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], ts_col: pdf[ts_col], "accepted": dec})

    folded = (hard.repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", id_col)
              .mapInPandas(fold, schema))
    return easy.unionByName(folded)


# W3
def current_grants(changes: DataFrame, key=("user_id", "app"), ts_col: str = "changed_at",
                   order_cols=("change_id",)) -> DataFrame:
    """Latest state per (user, app) from a change log; a latest `revoke` removes
    the grant. ``max_by`` keeps one row per key through a partial aggregate,
    so no window sorts a hot key's history."""
    latest = F.max_by(F.struct("action", "role", ts_col), F.struct(ts_col, *order_cols))
    return (changes.groupBy(*key).agg(latest.alias("_l"))
            .filter(F.col("_l.action") != "revoke")
            .select(*key, F.col("_l.role").alias("role"), F.col(f"_l.{ts_col}").alias("granted_at")))


# A12
def admin_count(grants: DataFrame) -> DataFrame:
    """Platform admins and whether one may remove themself (never the last)."""
    n = platform_admins(grants).agg(F.count(F.lit(1)).alias("admins"))
    return n.select("admins", (F.col("admins") > 1).alias("self_removal_allowed"))


# A15
def classify_responses(log: DataFrame, op_col: str = "op", status_col: str = "status",
                       content_col: str = "content") -> DataFrame:
    """Outcome of each logged invite/delete call by the ordered rules.

    A body that is not JSON gives an empty error code (parsed defensively). An
    invitation answered with 200 but without the new account's id is an error.
    """
    st = F.col(status_col)
    code = F.coalesce(F.get_json_object(F.col(content_col), "$.error_code"), F.lit(""))
    made = F.get_json_object(F.col(content_col), "$.id").isNotNull()
    invite = (F.when((st == 200) & made, F.lit("ok"))
              .when(st == 200, F.lit("no_user_id"))
              .when((st == 429) | (code == "over_email_send_rate_limit"), F.lit("rate_limited"))
              .when((st == 422) | code.isin("email_exists", "user_already_exists"), F.lit("already_exists"))
              .when(st == 401, F.lit("bad_key"))
              .when(st == 403, F.lit("forbidden"))
              .when(st >= 500, F.lit("server_error"))
              .otherwise(F.lit("other")))
    delete = (F.when(st.isin(200, 404), F.lit("ok"))
              .when(st == 401, F.lit("bad_key"))
              .when(st.isin(409, 500), F.lit("blocked_by_reference"))
              .otherwise(F.lit("other")))
    return log.withColumn("error_code", code).withColumn(
        "outcome", F.when(F.col(op_col) == "invite", invite).otherwise(delete))


def response_counts(classified: DataFrame, op_col: str = "op") -> DataFrame:
    return classified.groupBy(op_col, "outcome").agg(F.count(F.lit(1)).alias("n"))
