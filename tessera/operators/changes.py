"""Changes to grants, accounts and governed tables.

Spark file tables have no MERGE, so every operator takes DataFrames and returns
the new table (and, where the reference reports one, an outcome table). The
publisher in ``tessera.sources.publish`` writes a new version directory and
then a manifest, so readers see all of a change or none of it.

Batch rules (the reference makes single calls): a batch may not hold the same
key twice, and refusals are judged against the state before the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import access as acc
from tessera.session import checkpoint_dir
from tessera.sources.tables import page_numbers

GRANT_KEY = ("user_id", "app")

# Refusal texts of the invitation and deletion guards, in the
# order the guards run.
INVITE_REASONS = {
    "not_admin": "not authorised to invite users",
    "bad_email": "not an email address: ",
    "not_array": "grants must be a json array of {app, role}",
    "missing_field": "each grant needs an app and a role, got ",
    "unknown_role": "unknown role ",
    "platform": "platform admin cannot be granted by invitation — invite them first, then promote them from the grid",
    "exists": " already has an account — set their access from the grid instead",
    "rate_cap": "too many invitations in the last hour (limit {cap}) — wait, or send it from the dashboard",
    "duplicate": "the same address appears more than once in this batch",
    "repeated_app": "a request may name each app once",
}
DELETE_REASONS = {
    "not_admin": "not authorised to delete accounts",
    "no_id": "no account given",
    "self": "you cannot delete the account you are signed in as",
    "missing": "no account with that id — reload the page before trying again",
    "admin": " administers access rights — remove that first, then delete the account",
}
HOURLY_CAP = 10


def _dup_guard(df: DataFrame, keys, what: str) -> DataFrame:
    """Attach a per-row assertion that the key is unique within ``df``.

    The count runs over a window partitioned by the key, the same
    partitioning the following key join needs, so the check costs no extra
    shuffle; a duplicate fails the job with ``raise_error``.
    """
    w = Window.partitionBy(*keys)
    return df.withColumn("_dup", F.count(F.lit(1)).over(w)).withColumn(
        "_dup", F.when(F.col("_dup") > 1, F.raise_error(F.lit(f"duplicate key in {what} batch")))
        .otherwise(F.lit(None).cast("string")))


# S9
def apply_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill columns absent from ``df`` with a default (a Column or a value).

    A column that is present keeps its values, explicit nulls included.
    """
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return df


def grant_defaults(now: Column, caller=None) -> dict:
    return {"role": F.lit("member"), "granted_at": now,
            "granted_by": F.lit(caller).cast("bigint") if caller is not None else F.lit(None).cast("bigint")}


# M1, M2, M16
def upsert(table: DataFrame, new: DataFrame, keys, update_cols, insert_defaults: dict | None = None,
           what: str = "upsert") -> DataFrame:
    """``insert ... on conflict (keys) do update set update_cols = excluded.*``.

    One full outer join on the key; rows only in ``table`` pass through,
    rows only in ``new`` are inserted (with defaults for absent columns), and
    on a conflict only ``update_cols`` take the new values.
    """
    keys = list(keys)
    new = apply_defaults(new, insert_defaults or {})
    cols = table.columns
    # the guard column is null unless it raised; filtering on it keeps it evaluated
    new = _dup_guard(new.select(*[c for c in cols if c in new.columns]), keys, what)
    new = new.filter(F.col("_dup").isNull())
    o = table.select(*[F.col(c).alias(f"_o_{c}") if c not in keys else F.col(c) for c in cols],
                     F.lit(True).alias("_o_present"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") if c not in keys else F.col(c) for c in new.columns
                     if c != "_dup"], F.lit(True).alias("_n_present"))
    j = o.join(n, keys, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
            continue
        old_v, new_v = F.col(f"_o_{c}"), (F.col(f"_n_{c}") if f"_n_{c}" in n.columns else F.lit(None))
        conflict_v = new_v if c in update_cols else old_v
        out.append(F.when(F.col("_o_present").isNull(), new_v)
                   .when(F.col("_n_present").isNull(), old_v)
                   .otherwise(conflict_v).alias(c))
    return j.select(*out)


def upsert_grants(grants: DataFrame, new: DataFrame, mode: str = "role_only", now: Column | None = None,
                  caller=None) -> DataFrame:
    """M1 (`role_only`): a conflict updates the role only, granted_at/by stay.
    M2 (`merge_all`): a conflict updates every supplied column but granted_at."""
    if mode == "role_only":
        upd = ["role"]
    elif mode == "merge_all":
        upd = [c for c in new.columns if c not in GRANT_KEY and c != "granted_at"]
    else:
        raise ValueError("mode is role_only or merge_all")
    now = now if now is not None else F.current_timestamp()
    return upsert(grants, new, GRANT_KEY, upd, grant_defaults(now, caller), "grant")


# M3
def revoke(grants: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete grants by the composite key only, never by user alone."""
    missing = [k for k in GRANT_KEY if k not in keys.columns]
    if missing:
        raise ValueError(f"revocation keys need {GRANT_KEY}; missing {missing}")
    return grants.join(keys.select(*GRANT_KEY).distinct(), list(GRANT_KEY), "left_anti")


def revoke_report(grants: DataFrame, keys: DataFrame) -> DataFrame:
    """Per requested key: whether a grant was removed."""
    hit = grants.select(*GRANT_KEY).withColumn("removed", F.lit(True))
    return (keys.select(*GRANT_KEY).distinct().join(hit, list(GRANT_KEY), "left")
            .select(*GRANT_KEY, F.coalesce("removed", F.lit(False)).alias("removed")))


# M4
def _entry_check(p: Column) -> Column:
    """(code, reason) of the first rule one grant entry breaks, or nulls."""
    return F.struct(
        F.when(p["app"].isNull() | p["role"].isNull(), F.lit("missing_field"))
        .when(~p["role"].isin(*acc.ROLES), F.lit("unknown_role"))
        .when(p["app"] == acc.PLATFORM, F.lit("platform")).alias("code"),
        F.when(p["app"].isNull() | p["role"].isNull(), F.concat(F.lit(INVITE_REASONS["missing_field"]), p["raw"]))
        .when(~p["role"].isin(*acc.ROLES), F.concat(F.lit(INVITE_REASONS["unknown_role"]), p["role"]))
        .when(p["app"] == acc.PLATFORM, F.lit(INVITE_REASONS["platform"])).alias("reason"))


def validate_invites(requests: DataFrame, accounts: DataFrame, grants: DataFrame, caller,
                     now: Column, cap: int = HOURLY_CAP, key: str = "request_id",
                     email_col: str = "target_email", grants_col: str = "grants",
                     invited_col: str = "invited_at") -> DataFrame:
    """Outcome per invitation request; the first failing rule is reported.

    Rules in order: caller is not a platform admin; not an address; grants
    not a well-formed array (null means none); the first bad entry (missing app
    or role, unknown role, ``platform``); an account exists; duplicate address in
    the batch; an app named twice in the request; the hourly cap. Each refuses
    its own request only. Entries are checked in-row with higher-order array
    functions (each entry parsed once). The cap counts invitations in the
    hour before ``now`` plus the earlier accepted requests of the batch (by
    ``key``): at most ``cap - recent`` requests can pass, found with a
    distributed top-k.
    """
    raw = F.col(grants_col)
    entries = F.col("_entries")
    apps = F.transform(entries, lambda e: e["app"])
    bad = F.filter(F.transform(entries, _entry_check), lambda c: c["code"].isNotNull())
    base = (requests.select(key, email_col, grants_col, sx.normalize_email(email_col).alias("email_clean"),
                            sx.grant_entries(raw).alias("_entries"))
            .withColumn("_is_array", raw.isNull() | entries.isNotNull())
            .withColumn("_bad", F.try_element_at(bad, F.lit(1)))
            .withColumn("_twice", F.size(F.array_distinct(apps)) < F.size(apps)).drop("_entries"))
    # accounts are reduced to the batch's addresses first (a semi join whose
    # small side AQE can broadcast), so a large accounts table is scanned, not shuffled
    existing = (accounts.select(F.lower("email").alias("email_clean"))
                .join(base.select("email_clean").distinct(), "email_clean", "left_semi")
                .distinct().withColumn("_exists", F.lit(True)))
    # duplicates by a partial aggregate joined back on the address (AQE can
    # split a skewed join partition; it cannot split a window partition)
    dups = base.groupBy("email_clean").agg(F.count(F.lit(1)).alias("_dups"))
    j = base.join(existing, "email_clean", "left").join(dups, "email_clean", "left")
    j = j.withColumn("_admin", acc.is_platform_admin(grants, caller)).withColumn(
        "_email_ok", F.coalesce(sx.is_email("email_clean"), F.lit(False)))
    code = (F.when(~F.col("_admin"), F.lit("not_admin"))
            .when(~F.col("_email_ok"), F.lit("bad_email"))
            .when(~F.col("_is_array"), F.lit("not_array"))
            .when(F.col("_bad").isNotNull(), F.col("_bad.code"))
            .when(F.col("_exists"), F.lit("exists"))
            .when(F.col("_dups") > 1, F.lit("duplicate"))
            .when(F.col("_twice"), F.lit("repeated_app")))
    pre = j.select(key, email_col, grants_col, "email_clean", "_bad", code.alias("reason_code"))
    # the decisions feed both the output and the cap's top-k: materialise once
    # (reliable checkpoint in the shared folder) instead of parsing twice
    checkpoint_dir(requests.sparkSession)
    pre = pre.checkpoint(eager=True)
    reason = (F.when(F.col("reason_code") == "not_admin", F.lit(INVITE_REASONS["not_admin"]))
              .when(F.col("reason_code") == "bad_email", F.concat(F.lit(INVITE_REASONS["bad_email"]), F.col(email_col)))
              .when(F.col("reason_code") == "not_array", F.lit(INVITE_REASONS["not_array"]))
              .when(F.col("reason_code") == "exists",
                    F.concat(F.col("email_clean"), F.lit(INVITE_REASONS["exists"])))
              .when(F.col("reason_code").isin("duplicate", "repeated_app"),
                    F.when(F.col("reason_code") == "duplicate", F.lit(INVITE_REASONS["duplicate"]))
                    .otherwise(F.lit(INVITE_REASONS["repeated_app"])))
              .when(F.col("reason_code").isNotNull(), F.col("_bad.reason")))
    recent = accounts.filter(F.col(invited_col) > now - F.expr("INTERVAL 1 HOUR")).select(
        F.count(F.lit(1))).scalar()
    room = F.greatest(F.lit(cap) - recent, F.lit(0))
    # the first `room` passing requests by key: a top-k of at most `cap` rows
    firsts = (pre.filter(F.col("reason_code").isNull()).select(key).orderBy(F.col(key).asc_nulls_last()).limit(cap)
              .withColumn("_rank", F.row_number().over(Window.orderBy(F.col(key).asc_nulls_last()))))
    res = pre.join(F.broadcast(firsts), key, "left")
    over_cap = F.col("reason_code").isNull() & (F.coalesce(F.col("_rank"), F.lit(cap + 1)) > room)
    cap_msg = INVITE_REASONS["rate_cap"].format(cap=cap)
    return res.select(
        key, F.col("email_clean").alias("email"), grants_col,
        F.when(over_cap, F.lit("rate_cap")).otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(over_cap, F.lit(cap_msg)).otherwise(reason).alias("reason"),
        (F.col("reason_code").isNull() & ~over_cap).alias("accepted"))


# M5
def apply_invites(decisions: DataFrame, accounts: DataFrame, grants: DataFrame, caller,
                  now: Column, key: str = "request_id", grants_col: str = "grants",
                  new_id: Column | None = None):
    """Accounts and grants for accepted invitations, and the report
    {user_id, email, granted}.

    New ids come from ``new_id`` (default: the next integers after the
    largest existing id, in request order, numbered by the distributed
    ``page_numbers`` so no single task sees the whole accepted set); write
    the result once (publish) so ids are fixed.
    Returns (report, new_accounts, new_grants_table).
    """
    ok = decisions.filter("accepted")
    if new_id is None:
        top = accounts.select(F.max("user_id")).scalar()
        ok = page_numbers(ok, key, size=1).withColumn("user_id", top + F.col("_page") + 1).drop("_page")
    else:
        ok = ok.withColumn("user_id", new_id)
    ex = ok.select("user_id", F.explode(sx.grant_entries(grants_col)).alias("g"))
    new_grants = ex.select("user_id", F.col("g.app").alias("app"), F.col("g.role").alias("role"),
                           F.lit(caller).cast("bigint").alias("granted_by"))
    table = upsert_grants(grants, new_grants, "role_only", now=now, caller=caller)
    counts = new_grants.groupBy("user_id").agg(F.count(F.lit(1)).alias("granted"))
    report = (ok.select("user_id", "email").join(counts, "user_id", "left")
              .select("user_id", "email", F.coalesce("granted", F.lit(0)).cast("int").alias("granted")))
    new_accounts = ok.select("user_id", "email", now.alias("created_at"),
                             F.lit(None).cast(accounts.schema["last_sign_in_at"].dataType).alias("last_sign_in_at"))
    return report, new_accounts, table


# M6
def delete_decisions(targets: DataFrame, accounts: DataFrame, grants: DataFrame, caller,
                     target_col: str = "target_id") -> DataFrame:
    """Outcome per deletion target, first refusal wins: caller not admin; null
    id; self; no such account (one without an email counts as none); target
    administers access. All judged against the state before the batch."""
    admin = acc.is_platform_admin(grants, caller)
    # accounts and admins are reduced to the batch's ids first (semi joins
    # whose small side AQE can broadcast) before the outer joins
    ids = targets.select(target_col).filter(F.col(target_col).isNotNull()).distinct()
    acct = (accounts.select(F.col("user_id").alias(target_col), "email")
            .join(ids, target_col, "left_semi"))
    padm = (acc.platform_admins(grants).select(F.col("user_id").alias(target_col), F.lit(True).alias("_is_admin"))
            .join(ids, target_col, "left_semi"))
    j = targets.select(target_col).join(acct, target_col, "left").join(padm, target_col, "left")
    t = F.col(target_col)
    code = (F.when(~admin, F.lit("not_admin"))
            .when(t.isNull(), F.lit("no_id"))
            .when(t == F.lit(caller), F.lit("self"))
            .when(F.col("email").isNull(), F.lit("missing"))
            .when(F.col("_is_admin"), F.lit("admin")))
    reason = (F.when(~admin, F.lit(DELETE_REASONS["not_admin"]))
              .when(t.isNull(), F.lit(DELETE_REASONS["no_id"]))
              .when(t == F.lit(caller), F.lit(DELETE_REASONS["self"]))
              .when(F.col("email").isNull(), F.lit(DELETE_REASONS["missing"]))
              .when(F.col("_is_admin"), F.concat(F.col("email"), F.lit(DELETE_REASONS["admin"]))))
    return j.select(target_col, "email", code.alias("reason_code"), reason.alias("reason"),
                    code.isNull().alias("accepted"))


# M7
def clear_attribution(grants: DataFrame, targets: DataFrame, target_col: str = "target_id") -> DataFrame:
    """granted_by -> null where the granter is a target, except on the target's own rows."""
    t = targets.select(F.col(target_col).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    j = grants.join(t, grants["granted_by"] == t["_t"], "left")
    gb = F.when(F.col("_t").isNotNull() & (F.col("user_id") != F.col("_t")), F.lit(None)) \
        .otherwise(F.col("granted_by"))
    return j.select(*[gb.cast(grants.schema["granted_by"].dataType).alias(c) if c == "granted_by" else F.col(c)
                      for c in grants.columns])


# M8
def cascade_delete(df: DataFrame, col: str, action: str, targets: DataFrame,
                   target_col: str = "target_id", default=None) -> DataFrame:
    """Apply one foreign key's delete action for the targets to ``df``.

    c: rows go; n: the column is cleared; d: the column is set to ``default``
    (required); r/a: rows are untouched here, see ``blocking_targets``.
    """
    t = targets.select(F.col(target_col).alias(col)).filter(F.col(col).isNotNull()).distinct()
    if action == "c":
        return df.join(t, col, "left_anti")
    if action in ("n", "d"):
        if action == "d" and default is None:
            raise ValueError("set default needs a supplied default")
        hit = t.withColumn("_hit", F.lit(True))
        j = df.join(hit, col, "left")
        new = F.lit(None) if action == "n" else F.lit(default)
        val = F.when(F.col("_hit"), new).otherwise(F.col(col)).cast(df.schema[col].dataType)
        return j.select(*[val.alias(c) if c == col else F.col(c) for c in df.columns])
    if action in ("r", "a"):
        return df
    raise ValueError(f"unknown foreign-key action {action!r}")


def blocking_targets(df: DataFrame, col: str, targets: DataFrame, target_col: str = "target_id") -> DataFrame:
    """Targets that still have rows under a restrict/no-action key: the deletion fails."""
    return targets.select(target_col).join(
        df.select(F.col(col).alias(target_col)).filter(F.col(target_col).isNotNull()),
        target_col, "left_semi").distinct()


# M9
SIGN_OUT_REASONS = {
    "not_admin": "not authorised to sign other people out",
    "no_id": "no account given",
}


def end_sessions(sessions: DataFrame, tokens: DataFrame, targets: DataFrame,
                 target_col: str = "target_id", token_user_col: str = "user_id_text",
                 grants: DataFrame | None = None, caller=None):
    """Remove the targets' sessions and refresh tokens (token user id is text).

    With ``grants``, the caller must be a platform admin (else every target is
    refused and nothing is removed); a null target is refused. Returns
    (report, remaining_sessions, remaining_tokens); the report has one row per
    target with both counts, zero being normal.
    """
    t_all = targets.select(F.col(target_col).alias("user_id")).distinct()
    admin = acc.is_platform_admin(grants, caller) if grants is not None else F.lit(True)
    code = (F.when(~admin, F.lit("not_admin"))
            .when(F.col("user_id").isNull(), F.lit("no_id")))
    decided = t_all.withColumn("reason_code", code)
    t = decided.filter(F.col("reason_code").isNull()).select("user_id")
    tt = t.select(F.col("user_id").cast("string").alias(token_user_col))
    s_cnt = sessions.join(t, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions_ended"))
    k_cnt = (tokens.join(tt, token_user_col, "left_semi").groupBy(token_user_col)
             .agg(F.count(F.lit(1)).alias("tokens_revoked")))
    reason = F.coalesce(*[F.when(F.col("reason_code") == k, F.lit(v)) for k, v in SIGN_OUT_REASONS.items()])
    report = (decided.join(s_cnt, "user_id", "left")
              .join(k_cnt, F.col("user_id").cast("string") == F.col(token_user_col), "left")
              .select("user_id", F.coalesce("sessions_ended", F.lit(0)).alias("sessions_ended"),
                      F.coalesce("tokens_revoked", F.lit(0)).alias("tokens_revoked"),
                      "reason_code", reason.alias("reason")))
    return report, sessions.join(t, "user_id", "left_anti"), tokens.join(tt, token_user_col, "left_anti")


# M10
def decide_changes(changes: DataFrame, grants: DataFrame, caller, key: str = "change_id") -> DataFrame:
    """Outcome per requested role change (role null = revoke).

    not_admin for every change of a caller who is no platform admin; duplicate for
    each of several changes to one (user, app); no-op when the role is already the
    requested one (the grid offers no action there); refused when the caller removes
    their own platform admin; needs_confirmation when promoting someone else to
    platform admin; else apply. ``end_sessions`` is true iff revoking someone else.
    """
    cur = grants.select("user_id", "app", F.col("role").alias("current_role"))
    times = changes.groupBy("user_id", "app").agg(F.count(F.lit(1)).alias("_times"))
    j = changes.join(times, ["user_id", "app"], "left").join(cur, ["user_id", "app"], "left")
    j = j.withColumn("_admin", acc.is_platform_admin(grants, caller))
    is_self = F.col("user_id") == F.lit(caller)
    same = F.col("role").eqNullSafe(F.col("current_role"))
    outcome = (F.when(~F.col("_admin"), F.lit("not_admin"))
               .when(F.col("_times") > 1, F.lit("duplicate"))
               .when(same, F.lit("no-op"))
               .when(is_self & (F.col("app") == acc.PLATFORM) & F.col("role").isNull(), F.lit("refused"))
               .when((F.col("app") == acc.PLATFORM) & (F.col("role") == acc.ADMIN) & ~is_self,
                     F.lit("needs_confirmation"))
               .otherwise(F.lit("apply")))
    ends = (outcome == "apply") & F.col("role").isNull() & ~is_self
    return j.select(key, "user_id", "app", "role", "current_role", outcome.alias("outcome"),
                    ends.alias("end_sessions"))


# Write checks are filters that raise: a filter on a refused row can't be pruned away, whatever
# columns are read and however the rows are counted.
def _require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True))
                     .otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _may_write(grants: DataFrame, shape: str, app: str, caller, owner: Column) -> Column:
    gate = acc.has_app_access(grants, caller, app)
    return gate if shape == "shared" else gate & owner.eqNullSafe(F.lit(caller))


def may_change(grants: DataFrame, shape: str, app: str, caller, owner: Column, policies: DataFrame, table: str,
               verb: str) -> Column:
    """Whether ``caller`` may write a row of ``owner`` and ``table`` has a policy for ``verb``."""
    return _may_write(grants, shape, app, caller, owner) & _verb_exists(policies, table, verb)


WRITE_REFUSED = "new row violates row-level security policy"


# M11
def governed_insert(df: DataFrame, rows: DataFrame, grants: DataFrame, shape: str, app: str, caller,
                    owner_col: str = "user_id") -> DataFrame:
    """``df`` plus ``rows``; any row failing the write check fails the whole
    job (nothing is written), as a policy WITH CHECK violation raises."""
    return df.unionByName(_require(rows, _may_write(grants, shape, app, caller, F.col(owner_col)), WRITE_REFUSED))


def governed_insert_violations(rows: DataFrame, grants: DataFrame, shape: str, app: str, caller,
                               owner_col: str = "user_id") -> DataFrame:
    """The rows that would make ``governed_insert`` fail."""
    return rows.filter(~_may_write(grants, shape, app, caller, F.col(owner_col)))


# M12
def _updated(df: DataFrame, grants: DataFrame, shape: str, app: str, caller, where: Column, set_values: dict,
             policies: DataFrame, table: str, owner_col: str) -> tuple[DataFrame, Column]:
    """Rows as they would be after the update, with ``_hit`` on the changed ones, and the new-row check."""
    ok = may_change(grants, shape, app, caller, F.col(owner_col), policies, table, "UPDATE")
    flagged = df.withColumn("_hit", F.coalesce(where & ok, F.lit(False)))
    new = flagged.select(*[F.when(F.col("_hit"), set_values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType)
                           .alias(c) if c in set_values else F.col(c) for c in df.columns], "_hit")
    return new, ~F.col("_hit") | _may_write(grants, shape, app, caller, F.col(owner_col))


def governed_update(df: DataFrame, grants: DataFrame, shape: str, app: str, caller, where: Column,
                    set_values: dict, policies: DataFrame, table: str, owner_col: str = "user_id"):
    """UPDATE ... WHERE under the write policy: rows out of reach are skipped
    silently, a table with no UPDATE policy changes nothing, and a new row that
    the policy wouldn't let the caller write (one given to another owner) fails
    the job. Returns (new_df, affected_count_column_df)."""
    new, allowed = _updated(df, grants, shape, app, caller, where, set_values, policies, table, owner_col)
    checked = _require(new, allowed, WRITE_REFUSED)
    return checked.drop("_hit"), checked.agg(F.count(F.when(F.col("_hit"), 1)).alias("affected"))


def governed_update_violations(df: DataFrame, grants: DataFrame, shape: str, app: str, caller, where: Column,
                               set_values: dict, policies: DataFrame, table: str,
                               owner_col: str = "user_id") -> DataFrame:
    """The new rows that would make ``governed_update`` fail."""
    new, allowed = _updated(df, grants, shape, app, caller, where, set_values, policies, table, owner_col)
    return new.filter(~F.coalesce(allowed, F.lit(False))).drop("_hit")


def governed_delete(df: DataFrame, grants: DataFrame, shape: str, app: str, caller, where: Column,
                    policies: DataFrame, table: str, owner_col: str = "user_id"):
    """DELETE ... WHERE under the policy; without a DELETE policy nothing goes.
    Returns (new_df, affected_count_df)."""
    ok = may_change(grants, shape, app, caller, F.col(owner_col), policies, table, "DELETE")
    flagged = df.withColumn("_hit", F.coalesce(where & ok, F.lit(False)))
    return (flagged.filter(~F.col("_hit")).drop("_hit"),
            flagged.agg(F.count(F.when(F.col("_hit"), 1)).alias("affected")))


def _verb_exists(policies: DataFrame, table: str, verb: str) -> Column:
    return (policies.filter((F.col("tablename") == table) & F.upper("cmd").isin(verb, "ALL"))
            .select(F.lit(1)).exists())


# M14
def mark_instead_of_delete(df: DataFrame, keys: DataFrame, key: str, status: str,
                           status_col: str = "status") -> DataFrame:
    """Set ``status`` on the keyed rows instead of deleting them."""
    k = keys.select(key).distinct().withColumn("_mark", F.lit(True))
    j = df.join(k, key, "left")
    st = F.when(F.col("_mark"), F.lit(status)).otherwise(F.col(status_col))
    return j.select(*[st.alias(c) if c == status_col else F.col(c) for c in df.columns])


# M15
def backfill_owner(df: DataFrame, owner_col: str, owner) -> DataFrame:
    """Fill null owners before the personal shape applies; the job fails if
    any owner is still null afterwards (a null ``owner``)."""
    filled = F.coalesce(F.col(owner_col), F.lit(owner).cast(df.schema[owner_col].dataType))
    return _require(df.withColumn(owner_col, filled), F.col(owner_col).isNotNull(),
                    f"{owner_col} still null after backfill")


# M17
def dismiss(dismissed: DataFrame, new: DataFrame, keys=("posting_id", "user_id")) -> DataFrame:
    """Add suppression rows only; nothing else is touched."""
    return dismissed.unionByName(new.select(*dismissed.columns)).dropDuplicates(list(keys))
