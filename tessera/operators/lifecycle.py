"""End-to-end changes, each published
as one version.

Every function decides with the operators of ``changes``, computes the new
tables, and publishes them together under one manifest: readers see all of
the change or none of it (the reference's account creation and grants were
not atomic; these are). Decisions are judged against the state before the
batch, and the decision table is returned as the report. ``base_version`` is
the published version that the given tables were read from: a newer one makes
the change fail, instead of being undone by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import access as acc
from tessera.operators import cascade as cas
from tessera.operators import changes as ch
from tessera.sources import publish as pub

BLOCKED_REASON = " is still referenced under a restricting foreign key; nothing was deleted"


# §3.2 invitation: M4 -> M5 -> publish
def commit_invitations(requests: DataFrame, accounts: DataFrame, grants: DataFrame, caller, now: Column,
                       root: str, cap: int = ch.HOURLY_CAP, base_version: int | None = None) -> DataFrame:
    """Validate, create the accepted accounts and their grants, publish
    ``accounts`` and ``grants`` together; returns the decisions.

    ``accounts`` carries ``invited_at`` (the cap counts recent invitations);
    new accounts get ``invited_at = now``.
    """
    decisions = ch.validate_invites(requests, accounts, grants, caller, now, cap=cap)
    report, new_accounts, new_grants = ch.apply_invites(decisions, accounts, grants, caller, now)
    new_accounts = new_accounts.withColumn("invited_at", now.cast(accounts.schema["invited_at"].dataType))
    all_accounts = accounts.unionByName(new_accounts.select(*accounts.columns))
    pub.publish({"accounts": all_accounts, "grants": new_grants}, root, base_version)
    return decisions.join(report.select("email", "user_id", "granted"), "email", "left")


# §3.3 grant change: M10 -> M2/M3 -> M9 -> publish
def commit_grant_changes(changes: DataFrame, grants: DataFrame, sessions: DataFrame, tokens: DataFrame,
                         caller, now: Column, root: str, key: str = "change_id",
                         base_version: int | None = None) -> DataFrame:
    """Apply the changes M10 allows (a role sets or merges the grant, a null
    role revokes it), end the sessions of people whose access was revoked by
    someone else, publish grants, sessions and tokens together; returns the
    outcomes. A batch may change each (user, app) once: several changes to one
    are all refused. For a caller who is no platform admin nothing is published."""
    outcomes = ch.decide_changes(changes, grants, caller, key)
    if not changes.sparkSession.range(1).select(acc.is_platform_admin(grants, caller)).first()[0]:
        return outcomes
    todo = outcomes.filter(F.col("outcome") == "apply")
    upserts = todo.filter(F.col("role").isNotNull()).select(
        "user_id", "app", "role", F.lit(caller).cast(grants.schema["granted_by"].dataType).alias("granted_by"))
    revokes = todo.filter(F.col("role").isNull()).select("user_id", "app")
    new_grants = ch.upsert_grants(ch.revoke(grants, revokes), upserts, "merge_all", now=now, caller=caller)
    targets = todo.filter("end_sessions").select(F.col("user_id").alias("target_id")).distinct()
    _, rest_sessions, rest_tokens = ch.end_sessions(sessions, tokens, targets, grants=grants, caller=caller)
    pub.publish({"grants": new_grants, "sessions": rest_sessions, "tokens": rest_tokens}, root, base_version)
    return outcomes


# account erasure: M6 -> M7 -> M8 -> M9 -> publish
def commit_deletions(targets: DataFrame, accounts: DataFrame, grants: DataFrame, caller, root: str,
                     owned: dict[str, tuple] | None = None,
                     sessions: DataFrame | None = None, tokens: DataFrame | None = None,
                     target_col: str = "target_id", base_version: int | None = None) -> DataFrame:
    """Delete the accounts M6 accepts: attribution cleared (M7), grants and
    ``owned`` tables handled by their foreign-key action (M8: name -> (df,
    owner column, action)), sessions and tokens ended (M9), everything
    published together; set-default keys give the default as a fourth item.
    A target still referenced under a restrict/no-action key is refused, and
    nothing of it is deleted."""
    owned = owned or {}
    decisions = ch.delete_decisions(targets, accounts, grants, caller, target_col)
    accepted = decisions.filter("accepted").select(target_col)
    blocked = None
    for df, col, action, *_ in owned.values():
        if action in ("r", "a"):
            b = ch.blocking_targets(df, col, accepted, target_col)
            blocked = b if blocked is None else blocked.unionByName(b)
    if blocked is not None:
        blocked = blocked.distinct().withColumn("_blocked", F.lit(True))
        decisions = (decisions.join(blocked, target_col, "left")
                     .withColumn("reason_code", F.when(F.col("_blocked"), F.lit("blocked"))
                                 .otherwise(F.col("reason_code")))
                     .withColumn("reason", F.when(F.col("_blocked"), F.concat(
                         F.col("email"), F.lit(BLOCKED_REASON))).otherwise(F.col("reason")))
                     .withColumn("accepted", F.col("accepted") & F.col("_blocked").isNull()).drop("_blocked"))
        accepted = decisions.filter("accepted").select(target_col)
    tables = {
        "accounts": accounts.join(accepted.withColumnRenamed(target_col, "user_id"), "user_id", "left_anti"),
        "grants": ch.cascade_delete(ch.clear_attribution(grants, accepted, target_col), "user_id", "c",
                                    accepted, target_col),
    }
    for name, (df, col, action, *default) in owned.items():
        tables[name] = ch.cascade_delete(df, col, action, accepted, target_col,
                                         default[0] if default else None)
    if sessions is not None and tokens is not None:
        _, tables["sessions"], tables["tokens"] = ch.end_sessions(sessions, tokens, accepted, target_col,
                                                                      grants=grants, caller=caller)
    pub.publish(tables, root, base_version)
    return decisions


# account erasure along the whole foreign-key graph: M6 -> M8 (transitive) -> M7 -> M9 -> publish
def commit_cascading_deletions(targets: DataFrame, tables: dict[str, tuple[DataFrame, str | None]], fks: list[cas.ForeignKey],
                               caller, root: str, accounts: str = "accounts", grants: str = "grants",
                               sessions: str | None = None, tokens: str | None = None, target_col: str = "target_id",
                               base_version: int | None = None) -> DataFrame:
    """Delete the accounts M6 accepts and all that the foreign keys ``fks`` of ``tables`` (name -> (df, key column)) say goes or
    changes with them, at any depth; returns the decisions.

    A target that a restricting key stands against at any level is refused, and nothing of it goes. Attribution on
    grants is cleared first (M7), so who granted a right doesn't hold its giver back. Every table that changes is
    published in one version, with ``impact`` and the number of refused targets in its notes.
    """
    rights = tables[grants][0]
    decisions = ch.delete_decisions(targets, tables[accounts][0], rights, caller, target_col)
    asked = decisions.filter("accepted").select(target_col).distinct()

    def delete(some: DataFrame) -> cas.Cascade:
        cleared = ch.clear_attribution(rights, some, target_col)
        return cas.cascade_delete(tables | {grants: (cleared, tables[grants][1])}, fks, some, accounts, target_col)
    done = delete(asked)
    refused = done.refused.select(F.col("key").alias(target_col), F.lit(True).alias("_blocked"))
    if not refused.isEmpty():  # the attribution of refused targets stays: once more for the others alone
        done = delete(done.accepted.select(F.col("key").alias(target_col)))
    gone = done.accepted.select(F.col("key").alias(target_col))
    decisions = (decisions.join(refused, target_col, "left")
                 .withColumn("reason_code", F.when(F.col("_blocked"), F.lit("blocked")).otherwise(F.col("reason_code")))
                 .withColumn("reason", F.when(F.col("_blocked"), F.concat("email", F.lit(BLOCKED_REASON))).otherwise(F.col("reason")))
                 .withColumn("accepted", F.col("accepted") & F.col("_blocked").isNull()).drop("_blocked"))
    left = {grants: ch.clear_attribution(rights, gone, target_col)} | done.tables
    if sessions and tokens:
        _, left[sessions], left[tokens] = ch.end_sessions(left.get(sessions, tables[sessions][0]), left.get(tokens, tables[tokens][0]),
                                                          gone, target_col, grants=rights, caller=caller)
    impact = [r.asDict() for r in done.impact.collect()]  # one row per foreign key
    pub.publish(left, root, base_version, notes={"impact": impact, "refused": refused.count()})
    return decisions
