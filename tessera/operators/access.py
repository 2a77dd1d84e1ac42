"""Access decisions from a grants table.

The grants table has key (user_id, app) and role in ('member', 'app_admin');
the app ``platform`` is reserved, and app_admin on it administers grants.

Two evaluation forms:

* one caller: the decision is an uncorrelated ``EXISTS`` / scalar subquery on
  grants filtered to that caller. Catalyst evaluates it once per query (not per
  row) and the key bounds it to one row, so the governed table is filtered
  without any join or shuffle.
* every caller at once: callers are joined to grants on user_id, letting
  Catalyst/AQE choose broadcast or shuffle from runtime sizes.

``governed`` protects results, it is not a sandbox: Spark may evaluate a
user predicate before the access filter, so a hostile UDF could observe rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the access model.
PLATFORM = "platform"
ROLES = ("member", "app_admin")
ADMIN = "app_admin"
SHAPES = ("shared", "personal")


def _caller(caller) -> Column:
    return caller if isinstance(caller, Column) else F.lit(caller)


def grant_of(grants: DataFrame, caller, app: str) -> DataFrame:
    """The caller's grant row for one app: at most one row by the key."""
    return grants.filter((F.col("user_id") == _caller(caller)) & (F.col("app") == F.lit(app)))


# F1
def has_app_access(grants: DataFrame, caller, app: str) -> Column:
    """True iff a (caller, app) grant exists, any role; a null caller gives false."""
    return grant_of(grants, caller, app).select(F.lit(1)).exists()


# F2
def app_role(grants: DataFrame, caller, app: str) -> Column:
    """The caller's role text in ``app`` or null."""
    return grant_of(grants, caller, app).select("role").scalar()


# F3
def is_platform_admin(grants: DataFrame, caller) -> Column:
    return (grant_of(grants, caller, PLATFORM)
            .filter(F.col("role") == ADMIN).select(F.lit(1)).exists())


# F4, F5
def governed(df: DataFrame, grants: DataFrame, shape: str, app: str, caller,
             owner_col: str = "user_id") -> DataFrame:
    """Rows of ``df`` (a table of ``app``) that ``caller`` may read.

    shared: every row if the caller holds any grant on the app, else none.
    personal: additionally the caller's own rows unless they are app_admin of
    the app; a null owner matches no caller, so only an app_admin reads it.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown policy shape {shape!r}; use one of {SHAPES}")
    gate = has_app_access(grants, caller, app)
    if shape == "shared":
        return df.filter(gate)
    return df.filter(gate & ((app_role(grants, caller, app) == F.lit(ADMIN))
                             | (F.col(owner_col) == _caller(caller))))


def resolve_role(grants: DataFrame, caller, app: str) -> str | None:
    """The caller's role in ``app`` as a value, null without a grant: the first of two planning steps.

    Reads the one grant row now. A key held twice is an error, as it is for the scalar subquery.
    """
    if caller is None:
        return None
    found = grant_of(grants, caller, app).select("role").take(2)
    if len(found) > 1:
        raise ValueError(f"grants hold ({caller}, {app}) more than once")
    return found[0]["role"] if found else None


# F4, F5 planned in two steps
def governed_now(df: DataFrame, grants: DataFrame, shape: str, app: str, caller, owner_col: str = "user_id",
                 app_col: str | None = None) -> DataFrame:
    """The rows of ``governed``, with the decision taken first and the filter built from literals.

    A condition over a subquery stays above the scan. Here the caller's grant is read while the query is
    planned, so what is left for a member is ``owner = <caller>``: it is pushed into the scan and
    skips files and row groups by their statistics and Bloom filters (see
    ``tessera.sources.governed_store``). Someone without access gets an empty relation and nothing is scanned. With
    ``app_col``, ``df`` holds several apps' rows and those of ``app`` are read, by partition where it is one.

    The decision holds for the returned DataFrame: build one per query and a revocation shows in the next.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown policy shape {shape!r}; use one of {SHAPES}")
    role = resolve_role(grants, caller, app)
    if role is None:
        return df.filter(F.lit(False))
    rows = df if app_col is None else df.filter(F.col(app_col) == F.lit(app))
    if shape == "shared" or role == ADMIN:
        return rows
    return rows.filter(F.col(owner_col) == F.lit(caller))


# F4 (write side), F6
def writable(df: DataFrame, grants: DataFrame, shape: str, app: str, caller,
             owner_col: str = "user_id") -> DataFrame:
    """Rows ``caller`` may change: no admin widening for the personal shape."""
    if shape not in SHAPES:
        raise ValueError(f"unknown policy shape {shape!r}; use one of {SHAPES}")
    gate = has_app_access(grants, caller, app)
    if shape == "shared":
        return df.filter(gate)
    return df.filter(gate & (F.col(owner_col) == _caller(caller)))


# F7
def governed_grants(grants: DataFrame, caller) -> DataFrame:
    """Own grants, or all of them for a platform admin."""
    return grants.filter((F.col("user_id") == _caller(caller)) | is_platform_admin(grants, caller))


# F8
def writable_grants(grants: DataFrame, caller) -> DataFrame:
    """Grant rows the caller may change (old and new row): platform admin only."""
    return grants.filter(is_platform_admin(grants, caller))


# F9
VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE")


def allowed_verbs(relations: DataFrame, policies: DataFrame) -> DataFrame:
    """(relname, verb, allowed) per relation: a verb with no policy reaches no rows.

    A policy with cmd ``ALL`` covers every verb; names meet within a schema where
    both snapshots have ``schemaname``. Policies are aggregated to one
    row per (table, verb) before the join, so a table with many policies does
    not multiply rows.
    """
    verbs = F.array(*[F.lit(v) for v in VERBS])
    scope = ["schemaname"] if "schemaname" in relations.columns and "schemaname" in policies.columns else []
    pol = (policies
           .select(*scope, F.col("tablename").alias("relname"),
                   F.explode(F.when(F.upper("cmd") == "ALL", verbs)
                             .otherwise(F.array(F.upper("cmd")))).alias("verb"))
           .distinct()
           .withColumn("allowed", F.lit(True)))
    rel = relations.select(*scope, "relname", F.explode(verbs).alias("verb"))
    return (rel.join(pol, [*scope, "relname", "verb"], "left")
            .select(*scope, "relname", "verb", F.coalesce("allowed", F.lit(False)).alias("allowed")))


def verb_gate(df: DataFrame, policies: DataFrame, table: str, verb: str) -> DataFrame:
    """All of ``df`` if ``table`` has a policy for ``verb`` (or ALL), else nothing."""
    has = (policies.filter((F.col("tablename") == table)
                           & F.upper("cmd").isin(verb.upper(), "ALL"))
           .select(F.lit(1)).exists())
    return df.filter(has)


# F10
def list_accounts(accounts: DataFrame, grants: DataFrame, caller) -> DataFrame:
    """Four columns of every account for a platform admin, an empty set otherwise."""
    return (accounts.filter(is_platform_admin(grants, caller))
            .select(F.col("user_id").alias("id"), "email", "created_at", "last_sign_in_at")
            .orderBy(F.col("email").asc_nulls_last()))


# F11
def own_grants(grants: DataFrame, caller) -> DataFrame:
    """The caller's own app/role rows, even for an admin, by app."""
    return (grants.filter(F.col("user_id") == _caller(caller))
            .select("app", "role").orderBy(F.col("app").asc_nulls_last()))


def platform_admins(grants: DataFrame) -> DataFrame:
    return (grants.filter((F.col("app") == PLATFORM) & (F.col("role") == ADMIN))
            .select("user_id").distinct())


# F12
def deletable_accounts(accounts: DataFrame, grants: DataFrame, caller) -> DataFrame:
    """Accounts the caller could delete: not themself and not a platform admin."""
    return (accounts.filter(~F.col("user_id").eqNullSafe(_caller(caller)))
            .join(platform_admins(grants), "user_id", "left_anti"))


# Every caller at once --------------------------------------------------------

def access_by_caller(callers: DataFrame, grants: DataFrame, app: str) -> DataFrame:
    """(user_id, has_access, role) for each caller in ``callers`` and one app."""
    g = grants.filter(F.col("app") == app).select("user_id", "role")
    return (callers.select("user_id").join(g, "user_id", "left")
            .select("user_id", F.col("role").isNotNull().alias("has_access"), "role"))


def platform_admin_flags(callers: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, is_platform_admin) for every caller."""
    adm = platform_admins(grants).withColumn("is_platform_admin", F.lit(True))
    return (callers.select("user_id").join(adm, "user_id", "left")
            .select("user_id", F.coalesce("is_platform_admin", F.lit(False)).alias("is_platform_admin")))


# A10
def visibility(df: DataFrame, grants: DataFrame, callers: DataFrame, app: str,
               owner_col: str = "user_id", shape: str = "personal") -> DataFrame:
    """Rows of ``df`` each caller would read, set-based.

    Totals and per-owner counts are aggregated first (partial aggregation on
    the map side), then joined to the callers' grants: the cost is one pass
    over ``df`` however many callers there are, and nothing pairs callers with
    rows.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    own = (df.filter(F.col(owner_col).isNotNull())
           .groupBy(F.col(owner_col).alias("user_id"))
           .agg(F.count(F.lit(1)).alias("own_rows")))
    acc = access_by_caller(callers, grants, app)
    out = acc.join(own, "user_id", "left").withColumn("total_rows", total)
    own_n = F.coalesce("own_rows", F.lit(0))
    if shape == "shared":
        visible = F.when(F.col("has_access"), F.col("total_rows")).otherwise(F.lit(0))
    else:
        visible = (F.when(~F.col("has_access"), F.lit(0))
                   .when(F.col("role") == ADMIN, F.col("total_rows"))
                   .otherwise(own_n))
    return out.select("user_id", "has_access", "role", own_n.alias("own_rows"),
                      F.col("total_rows"), visible.cast("bigint").alias("visible_rows"))


def probe(df: DataFrame, grants: DataFrame, probes: DataFrame, app: str,
          owner_col: str = "user_id", shape: str = "personal") -> DataFrame:
    """Impersonation probe as a table of (seq, label, result, verdict).

    ``probes`` holds (seq, label, caller, expect) where expect is ``all``
    (every row), ``own`` (the caller's rows), ``none`` or a number. A caller
    expected to read rows who holds no grant and reads nothing is
    ``inconclusive``: the impersonation, not the policy, failed. And where no
    probe of the run reads any row, reading nothing proves nothing: every such row
    is ``inconclusive`` too.
    """
    p = probes.withColumnRenamed("caller", "user_id")
    callers = p.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    # one scan: rows by the caller that owns them, all others together; their sum is the table's count
    known = callers.select(F.col("user_id").alias(owner_col), F.col("user_id").alias("_caller"))
    counts = df.select(owner_col).join(known, owner_col, "left").groupBy("_caller").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # as many rows as callers, and one that is there for an empty table, too
    both = (callers.select(F.col("user_id").alias("_caller")).unionByName(callers.sparkSession.range(1).select(F.lit(None).cast(
        callers.schema["user_id"].dataType).alias("_caller"))).withColumn("n", F.lit(0).cast("long")).unionByName(counts)
            .groupBy("_caller").agg(F.sum("n").alias("own_rows")).withColumn("t_all", F.sum("own_rows").over(every)))
    j = (p.join(access_by_caller(callers, grants, app), "user_id", "left")
         .join(both, F.col("user_id").eqNullSafe(F.col("_caller")), "left")
         .withColumn("own_rows", F.when(F.col("user_id").isNotNull(), F.col("own_rows"))))
    seen = F.when(F.col("has_access"), F.col("t_all") if shape == "shared" else
                  F.when(F.col("role") == ADMIN, F.col("t_all")).otherwise(F.col("own_rows")))
    j = j.withColumn("visible_rows", seen)
    got = F.coalesce("visible_rows", F.lit(0)).cast("bigint")
    want = (F.when(F.col("expect") == "all", F.col("t_all"))
            .when(F.col("expect") == "own", F.coalesce("own_rows", F.lit(0)))
            .when(F.col("expect") == "none", F.lit(0))
            .otherwise(F.col("expect").cast("bigint")))
    works = j.select(F.bool_or((got > 0) & (want > 0))).scalar()
    verdict = (F.when((got == 0) & ~F.coalesce(works, F.lit(False)), F.lit("inconclusive"))
               .when(got == want, F.lit("pass"))
               .when((want > 0) & (got == 0) & ~F.coalesce("has_access", F.lit(False)),
                     F.lit("inconclusive"))
               .otherwise(F.lit("fail")))
    return j.select("seq", "label", got.cast("string").alias("result"),
                    want.alias("expected"), verdict.alias("verdict"))
