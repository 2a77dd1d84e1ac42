"""Scalar expressions of the access model and the filters built on them.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. An address is one run of non-space, non-@ characters, an @,
# and a dotted domain. `\A...\z` anchors the whole string: Java's `$` would
# also match before a trailing newline.
EMAIL_PATTERN = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
DEFAULT_TOKEN_SECONDS = 3600
REFRESH_MARGIN_SECONDS = 60
NULL_MARK = "~NULL~"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered(*cols) -> list[Column]:
    """Sort keys with the null position stated: ascending names sort nulls
    last (the SQL convention of the original queries; Spark's default is
    first). Pass a Column for anything else, e.g. ``desc_nulls_first()``."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def normalize_email(c) -> Column:
    """lower(trim(x)): strips spaces only, a newline survives."""
    return F.lower(F.trim(_c(c)))


def is_email(c) -> Column:
    """True when the text is one address (null stays null)."""
    return _c(c).rlike(EMAIL_PATTERN)


def strip_scheme(c) -> Column:
    """The url shown as a link label: scheme removed."""
    return F.regexp_replace(_c(c), r"^https?://", "")


def plural_apps(n) -> Column:
    """`no access`, `1 app`, `n apps`."""
    n = _c(n)
    return (F.when(n == 0, F.lit("no access"))
            .when(n == 1, F.lit("1 app"))
            .otherwise(F.concat(n.cast("string"), F.lit(" apps"))))


def last_sign_in_text(c) -> Column:
    """`last sign-in YYYY-MM-DD` or `never signed in`."""
    c = _c(c)
    return F.when(c.isNull(), F.lit("never signed in")).otherwise(
        F.concat(F.lit("last sign-in "), F.substring(c.cast("string"), 1, 10)))


def as_invitations(accounts: DataFrame) -> DataFrame:
    """Fixture mapping: invited_at = created_at, confirmed_at = last_sign_in_at."""
    return (accounts.withColumn("invited_at", F.col("created_at"))
            .withColumn("confirmed_at", F.col("last_sign_in_at")))


# F13
def pending_invitations(accounts: DataFrame) -> DataFrame:
    """Invited and not yet confirmed."""
    return accounts.filter(F.col("invited_at").isNotNull() & F.col("confirmed_at").isNull())


# F14
def session_expiry(start_col: str = "started_at", expires_at_col: str | None = None,
                   expires_in_col: str | None = None) -> Column:
    """expires_at, else start + coalesce(expires_in, 3600) seconds."""
    secs = F.col(expires_in_col) if expires_in_col else F.lit(None)
    derived = F.col(start_col) + F.make_dt_interval(
        secs=F.coalesce(secs, F.lit(DEFAULT_TOKEN_SECONDS)).cast("decimal(18,6)"))
    return F.coalesce(F.col(expires_at_col), derived) if expires_at_col else derived


def expiring_sessions(sessions: DataFrame, now: Column, margin: int = REFRESH_MARGIN_SECONDS,
                      start_col: str = "started_at", expires_at_col: str | None = None,
                      expires_in_col: str | None = None) -> DataFrame:
    """Sessions due for refresh: expires_at - margin <= now."""
    exp = session_expiry(start_col, expires_at_col, expires_in_col)
    return (sessions.withColumn("expires_at", exp)
            .filter(F.col("expires_at") - F.make_dt_interval(secs=F.lit(margin)) <= now))


# F15
def has_json_key(c, key: str) -> Column:
    """The JSON object has ``key`` at the top level, even when its value is null."""
    return F.array_contains(F.json_object_keys(_c(c)), F.lit(key))


def rows_with_json_key(df: DataFrame, col: str, key: str) -> DataFrame:
    return df.filter(has_json_key(col, key))


def json_array_type_ok(c) -> Column:
    """A JSON text is a whole, well-formed array. Null stays null; malformed text is false."""
    c = _c(c)
    opens = F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1) == F.lit("[")
    return opens & F.try_parse_json(c).isNotNull() & F.from_json(c, "array<string>").isNotNull()


def grant_entries(c) -> Column:
    """The entries (raw, app, role) of a JSON grant list; null for null or for anything but an array.

    An entry that is no object, or lacks a field, has null fields.
    """
    c = _c(c)
    raw = F.when(json_array_type_ok(c), F.from_json(c, "array<string>"))
    return F.transform(raw, lambda e: F.struct(e.alias("raw"), F.get_json_object(e, "$.app").alias("app"),
                                               F.get_json_object(e, "$.role").alias("role")))


def _param_pairs(part: Column, priority: int) -> Column:
    """(priority, pos, key, value) structs of one `a=b&c=d` part, decoded
    as form parameters (`+` is a space; a key without `=` has value '')."""
    items = F.filter(F.split(F.coalesce(part, F.lit("")), "&"), lambda x: x != "")
    return F.transform(items, lambda kv, i: F.struct(
        F.lit(priority).alias("priority"), i.alias("pos"),
        F.url_decode(F.split(kv, "=", 2)[0]).alias("key"),
        F.url_decode(F.coalesce(F.try_element_at(F.split(kv, "=", 2), F.lit(2)), F.lit(""))).alias("value")))


def link_params(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, key, value) for every parameter of a link; a parameter in the
    fragment wins over the same one in the query, and the first occurrence
    within a part wins. Each link's parameters are grouped on their own."""
    u = F.col(url_col)
    pairs = F.concat(_param_pairs(F.parse_url(u, F.lit("REF")), 0),
                     _param_pairs(F.parse_url(u, F.lit("QUERY")), 1))
    ex = df.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.*")
    return (ex.groupBy(id_col, "key")
            .agg(F.min_by("value", F.struct("priority", "pos")).alias("value")))


def invite_link(base: str, redirect_col) -> Column:
    """`base?redirect_to=<url-encoded target>`."""
    return F.concat(F.lit(base + "?redirect_to="), F.url_encode(_c(redirect_col)))


def checksum_line(cols: list[str], ts_cols: tuple[str, ...] = (), guard=None) -> Column:
    """One row as text: fields joined by '|', nulls as ~NULL~, timestamps as
    `yyyy-MM-dd HH:mm:ss.SSSSSS` in UTC (the session zone).

    ``guard`` lists the columns whose null is written as ~NULL~ (default:
    all). Passing the original digest's list (insurer, flag_status, note)
    reproduces it exactly: a null in an unguarded column nulls the whole
    line, and the aggregate then skips that row.
    """
    guarded = set(cols if guard is None else guard)
    parts = []
    for c in cols:
        v = (F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS") if c in ts_cols
             else F.col(c).cast("string"))
        parts.append(F.coalesce(v, F.lit(NULL_MARK)) if c in guarded else v)
    seps = [F.lit("|")] * (len(parts) - 1)
    return F.concat(*[x for pair in zip(parts, seps + [None]) for x in pair if x is not None])
