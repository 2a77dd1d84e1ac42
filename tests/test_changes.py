"""Grant changes, invitations, deletions and governed writes on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from tessera.functions import scalar as sx
from tessera.operators import changes as ch

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")

GRANT_SCHEMA = "user_id bigint, app string, role string, granted_at timestamp_ntz, granted_by bigint"
ERRORS = (PySparkException, Py4JJavaError)


@pytest.fixture
def grants(spark):
    return spark.createDataFrame([(1, "platform", "app_admin", T0, None), (2, "crm", "member", T0, 1),
                                  (3, "crm", "member", T0, 1)], GRANT_SCHEMA)


def as_set(df, cols=("user_id", "app", "role", "granted_by")):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_role_only_upsert_keeps_attribution(spark, grants):
    new = spark.createDataFrame([(2, "crm", "app_admin", 9), (4, "crm", "member", 9)],
                                "user_id bigint, app string, role string, granted_by bigint")
    out = ch.upsert_grants(grants, new, "role_only", now=now())
    got = {r.user_id: r for r in out.filter("app = 'crm'").collect()}
    assert got[2].role == "app_admin" and got[2].granted_by == 1 and got[2].granted_at == T0
    assert got[4].granted_by == 9 and got[4].granted_at == dt.datetime(2024, 1, 15)


def test_merge_all_updates_supplied_columns(spark, grants):
    new = spark.createDataFrame([(2, "crm", "app_admin", 9)], "user_id bigint, app string, role string, granted_by bigint")
    r = ch.upsert_grants(grants, new, "merge_all", now=now()).filter("user_id = 2").first()
    assert (r.role, r.granted_by, r.granted_at) == ("app_admin", 9, T0)


def test_upsert_is_idempotent(spark, grants):
    new = spark.createDataFrame([(2, "crm", "app_admin", 9), (5, "shop", "member", 9)],
                                "user_id bigint, app string, role string, granted_by bigint")
    once = ch.upsert_grants(grants, new, "role_only", now=now())
    twice = ch.upsert_grants(once, new, "role_only", now=now())
    assert as_set(once) == as_set(twice)


def test_revoke_then_grant_restores_role(spark, grants):
    keys = spark.createDataFrame([(2, "crm")], "user_id bigint, app string")
    gone = ch.revoke(grants, keys)
    assert gone.count() == 2
    back = ch.upsert_grants(gone, spark.createDataFrame([(2, "crm", "member", 1)],
                                                        "user_id bigint, app string, role string, granted_by bigint"),
                            "merge_all", now=now())
    assert as_set(back) == as_set(grants)


def test_revoke_needs_the_composite_key(spark, grants):
    with pytest.raises(ValueError):
        ch.revoke(grants, spark.createDataFrame([(2,)], "user_id bigint"))


def test_duplicate_key_in_batch_fails_the_job(spark, grants):
    new = spark.createDataFrame([(2, "crm", "app_admin", 9), (2, "crm", "member", 9)],
                                "user_id bigint, app string, role string, granted_by bigint")
    with pytest.raises(ERRORS):
        ch.upsert_grants(grants, new, "role_only", now=now()).collect()


def test_defaults_only_fill_absent_columns(spark):
    df = spark.createDataFrame([(1, "crm", None)], "user_id bigint, app string, role string")
    r = ch.apply_defaults(df, ch.grant_defaults(now())).first()
    assert r.role is None and r.granted_at == dt.datetime(2024, 1, 15)


def test_email_rules(spark):
    df = spark.createDataFrame([("a@b.co",), ("a@b.co\n",), (" A@B.CO ",), ("a b@c.de",), ("nope",), (None,)], "e string")
    got = [(r.n, r.ok) for r in df.select(sx.normalize_email("e").alias("n"),
                                          sx.is_email(sx.normalize_email("e")).alias("ok")).collect()]
    assert got == [("a@b.co", True), ("a@b.co\n", False), ("a@b.co", True), ("a b@c.de", False),
                   ("nope", False), (None, None)]


def _invite(spark, rows, caller=1, accounts=None, cap=10):
    req = spark.createDataFrame(rows, "request_id bigint, target_email string, grants string")
    acc = accounts or spark.createDataFrame([(1, "admin@x.io", T0, T0)],
                                            "user_id bigint, email string, invited_at timestamp_ntz, "
                                            "last_sign_in_at timestamp_ntz")
    g = spark.createDataFrame([(1, "platform", "app_admin", T0, None)], GRANT_SCHEMA)
    out = ch.validate_invites(req, acc, g, caller, now(), cap=cap)
    return {r.request_id: (r.reason_code, r.accepted) for r in out.collect()}


def test_invitation_first_failing_rule_wins(spark):
    got = _invite(spark, [
        (1, "not-an-address", '[{"app":"platform","role":"app_admin"}]'),
        (2, "new@x.io", '{"app":"crm","role":"member"}'),
        (3, "new3@x.io", '[{"app":"crm","role":"member"},{"app":"crm"},{"app":"x","role":"owner"}]'),
        (4, "new4@x.io", '[{"app":"crm","role":"owner"},{"app":"platform","role":"app_admin"}]'),
        (5, "new5@x.io", '[{"app":"platform","role":"app_admin"}]'),
        (6, " Admin@X.io ", "[]"),
        (7, "new7@x.io", None),
        (8, "dup@x.io", "[]"),
        (9, "DUP@x.io", "[]"),
        (10, "new10@x.io\n", "[]"),
    ])
    assert got == {1: ("bad_email", False), 2: ("not_array", False), 3: ("missing_field", False),
                   4: ("unknown_role", False), 5: ("platform", False), 6: ("exists", False),
                   7: (None, True), 8: ("duplicate", False), 9: ("duplicate", False), 10: ("bad_email", False)}


def test_invitation_refused_for_non_admin(spark):
    got = _invite(spark, [(1, "new@x.io", "[]")], caller=2)
    assert got == {1: ("not_admin", False)}


def test_invitation_cap_counts_recent_and_earlier_in_batch(spark):
    recent = [(100 + i, f"r{i}@x.io", dt.datetime(2024, 1, 14, 23, 30), None) for i in range(8)]
    acc = spark.createDataFrame([(1, "admin@x.io", T0, T0)] + recent,
                                "user_id bigint, email string, invited_at timestamp_ntz, last_sign_in_at timestamp_ntz")
    got = _invite(spark, [(i, f"n{i}@x.io", "[]") for i in range(1, 6)], accounts=acc)
    assert [got[i][1] for i in range(1, 6)] == [True, True, False, False, False]
    assert got[3][0] == "rate_cap"


def test_delete_refusals_in_order(spark):
    targets = spark.createDataFrame([(None,), (1,), (7,), (5,), (3,)], "target_id bigint")
    accounts = spark.createDataFrame([(1, "a"), (3, "c"), (5, "e")], "user_id bigint, email string")
    g = spark.createDataFrame([(1, "platform", "app_admin", T0, None), (5, "platform", "app_admin", T0, 1)],
                              GRANT_SCHEMA)
    got = {r.target_id: r.reason_code for r in ch.delete_decisions(targets, accounts, g, 1).collect()}
    assert got == {None: "no_id", 1: "self", 7: "missing", 5: "admin", 3: None}
    got = {r.target_id: r.reason_code for r in ch.delete_decisions(targets, accounts, g, 3).collect()}
    assert set(got.values()) == {"not_admin"}


def test_clear_attribution_keeps_targets_own_rows(spark):
    g = spark.createDataFrame([(2, "crm", "member", T0, 5), (5, "crm", "member", T0, 5), (3, "crm", "member", T0, 1)],
                              GRANT_SCHEMA)
    t = spark.createDataFrame([(5,)], "target_id bigint")
    got = {r.user_id: r.granted_by for r in ch.clear_attribution(g, t).collect()}
    assert got == {2: None, 5: 5, 3: 1}


def test_cascade_actions(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, owner bigint")
    t = spark.createDataFrame([(5,)], "target_id bigint")
    assert sorted(r.id for r in ch.cascade_delete(df, "owner", "c", t).collect()) == [2, 3]
    assert {r.id: r.owner for r in ch.cascade_delete(df, "owner", "n", t).collect()} == {1: None, 2: 6, 3: None}
    assert {r.id: r.owner for r in ch.cascade_delete(df, "owner", "d", t, default=0).collect()}[1] == 0
    with pytest.raises(ValueError):
        ch.cascade_delete(df, "owner", "d", t)
    assert [r.target_id for r in ch.blocking_targets(df, "owner", t).collect()] == [5]


def test_end_sessions_counts_zero_is_normal(spark):
    s = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "session_id int, user_id bigint")
    k = spark.createDataFrame([(1, "5")], "token_id int, user_id_text string")
    t = spark.createDataFrame([(5,), (7,)], "target_id bigint")
    rep, rest, rest_k = ch.end_sessions(s, k, t)
    assert {r.user_id: (r.sessions_ended, r.tokens_revoked) for r in rep.collect()} == {5: (2, 1), 7: (0, 0)}
    assert rest.count() == 1 and rest_k.count() == 0


def test_end_sessions_guards(spark):
    s = spark.createDataFrame([(1, 5)], "session_id int, user_id bigint")
    k = spark.createDataFrame([(1, "5")], "token_id int, user_id_text string")
    t = spark.createDataFrame([(5,), (None,)], "target_id bigint")
    g = spark.createDataFrame([(1, "platform", "app_admin", T0, None)], GRANT_SCHEMA)
    rep, rest, _ = ch.end_sessions(s, k, t, grants=g, caller=2)
    assert {r.reason_code for r in rep.collect()} == {"not_admin"} and rest.count() == 1
    rep, rest, _ = ch.end_sessions(s, k, t, grants=g, caller=1)
    assert {r.user_id: r.reason_code for r in rep.collect()} == {5: None, None: "no_id"} and rest.count() == 0


def test_decide_changes(spark):
    g = spark.createDataFrame([(1, "platform", "app_admin", T0, None), (2, "crm", "member", T0, 1)], GRANT_SCHEMA)
    changes = spark.createDataFrame([("a", 1, "platform", None), ("b", 2, "platform", "app_admin"),
                                     ("c", 2, "crm", None), ("e", 1, "crm", None), ("f", 3, "crm", "member"),
                                     ("g", 3, "crm", None), ("h", 4, "crm", "member")],
                                    "change_id string, user_id bigint, app string, role string")
    got = {r.change_id: (r.outcome, r.end_sessions) for r in ch.decide_changes(changes, g, 1).collect()}
    assert got == {"a": ("refused", False), "b": ("needs_confirmation", False), "c": ("apply", True),
                   "e": ("no-op", False), "f": ("duplicate", False), "g": ("duplicate", False), "h": ("apply", False)}
    others = {(r.outcome, r.end_sessions) for r in ch.decide_changes(changes, g, 2).collect()}
    assert others == {("not_admin", False)}


def test_governed_insert_raises_and_writes_nothing(spark):
    g = spark.createDataFrame([(1, "crm", "member", T0, None)], GRANT_SCHEMA)
    base = spark.createDataFrame([(1, 1)], "row_id bigint, user_id bigint")
    ok = spark.createDataFrame([(2, 1)], "row_id bigint, user_id bigint")
    bad = spark.createDataFrame([(3, 2)], "row_id bigint, user_id bigint")
    assert ch.governed_insert(base, ok, g, "personal", "crm", 1).count() == 2
    refused = ch.governed_insert(base, ok.unionByName(bad), g, "personal", "crm", 1)
    for read in (refused.collect, refused.count, refused.select("user_id").collect):
        with pytest.raises(ERRORS):
            read()
    assert ch.governed_insert_violations(bad, g, "personal", "crm", 1).count() == 1


def test_governed_update_and_delete_skip_silently(spark):
    g = spark.createDataFrame([(1, "crm", "member", T0, None)], GRANT_SCHEMA)
    df = spark.createDataFrame([(1, 1, 5.0), (2, 2, 5.0)], "row_id bigint, user_id bigint, v double")
    pol = spark.createDataFrame([("t", "SELECT"), ("u", "UPDATE")], "tablename string, cmd string")
    args = (df, g, "personal", "crm", 1, F.lit(True))
    out, n = ch.governed_update(*args, {"v": F.col("v") + 1}, pol, "u")
    assert {r.row_id: r.v for r in out.collect()} == {1: 6.0, 2: 5.0} and n.first().affected == 1
    out, n = ch.governed_update(*args, {"v": F.col("v") + 1}, pol, "t")
    assert {r.row_id: r.v for r in out.collect()} == {1: 5.0, 2: 5.0} and n.first().affected == 0
    rest, n = ch.governed_delete(*args, pol, "t")
    assert rest.count() == 2 and n.first().affected == 0


def test_governed_update_cannot_give_rows_away(spark):
    g = spark.createDataFrame([(1, "crm", "member", T0, None)], GRANT_SCHEMA)
    df = spark.createDataFrame([(1, 1, 5.0), (2, 2, 5.0)], "row_id bigint, user_id bigint, v double")
    pol = spark.createDataFrame([("u", "ALL")], "tablename string, cmd string")
    args = (df, g, "personal", "crm", 1, F.lit(True), {"user_id": F.lit(2)}, pol, "u")
    out, n = ch.governed_update(*args)
    for read in (out.count, n.collect, out.select("v").collect):
        with pytest.raises(ERRORS):
            read()
    assert [r.row_id for r in ch.governed_update_violations(*args).collect()] == [1]


def test_backfill_owner_fails_if_still_null(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "id int, owner bigint")
    assert [r.owner for r in ch.backfill_owner(df, "owner", 9).orderBy("id").collect()] == [9, 3]
    for read in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("id").collect()):
        with pytest.raises(ERRORS):
            read(ch.backfill_owner(df, "owner", None))


def test_malformed_and_repeating_grant_lists_refuse_their_own_request(spark, grants):
    accounts = spark.createDataFrame([(9, "a@x.io", T0, None, None)], "user_id bigint, email string, "
                                     "created_at timestamp_ntz, last_sign_in_at timestamp_ntz, invited_at timestamp_ntz")
    lists = {1: "[oops", 2: '[{"app":"crm","role":"member"}', 3: "[1]", 4: '{"app":"crm","role":"member"}',
             5: '[{"app":"crm","role":"member"},{"app":"crm","role":"app_admin"}]', 6: None, 7: ' [{"app":"crm","role":"member"}]',
             8: "", 9: "null"}
    req = spark.createDataFrame([(k, f"n{k}@x.io", v) for k, v in lists.items()],
                                "request_id bigint, target_email string, grants string")
    dec = ch.validate_invites(req, accounts, grants, 1, now())
    assert {r.request_id: r.reason_code for r in dec.collect()} == {
        1: "not_array", 2: "not_array", 3: "missing_field", 4: "not_array", 5: "repeated_app", 6: None, 7: None,
        8: "not_array", 9: "not_array"}
    report, new, table = ch.apply_invites(dec, accounts, grants, 1, now())
    assert {(r.email, r.granted) for r in report.collect()} == {("n6@x.io", 0), ("n7@x.io", 1)}
    assert table.count() == 4 and new.count() == 2


def test_an_account_without_an_email_is_missing(spark, grants):
    accounts = spark.createDataFrame([(1, "a@x.io"), (2, None), (3, "c@x.io")], "user_id bigint, email string")
    t = spark.createDataFrame([(2,), (3,), (9,)], "target_id bigint")
    got = {r.target_id: r.reason_code for r in ch.delete_decisions(t, accounts, grants, 1).collect()}
    assert got == {2: "missing", 3: None, 9: "missing"}


def test_verdicts_keyed_by_posting_and_user(spark):
    m = spark.createDataFrame([(1, 1, 50), (1, 2, 60)], "posting_id bigint, user_id bigint, score bigint")
    new = spark.createDataFrame([(1, 1, 70)], "posting_id bigint, user_id bigint, score bigint")
    got = {(r.posting_id, r.user_id): r.score for r in ch.upsert(m, new, ("posting_id", "user_id"), ["score"]).collect()}
    assert got == {(1, 1): 70, (1, 2): 60}


def test_dismiss_adds_only(spark):
    d = spark.createDataFrame([(1, 1)], "posting_id bigint, user_id bigint")
    new = spark.createDataFrame([(1, 1), (2, 1)], "posting_id bigint, user_id bigint")
    assert ch.dismiss(d, new).count() == 2
