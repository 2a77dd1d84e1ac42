"""End-to-end changes, each published as one version."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import cascade as cas
from tessera.operators import lifecycle as lc
from tessera.sources import publish as pub

T0 = dt.datetime(2024, 1, 1)
GRANT_SCHEMA = "user_id bigint, app string, role string, granted_at timestamp_ntz, granted_by bigint"
ACC_SCHEMA = "user_id bigint, email string, created_at timestamp_ntz, last_sign_in_at timestamp_ntz, invited_at timestamp_ntz"


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


def base(spark):
    accounts = spark.createDataFrame([(1, "a@x.io", T0, T0, T0), (2, "b@x.io", T0, None, T0),
                                      (3, "c@x.io", T0, T0, T0), (4, "d@x.io", T0, T0, T0)], ACC_SCHEMA)
    grants = spark.createDataFrame([(1, "platform", "app_admin", T0, None), (2, "crm", "member", T0, 1),
                                    (3, "crm", "member", T0, 1), (2, "shop", "member", T0, 3)], GRANT_SCHEMA)
    sessions = spark.createDataFrame([(10, 2, "2"), (11, 3, "3"), (12, 1, "1")],
                                     "session_id int, user_id bigint, user_id_text string")
    return accounts, grants, sessions


def test_invitations_publish_accounts_and_grants_together(spark, tmp_path):
    accounts, grants, _ = base(spark)
    req = spark.createDataFrame([(1, "new1@x.io", '[{"app":"crm","role":"member"}]'),
                                 (2, "A@x.io", "[]"), (3, "new3@x.io", None)],
                                "request_id bigint, target_email string, grants string")
    root = str(tmp_path)
    out = {r.request_id: (r.accepted, r.user_id, r.granted) for r in
           lc.commit_invitations(req, accounts, grants, 1, now(), root).collect()}
    assert out == {1: (True, 5, 1), 2: (False, None, None), 3: (True, 6, 0)}
    acc = pub.read_published(spark, root, "accounts")
    assert acc.count() == 6 and acc.filter("email = 'new1@x.io'").first().invited_at == dt.datetime(2024, 1, 15)
    g = pub.read_published(spark, root, "grants")
    assert g.filter("user_id = 5").first().granted_by == 1 and g.count() == 5


def test_grant_changes_revoke_end_sessions_and_keep_refusals(spark, tmp_path):
    _, grants, sessions = base(spark)
    changes = spark.createDataFrame([("a", 2, "crm", None), ("b", 3, "platform", "app_admin"),
                                     ("c", 1, "platform", None), ("d", 3, "crm", "app_admin")],
                                    "change_id string, user_id bigint, app string, role string")
    root = str(tmp_path)
    out = {r.change_id: r.outcome for r in
           lc.commit_grant_changes(changes, grants, sessions, sessions.select("session_id", "user_id_text"),
                                   1, now(), root).collect()}
    assert out == {"a": "apply", "b": "needs_confirmation", "c": "refused", "d": "apply"}
    g = {(r.user_id, r.app): (r.role, r.granted_by) for r in pub.read_published(spark, root, "grants").collect()}
    assert (2, "crm") not in g and g[(3, "crm")] == ("app_admin", 1) and (1, "platform") in g
    assert (3, "platform") not in g
    assert sorted(r.user_id for r in pub.read_published(spark, root, "sessions").collect()) == [1, 3]


def test_grant_changes_of_a_caller_without_admin_publish_nothing(spark, tmp_path):
    _, grants, sessions = base(spark)
    changes = spark.createDataFrame([("a", 1, "platform", None), ("b", 2, "crm", "app_admin")],
                                    "change_id string, user_id bigint, app string, role string")
    root = str(tmp_path / "tables")
    out = lc.commit_grant_changes(changes, grants, sessions, sessions.select("session_id", "user_id_text"), 2, now(), root)
    assert {r.outcome for r in out.collect()} == {"not_admin"}
    assert not (tmp_path / "tables").exists()


def test_deletions_cascade_clear_attribution_and_respect_blocking_keys(spark, tmp_path):
    accounts, grants, sessions = base(spark)
    personal = spark.createDataFrame([(1, 3), (2, 2), (3, None)], "row_id int, owner bigint")
    audit = spark.createDataFrame([(1, 4)], "row_id int, actor bigint")
    targets = spark.createDataFrame([(3,), (4,), (1,)], "target_id bigint")
    root = str(tmp_path)
    dec = {r.target_id: r.reason_code for r in lc.commit_deletions(
        targets, accounts, grants, 1, root, owned={"personal": (personal, "owner", "c"),
                                                   "audit": (audit, "actor", "a")},
        sessions=sessions, tokens=sessions.select("session_id", "user_id_text")).collect()}
    assert dec == {3: None, 4: "blocked", 1: "self"}
    read = lambda n: pub.read_published(spark, root, n)
    assert sorted(r.user_id for r in read("accounts").collect()) == [1, 2, 4]
    g = {(r.user_id, r.app): r.granted_by for r in read("grants").collect()}
    assert (3, "crm") not in g and g[(2, "shop")] is None and g[(2, "crm")] == 1
    assert sorted(r.row_id for r in read("personal").collect()) == [2, 3]
    assert read("audit").count() == 1
    assert sorted(r.user_id for r in read("sessions").collect()) == [1, 2]


def test_deletions_along_the_whole_graph(spark, tmp_path):
    """Folders of an account and their files go with it, comments lose their author; a held file two levels below refuses."""
    accounts, grants, sessions = base(spark)
    folders = spark.createDataFrame([(10, 3), (11, 4), (12, 2)], "folder int, owner bigint")
    files = spark.createDataFrame([(100, 10), (101, 11), (102, 12)], "file int, folder int")
    holds = spark.createDataFrame([(101,)], "file int")
    comments = spark.createDataFrame([("a", 3), ("b", 4), ("c", None)], "body string, author bigint")
    tables = {"accounts": (accounts, "user_id"), "grants": (grants, None), "folders": (folders, "folder"), "files": (files, "file"),
              "holds": (holds, None), "comments": (comments, None), "sessions": (sessions, None),
              "tokens": (sessions.select("session_id", "user_id_text"), None)}
    fks = [cas.ForeignKey("grants", "user_id", "accounts", "c"), cas.ForeignKey("grants", "granted_by", "accounts", "a"),
           cas.ForeignKey("folders", "owner", "accounts", "c"), cas.ForeignKey("files", "folder", "folders", "c"),
           cas.ForeignKey("holds", "file", "files", "r"), cas.ForeignKey("comments", "author", "accounts", "n")]
    targets = spark.createDataFrame([(3,), (4,), (1,)], "target_id bigint")
    root = str(tmp_path)
    dec = {r.target_id: r.reason_code for r in lc.commit_cascading_deletions(
        targets, tables, fks, 1, root, sessions="sessions", tokens="tokens").collect()}
    assert dec == {3: None, 4: "blocked", 1: "self"}
    read = lambda n: pub.read_published(spark, root, n)
    assert sorted(r.user_id for r in read("accounts").collect()) == [1, 2, 4]
    g = {(r.user_id, r.app): r.granted_by for r in read("grants").collect()}
    before = {(r.user_id, r.app): r.granted_by for r in grants.collect()}
    assert g == {k: None if by == 3 else by for k, by in before.items() if k[0] != 3}
    assert sorted(r.file for r in read("files").collect()) == [101, 102]
    assert sorted((r.body, r.author) for r in read("comments").collect() if r.author) == [("b", 4)]
    assert 3 not in {r.user_id for r in read("sessions").collect()}
    notes = pub.current_manifest(spark, root)["notes"]
    assert notes["refused"] == 1 and {(i["tbl"], i["column"]): i["rows"] for i in notes["impact"]}["files", "folder"] == 1
