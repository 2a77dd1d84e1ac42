"""Access decisions on hand-made rows (FIXTURES §2 edge cases) and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import sql as fsql
from tessera.operators import access as acc
from tessera.sources import governed_store as store

T0 = dt.datetime(2024, 1, 1)
GRANTS = [  # user 1 admin of platform and member of crm; user 2 app_admin of crm; user 3 member of shop
    (1, "platform", "app_admin", T0, None),
    (1, "crm", "member", T0, 1),
    (2, "crm", "app_admin", T0, 1),
    (3, "shop", "member", T0, 1),
]
GRANT_SCHEMA = "user_id bigint, app string, role string, granted_at timestamp_ntz, granted_by bigint"
ROWS = [(10, 1), (11, 2), (12, 2), (13, None), (14, 3)]  # (row_id, owner)


@pytest.fixture
def grants(spark):
    return spark.createDataFrame(GRANTS, GRANT_SCHEMA)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id bigint, user_id bigint")


def ids(df, col="row_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_shared_all_or_nothing(grants, rows):
    assert ids(acc.governed(rows, grants, "shared", "crm", 1)) == [10, 11, 12, 13, 14]
    assert ids(acc.governed(rows, grants, "shared", "crm", 3)) == []


def test_personal_admin_reads_null_owner_member_reads_own(grants, rows):
    assert ids(acc.governed(rows, grants, "personal", "crm", 2)) == [10, 11, 12, 13, 14]
    assert ids(acc.governed(rows, grants, "personal", "crm", 1)) == [10]
    # an owner without the grant sees nothing, their own rows included
    assert ids(acc.governed(rows, grants, "personal", "crm", 3)) == []


def test_null_caller_sees_nothing(grants, rows):
    for shape in ("shared", "personal"):
        assert ids(acc.governed(rows, grants, shape, "crm", None)) == []
    assert acc.list_accounts(rows.withColumnRenamed("row_id", "email")
                             .withColumn("created_at", F.lit(None)).withColumn("last_sign_in_at", F.lit(None)),
                             grants, None).count() == 0


def test_writes_never_widen_for_admin(grants, rows):
    assert ids(acc.writable(rows, grants, "personal", "crm", 2)) == [11, 12]
    assert ids(acc.writable(rows, grants, "shared", "crm", 2)) == [10, 11, 12, 13, 14]


def test_governed_is_subset_of_input(grants, rows):
    for caller in (None, 1, 2, 3, 99):
        for shape in ("shared", "personal"):
            out = set(ids(acc.governed(rows, grants, shape, "crm", caller)))
            assert out <= set(ids(rows))


def test_grants_table_policies(grants):
    assert acc.governed_grants(grants, 3).count() == 1
    assert acc.governed_grants(grants, 1).count() == 4
    assert acc.writable_grants(grants, 2).count() == 0
    assert acc.writable_grants(grants, 1).count() == 4


def test_unknown_shape_refused(grants, rows):
    with pytest.raises(ValueError):
        acc.governed(rows, grants, "public", "crm", 1)


def test_deletable_excludes_self_and_admins(spark, grants):
    accounts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id bigint, email string")
    assert ids(acc.deletable_accounts(accounts, grants, 2), "user_id") == [3]


def test_verbs_without_policy_reach_nothing(spark):
    rel = spark.createDataFrame([("t1",), ("t2",)], "relname string")
    pol = spark.createDataFrame([("t1", "SELECT"), ("t2", "ALL")], "tablename string, cmd string")
    got = {(r.relname, r.verb): r.allowed for r in acc.allowed_verbs(rel, pol).collect()}
    assert got[("t1", "SELECT")] and not got[("t1", "DELETE")]
    assert all(got[("t2", v)] for v in acc.VERBS)
    assert acc.verb_gate(rel, pol, "t1", "delete").count() == 0


def test_probe_inconclusive_when_impersonation_fails(spark, grants, rows):
    probes = spark.createDataFrame([(1, "owner reads", 3, "own"), (2, "admin reads", 2, "all"),
                                    (3, "nobody", None, "none")], "seq int, label string, caller bigint, expect string")
    got = {r.seq: r.verdict for r in acc.probe(rows, grants, probes, "crm").collect()}
    assert got == {1: "inconclusive", 2: "pass", 3: "pass"}


def test_sql_functions_follow_the_session_caller(spark, grants, rows):
    accounts = spark.createDataFrame([(1, "a@x.io", T0, None), (2, "b@x.io", T0, T0)],
                                     "user_id bigint, email string, created_at timestamp_ntz, "
                                     "last_sign_in_at timestamp_ntz")
    fsql.register_access_functions(spark, grants, accounts)
    rows.createOrReplaceTempView("crm_rows")
    q = "SELECT row_id FROM crm_rows WHERE has_app_access('crm') AND (app_role('crm') = 'app_admin' OR user_id = caller)"
    fsql.set_caller(spark, 2)
    assert ids(spark.sql(q)) == [10, 11, 12, 13, 14]
    fsql.set_caller(spark, 1)
    assert ids(spark.sql(q)) == [10]
    assert spark.sql("SELECT * FROM list_app_users()").count() == 2
    fsql.set_caller(spark, None)
    assert spark.sql(q).count() == 0
    assert spark.sql("SELECT * FROM list_app_users()").count() == 0


def test_governed_now_equals_governed(grants, rows):
    for shape in ("shared", "personal"):
        for caller in (None, 1, 2, 3, 99):
            assert ids(acc.governed_now(rows, grants, shape, "crm", caller)) == ids(acc.governed(rows, grants, shape, "crm", caller))
    with pytest.raises(ValueError):
        acc.governed_now(rows, grants, "private", "crm", 1)
    with pytest.raises(ValueError):
        acc.resolve_role(grants.unionByName(grants), 2, "crm")


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_members_filter_reaches_the_files(spark, tmp_path, grants):
    """Rows of 400 owners and two apps; the owner is pushed down, other files and row groups are skipped."""
    path = str(tmp_path / "store")
    rows = spark.range(40_000).select("id", (F.col("id") % 400).alias("owner_id"),
                                      F.when(F.col("id") % 3 == 0, "shop").otherwise("crm").alias("app"))
    rows = rows.unionByName(spark.range(10).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("owner_id"), F.lit("crm").alias("app")))
    store.write_governed(rows, path, ranges=16)

    def read(caller, app="crm"):
        return store.read_governed(spark, path, grants, "personal", app, caller)
    own = read(1)
    plan = plan_of(own)
    assert "EqualTo(owner_id,1)" in plan.split("PushedFilters:")[1].splitlines()[0]
    assert "(app" in plan.split("PartitionFilters:")[1].splitlines()[0] and "Exchange" not in plan and "Subquery" not in plan
    assert ids(own, "id") == sorted(i for i in range(40_000) if i % 400 == 1 and i % 3)
    assert own.select(F.input_file_name()).distinct().count() == 1  # the owner's rows lie together
    assert read(2).count() == rows.where("app = 'crm'").count()  # app_admin: null owners too
    nobody = read(3)
    assert nobody.count() == 0 and "Scan parquet" not in plan_of(nobody)
    # a hot owner is several files: no range holds all of one key
    hot = spark.range(20_000).select("id", F.lit(1).cast("long").alias("owner_id"), F.lit("crm").alias("app"))
    store.write_governed(hot, str(tmp_path / "hot"), ranges=8)
    assert spark.read.parquet(str(tmp_path / "hot")).select(F.input_file_name()).distinct().count() >= 6


def test_a_revoked_grant_shows_in_the_next_read(spark, tmp_path, grants):
    path, held = str(tmp_path / "store"), str(tmp_path / "grants")
    store.write_governed(spark.range(20).select("id", (F.col("id") % 4).alias("owner_id"), F.lit("crm").alias("app")), path)
    grants.write.parquet(held)
    assert store.read_governed(spark, path, spark.read.parquet(held), "personal", "crm", 1).count() == 5
    grants.where("user_id <> 1").write.mode("overwrite").parquet(held)
    assert store.read_governed(spark, path, spark.read.parquet(held), "personal", "crm", 1).count() == 0
