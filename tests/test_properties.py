"""Property-based checks of the operators against brute-force Python models."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import access as acc
from tessera.operators import history as hi
from tessera.operators import integrity as ig
from tessera.operators import matching as mt

SPARK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
T0 = dt.datetime(2024, 1, 1)

users = st.integers(min_value=1, max_value=6)
grant_rows = st.lists(st.tuples(users, st.sampled_from(["crm", "shop", "platform"]),
                                st.sampled_from(["member", "app_admin"])),
                      max_size=12, unique_by=lambda g: (g[0], g[1]))
data_rows = st.lists(st.one_of(st.none(), users), max_size=20)


@SPARK
@given(grants=grant_rows, owners=data_rows, caller=st.one_of(st.none(), users),
       shape=st.sampled_from(["shared", "personal"]))
def test_governed_matches_the_policy_text(spark, grants, owners, caller, shape):
    g = spark.createDataFrame([(u, a, r, T0, None) for u, a, r in grants],
                              "user_id bigint, app string, role string, granted_at timestamp_ntz, granted_by bigint")
    rows = spark.createDataFrame(list(enumerate(owners)), "row_id bigint, user_id bigint")
    role = {(u, a): r for u, a, r in grants}.get((caller, "crm"))
    has = role is not None
    if shape == "shared":
        want = [i for i, _ in enumerate(owners) if has]
    else:
        want = [i for i, o in enumerate(owners) if has and (role == "app_admin" or (o is not None and o == caller))]
    got = sorted(r.row_id for r in acc.governed(rows, g, shape, "crm", caller).collect())
    assert got == want


def brute_fold(times, cap, window):
    accepted, out = [], []
    for t in times:
        ok = sum(1 for a in accepted if a > t - window) < cap
        out.append(ok)
        if ok:
            accepted.append(t)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20_000), max_size=80), st.integers(min_value=1, max_value=5))
def test_fold_matches_brute_force(times, cap):
    times = sorted(times)
    got, _ = hi.fold_rate_cap(times, cap=cap, window_us=3600)
    assert got == brute_fold(times, cap, 3600)


@SPARK
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6 * 3600)), min_size=1, max_size=40),
       st.integers(min_value=1, max_value=6))
def test_trailing_counts_and_history_match_brute_force(spark, attempts, chunk_hours):
    rows = [(i, k, T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(attempts)]
    df = spark.createDataFrame(rows, "attempt_id bigint, inviter bigint, attempted_at timestamp_ntz")
    trail = {r.attempt_id: r.trailing_count for r in hi.trailing_hour_counts(df, chunk_hours=chunk_hours).collect()}
    hist = {r.attempt_id: r.accepted for r in hi.rate_cap_history(df, cap=3, chunk_hours=chunk_hours).collect()}
    for k in (0, 1):
        mine = sorted((t, i) for i, kk, t in rows if kk == k)
        for t, i in mine:
            assert trail[i] == sum(1 for u, _ in mine if t - dt.timedelta(hours=1) < u <= t)
        secs = [(t - T0).total_seconds() for t, _ in mine]
        assert [hist[i] for _, i in mine] == brute_fold(secs, 3, 3600)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 29), st.integers(1, 3)), max_size=60), st.integers(1, 8),
       st.integers(1, 12))
def test_budgeted_candidates_match_brute_force(spark, verdicts, cap, chunk):
    postings = spark.range(30).withColumnRenamed("id", "posting_id")
    users_df = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    matches = spark.createDataFrame(sorted(verdicts) or [(0, 99)], "posting_id bigint, user_id bigint") \
        .withColumn("score", F.lit(1))
    got = {(r.user_id, r.user_rank): r.posting_id
           for r in mt.budgeted_candidates(postings, users_df, matches, cap, chunk=chunk).collect()}
    want = {}
    for u in (1, 2, 3):
        free = [p for p in range(30) if (p, u) not in verdicts][:cap]
        for rank, p in enumerate(free, start=1):
            want[(u, rank)] = p
    assert got == want


@SPARK
@given(st.lists(st.tuples(st.integers(0, 50), st.one_of(st.none(), st.text(max_size=3))), min_size=1, max_size=30),
       st.integers(1, 5))
def test_checksum_independent_of_order_and_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows, "id bigint, v string")
    a = ig.table_checksum(df, ["id", "v"], "id").first()
    b = ig.table_checksum(df.repartition(parts).sortWithinPartitions("v"), ["id", "v"], "id").first()
    buckets_a = {r.bucket: (r.rows, r.digest) for r in ig.bucket_checksums(df, ["id", "v"], "id").collect()}
    buckets_b = {r.bucket: (r.rows, r.digest)
                 for r in ig.bucket_checksums(df.repartition(parts), ["id", "v"], "id").collect()}
    assert a == b and buckets_a == buckets_b
