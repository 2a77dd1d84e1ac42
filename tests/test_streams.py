"""Streaming operators against their batch twins, and revocation between batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import history as hi
from tessera.sources import publish as pub
from tessera.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)
GRANT_SCHEMA = "user_id bigint, app string, role string, granted_at timestamp_ntz, granted_by bigint"
ROW_SCHEMA = "row_id bigint, app string, owner_id bigint, value double"


def test_revocation_applies_from_the_next_micro_batch(spark, tmp_path):
    base = str(tmp_path)
    grants = spark.createDataFrame([(1, "crm", "member", T0, None), (2, "crm", "member", T0, None)], GRANT_SCHEMA)
    pub.publish({"grants": grants}, f"{base}/grants")
    first = spark.createDataFrame([(1, "crm", 1, 1.0), (2, "crm", 2, 1.0), (3, "crm", 3, 1.0)], ROW_SCHEMA)
    first.coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = st.file_stream(spark, f"{base}/in", first.schema)
    st.governed_stream(src, f"{base}/grants", "crm", "owner_id", f"{base}/out", f"{base}/ckpt")
    assert sorted(r.row_id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2]
    # user 2 is revoked; the next batch is filtered by the new grants version
    pub.publish({"grants": grants.filter("user_id = 1")}, f"{base}/grants")
    second = spark.createDataFrame([(4, "crm", 1, 1.0), (5, "crm", 2, 1.0)], ROW_SCHEMA)
    second.coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = st.file_stream(spark, f"{base}/in", first.schema)
    st.governed_stream(src, f"{base}/grants", "crm", "owner_id", f"{base}/out", f"{base}/ckpt")
    assert sorted(r.row_id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 4]


ATTEMPTS = "attempt_id bigint, inviter bigint, attempted_at timestamp_ntz"


def _decided(spark, tmp_path, files):
    """Decisions after streaming the given row lists, one file and micro-batch each."""
    for rows in files:
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = st.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], ATTEMPTS).schema)
        st.run_to_parquet(st.stream_rate_cap(src), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    return {r.attempt_id: (r.accepted, r.attempted_at) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_stream_rate_cap_on_files_out_of_order(spark, tmp_path):
    rnd = random.Random(3)
    rows, t = [], T0
    for i in range(300):
        t += dt.timedelta(seconds=rnd.choice([1, 2, 5, 10] * 12 + [5000]), microseconds=rnd.randrange(1_000_000))
        rows.append((i, i % 2, t))
    # neighbouring runs of 20 attempts change places; a row far ahead closes the stream
    runs = [rows[i:i + 20] for i in range(0, 300, 20)]
    mixed = [r for i in range(0, len(runs) - 1, 2) for r in (*runs[i + 1][:10], *runs[i], *runs[i + 1][10:])] + runs[-1]
    files = [mixed[:100], mixed[100:220], mixed[220:], [(-1, -1, t + dt.timedelta(hours=9))]]
    got = _decided(spark, tmp_path, files)
    batch = {r.attempt_id: (r.accepted, r.attempted_at)
             for r in hi.rate_cap_history(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == batch and not all(ok for ok, _ in batch.values())


def test_stream_rate_cap_drops_late_rows_and_forgets_quiet_keys(spark, tmp_path):
    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)
    first = [(i, 1, at(i)) for i in range(12)]
    files = [first, [(20, 2, at(600))], [(30, 1, at(5)), (31, 1, at(700))], [(40, 2, at(2000))], [(50, 3, at(4000))]]
    got = _decided(spark, tmp_path, files)
    assert [got[i][0] for i in range(12)] == [True] * 10 + [False] * 2
    assert 30 not in got  # two days late in stream time: dropped, its successors are decided
    assert got[31][0] and got[20][0] and got[40][0] and 50 not in got
    state = spark.read.format("statestore").load(f"{tmp_path}/ckpt").count()
    assert state == 1  # only the key whose attempt still waits


def test_stream_interval_join_equals_batch_twin(spark, tmp_path):
    access = spark.createDataFrame([(i, i % 3, T0 + dt.timedelta(minutes=7 * i)) for i in range(60)],
                                   "event_id bigint, user_id bigint, ts timestamp_ntz")
    rev = spark.createDataFrame([(0, "crm", T0 + dt.timedelta(hours=1)), (1, "crm", T0 + dt.timedelta(hours=3))],
                                "user_id bigint, app string, revoked_at timestamp_ntz")
    access.write.parquet(f"{tmp_path}/a")
    rev.write.parquet(f"{tmp_path}/r")
    out = st.stream_stale_token(st.file_stream(spark, f"{tmp_path}/a", access.schema),
                                st.file_stream(spark, f"{tmp_path}/r", rev.schema))
    st.run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    streamed = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = sorted(r.event_id for r in hi.stale_token_exposure(access, rev).collect())
    assert streamed == batch and batch


def test_stream_current_grants_ignores_late_older_changes(spark, tmp_path):
    schema = "change_id bigint, user_id bigint, app string, changed_at timestamp_ntz, action string, role string"
    b1 = spark.createDataFrame([(1, 1, "crm", T0 + dt.timedelta(days=2), "grant", "app_admin")], schema)
    b2 = spark.createDataFrame([(2, 1, "crm", T0 + dt.timedelta(days=1), "revoke", "member"),
                                (3, 2, "crm", T0, "grant", "member")], schema)
    for b in (b1, b2):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = st.file_stream(spark, f"{tmp_path}/in", b1.schema, max_files_per_trigger=1)
    st.stream_current_grants(src, f"{tmp_path}/state", f"{tmp_path}/ckpt")
    got = sorted((r.user_id, r.role) for r in st.current_from_state(spark, f"{tmp_path}/state").collect())
    assert got == [(1, "app_admin"), (2, "member")]


def test_compacted_state_and_later_changes_agree(spark, tmp_path):
    schema = "change_id bigint, user_id bigint, app string, changed_at timestamp_ntz, action string, role string"
    first = spark.createDataFrame([(1, 1, "crm", T0 + dt.timedelta(days=2), "grant", "member"),
                                   (2, 2, "crm", T0, "grant", "member")], schema)
    first.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = st.file_stream(spark, f"{tmp_path}/in", first.schema)
    st.stream_current_grants(src, f"{tmp_path}/state", f"{tmp_path}/ckpt")
    st.compact(spark, f"{tmp_path}/state")
    later = spark.createDataFrame([(3, 1, "crm", T0 + dt.timedelta(days=1), "revoke", "member"),
                                   (4, 2, "crm", T0 + dt.timedelta(days=3), "grant", "app_admin")], schema)
    last = spark.createDataFrame([(5, 3, "crm", T0, "grant", "member")], schema)
    for more in (later, last):
        more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = st.file_stream(spark, f"{tmp_path}/in", first.schema)
        st.stream_current_grants(src, f"{tmp_path}/state", f"{tmp_path}/ckpt")
        st.compact(spark, f"{tmp_path}/state", prune=True)
    log = sorted(p.name for p in (tmp_path / "state" / "log").iterdir())
    assert log == ["epoch=2"]  # what an earlier snapshot holds is gone, and no state with it
    got = sorted((r.user_id, r.role) for r in st.current_from_state(spark, f"{tmp_path}/state").collect())
    assert got == [(1, "member"), (2, "app_admin"), (3, "member")]
    batch = sorted((r.user_id, r.role) for r in hi.current_grants(first.unionByName(later).unionByName(last)).collect())
    assert got == batch
