"""Structured Streaming forms of the access operators.

Each has a batch twin in ``tessera.operators``; under an ``availableNow``
trigger over the same files the two give the same rows. Sources are file
streams (any format Spark reads); sinks are Parquet tables or versioned
publishes, and every query keeps its checkpoint in the shared checkpoint
folder so it survives a lost executor or driver restart.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators import history as hi
from tessera.sources import publish as pub


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain everything available now into a Parquet table (exactly once via
    the sink's file log and the checkpoint)."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


# T1
def governed_stream(events: DataFrame, grants_root: str, app: str, owner_col: str, out: str,
                    checkpoint: str) -> None:
    """Rows of ``app`` whose owner holds a grant on it *at the time of the
    micro-batch*: grants are re-read from the newest published version for
    every batch, so a revocation applies from the next batch on. Each batch
    overwrites its own ``out/epoch=<id>`` directory, so a replay after a
    failure cannot duplicate rows."""
    spark = events.sparkSession

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        grants = pub.read_published(spark, grants_root, "grants")  # fresh each batch
        allowed = grants.filter(F.col("app") == app).select(F.col("user_id").alias(owner_col))
        (batch.filter(F.col("app") == app).join(allowed, owner_col, "left_semi")
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}"))

    q = (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# T2
LATE_SECONDS = 3600


def stream_rate_cap(requests: DataFrame, key: str = "inviter", ts_col: str = "attempted_at",
                    id_col: str = "attempt_id", cap: int = hi.HOURLY_CAP, late_seconds: int = LATE_SECONDS) -> DataFrame:
    """Hourly cap decided in event order, per ``key``.

    Attempts wait in the key's state until the watermark has passed them, and are then decided in
    order of (time, id); so files may arrive in any order within ``late_seconds``. An attempt
    older than the watermark when it arrives is dropped, as its successors are decided. State
    per key is the accepted times of the last hour (at most ``cap``) and the attempts of the
    last ``late_seconds``; it goes when both have passed. A source that falls silent leaves its last
    attempts waiting: a later row (of any key) moves the watermark on.
    Event time is derived from the NTZ wall clock without the session zone.
    """
    ev = (requests.withColumn("_ts", hi.event_time(requests, ts_col))
          .withColumn("_us", hi.epoch_micros(requests, ts_col)).withWatermark("_ts", f"{late_seconds} seconds"))
    key_type = requests.schema[key].dataType.simpleString()
    id_type = requests.schema[id_col].dataType.simpleString()
    out_schema = f"{key} {key_type}, {id_col} {id_type}, _us long, accepted boolean"

    def decide(k, pdfs, state):
        times, waiting_us, waiting_id = state.get if state.exists else ([], [], [])
        waiting = list(zip(waiting_us, waiting_id))
        for pdf in pdfs:
            waiting.extend(zip(pdf["_us"].tolist(), pdf[id_col].tolist()))
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        n = sum(us < passed for us, _ in waiting)
        ready, waiting = waiting[:n], waiting[n:]
        decisions, kept = hi.fold_rate_cap([us for us, _ in ready], cap, state=deque(times))
        kept = [t for t in kept if t > passed - hi.HOUR_SECONDS * 1_000_000]
        if waiting or kept:
            state.update((kept, [us for us, _ in waiting], [i for _, i in waiting]))
            due = waiting[0][0] if waiting else kept[-1] + hi.HOUR_SECONDS * 1_000_000
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame({key: [k[0]] * n, id_col: [i for _, i in ready], "_us": [us for us, _ in ready],
                                "accepted": decisions})

    out = ev.groupBy(key).applyInPandasWithState(
        decide, out_schema, f"times array<long>, waiting_us array<long>, waiting_id array<{id_type}>", "append",
        GroupStateTimeout.EventTimeTimeout)
    moment = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=(F.col("_us").cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return out.select(key, id_col, moment.cast(requests.schema[ts_col].dataType).alias(ts_col), "accepted")


# T3
def stream_stale_token(access: DataFrame, revocations: DataFrame, ttl_seconds: int = hi.HOUR_SECONDS,
                       ts_col: str = "ts", revoked_col: str = "revoked_at") -> DataFrame:
    """J13 continuously: a stream-stream interval join, watermarks on both sides bound the state to
    the token lifetime. As in the batch form, the join key is (user, time bucket of the token lifetime's width),
    with each revocation listed in both buckets its interval touches: a busy user's waiting rows are spread over
    as many state partitions as they have buckets, and an access meets a revocation in its own bucket only. Event
    times are derived from the NTZ wall clocks without the session zone; output keeps them."""
    width = ttl_seconds * 1_000_000
    a = (access.withColumn("_ats", hi.event_time(access, ts_col))
         .withColumn("_b", F.floor(hi.epoch_micros(access, ts_col) / width).cast("long")).withWatermark("_ats", f"{ttl_seconds} seconds"))
    first = F.floor(hi.epoch_micros(revocations, revoked_col) / width).cast("long")
    r = (revocations.select(F.col("user_id").alias("_ru"), F.col("app").alias("revoked_app"), revoked_col,
                            hi.event_time(revocations, revoked_col).alias("_rts"), F.explode(F.sequence(first, first + 1)).alias("_rb"))
         .withWatermark("_rts", f"{ttl_seconds} seconds"))
    cond = ((a["user_id"] == r["_ru"]) & (a["_b"] == r["_rb"]) & (a["_ats"] > r["_rts"])
            & (a["_ats"] <= r["_rts"] + F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    return a.join(r, cond, "inner").drop("_ats", "_rts", "_ru", "_b", "_rb")


# T4
def stream_current_grants(changes: DataFrame, root: str, checkpoint: str, key=("user_id", "app"),
                          ts_col: str = "changed_at") -> None:
    """Maintain current grants from a change stream.

    Each micro-batch reduces its changes to the latest per key (``max_by``, a
    partial aggregate) and writes only those rows to ``root/log/epoch=<id>``;
    overwriting that one directory makes a replayed batch idempotent. The
    current state is W3's rule over the log (latest change wins, so a late
    change older than the stored one is ignored); ``compact`` folds the log
    into a published snapshot. A batch never rewrites the whole state.
    """
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct("change_id", "action", "role", ts_col),
                                                  F.struct(ts_col, "change_id")).alias("_l"))
        (latest.select(*key, "_l.*").write.mode("overwrite")
         .parquet(f"{root}/log/epoch={epoch_id}"))

    q = (changes.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _log_epochs(spark: SparkSession, root: str, after: int) -> list[int]:
    """Finished epochs of the log beyond ``after``."""
    found = [int(n[6:]) for n in pub.list_names(spark, f"{root}/log") if n.startswith("epoch=")]
    return sorted(e for e in found if e > after and pub.exists(spark, f"{root}/log/epoch={e}/_SUCCESS"))


def _folded(spark: SparkSession, root: str) -> tuple[DataFrame | None, int, int]:
    """(snapshot and the log beyond it, the last epoch in it, the snapshot's version)."""
    m = pub.current_manifest(spark, f"{root}/snapshot")
    upto = m["notes"]["upto"] if m else -1
    epochs = _log_epochs(spark, root, upto)
    parts = [spark.read.parquet(m["tables"]["state"])] if m else []
    if epochs:
        parts.append(spark.read.parquet(*[f"{root}/log/epoch={e}" for e in epochs]))
    df = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    return df, max([upto, *epochs]), m["version"] if m else 0


def current_from_state(spark: SparkSession, root: str, key=("user_id", "app"),
                       ts_col: str = "changed_at") -> DataFrame:
    """Current grants: the latest logged change per key, revocations removed, from
    the snapshot of ``compact``, if any, and the epochs logged after it."""
    df, _, _ = _folded(spark, root)
    if df is None:
        raise FileNotFoundError(f"no state under {root}")
    return hi.current_grants(df, key=key, ts_col=ts_col)


def compact(spark: SparkSession, root: str, key=("user_id", "app"), ts_col: str = "changed_at",
            prune: bool = False) -> None:
    """Publish the latest change per key of the snapshot and the log beyond it as the new
    snapshot, which records the last epoch it holds; revocations are kept so an older late
    change stays ignored. ``prune`` deletes the log that earlier snapshots hold: readers
    that resolved the snapshot before this one still find the epochs they need.
    """
    before = pub.current_manifest(spark, f"{root}/snapshot")
    df, upto, version = _folded(spark, root)
    if df is None:
        return
    latest = df.groupBy(*key).agg(F.max_by(F.struct("change_id", "action", "role", ts_col),
                                           F.struct(ts_col, "change_id")).alias("_l")).select(*key, "_l.*")
    pub.publish({"state": latest}, f"{root}/snapshot", base_version=version, notes={"upto": upto})
    if prune and before:
        for e in _log_epochs(spark, root, -1):
            if e <= before["notes"]["upto"]:
                pub.remove(spark, f"{root}/log/epoch={e}")
