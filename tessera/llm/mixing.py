"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, one epoch after the other.
A document's virtual finish time is the source's words through it divided by the source's
target, so all queues reach time 1 at their targets; the documents of all sources, sorted by
finish time, are served until the total budget is used up. A document that straddles its
source's target is split there into two packets, so that one long document neither holds its
source back nor runs over; ``mix`` tells the words taken, ``mixed_documents`` gives whole documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, table_of, text_bytes, text_slices

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BUCKET_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row_hash, size): one row per document; size is its words, 0 for a null text."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            n = pa.array([len(t.split()) for t in text_bytes(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "source", "row_hash")], n],
                                             ["doc_id", "source", "row_hash", "size"])
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                                 F.xxhash64(*docs.columns).alias("row_hash"), "text"), fill,
                     "doc_id long, source string, row_hash long, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, place, target): each source's words to take.

    ``sources`` is (source, source_size), one row per source. Sources in code-point order, null
    last, weigh ``weights`` in turn and share ``share`` of all words; none gets more than
    ``epochs`` times its words. With sources in order of (most it may get / weight), those before
    some place get their most and the rest share what is left by weight; the place is found from
    running sums. The windows run over one row per source.
    """
    everywhere = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", epochs * F.col("source_size")).withColumn(
        "budget", F.lit(share) * F.sum("source_size").over(everywhere))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"),
                        F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(everywhere)["level"]
    return levelled.withColumn("free", free).select(
        "source", "source_size", "place",
        F.when(F.col("free").isNull() | (F.col("most") <= F.col("weight") * F.col("free")), F.col("most").cast("double"))
        .otherwise(F.col("weight") * F.col("free")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, row_hash): one row per document.

    ``taken`` is the number of words the mix takes, at most ``epochs`` times ``size``. The order
    within a source is by a digest of the doc_id, ties by one of the row, so reruns and other
    partitionings agree; wholly equal rows are interchangeable. A null text has size 0 and is not taken, a null
    source is a source of its own, a null doc_id is one value, no rows give no rows.
    Only (ids, sizes) are shuffled. A source's running sum is taken inside hash buckets of its order
    and carried over by bucket totals, so one source with most of the rows is many groups.
    """
    rows = sized(docs).withColumn("order", F.md5(F.concat(
        F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = table_of(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    bits = max(0, min(24, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 6), 16, 10).cast("long"), 24 - bits))
    bucket_sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    shares = targets(bucket_sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (bucket_sums.withColumn("carried", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
               .withColumnRenamed("source", "s")
               .join(shares, F.col("s").eqNullSafe(F.col("source"))).drop("s", "words")
               .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "carried", "source_size", "place", "target"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "row_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (rows.withColumn("through", F.sum("size").over(within))
              .join(carried, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .withColumn("through", F.col("through") + F.col("carried")))
    epoch = F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(epochs - 1)).otherwise(0))).alias("epoch")
    queued = queued.select("row", "doc_id", "source", "row_hash", "size", "source_size", "place", "target", "order",
                           "through", epoch).withColumn("end", F.col("through") + F.col("epoch") * F.col("source_size"))
    head = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - (F.col("end") - F.col("size"))))
    packet = F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("part"), head.alias("words"), (F.col("end") - F.col("size") + head).alias("finish")),
        F.struct(F.lit(1).alias("part"), (F.col("size") - head).alias("words"), F.col("end").alias("finish"))),
        lambda p: (p["words"] > 0) | ((F.col("size") == 0) & (p["part"] == 0)))).alias("p")
    packets = queued.select("row", "doc_id", "source", "row_hash", "size", "source_size", "place", "target", "order", "epoch", packet)
    packets = packets.select("*", "p.part", "p.words",
                             F.coalesce(F.try_divide(F.col("p.finish"), F.col("target")), F.lit(0.0)).alias("time")).drop("p")
    served = _serve(packets, F.lit(share))
    kept = ["doc_id", "source", "row_hash", "size", "source_size", "target"]
    return served.groupBy("row").agg(*[F.first(c).alias(c) for c in kept], F.sum("served").alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "row_hash")


def _serve(packets: DataFrame, share) -> DataFrame:
    """The packets in order of time until the budget is used, ``served`` words of each.

    The packets are sorted by range into partitions that are written down; partition totals give
    what was served before each, and only the partition in which the budget ends is summed row by row.
    """
    order = ["time", "place", "epoch", "order", "row_hash", "row", "part"]
    lined = table_of(packets.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "packets")
    sums = lined.groupBy("run").agg(F.sum("words").alias("words"))
    budget = lined.where("epoch = 0").agg(F.floor(share * F.sum("words")).alias("budget"))
    runs = (sums.withColumn("before", F.coalesce(F.sum("words").over(
        Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .crossJoin(budget).select("run", "before", "budget", (F.col("before") + F.col("words")).alias("after")))
    placed = lined.join(runs, "run")
    whole = placed.where("after <= budget or before >= budget").withColumn(
        "served", F.when(F.col("after") <= F.col("budget"), F.col("words")).otherwise(F.lit(0)))
    upto = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where("after > budget and before < budget").withColumn(
        "ahead", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = last.withColumn("served", F.greatest(F.lit(0), F.least("words", F.col("budget") - F.col("ahead")))).drop("ahead")
    return whole.unionByName(last)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                    epochs: int = EPOCHS) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document is repeated as often as it is taken.

    Texts are never cut. A document taken in part, where its source's target or the budget ends, is there once more if
    at least half of that copy was taken and not if less, which is what brings its source nearer to the target. Wholly
    equal rows are taken together.
    """
    keys = ["id", "row_hash"]
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = (mix(docs, weights, share, epochs).where("taken > 0")
             .groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash")
             .agg(F.first("size").alias("size"), F.sum("taken").alias("taken"))
             .select(*keys, copies.alias("copies")).where("copies > 0"))
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                        F.xxhash64(*docs.columns).alias("row_hash")).dropDuplicates(keys)
    repeated = keyed.join(taken, keys).select("doc", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select("doc.*")
