"""SimHash near-duplicates found by covering locality-sensitive hashing.

A text becomes 64 majority bits over the hashes of its word shingles. Two texts are linked
when their fingerprints differ in at most ``radius`` bits, and links make components.

Covering hashing: every bit position gets a non-zero vector of radius + 1 bits. For each of
the 2**(radius+1) - 1 non-zero vectors v, the mask of v keeps the positions whose vector has
an odd product with v. The vectors of `radius` differing positions can't span the whole
space, so some v is orthogonal to all of them: its mask hides every difference, and the
pair meets in that table. No pair is missed, whatever the data.

A bucket of a table holds distinct fingerprints only (copies are one row by then). Buckets of
up to PAIR_BUCKET are compared pair by pair. Larger ones are linked exactly without pairs (see
``_dense_links``), so no bucket is cut off and none grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, table_of, text_bytes, text_slices
from tessera.llm.components import components

BITS = 64
PAIR_BUCKET = 32
STEP = 1 << 15  # hashes whose bits are counted at once


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text; a text without words has fingerprint zero.

    Words are lower-cased (A-Z) and joined by one space; a text of fewer words than
    ``shingle`` is one shingle. A bit is set where it is set in over half of the hashes. Hashes are counted
    in steps, so memory is bounded by the texts and not by the bits of their shingles.
    """
    hashes: list[int] = []
    owners: list[int] = []
    firsts: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    ones = np.zeros((len(texts), BITS), dtype=np.int32)
    digest = xxhash.xxh64_intdigest

    def count():
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[owners] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
            for held in (hashes, owners, firsts):
                held.clear()
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        counts[i] = k = max(n - shingle + 1, 1)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        del words
        after = np.cumsum(sizes + 1)
        starts, ends = after[:k] - sizes[:k] - 1, after[min(n, shingle) - 1:] - 1
        for a in range(0, k, STEP):
            owners.append(i)
            firsts.append(len(hashes))
            hashes.extend([digest(line[s:e], seed) for s, e in zip(starts[a:a + STEP].tolist(), ends[a:a + STEP].tolist())])
            if len(hashes) >= STEP:
                count()
    count()
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; a null text counts as empty."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            fp = fingerprints(text_bytes(b), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"),
                                              pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])
    return map_texts(docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text"), fill,
                     "doc_id long, text_hash long, fp long")


def text_hash() -> Column:
    return F.xxhash64("text")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector of radius + 1 bits, as signed 64-bit integers."""
    size = 1 << (radius + 1)
    masks = []
    for v in range(1, size):
        m = sum(1 << i for i in range(bits) if ((i % (size - 1) + 1) & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(fps: DataFrame, radius: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect exactly what lies within ``radius`` bits.

    ``fps`` has a long column fp without repeats. Buckets of at most ``pair_bucket`` yield every
    pair within the radius; larger ones yield links enough to connect the same fingerprints,
    each between two within the radius.
    """
    if radius != 2 and pair_bucket < BITS * BITS:
        raise ValueError("large buckets are linked for a radius of 2; give other radii a large pair_bucket")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.inline(tables))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = table_of(keyed.join(sizes, ["t", "key"]), "buckets")
    few = shared.where(F.col("n") <= pair_bucket)
    pairs = (few.select("t", "key", F.col("fp").alias("u"))
             .join(few.select("t", "key", F.col("fp").alias("v")), ["t", "key"])
             .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
             .select("u", "v"))
    return pairs.union(_dense_links(shared.where(F.col("n") > pair_bucket), masks)).distinct()


def _dense_links(shared: DataFrame, masks: list[int]) -> DataFrame:
    """Links of the members of large buckets, for a radius of two bits, without comparing pairs.

    Members of a bucket differ in its hidden bits only. Each member names itself and every
    pattern one hidden bit away; two members at one or two bits name a common pattern, and any
    two that name one pattern are at most two bits apart. Joining each to the smallest that
    names the same pattern therefore keeps them connected, in a linear number of rows.
    """
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("t") + 1)
    named = (shared.select("fp", mask.alias("mask"))
             .select("fp", F.expr("explode(concat(array(fp), transform("
                                  "filter(sequence(0, 63), i -> (mask & shiftleft(1L, i)) = 0), "
                                  "i -> fp ^ shiftleft(1L, i))))").alias("pattern")).distinct())
    least = named.groupBy("pattern").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (named.join(least, "pattern").where("fp <> v")
            .select(F.col("v").alias("u"), F.col("fp").alias("v")))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, label): one row per document.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits. Texts that
    are null, empty or without words have fingerprint zero and link like any other. Repeated rows
    each keep their row; a null doc_id takes part but is never a component's id, unless a
    component has no other (its id is then null). Where doc_ids repeat, two components can have one
    id; label, the smallest fingerprint, tells them apart. Other columns of ``docs`` are ignored.
    """
    rows = table_of(fingerprint_rows(docs, shingle, seed), "fingerprints")
    members = components(links(rows.select("fp").distinct(), radius))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = F.coalesce("root", "fp").alias("label")
    placed = least.join(members, least["fp"] == members["node"], "left").select("fp", "least", label)
    ids = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = placed.join(ids, "label").select("fp", "component_id", "label")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "label")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each near-duplicate component, with the columns of ``docs``.

    The one kept has the smallest doc_id (null last), ties to the smallest hash of the text; of
    wholly equal rows one stays. Only (doc_id, hashes) are grouped; the texts move once, to the
    join that picks the kept rows.
    """
    place = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"]
    best = (near_duplicates(docs, shingle, radius).groupBy("label").agg(F.min(F.struct(*place)).alias("best"))
            .select("best.*"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").isNull().alias("no_id"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("text_hash"))
    return keyed.join(best, best.columns, "left_semi").dropDuplicates(best.columns).select("doc.*")
