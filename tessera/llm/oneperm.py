"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the hash names a bin and competes for the least value in it. Empty
bins are filled by optimal densification: each goes through an order of the other bins that is its own and
the same for all documents, and takes the value of the first that isn't empty. Of each bin the low
bits are stored, packed; likeness is the share of equal bins, corrected for those equal by chance.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table_of, text_slices

SHINGLE = 5
BINS = 512  # a power of two
BITS = 4  # stored of each bin; 1, 2, 4 or 8
SEED = 42
TRIES = 8  # places of a bin's order tried for all documents at once, before going document by document
_LOWER = bytes(b | 0x20 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _orders(bins: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bin's order of all bins, one column per bin, and each bin's place in every order (one row per order)."""
    held = sys.__dict__.setdefault("_tessera_bin_orders", {})  # outlives the task, as the worker does
    if (bins, seed) not in held:
        order = np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1).astype(np.int64)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(bins), (bins, bins)), axis=1)
        held[bins, seed] = np.ascontiguousarray(order.T), place
    return held[bins, seed]


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count): the hashes of all shingles, text by text, and how many each text has.

    A shingle is ``shingle`` words in a row, words being runs of anything but the six ASCII white-space
    characters, A-Z lower-cased; a text of fewer words has its whole sequence as the only one.
    """
    codes: list[int] = []
    known: dict[bytes, int] = {}
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = t.translate(_LOWER).split()
        sizes[i] = len(words)
        codes.extend([known.setdefault(w, len(known)) for w in words])
    value = np.array([xxhash.xxh64_intdigest(w, seed) for w in known], dtype=np.uint64)[np.array(codes, dtype=np.int64)]
    odd = _mixed(np.arange(1, shingle + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
    last = np.cumsum(sizes)
    # the words from each place on; those of a short text stop at its end and keep their number apart
    total = np.zeros(len(codes), dtype=np.uint64)
    left = np.repeat(last, sizes) - np.arange(len(codes))
    for k in range(shingle):
        step = np.zeros(len(codes), dtype=np.uint64)
        ahead = value[k:] * odd[k]
        step[:len(ahead)] = ahead
        step[left <= k] = 0
        total += step
    start = last - sizes
    whole = left >= shingle
    short = (sizes > 0) & (sizes < shingle)
    whole[start[short]] = True
    total[start[short]] += sizes[short].astype(np.uint64)
    count = np.where(short, 1, np.maximum(sizes - shingle + 1, 0))
    return _mixed(total[whole]), count


class OnePermutation:
    """Fingerprints of ``bins`` bins with ``bits`` bits of each."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8, and the two must fill bytes")
        self.bins, self.bits, self.shingle, self.seed = bins, bits, shingle, seed

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(value per text and bin, whether the text has any shingle), all bins filled where it has."""
        hashes, count = shingle_hashes(texts, self.shingle, self.seed)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(len(texts) * self.bins, empty, dtype=np.uint64)
        width = np.uint64(64 - (self.bins.bit_length() - 1))
        at = np.repeat(np.arange(len(texts)) * self.bins, count)
        if self.bins > 1:
            at = at + (hashes >> width).astype(np.int64)
        np.minimum.at(out, at, hashes)
        out = out.reshape(len(texts), self.bins)
        some = count > 0
        self._densify(out, out != empty, some)
        return out, some

    def _densify(self, out: np.ndarray, full: np.ndarray, some: np.ndarray) -> None:
        order, place = _orders(self.bins, self.seed)
        doc, bin_ = np.nonzero(~full & some[:, None])
        for t in range(min(TRIES, self.bins)):
            source = order[t, bin_]
            found = full[doc, source]
            out[doc[found], bin_[found]] = out[doc[found], source[found]]
            doc, bin_ = doc[~found], bin_[~found]
        # few bins of these texts are full: the first of a bin's order is the full one with the least place in it
        for i, (s, e) in zip(*_groups(doc)):
            filled = np.flatnonzero(full[i])
            out[i, bin_[s:e]] = out[i, filled[place[bin_[s:e]][:, filled].argmin(axis=1)]]

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Each text's fingerprint; empty where it has no word."""
        values, some = self.values(texts)
        # a value stands for its bin, too: two texts of one shingle each must not agree in all bins by one chance
        own = _mixed(values ^ _mixed(np.arange(1, self.bins + 1, dtype=np.uint64))[None, :])
        low = (own & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        parts = low.reshape(len(texts), self.bins // per, per) << (np.arange(per, dtype=np.uint8) * self.bits)[None, None, :]
        data = np.bitwise_or.reduce(parts, axis=2)
        return [row.tobytes() if s else b"" for row, s in zip(data, some.tolist())]

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated share of common shingles of each two fingerprints, from 0 to 1; two empty ones are alike."""
        out = np.array([float(x == y) for x, y in zip(a, b)])
        at = [i for i, (x, y) in enumerate(zip(a, b)) if x and y and x != y]
        if at:
            size = self.bins * self.bits // 8
            x, y = (np.frombuffer(b"".join(side[i] for i in at), dtype=np.uint8).reshape(-1, size) for side in (a, b))
            differ = x ^ y
            shift = np.arange(0, 8, self.bits, dtype=np.uint8)
            equal = ((differ[:, :, None] >> shift & np.uint8((1 << self.bits) - 1)) == 0).sum(axis=(1, 2))
            chance = 2.0 ** -self.bits
            out[at] = np.clip((equal / self.bins - chance) / (1 - chance), 0, 1)
        return out


def _groups(doc: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """The different values of an ascending array and where each stands."""
    if not len(doc):
        return [], []
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))).tolist()
    return doc[start].tolist(), list(zip(start, [*start[1:], len(doc)]))


def fingerprinted(docs: DataFrame, scheme: OnePermutation | None = None) -> DataFrame:
    """(doc_id, fingerprint): one row per document, the fingerprint packed; no shuffle."""
    scheme = scheme or OnePermutation()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scheme.packed(texts), pa.binary())],
                                             ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


REPORT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the beginning of the next one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _report(scheme: OnePermutation, ids: list[int | None], texts: list[str], prints: list[bytes]) -> list[list]:
    """The columns of REPORT for all rows but the last, which is only the next of the one before."""
    changed = [edited(t, f).encode() for t, f in zip(texts, texts[1:])]
    new = scheme.packed(changed)
    own = prints[:-1]
    return [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(t).digest() for t in changed], own, new,
            scheme.likeness(own, new).tolist(), scheme.likeness(own, prints[1:]).tolist()]


def compared(docs: DataFrame, scheme: OnePermutation | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every document against
    its edited text and the next document, digests in hexadecimal.

    Documents stand by descending doc_id, null last; rows of one doc_id stand in the order of their texts'
    hashes; after the last comes the first. A null text is empty. An empty text's edited text is empty, and its
    fingerprint ''; so is that of a text without words. A lone document is its own next one. Other columns of
    ``docs`` are ignored. Texts move once, by range of that order; the ends of the ranges, two rows each, are
    written beside the finished rows and meet by range number. Equal rows are spread over ranges by their
    place in the input.
    """
    scheme = scheme or OnePermutation()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select(
        "*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = [F.desc_nulls_last("doc_id"), "hash", "nth"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
                       ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
                       ("near_next", pa.float64()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())])

    def batch(columns: list[list], part: int | None = None, first: str | None = None, last: str | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            [*columns, [part] * n, [first] * n, [last] * n], arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, held_id, held_text, held_print = None, None, None, None
        for b in text_slices(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            prints = scheme.packed([t.encode() for t in texts])
            if first is None:
                first = texts[0]
            else:
                ids, texts, prints = [held_id, *ids], [held_text, *texts], [held_print, *prints]
            if len(ids) > 1:
                yield batch(_report(scheme, ids, texts, prints))
            held_id, held_text, held_print = ids[-1], texts[-1], prints[-1]
        if first is not None:
            yield batch([[held_id], *[[None]] * 6], part, first, held_text)
    done = table_of(ranges.mapInArrow(run, REPORT + ", part int, first string, last string"), "compared")

    # one row per range, in order: each range's last document is followed by the next range's first
    ends = done.where("part is not null").select("part", "doc_id", "first", "last")
    numbers = ends.select("part")
    by_part = Window.orderBy("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(
        by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    heads = ends.select(F.col("part").alias("next_part"), F.col("first").alias("following"))
    edges = ends.select("part", "doc_id", "last").join(after, "part").join(heads, "next_part").select("doc_id", "last", "following")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text="last"):
            for doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "last", "following"))):
                two = [text, following]
                yield batch(_report(scheme, [doc_id, None], two, scheme.packed([t.encode() for t in two]))).select(arrow.names[:7])
    every = done.where("part is null").select(*arrow.names[:7]).unionByName(edges.mapInArrow(join_edges, REPORT))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
