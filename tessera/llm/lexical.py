"""Ranked lexical search by best positions over impact lists.

A first pass writes a forward index: of every document its length and how often it holds each term
of the items searched for. Corpus counts come from that index. A second pass takes runs of
documents, keeps the impacts of each term in descending order, and answers every item over them:
lists are read from the top, a document met there is scored at once by direct access to its other
impacts, and all positions so reached are marked as seen. The first unseen position of each list
bounds what an unmet document can score, which is tighter than the last position read; reading stops
when that bound is strictly below the score of the k-th best held.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table_of, text_bytes, text_slices

K = 50
# items answered in one reading of the index: their terms and best documents are known to every task
BLOCK_ITEMS, BLOCK_TERMS = 8_192, 262_144
RUN_POSTINGS = 1 << 20  # postings of the documents whose lists are held at once
STEP = 16  # positions of each list read first; doubled from round to round
# letters, digits and all bytes of other characters stand; A-Z become small, the rest separates
_TERMS = bytes(b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int | None, list[int]]], dict[bytes, int]]]:
    """([(item_id, its different terms as numbers)], {term: number}) for as many items as a block may hold.

    Items come one partition at a time; an item with more terms than a block may hold is one of its own.
    """
    block: list[tuple[int | None, list[int]]] = []
    known: dict[bytes, int] = {}
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        own = dict.fromkeys(terms((row.text or "").encode()))
        if not own:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(known) + len(own) > BLOCK_TERMS):
            yield block, known
            block, known = [], {}
        block.append((row.item_id, [known.setdefault(t, len(known)) for t in own]))
    if block:
        yield block, known


def forward_index(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): of every document its number of terms, and the known ones by number."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in text_slices(batches):
            n, size, term, tf = [], [], [], []
            for text in text_bytes(b):
                found = terms(text)
                times = Counter(found)
                here = [t for t in times if t in number]
                n.append(len(found))
                size.append(len(here))
                term.extend([number[t] for t in here])
                tf.extend([times[t] for t in here])
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], ["doc_id", "n", "term", "tf"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        index, "doc_id long, n long, term array<int>, tf array<int>")


class Best:
    """The k best documents found so far: highest score first, then smallest id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def least(self) -> int:
        """The score of the k-th, or 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def offer(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= max(1, self.least())
        if not good.any():
            return
        score = np.concatenate((self.score, score[good]))
        doc, null = np.concatenate((self.doc, doc[good])), np.concatenate((self.null, null[good]))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class ImpactLists:
    """The postings of a run of documents, by document and by term in descending impact.

    ``ptr`` cuts ``term`` and ``share`` (the part of an impact that is no weight) into documents.
    """

    def __init__(self, doc_id: np.ndarray, null: np.ndarray, ptr: np.ndarray, term: np.ndarray, share: np.ndarray,
                 weights: np.ndarray):
        self.doc_id, self.null, self.ptr, self.term = doc_id, null, ptr, term
        self.impact = weights[term] * share
        self.listed = np.argsort((term.astype(np.int64) << 20) + (1_000_000 - share), kind="stable")
        self.place = np.empty_like(self.listed)
        self.place[self.listed] = np.arange(len(term))
        self.start = np.searchsorted(term[self.listed], np.arange(len(weights) + 1))
        self.doc = np.repeat(np.arange(len(doc_id)), np.diff(ptr))
        self.weights = weights
        self.wanted = np.zeros(len(weights), dtype=bool)
        self.seen = np.zeros(len(term), dtype=bool)
        self.met = np.zeros(len(doc_id), dtype=bool)
        self.accesses = 0

    def search(self, query: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that could be among the k best for the terms of ``query``."""
        query = query[(self.weights[query] > 0) & (self.start[query] < self.start[query + 1])]
        if not len(query):
            return
        self.wanted[query] = True
        lo, hi = self.start[query], self.start[query + 1]
        unseen = lo.copy()
        depth, step = 0, STEP
        while True:
            read = self.listed[_ranges(np.minimum(lo + depth, hi), np.minimum(lo + depth + step, hi))]
            self.accesses += len(read)
            depth, step = depth + step, 2 * step
            docs = np.unique(self.doc[read])
            docs = docs[~self.met[docs]]
            if len(docs):
                self.met[docs] = True
                at = _ranges(self.ptr[docs], self.ptr[docs + 1])
                owner = np.repeat(np.arange(len(docs)), self.ptr[docs + 1] - self.ptr[docs])
                mine = self.wanted[self.term[at]]
                at = at[mine]
                score = np.zeros(len(docs), dtype=np.int64)
                np.add.at(score, owner[mine], self.impact[at])
                self.seen[self.place[at]] = True
                best.offer(score, self.doc_id[docs], self.null[docs])
            bound = 0
            for j, (a, b) in enumerate(zip(unseen.tolist(), hi.tolist())):
                if a < b:
                    rest = self.seen[a:b]
                    gap = int(rest.argmin())
                    unseen[j] = a = b if rest[gap] else a + gap
                    if a < b:
                        bound += int(self.impact[self.listed[a]])
            if bound <= 0 or bound < best.least():
                break
        self.wanted[query] = False
        self.seen[:] = False
        self.met[:] = False


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All of a[0]..b[0]-1, a[1]..b[1]-1 and so on."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _runs(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[ImpactLists]:
    """Impact lists over runs of documents that hold about RUN_POSTINGS postings."""
    held: list[pa.RecordBatch] = []
    size = 0

    def lists() -> ImpactLists:
        t = pa.Table.from_batches(held).combine_chunks()
        tf, term = (t[c].combine_chunks() for c in ("tf", "term"))
        count = tf.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = t["n"].to_numpy().tolist()
        # as integers of any size: the product of two corpus counts and a length may pass 64 bits
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n], dtype=np.int64)
        tf = tf.flatten().to_numpy().astype(np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, count))
        return ImpactLists(t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy(),
                           np.concatenate(([0], np.cumsum(count))), term.flatten().to_numpy(), share, weights)
    for b in batches:
        b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("term")), 0))
        while b.num_rows:
            through = np.cumsum(b.column("term").value_lengths().to_numpy(zero_copy_only=False))
            take = max(1, int(np.searchsorted(through, RUN_POSTINGS - size, "right")))
            held.append(b.slice(0, take))
            size += int(through[take - 1])
            b = b.slice(take)
            if size >= RUN_POSTINGS or b.num_rows:
                yield lists()
                held, size = [], 0
    if held:
        yield lists()


def _search_block(index: DataFrame, block: list[tuple[int | None, list[int]]], n_known: int, k: int) -> DataFrame:
    """The k best of the index for each item of a block: (item, item_id, doc_id, score, rank)."""
    spark = index.sparkSession
    total = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms or 0
    weights = np.zeros(n_known, dtype=np.int64)
    counts = index.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()  # at most a block's terms
    for term, df in zip(counts["term"].to_pylist(), counts["count"].to_pylist()):
        weights[term] = weight(n_docs, df)
    shared = spark.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        queries = [np.array(q, dtype=np.int64) for _, q in items]
        best = [Best(k) for _ in items]
        for lists in _runs(batches, w, n_docs, n_terms):
            for q, b in zip(queries, best):
                lists.search(q, b)
        for i, b in enumerate(best):
            if len(b.score):
                same = len(b.score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * same, pa.int32()), pa.array([items[i][0]] * same, pa.int64()),
                     pa.array(b.doc, pa.int64(), mask=b.null), pa.array(b.score, pa.int64())],
                    ["item", "item_id", "doc_id", "score"])
    found = index.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each row of ``items``.

    Every row of ``items`` is an item of its own, also where ids or texts repeat, and every row of
    ``docs`` a document. A null or empty text has no terms: as an item it finds nothing, as a document it is
    found by nothing and not counted. Equal scores stand by ascending doc_id, null last. Other columns of both
    are ignored. All documents are read; items are answered in blocks of a bounded number of terms, each
    with an index of its own.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block, known in _item_blocks(items):
        index = table_of(forward_index(docs, known), "forward-index")
        found = table_of(_search_block(index, block, len(known), k), "ranked")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
