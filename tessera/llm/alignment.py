"""Alignment of two tokenizers over the same texts by pointer jumping.

Both tokenizers cover the bytes of blank + text without gaps. Every token points to the token that
reaches farthest to the right among those it overlaps, of the second tokenizer where both reach
as far; so chains move right until tokens of both end at one byte. Doubling the pointers (each
takes over its target's target) leads every token of a slice of texts to its component's
last token in as many steps as the longest chain's logarithm, and that token labels the group.

How many documents link an id of the one with an id of the other is counted over the corpus. Documents
are kept in chunks with the distinct pairs of a chunk listed once: a pair's count comes
back once per chunk and not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table_of, text_slices
from tessera.llm.tokens import encoder

SLICE = 2 << 20  # bytes of text aligned at once
CHUNK_LINKS = 3 << 20  # distinct links of the documents that share a list of pairs
SMALL_GROUP = 64  # links of a group that are written out; larger groups count their ids first
EXPAND = 2 << 20  # links written out at once
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary of the `tokenizers` library."""
    # the printable bytes stand for themselves, the others for the code points from 256 on, in order
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i) or ""
        out.append(bytes(char[c] for c in token) if all(c in char for c in token) else token.encode())
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of every piece of a sentencepiece model: its mark as a blank, byte pieces as their byte."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


class Pair:
    """The two tokenizers of a Python worker, and their ids' bytes and names."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = encoder(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = byte_level_bytes(self.a.tokenizer), piece_bytes(self.b)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # an id followed by what separates it from the next one
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(most)]
        self.most = most

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each text's ids by both; none where the text is empty or either one's bytes aren't those of blank + text."""
        whole = [" " + t for t in texts]
        a = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in self.a.encode(whole)]
        b = [np.array(x, dtype=np.int64) for x in self.b.encode(texts, num_threads=1)]
        none = np.zeros(0, dtype=np.int64)
        for i, t in enumerate(whole):
            data = t.encode()
            if (len(data) == 1 or b"".join(map(self.a_bytes.__getitem__, a[i].tolist())) != data
                    or b"".join(map(self.b_bytes.__getitem__, b[i].tolist())) != data):
                a[i] = b[i] = none
        return a, b


def pair_of(a_path: str, b_path: str) -> Pair:
    import sys
    held = sys.__dict__.setdefault("_tessera_pairs", {})  # outlives the task, as the worker does
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Pair(a_path, b_path)
    return held[a_path, b_path]


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each token of the first tokenizer, then of the second, its component's last token, by pointer jumping.

    Ends are byte offsets, ascending; both cover the same bytes. Tokens of the second are numbered after
    those of the first.
    """
    n = len(a_end)
    # the token that holds a token's last byte is the one of the other side that reaches farthest
    of_a = n + np.searchsorted(b_end, a_end)
    of_b = np.searchsorted(a_end, b_end)
    own = np.arange(n, n + len(b_end))
    successor = np.concatenate((of_a, np.where(a_end[of_b] > b_end, of_b, own) if n else own))
    while True:
        twice = successor[successor]
        if np.array_equal(twice, successor):
            return successor
        successor = twice


def _ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _links(group: np.ndarray, ids_a: np.ndarray, times_a: np.ndarray, first_a: np.ndarray, n_a: np.ndarray,
           ids_b: np.ndarray, times_b: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) for all ids a of a group with all its ids b."""
    total = n_a * n_b
    at = np.repeat(np.arange(len(group)), total)
    k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    i, j = first_a[at] + k // n_b[at], first_b[at] + k % n_b[at]
    return group[at], ids_a[i] << 16 | ids_b[j], times_a[i] * times_b[j]


def _counted(group: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, times, first, n): the different ids of each wanted group (ascending numbers) and how often each stands there."""
    key, times = np.unique(group << 16 | ids, return_counts=True)
    first = np.searchsorted(key >> 16, wanted)
    return key & 0xFFFF, times, first, np.searchsorted(key >> 16, wanted, "right") - first


def _sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(value, at)


class Aligned:
    """The alignment of a slice of documents: per document its digest, its distinct pairs and their links."""

    def __init__(self, pair: Pair, texts: list[str]):
        a, b = pair.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        a_end, b_end = np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b])
        root = terminals(a_end, b_end)
        last, label = np.unique(root, return_inverse=True)  # in order of their place
        group_a, group_b = label[:len(ids_a)], label[len(ids_a):]
        groups = len(last)
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        doc_of_b = np.repeat(np.arange(len(texts)), self.n_b)
        doc = doc_of_b[last - len(ids_a)]
        self.n_groups = np.bincount(doc, minlength=len(texts))
        self.n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(self.n_links, doc, per_a * per_b)
        self.digests = self._digests(pair, ids_a, ids_b, group_a, group_b, per_a, per_b)
        self.pairs, self.links = self._pairs(ids_a, ids_b, group_a, group_b, per_a, per_b, doc, len(texts))

    def _digests(self, pair, ids_a, ids_b, group_a, group_b, per_a, per_b) -> list[str]:
        through_a, through_b = np.cumsum(per_a), np.cumsum(per_b)
        mark_a, mark_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        mark_a[through_a - 1], mark_b[through_b - 1] = 1, 2
        names = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        names[np.arange(len(ids_a)) + (through_b - per_b)[group_a]] = mark_a * pair.most + ids_a
        names[np.arange(len(ids_b)) + through_a[group_b]] = mark_b * pair.most + ids_b
        told = list(map(pair.names.__getitem__, names.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256(b"".join(told[s:e])[:-1]).hexdigest() if e > s else ""
                for s, e in zip([0, *ends], ends)]

    @staticmethod
    def _pairs(ids_a, ids_b, group_a, group_b, per_a, per_b, doc, n_docs) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys, sums = [], []

        def add(where, pairs, times):
            """Sums of a run of groups by document and pair."""
            key, value = _sum_by(doc[where] << 32 | pairs, times)
            keys.append(key)
            sums.append(value)

        def blocks(n):
            """Runs of groups with about EXPAND links; a group of more is alone."""
            through, at = np.cumsum(n), 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + EXPAND, "right")))
                yield slice(at, to)
                at = to
        one_a, one_b = np.ones(len(ids_a), dtype=np.int64), np.ones(len(ids_b), dtype=np.int64)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        small = np.flatnonzero(per_a * per_b <= SMALL_GROUP)
        for s in blocks(per_a[small] * per_b[small]):
            g = small[s]
            add(*_links(g, ids_a, one_a, first_a[g], per_a[g], ids_b, one_b, first_b[g], per_b[g]))
        large = np.flatnonzero(per_a * per_b > SMALL_GROUP)
        if len(large):
            many = np.zeros(len(per_a), dtype=bool)
            many[large] = True
            a, b = (_counted(grp[many[grp]], ids[many[grp]], large) for grp, ids in ((group_a, ids_a), (group_b, ids_b)))
            for s in blocks(a[3] * b[3]):
                # a run of one group is cut by its ids of the first side
                width = int(b[3][s].max())
                step = max(1, EXPAND // width) if s.stop - s.start == 1 else int(a[3][s].max())
                for skip in range(0, int(a[3][s].max()), step):
                    n = np.clip(a[3][s] - skip, 0, step)
                    add(*_links(large[s], a[0], a[1], a[2][s] + skip, n, b[0], b[1], b[2][s], b[3][s]))
        key, value = _sum_by(np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.concatenate([np.zeros(0, dtype=np.int64), *sums]))
        cut = np.searchsorted(key >> 32, np.arange(n_docs + 1)).tolist()
        return ([key[s:e] & 0xFFFFFFFF for s, e in zip(cut, cut[1:])], [value[s:e] for s, e in zip(cut, cut[1:])])


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The digests of all documents, and the distinct pairs of chunks of them.

    A document's row holds its chunk, its digest, the places of its pairs in the chunk's list (``at``) and
    their links (``times``), as 32-bit and 64-bit integers. A chunk's own row has no digest but its
    ``pairs`` (the two ids in one number) and in how many of its documents each is linked (``n_docs``).
    """
    schema = "chunk long, " + DIGEST + ", at binary, times binary, pairs array<long>, n_docs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        part, nth = TaskContext.get().partitionId(), 0
        rows: list[dict] = []
        pairs: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 32 | nth
            every = np.concatenate(pairs)
            if len(every):
                known, at, times = np.unique(every, return_inverse=True, return_counts=True)
                yield out([{"chunk": chunk, "pairs": known, "n_docs": times}])
            begin = 0
            for r, p in zip(rows, pairs):
                r["chunk"], r["at"] = chunk, at[begin:begin + len(p)].astype("<u4").tobytes() if len(p) else b""
                begin += len(p)
            for i in range(0, len(rows), 1000):
                yield out(rows[i:i + 1000])

        def out(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(some, schema=arrow)
        arrow = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                           ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("at", pa.binary()),
                           ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32()))])
        for b in text_slices(batches, limit=SLICE):
            got = Aligned(pair, [t or "" for t in b.column("text").to_pylist()])
            cols = zip(b.column("doc_id").to_pylist(), got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist(),
                       got.n_links.tolist(), got.digests, got.links)
            for doc_id, n_a, n_b, groups, links, digest, times in cols:
                rows.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links,
                             "groups_sha256": digest, "times": times.astype("<i8").tobytes()})
            pairs.extend(got.pairs)
            size += sum(map(len, got.pairs))
            if size >= CHUNK_LINKS:
                yield from flush()
                rows, pairs, size, nth = [], [], 0, nth + 1
        if rows:
            yield from flush()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents link the two ids, and whether no other partner of the first id has more."""
    each = chunks.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "n_docs"))).toDF("pair", "n")
    counts = table_of(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    # one row per id of the first vocabulary, at most 65,536
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", 16) == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document.

    ``a_path`` is a byte-level file of the `tokenizers` library, given blank + text, with the strings of
    special tokens as plain text; ``b_path`` a sentencepiece model, which adds the blank itself. A null or empty text has no
    tokens, nor has one whose tokens don't join to blank + text again: its numbers are 0 and its digest ''.
    Every row is a document of its own, also where ids repeat or are null, and counts as one for its pairs.
    Other columns of ``docs`` are ignored.
    """
    chunks = table_of(aligned_chunks(docs, a_path, b_path), "aligned")
    listed = chunks.where("pairs is not null").select("chunk", F.explode("pairs").alias("pair"))
    back = listed.join(pair_counts(chunks), "pair").select(F.col("chunk").alias("for_chunk"), "pair", "count", "best")
    rows = chunks.where("pairs is null").drop("pairs", "n_docs")
    out = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def finish(docs_of: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["pair"].to_numpy())
        count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
        n_best, total = [], []
        for at, times in zip(docs_of["at"].to_pylist(), docs_of["times"].to_pylist()):
            at, times = np.frombuffer(at, dtype="<u4"), np.frombuffer(times, dtype="<i8")
            n_best.append(int(times[best[at]].sum()))
            total.append(int((times * count[at]).sum()))
        return pa.table([*[docs_of[c] for c in out.names[:5]], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                         docs_of["groups_sha256"]], schema=out)
    return rows.groupBy("chunk").cogroup(back.groupBy("for_chunk")).applyInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
