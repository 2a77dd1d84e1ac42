"""Token-id files compressed by a Re-Pair grammar, with random access by document.

A file holds consecutive documents. Frequent pairs of neighbouring ids are replaced by
nonterminals, round after round; a rule is the pair it stands for, and its expansion length is
stored beside it. Pairs never cross the end of a document, so every document starts at a symbol of
its own and can be decoded alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import qualified, scratch, table_of, text_slices
from tessera.llm.tokens import ENCODE_BYTES, encoder

MAGIC = b"TRP1"
FILE_IDS = 4 << 20
MIN_PAIRS = 12
TABLE_BITS = 20
WIDE = 1 << 24  # symbols take two bytes, or three where a file needs more of them


def _cells(first: np.ndarray, second: np.ndarray, turn: int, step: int = 1 << 16) -> np.ndarray:
    """The hash cell of each pair, a step that fits the processor's cache at a time."""
    one, two, add = (np.uint32(m * (2 * turn + 1) & 0xFFFFFFFF) for m in (2654435761, 2246822519, 374761393))
    out = np.empty(len(first), dtype=np.int32)
    for i in range(0, len(first), step):
        cell = (first[i:i + step] * one) ^ (second[i:i + step] * two + add)
        cell ^= cell >> np.uint32(15)
        cell *= np.uint32(2654435761)
        out[i:i + step] = cell >> np.uint32(32 - TABLE_BITS)
    return out


def _frequent(seq: np.ndarray, last: np.ndarray, min_pairs: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, name, count): places whose pair is frequent, a small number for each pair, and how often it was counted.

    Pairs are counted in a table of hash cells first; one that is frequent lies in a full cell. Then one pair
    of each full cell is counted and the others are left for another turn, which hashes otherwise.
    """
    cell = _cells(seq[:-1], seq[1:], turn)
    cell[last[:-1]] = 1 << TABLE_BITS  # pairs across documents share a cell that is never full
    full = np.bincount(cell, minlength=(1 << TABLE_BITS) + 1) >= min_pairs
    full[-1] = False
    at = np.flatnonzero(full[cell])
    pair = seq[at].astype(np.int64) << 32 | seq[at + 1]
    name = cell[at]
    named = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    named[name] = pair
    same = named[name] == pair
    del cell, pair  # a worker's memory peaks here
    at, name = at[same], name[same]
    counts = np.bincount(name, minlength=1 << TABLE_BITS)
    often = (counts >= min_pairs)[name]
    at, name = at[often], name[often]
    return at, name, counts[name]


def _open(first: np.ndarray, second: np.ndarray, at: np.ndarray, min_pairs: int, turn: int,
          exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(open, place, name, count): of the places ``at`` of pairs, those whose pair may still be frequent; the places whose pair
    is, a small number for each pair, and how often it was counted.

    Counted as by ``_frequent``. What is counted as rare is done with; the other pairs of its cell are not.
    """
    cell = _cells(first, second, turn)
    full = (np.bincount(cell, minlength=1 << TABLE_BITS) >= min_pairs)[cell]
    at, first, second, name = at[full], first[full], second[full], cell[full]
    pair = first.astype(np.int64) << 32 | second
    if exact:
        _, name, counts = np.unique(pair, return_inverse=True, return_counts=True)
        often = (counts >= min_pairs)[name]
        at, name = at[often], name[often]
        return at, at, name, counts[name]
    named = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    named[name] = pair
    same = np.flatnonzero(named[name] == pair)
    counts = np.bincount(name[same], minlength=1 << TABLE_BITS)
    place, name = at[same], name[same]
    count = counts[name]
    often = count >= min_pairs
    still = np.ones(len(at), dtype=bool)
    still[same[~often]] = False
    return at[still], place[often], name[often], count[often]


def _sparse_rounds(seq: np.ndarray, last: np.ndarray, base: int, min_pairs: int, turn: int,
                   rules: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, last) after the rounds of ``repair`` that replace little; their rules are added to ``rules``.

    A pair can only become frequent while one of its symbols is new, as replacing takes pairs of older symbols away. So a round
    looks only at the pairs not yet found rare and at those beside the symbols just made; ``after`` and ``before`` lead over
    the gaps that replaced symbols leave.
    """
    made, exact, live = sum(map(len, rules)), False, len(seq)
    after, before = np.arange(1, live + 1, dtype=np.int32), np.arange(-1, live, dtype=np.int32)
    gone, open_ = np.zeros(live, dtype=bool), ~last
    at = np.flatnonzero(open_)
    while len(at) and base + made < WIDE:
        at, place, name, count = _open(seq[at], seq[after[at]], at, min_pairs, turn, exact)
        turn += 1
        follow = after[place]
        # every other pair of a run of one symbol
        run = np.flatnonzero(seq[place] == seq[follow])
        if len(run):
            first = np.flatnonzero(np.concatenate(([True], place[run[1:]] != follow[run[:-1]])))
            nth = np.arange(len(run)) - np.repeat(first, np.diff(first, append=len(run)))
            keep = np.ones(len(place), dtype=bool)
            keep[run[nth % 2 == 1]] = False
            place, follow, name, count = place[keep], follow[keep], name[keep], count[keep]
            if exact:  # the pairs left are those that can be replaced
                count = np.bincount(name)[name]
                keep = count >= min_pairs
                place, follow, name, count = place[keep], follow[keep], name[keep], count[keep]
        # of neighbours that overlap, the more frequent pair stays, of equally frequent ones the one with the larger number
        touch = np.flatnonzero(follow[:-1] == place[1:])
        more = count[touch + 1] - count[touch]
        less = (more > 0) | (more == 0) & (name[touch] < name[touch + 1])
        keep = np.ones(len(place), dtype=bool)
        keep[touch[less]] = False
        keep[touch[~less] + 1] = False
        place, follow, name = place[keep], follow[keep], name[keep]
        often = np.bincount(name) >= min_pairs
        used = np.flatnonzero(often)
        if not len(used):
            if exact:
                break
            exact = True
            continue
        symbol = np.zeros(len(often), dtype=np.uint32)
        symbol[used] = np.arange(len(used))
        keep = often[name]
        place, follow, new = place[keep], follow[keep], symbol[name[keep]]
        rule = np.empty((len(used), 2), dtype=np.uint32)
        rule[new] = np.stack((seq[place], seq[follow]), axis=1)
        rules.append(rule)
        seq[place] = new + np.uint32(base + made)
        made += len(used)
        exact = len(place) < 0.01 * live
        live -= len(place)
        last[place] = last[follow]
        gone[follow] = True
        past = after[follow]
        after[place], before[past] = past, place
        open_[:] = False
        open_[at] = open_[place] = open_[before[place]] = True
        open_ &= ~(gone | last)
        at = np.flatnonzero(open_)
    return seq[~gone], last[~gone]


def repair(ids: np.ndarray, last: np.ndarray, base: int, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): ``ids`` with frequent pairs replaced by symbols from ``base`` on, until none is left.

    ``last`` marks the last id of each document. A round gives a rule to every pair that it can replace
    ``min_pairs`` times, where of overlapping pairs the more frequent one is replaced (of equal ones, as in a run of one symbol,
    every other one from the left). Symbols of earlier rounds pair up in later ones. Rounds that find few pairs are followed by one
    that counts all of them exactly; when that one finds none, no pair occurs ``min_pairs`` times (runs of one symbol counted by halves).
    Rounds that replace less than a tenth look at the places of changes only.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    made, turn, share = 0, 0, 1.0
    while share >= 0.1 and len(seq) > 1 and base + made < WIDE:
        at, name, count = _frequent(seq, last, min_pairs, turn)
        turn += 1
        # every other pair of a run of one symbol
        run = np.flatnonzero(seq[at] == seq[at + 1])
        if len(run):
            place = at[run]
            fresh = np.concatenate(([True], np.diff(place) != 1))
            start = place[fresh][np.cumsum(fresh) - 1]
            drop = run[(place - start) % 2 == 1]
            at, name, count = np.delete(at, drop), np.delete(name, drop), np.delete(count, drop)
        # of neighbours that overlap, the more frequent pair stays, of equally frequent ones the one with the larger number
        own, apart = count << 24 | name, np.diff(at) != 1
        keep = np.ones(len(at), dtype=bool)
        keep[1:] &= apart | (own[1:] > own[:-1])
        keep[:-1] &= apart | (own[:-1] > own[1:])
        del count, own
        at, name = at[keep], name[keep]
        times = np.bincount(name)
        used = np.flatnonzero(times >= min_pairs)
        if not len(used):
            break
        symbol = np.full(len(times), -1, dtype=np.int64)
        symbol[used] = base + made + np.arange(len(used))
        new = symbol[name]
        replaced = new >= 0
        at, new, name = at[replaced], new[replaced], name[replaced]
        one = np.empty(len(times), dtype=np.int64)
        one[name] = at  # any of a pair's places
        rules.append(np.stack((seq[one[used]], seq[one[used] + 1]), axis=1))
        made += len(used)
        seq[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        share = len(at) / len(seq)
        seq, last = seq[keep], last[keep]
    seq, last = _sparse_rounds(seq, last, base, min_pairs, turn, rules)
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def expansions(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): the ids of every symbol, those below ``base`` standing for themselves."""
    every = np.arange(base, dtype="<u4")
    one = every.tobytes()
    own: list[bytes] = []
    for left, right in rules.tolist():
        own.append((one[4 * left:4 * left + 4] if left < base else own[left - base])
                   + (one[4 * right:4 * right + 4] if right < base else own[right - base]))
    length = np.concatenate((np.ones(base, dtype=np.int64), np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4))
    return np.frombuffer(b"".join([one, *own]), dtype="<u4"), np.cumsum(length) - length, length


def write_file(out, doc_ids: list[int | None], encoded: list[bytes]) -> None:
    """A file of documents given as ids in bytes (little-endian, 32 bits, none of them empty)."""
    sizes = np.array([len(x) // 4 for x in encoded], dtype="<u8")
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes).astype(np.int64) - 1] = True
    base = int(ids.max()) + 1
    symbols, last, rules = repair(ids, last, base)
    narrow = base + len(rules) <= 1 << 16
    length = expansions(base, rules)[2][base:]
    ends = np.flatnonzero(last).astype("<u8") + 1
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    body = b"".join([np.array([2 if narrow else 3, base, len(rules), len(doc_ids), len(symbols), len(ids)], dtype="<u8").tobytes(),
                     rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(), known.tobytes(), numbers.tobytes(),
                     sizes.tobytes(), ends.tobytes(), (symbols & 0xFFFF).astype("<u2").tobytes(),
                     b"" if narrow else (symbols >> 16).astype("u1").tobytes()])
    out.write(MAGIC + body + zlib.crc32(body).to_bytes(4, "little"))


class TokenFile:
    """A file read back. ``document(i)`` decodes one document, ``ids(a, b)`` any run of ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[4:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole token file")
        at = 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out
        width, base, n_rules, n_docs, n_symbols, self.n_ids = take("<u8", 6).tolist()
        rules, length = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        known, numbers = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [d if k else None for k, d in zip(known.tolist(), numbers.tolist())]
        self.sizes = take("<u8", n_docs).astype(np.int64)
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.symbols = take("<u2", n_symbols)
        if width == 3:
            self.symbols = self.symbols | take("u1", n_symbols).astype(np.uint32) << 16
        self._flat, self._start, self._length = expansions(base, rules)
        if not np.array_equal(self._length[base:], length):
            raise ValueError("the expansion lengths aren't those of the rules")

    def decode(self, a: int, b: int) -> np.ndarray:
        """The ids of symbols a to b."""
        s = self.symbols[a:b]
        n = self._length[s]
        before = np.cumsum(n) - n
        return self._flat[np.repeat(self._start[s] - before, n) + np.arange(int(n.sum()))]

    def document(self, i: int) -> np.ndarray:
        return self.decode(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file; expansion lengths tell which symbols hold them."""
        through = np.cumsum(self._length[self.symbols])
        first, past = int(np.searchsorted(through, a, "right")), int(np.searchsorted(through, b, "left")) + 1
        skip = a - (int(through[first - 1]) if first else 0)
        return self.decode(first, past)[skip:skip + b - a]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(i, ids) of every document, decoding about ``step`` symbols at once."""
        i = 0
        while i < len(self.ends):
            a = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, a + step, "right")))
            out = self.decode(a, int(self.ends[j - 1]))
            starts = np.cumsum(self.sizes[i:j]) - self.sizes[i:j]
            for k in range(i, j):
                yield k, out[starts[k - i]:starts[k - i] + self.sizes[k]]
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order (null first) below ``path``, a shared folder.

    Returns the manifest (path, part, nth, docs, ids), made as files are written; files in order of
    (part, nth) hold the documents in order. Each document is its ids and ``end_id``; a null text is
    empty; rows of one doc_id (or of none) are in order of a hash of their texts, and so spread over ranges, equal ones by
    their place in the input. Documents move once, by range of that order; a file is closed at about ``file_ids`` ids and named only when it is whole.
    """
    where = qualified(docs.sparkSession, path).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        enc, end, part, nth = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush():
            name = f"{uuid.uuid4().hex}.trp"
            with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                write_file(out, names, held)
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{where}/{name}", "part": part, "nth": nth, "docs": len(names),
                                                "ids": size}], schema)
        schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
        for b in text_slices(batches, limit=ENCODE_BYTES):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                names.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= file_ids:
                    yield flush()
                    names, held, size, nth = [], [], 0, nth + 1
        if names:
            yield flush()
    texts = docs.select(F.col("doc_id").cast("long"), "text").select(
        "*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("nth")]
    texts = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return texts.mapInArrow(write, "path string, part long, nth long, docs long, ids long")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]): one row per document, decoded from the files.

    start counts the ids of all documents before it, over all files of the manifest.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", "docs", before.alias("start"))
    spark = manifest.sparkSession
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_stream(name, compression=None) as src:
                    f = TokenFile(src.read())
                if len(f.doc_ids) != row["docs"]:
                    raise ValueError(f"{row['path']} holds {len(f.doc_ids)} documents; {row['docs']} were written")
                starts = (np.cumsum(f.sizes) - f.sizes + row["start"]).tolist()
                out: list[tuple] = []
                for i, ids in f.documents():
                    data = ids.astype("<u4").tobytes()
                    out.append((f.doc_ids[i], starts[i], len(ids), zlib.crc32(data), *([data] if with_ids else [])))
                    if len(out) >= (500 if with_ids else 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """What the files of ``docs`` hold, read back; one row per document."""
    spark = docs.sparkSession
    return read_tokens(table_of(write_tokens(docs, tokenizer, scratch(spark, "tokens"), end_id), "manifest"))
