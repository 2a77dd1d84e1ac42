"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing.

Each task tokenises its documents and packs them by best fit, largest first. Bins that are
nearly full are done. The underfull ones become items of the next level, where fewer nodes
pack the bins of several of the level below by best fit again, until one node has held all
that is left. Only (ids, lengths) travel between levels, never texts or token ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, table_of, text_slices
from tessera.llm.tokens import ENCODE_BYTES, encoder

CAPACITY = 2048
NEARLY = 0.995
FAN_IN = 8
NODE_ITEMS = 200_000
SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long, fill long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each item and the fill of each bin; largest first, ties in the order given.

    Open bins are kept by the room they have left; a bit set of the rooms finds the tightest fit.
    """
    place, offset = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += size
        open_bins[room - size].append(b)
        rooms |= 1 << (room - size)
    return place, offset, fill


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or whole sequences after a first one of what is over."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise_and_pack(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        first_id = TaskContext.get().partitionId() << 40
        made, cols = 0, [[] for _ in range(5)]

        def flush():
            nonlocal made, cols
            place, offset, fill = best_fit(cols[3], capacity)
            ids = [first_id + made + b for b in place]
            made += len(fill)
            out = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]],
                 pa.array(ids, pa.int64()), pa.array(offset, pa.int64()), pa.array([fill[b] for b in place], pa.int64())],
                [f.split()[0] for f in SCHEMA.split(", ")])
            cols = [[] for _ in range(5)]
            return out

        for b in text_slices(batches, limit=ENCODE_BYTES):
            encoded = enc.encode(b.column("text"))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoded):
                ids += end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))):
                        c.append(v)
            if len(cols[0]) >= NODE_ITEMS:
                yield flush()
        if cols[0]:
            yield flush()
    return run


def _repack(capacity: int):
    """Best fit over the bins of one node, each as one item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, first, inverse = np.unique(t["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        sizes = t["fill"].to_numpy()[first]
        place, shift, fill = best_fit(sizes.tolist(), capacity)
        place, shift, fill = np.array(place), np.array(shift), np.array(fill)
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, place, ids)
        new = {"sequence_id": name[place][inverse], "offset": t["offset"].to_numpy() + shift[inverse],
               "fill": fill[place][inverse]}
        for k, v in new.items():
            t = t.set_column(t.schema.get_field_index(k), k, pa.array(v, pa.int64()))
        yield from t.to_batches(max_chunksize=50_000)
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of a document.

    A document is its ids and ``end_id``; longer ones than ``capacity`` are cut, the first piece being
    what is over. A null text is empty and so just ``end_id``; a null doc_id stays null; rows
    that repeat are packed as documents of their own. Other columns of ``docs`` are ignored.
    A node of the tree holds at most about ``NODE_ITEMS`` bins: where more are underfull, a level has
    as many nodes as they need, and the rounds end when a round no longer saves bins.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    nodes = max(1, texts.rdd.getNumPartitions())
    packed = table_of(map_texts(texts, _tokenise_and_pack(tokenizer, capacity, end_id), SCHEMA), "pieces")
    nearly = int(capacity * NEARLY)
    done = []
    bins, level = None, 0
    while True:
        done.append(packed.where(F.col("fill") >= nearly))
        rest = packed.where(F.col("fill") < nearly)
        before, bins = bins, rest.where("offset = 0").count()
        fewer = max(-(-nodes // FAN_IN), -(-bins // NODE_ITEMS))
        # a node packs more often than once, so even a lone one is packed again after the first level
        if bins < 2 or (level and nodes == 1) or (before is not None and fewer >= nodes and bins >= before):
            break
        nodes, level = fewer, level + 1
        packed = table_of(rest.repartition(nodes, "sequence_id").mapInArrow(_repack(capacity), SCHEMA), "repacked")
    for d in done:
        rest = rest.unionByName(d)
    return rest.drop("fill")
