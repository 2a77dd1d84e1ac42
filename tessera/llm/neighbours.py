"""Nearest neighbours by inner product with collision-counting hashing.

Two vectors collide on a random line when they lie on the same side of it, and the share of lines on
which they do tells the angle between them. A vector's sides are packed into words, so that a pair's
collisions are counted by a few machine instructions; a vector that collides with the query on enough
lines is verified by its true inner product. To turn the largest inner product into the smallest
angle, a vector gets one more component that brings it to the largest norm M.

Enough means: a vector as near as the k-th best known would have reached that count with the
certainty that ``sure`` stands for. So clustered data end after few verifications and structureless
data after many; nothing is cut off.

Vectors lie in cells, each with the centre it is nearest to; the centres are about sqrt(n) / 4
vectors of the table. A query looks into its own cell first, and then, with the k-th best score found
there as a floor, into the cells that follow by their centres' nearness, as many as hold COVER of the
true neighbours of a sample of about SAMPLE queries, found by comparing these with every row. Every
row is in the index. Large cells are dealt into blocks that bound a task's memory, queries too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table_of

PROJECTIONS = 256
SURE = 1.5
COVER = 0.97
SAMPLE = 256
CELL_SHARE = 0.25
BLOCK = 32_768
QUERY_BLOCK = 32_768
COMPONENTS = 1 << 23  # of a block's vectors, where these are long
STEP = 1 << 18  # pairs whose collisions are counted at once


def _sides(values: np.ndarray) -> np.ndarray:
    """(words, rows): which side of each line a row lies on, 64 lines to a word."""
    bits = np.packbits(values > 0, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits.view(np.uint64).T)


def _extra(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The component that brings each vector to the largest norm."""
    return np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))


def _top(which: np.ndarray, places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The pairs that are among the k best of their query, in order."""
    order = np.lexsort((ids[places], -scores, which))
    which, places, scores = which[order], places[order], scores[order]
    mine = np.arange(len(which)) - np.searchsorted(which, which) < k
    return which[mine], places[mine], scores[mine]


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, norm: float, k: int,
                 projections: int = PROJECTIONS, sure: float = SURE, seed: int = 7,
                 floors: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query's place, places of its k best, their scores, number verified) for each query of the block.

    A query's floor is a score that k vectors are known to reach; only vectors that reach it too are
    returned. A query without one gets it from the vectors that it collides with most.
    """
    n, dim = vectors.shape
    rng = np.random.default_rng([seed, dim])
    lines = rng.standard_normal((dim + 1, projections))
    rows = _sides(vectors @ lines[:dim] + _extra(vectors, norm)[:, None] * lines[dim])
    wanted = _sides(queries @ lines[:dim])
    floors = np.full(len(queries), -math.inf) if floors is None else floors
    sizes = np.sqrt((queries * queries).sum(axis=1))
    out = []
    step = max(1, STEP // n)
    for start in range(0, len(queries), step):
        q, mine, floor = queries[start:start + step], query_ids[start:start + step], floors[start:start + step].copy()
        apart = np.zeros((len(q), n), dtype=np.uint16)  # lines on which a pair doesn't collide
        for row, word in zip(rows, wanted[:, start:start + step]):
            apart += np.bitwise_count(row[None, :] ^ word[:, None])

        def verify(places: np.ndarray, at_most: np.ndarray) -> tuple[np.ndarray, ...]:
            which, near = np.nonzero(apart[places] <= at_most[:, None])
            which = places[which]
            seen = np.bincount(which, minlength=len(q))
            other = ids[near] != mine[which]
            which, near = which[other], near[other]
            scores = np.empty(len(near))
            for i in range(0, len(near), STEP // 8):  # the same sum wherever a vector lies
                part = slice(i, i + STEP // 8)
                scores[part] = (vectors[near[part]] * q[which[part]]).sum(axis=1)
            return which, near, scores, seen
        open_ = np.flatnonzero(np.isinf(floor))
        if len(open_) and n > 4 * k:
            first = np.partition(apart[open_], 4 * k - 1, axis=1)[:, 4 * k - 1]
            which, near, scores, _ = verify(open_, first)
            which, _, scores = _top(which, near, scores, ids, k)
            last = np.flatnonzero(np.arange(len(which)) - np.searchsorted(which, which) == k - 1)
            floor[which[last]] = scores[last]
        # where the floor is open still, every vector is verified
        share = np.arccos(np.clip(floor / (sizes[start:start + step] * norm), -1, 1)) / math.pi
        most = projections * share + sure * np.sqrt(projections * share * (1 - share)) + 1
        most[np.isinf(floor)] = projections
        which, near, scores, seen = verify(np.arange(len(q)), most)
        good = scores >= floor[which]
        which, near, scores = _top(which[good], near[good], scores[good], ids, k)
        ends = np.searchsorted(which, np.arange(len(q) + 1))
        out.extend((start + i, near[a:b], scores[a:b], int(seen[i]))
                   for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())))
    return out


RESULT = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()),
                    ("verified", pa.int64())])
FOUND = "query_id long, query_hash long, vec_id long, score double, verified long"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim): the vectors that take part, in single precision if they are held in it, else in double.

    Vectors that are null, empty or zero or that hold a null, NaN or infinite component don't.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    return v.where("embedding is not null and size(embedding) > 0"
                   " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
                   " and exists(embedding, x -> x <> 0)").withColumn("dim", F.size("embedding"))


class _Cells:
    """Centres by dimension: the cell of a vector, and a query's cells from its own on."""

    def __init__(self, norms: dict[int, float], centres: dict[int, np.ndarray]):
        self.norms, self.depth, self.sizes, self.enough, self.centres = norms, {}, {}, 0, {}
        for dim, norm in norms.items():
            c = centres.get(dim, np.ones((1, dim)))
            c = np.column_stack((c, _extra(c, norm)))
            self.centres[dim] = c / np.sqrt((c * c).sum(axis=1))[:, None]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        c, extra = self.centres[dim], _extra(vectors, self.norms[dim])
        return np.concatenate([np.argmax(vectors[i:i + 1024] @ c[:, :dim].T + extra[i:i + 1024, None] * c[:, dim], axis=1)
                               for i in range(0, len(vectors), 1024)])

    def order(self, queries: np.ndarray) -> np.ndarray:
        c = self.centres[queries.shape[1]]
        return np.argsort(-(queries @ c[:, :-1].T), axis=1, kind="stable")

    def visited(self, queries: np.ndarray) -> list[np.ndarray]:
        """Each query's cells: the depth that the sample asks for, or further until they hold enough vectors."""
        dim, out = queries.shape[1], []
        for i in range(0, len(queries), 1024):
            order = self.order(queries[i:i + 1024])
            filled = (np.cumsum(self.sizes[dim][order], axis=1) < self.enough).sum(axis=1) + 1
            out.extend(o[:max(self.depth[dim], f)] for o, f in zip(order, filled.tolist()))
        return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


def _small(df: DataFrame, rows: list[tuple], /, **columns: pa.DataType) -> DataFrame:
    """A few rows of the driver's, to be joined with ``df``."""
    values = [[r[i] for r in rows] for i in range(len(columns))]
    return df.sparkSession.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns)))


def _sampled(df: DataFrame, counts: dict[int, int], wanted: dict[int, int]) -> dict[int, list]:
    """About so many rows of each dimension, chosen by their hash."""
    share = _small(df, [(d, n, wanted[d]) for d, n in counts.items()], dim=pa.int32(), rows=pa.int64(), wanted=pa.int64())
    rows = df.join(F.broadcast(share), "dim").where(
        F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "embedding"), F.col("rows")) < F.col("wanted"))
    out = {}
    for r in rows.select("dim", "vec_id", "embedding").distinct().orderBy("dim", "vec_id", F.xxhash64("embedding")).collect():
        out.setdefault(r.dim, []).append((r.vec_id, r.embedding))
    return out


def _true_neighbours(index: DataFrame, sample: dict[int, list], k: int) -> DataFrame:
    """(dim, place, cell): the cells of each sampled query's k nearest, by comparison with every row."""
    asked = {d: (np.array([-1 if i is None else i for i, _ in rows]), np.array([i is not None for i, _ in rows]),
                 np.array([e for _, e in rows], dtype=np.float64)) for d, rows in sample.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.full((len(q), k), -math.inf), np.zeros((len(q), k), dtype=np.int32)) for d, (_, _, q) in asked.items()}
        for batch in batches:
            for dim, rows in _by_dim(batch):
                if dim not in asked:
                    continue
                ids, known, q = asked[dim]
                scores = q @ _matrix(rows.column("embedding"), dim).T
                number = rows.column("vec_id").fill_null(0).to_numpy()
                held = rows.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
                scores[(ids[:, None] == number) & known[:, None] & held] = -math.inf
                s = np.concatenate((best[dim][0], scores), axis=1)
                c = np.concatenate((best[dim][1], np.broadcast_to(rows.column("cell").to_numpy(), scores.shape)), axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[dim] = np.take_along_axis(s, top, axis=1), np.take_along_axis(c, top, axis=1)
        for dim, (s, c) in best.items():
            place, column = np.nonzero(s > -math.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), dim, dtype=np.int32)), pa.array(place.astype(np.int32)), pa.array(c[place, column]),
                 pa.array(s[place, column])], names=["dim", "place", "cell", "score"])
    near = index.mapInArrow(run, "dim int, place int, cell int, score double")
    best = Window.partitionBy("dim", "place").orderBy(F.desc("score"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("dim", "place", "cell")


def _indexed(vectors: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, _Cells]:
    """The usable vectors with their cells, and the cells fitted to the sampled queries."""
    rows = usable(vectors)
    stats = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(
        F.expr("aggregate(embedding, 0d, (s, x) -> s + cast(x as double) * x)")).alias("norm2")).collect()
    counts = {r.dim: r.n for r in stats}
    centres = _sampled(rows, counts, {d: max(1, round(CELL_SHARE * math.sqrt(n))) for d, n in counts.items()})
    cells = _Cells({r.dim: math.sqrt(r.norm2) * (1 + 1e-9) for r in stats},
                   {d: np.array([e for _, e in c], dtype=np.float64) for d, c in centres.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                cell = cells.of(_matrix(part.column("embedding"), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], names=[*part.schema.names, "cell"])
    kind = rows.schema["embedding"].dataType.simpleString()
    index = table_of(rows.mapInArrow(place, f"vec_id long, embedding {kind}, dim int, cell int"), "vectors")
    cells.sizes = {d: np.zeros(len(c), dtype=np.int64) for d, c in cells.centres.items()}
    for r in index.groupBy("dim", "cell").count().collect():
        cells.sizes[r.dim][r.cell] = r["count"]
    # a query can't take the rows of its own vec_id
    own = index.where("vec_id is not null").groupBy("vec_id").count().agg(F.max("count")).first()[0]
    cells.enough = k + (own or 0)
    asked_of = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect() if r.dim in counts}
    sample = _sampled(asked, asked_of, {d: SAMPLE for d in asked_of})
    ranks = {}
    order = {d: np.argsort(cells.order(np.array([e for _, e in q], dtype=np.float64)), axis=1) for d, q in sample.items()}
    for r in _true_neighbours(index, sample, k).collect() if sample else []:
        ranks.setdefault(r.dim, []).append(order[r.dim][r.place, r.cell])
    for d, c in cells.centres.items():
        cells.depth[d] = 1 + int(np.quantile(ranks[d], COVER, method="higher")) if d in ranks else len(c)
    return index, cells


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK,
            **search) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query.

    Both frames have (vec_id, embedding); other columns are ignored. A query meets vectors of its own
    dimension whose vec_id is another than its own (a null vec_id is other than any); with fewer than k
    of them it gets them all. Ties go to the smaller vec_id, null last. A query row that repeats wholly
    counts once; queries that share a vec_id but not the vector have results each.
    """
    asked = usable(queries).withColumn("query_hash", F.xxhash64("embedding")).dropDuplicates(["vec_id", "query_hash"])
    asked = table_of(asked, "asked")
    index, cells = _indexed(vectors, asked, k)
    norms = cells.norms
    known = _small(asked, [(d,) for d in norms], dim=pa.int32())

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                lists = pa.array(cells.visited(_matrix(part.column("embedding"), dim)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cells"])
    kind = asked.schema["embedding"].dataType.simpleString()
    asked = asked.join(F.broadcast(known), "dim").select("vec_id", "embedding", "dim", "query_hash").mapInArrow(
        visits, f"vec_id long, embedding {kind}, dim int, query_hash long, cells array<int>")

    def group(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return RESULT.empty_table()
        dim = rows["dim"][0].as_py()
        known = rows["vec_id"].is_valid().to_numpy()
        number = rows["vec_id"].fill_null(0).to_numpy()
        # places stand for ids, so that a null id differs from every other
        ids = np.where(known, number, np.iinfo(np.int64).max)
        query_ids = wanted["vec_id"].fill_null(np.iinfo(np.int64).max - 1).to_numpy()
        floors = wanted["floor"].fill_null(-math.inf).to_numpy()
        results = search_block(ids, _matrix(rows["embedding"], dim), query_ids, _matrix(wanted["embedding"], dim),
                               norms[dim], k, floors=floors, **search)
        lengths = [len(places) for _, places, _, _ in results]
        if not sum(lengths):
            return RESULT.empty_table()
        who = np.repeat([qi for qi, _, _, _ in results], lengths)
        places = np.concatenate([p for _, p, _, _ in results])
        return pa.table([wanted["vec_id"].take(pa.array(who)), wanted["query_hash"].take(pa.array(who)), rows["vec_id"].take(pa.array(places)),
                         pa.array(np.concatenate([s for _, _, s, _ in results])),
                         pa.array(np.repeat([v for _, _, _, v in results], lengths))], schema=RESULT)

    def look(wanted: DataFrame) -> DataFrame:
        """What the queries find in their cells."""
        def parts(rows: int, most: int, dim: int) -> int:
            return -(-rows // max(1, min(most, COMPONENTS // dim)))
        plan = [(r.dim, r.cell, parts(int(cells.sizes[r.dim][r.cell]), block, r.dim), parts(r["count"], query_block, r.dim))
                for r in wanted.groupBy("dim", "cell").count().collect() if cells.sizes[r.dim][r.cell]]
        plan = F.broadcast(_small(index, plan, dim=pa.int32(), cell=pa.int32(), blocks=pa.int64(), query_blocks=pa.int64()))

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            return df.join(plan, ["dim", "cell"]).withColumn(
                own, F.pmod(F.xxhash64(F.lit(own), "vec_id", "embedding"), F.col(own + "s"))).withColumn(
                other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))).drop("blocks", "query_blocks").groupBy(
                "dim", "cell", "block", "query_block")
        return dealt(index, "block", "query_block").cogroup(dealt(wanted, "query_block", "block")).applyInArrow(group, FOUND)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = ["vec_id", "embedding", "dim", "query_hash", "floor"]
    own = asked.withColumns({"cell": F.element_at("cells", 1), "floor": F.lit(None).cast("double")})
    first = table_of(best(look(own.select(*names, "cell"))), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id"), F.col("query_hash").alias("hash"), F.col("score").alias("floor"))
    rest = asked.join(floors, F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("query_hash") == F.col("hash")), "left")
    rest = table_of(rest.where("size(cells) > 1").select(*names, F.slice("cells", 2, F.size("cells")).alias("cells")), "rest")
    rest = rest.select(*names, F.explode("cells").alias("cell"))
    return best(first.drop("rank").unionByName(look(rest))).select("query_id", "rank", "vec_id", "score")
