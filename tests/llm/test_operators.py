"""The operators against brute force, exact round trips, and rows with every awkward value."""

import functools
import hashlib
import io
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import llm_brute as brute
from tessera.llm import components as cc
from tessera.llm import (common, lm, mixing, neighbours, packing, quality, sanitise, sharding, simhash, tokenfile, tokens, warc)

EDGE_ROWS = 12


@functools.cache
def library(tokenizer):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer)  # untouched: ids are compared with the library's own


def ids_of(tokenizer, text, end):
    return library(tokenizer).encode(text or "", add_special_tokens=False).ids + [end]


# 1 --------------------------------------------------------------------------------------------------------------------
def check_scores(rows, texts):
    counts = Counter()
    for i, t in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update([w.lower() for w in brute.words(t)] + [b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = [x.lower() for x in brute.words(t)] + [b""]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, len(w), sum(counts[x] > 0 for x in w), round(base, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_lm_scores(docs, doc_rows):
    rows = lm.scored(docs).collect()
    check_scores(rows, [(r["doc_id"], r["text"]) for r in doc_rows])
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_edges(edge, none):
    rows = lm.scored(edge).collect()
    assert len(rows) == EDGE_ROWS
    check_scores(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert lm.scored(none).collect() == []
    nothing_learned = lm.scored(edge, train=F.lit(False)).collect()
    assert len(nothing_learned) == EDGE_ROWS and {r.n_known for r in nothing_learned} == {0}


def test_lm_class_probabilities_sum_to_one():
    m = lm.LogBilinear(7, np.arange(7.0))
    rng = np.random.default_rng(0)
    contexts = rng.integers(0, 7, (lm.CONTEXT, 1))
    total = sum(10 ** m.log10_probabilities(contexts, np.array([t]))[0] for t in range(7))
    assert abs(total - 1) < 1e-5


def test_lm_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    targets = rng.integers(0, 5, 20_000)
    contexts = np.stack([(targets + 1) % 5] * lm.CONTEXT)  # the context tells the class
    m = lm.LogBilinear(5, np.bincount(targets).astype(float))
    before = m.log10_probabilities(contexts, targets).mean()
    m.train(contexts, targets, rng, [np.zeros_like(p) for p in m.parameters()])
    assert m.log10_probabilities(contexts, targets).mean() > before + 0.3


# 2 --------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_hide_every_small_difference(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(difference & m == 0 for m in masks)


def test_fingerprints_by_definition():
    texts = ["", "One", "one TWO", "a b c", "a b c d", "a b c a b c a b c", "Été café X\x85Y z"]
    got = simhash.fingerprints([t.encode() for t in texts]).tolist()
    assert got == [brute.fingerprint(t) for t in texts]


def test_texts_reach_the_pipelines_operators_in_batches_bounded_in_bytes(spark, tokenizer):
    """Ten thousand long rows would be one batch of 40 MB, held by the JVM and by the Python worker."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 500) as text", "'s' as source")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})
    operators = (quality.ledger, quality.keep_passing, simhash.fingerprint_rows, mixing.sized,
                 lambda d: packing.pack(d.limit(10), tokenizer))
    before = spark.conf.get(common.BATCH_CONF, None)
    try:
        for operator in operators:
            spark.conf.unset(common.BATCH_CONF)
            operator(docs)
            seen = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < common.SLICE_BYTES
        spark.conf.set(common.BATCH_CONF, "1m")
        seen = common.map_texts(docs, sizes, "n long, size long").collect()
        assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < 1 << 21
    finally:
        spark.conf.unset(common.BATCH_CONF) if before is None else spark.conf.set(common.BATCH_CONF, before)


def test_a_task_gives_back_what_its_slices_held(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1
    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30]}), pa.RecordBatch.from_pydict({"text": ["c"]})]
    assert [b["text"].to_pylist() for b in common.text_slices(iter(batches), limit=20)] == [["a" * 10, None], ["b" * 30], ["c"]]
    assert pool.released == 1


def test_fingerprints_are_counted_in_steps(monkeypatch):
    """Texts that fill several steps alone and together; the memory taken is a few times that of the texts."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(n)) for n in (0, 1, 4, 19, 20, 21, 60, 1, 7, 0, 2, 3)]
    want = [brute.fingerprint(t) for t in texts]
    for step in (1, 7, 19):
        monkeypatch.setattr(simhash, "STEP", step, raising=False)
        assert simhash.fingerprints([t.encode() for t in texts]).tolist() == want
    monkeypatch.undo()
    long = [" ".join(map(str, range(i, i + 2000))).encode() for i in range(100)] + [b"a b " * 50_000]
    tracemalloc.start()
    try:
        simhash.fingerprints(long)
        assert tracemalloc.get_traced_memory()[1] < 40 * sum(map(len, long))
    finally:
        tracemalloc.stop()


def test_near_duplicates_match_brute_force(docs, doc_rows):
    fps = {r["doc_id"]: brute.fingerprint(r["text"]) for r in doc_rows}
    comp = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{fps[k]:016x}", comp[k]) for k in fps}


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_connect_what_brute_force_connects(spark, bucket):
    """A dense ball of fingerprints, chains and lone ones; bucket 2 sends all through the dense form."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        values.add(chain)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bucket).collect()
    assert all(((r.u ^ r.v) & (2 ** 64 - 1)).bit_count() <= 2 for r in found)
    roots = {r.node: r.root for r in cc.components(spark.createDataFrame([(r.u, r.v) for r in found], "u long, v long")).collect()}
    want = brute.components({v: v & (2 ** 64 - 1) for v in signed})
    assert {v: roots.get(v, v) for v in signed} == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, edges):
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = list(range(13))
    for _ in range(13):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: got.get(k, k) for k in range(13)} == dict(enumerate(root))


def test_simhash_edges(edge, none):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == EDGE_ROWS
    blank = [r for r in rows if int(r.fingerprint, 16) == 0]
    assert len(blank) == 4 and {r.component_id for r in blank} == {2}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    keys = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12]) for r in kept.collect())
    assert keys == [(False, 1, "a b c d e f "), (False, 1, "another text"), (False, 2, ""), (False, 5, "x" * 12),
                    (False, 6, "w0 w1 w2 w3 "), (False, 7, "Été \U0001d4b3 café\nl"), (False, 8, "one<|endofte"),
                    (True, 0, "null id word")]
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


# 3 --------------------------------------------------------------------------------------------------------------------
def test_neighbours_recall_and_order(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = vectors.collect()
    e, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, block=200, query_block=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = e @ e[q]
        s[q] = -9
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(v, c) for _, v, c in mine] == sorted([(v, c) for _, v, c in mine], key=lambda x: (-x[1], x[0]))
        place = {v: i for i, v in enumerate(ids.tolist())}
        assert all(abs(s[place[v]] - c) < 1e-12 for _, v, c in mine)
        hit.append(len({v for _, v, _ in mine} & set(ids[best])) / 20)
    assert np.mean(hit) >= 0.9


def test_neighbours_of_different_lengths_and_ties():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 8)) * rng.uniform(0.1, 5, (600, 1))
    v[100:140] = v[100]  # equal vectors
    ids = rng.permutation(600)
    q = v[[3, 100, 7]]
    norm = float(np.sqrt((v * v).sum(axis=1).max()))
    for qi, places, scores, _ in neighbours.search_block(ids, v, np.array([-1, -1, -1]), q, norm, 10):
        s = (v * q[qi]).sum(axis=1)
        best = np.lexsort((ids, -s))[:10]
        assert len(set(best) & set(places)) >= 9 and list(scores) == sorted(scores, reverse=True)
        if qi == 1 and s[100] == s.max():
            assert list(ids[places]) == sorted(ids[100:140])[:10]


def test_neighbours_verify_few():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64))  # without structure
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    ids = np.arange(4000)
    seen, hit = [], []
    for qi, places, _, verified in neighbours.search_block(ids, v, ids[:40], v[:40], 1.0 + 1e-9, 20):
        s = v @ v[qi]
        s[qi] = -9
        seen.append(verified / 4000)
        hit.append(len(set(np.lexsort((ids, -s))[:20]) & set(places)) / 20)
    assert np.mean(hit) >= 0.95 and np.mean(seen) <= 0.25


def test_neighbours_queries_meet_few_cells(spark):
    rng = np.random.default_rng(5)

    def clustered(n):
        v = rng.normal(size=(n // 50, 16))[rng.integers(0, n // 50, n)] + 0.1 * rng.normal(size=(n, 16))
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        return v, spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").cache()
    met = []
    for n in (1000, 4000):
        v, df = clustered(n)
        queries = df.where("vec_id % 20 = 0")
        index, cells = neighbours._indexed(df, neighbours.usable(queries), 20)
        assert index.count() == n == cells.sizes[16].sum()  # every row is in a cell
        met.append(np.mean([cells.sizes[16][c].sum() for c in cells.visited(v[::20])]))
    assert met[1] < 2.5 * met[0] and met[1] < 4000 / 5, met  # four times the rows
    got = defaultdict(set)
    for r in neighbours.nearest(df, queries, k=20).collect():
        got[r.query_id].add(r.vec_id)
    s = v[::20] @ v.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    assert np.mean([len(got[20 * i] & set(np.argsort(-x)[:20].tolist())) / 20 for i, x in enumerate(s)]) >= 0.9


def test_neighbours_far_cells_fill_up(spark):
    """Small cells, and a query whose own vec_id fills its cell, are followed by others until k are found."""
    rng = np.random.default_rng(6)
    v = np.repeat(np.eye(8) * 5, 40, axis=0) + 0.01 * rng.normal(size=(320, 8))
    rows = [(0 if i < 40 else i, x) for i, x in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts = {r.query_id: r["count"] for r in neighbours.nearest(df, df.where("vec_id = 0"), k=60).where(
        "vec_id <> 0").groupBy("query_id", "score").count().groupBy("query_id").count().collect()}
    assert counts[0] >= 60


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
            (None, [0.9, 0.1]), (7, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0]), (1, [0.5, 0.5]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "dim": F.lit(1)})
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in
           neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, None, 0.9), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (20, 1, 7, 6.0)]
    assert neighbours.nearest(df.where("false"), df.where("false")).collect() == []
    assert neighbours.nearest(df, df.where("false")).collect() == []


# 4, 7 -----------------------------------------------------------------------------------------------------------------
TEXTS = ["", " ", "  two  spaces ", "tabs\tand\n\nlines \n", "x y z\x85q", "it's don't 123 4.5!?", "a\x1cb\x1d c", "\n", "\n\n x",
         "<|endoftext|> is one id", "a b<|endoftext|>c d", "x <|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext|>",
         "not <|endoftext| one", "é\U0001f600 中文", "trailing \r\n", "word" * 50 + " " + "word" * 50]


def test_encoder_gives_the_library_ids(tokenizer):
    e = tokens.Encoder(tokenizer)
    for _ in range(2):
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(TEXTS)]
        assert got == [ids_of(tokenizer, t, 0)[:-1] for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab '.1\n\t  \x1cé", max_size=25), max_size=4))
def test_encoder_on_any_white_space(texts):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in tokens.encoder(path).encode(texts)]
    assert got == [x.ids for x in library(path).encode_batch(texts, add_special_tokens=False)]


def test_encoder_with_another_pattern():
    import public_tokenizers
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.by_chunk
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(TEXTS)] == [
        x.ids for x in library(public_tokenizers.path("word_bpe_49k.json")).encode_batch(TEXTS, add_special_tokens=False)]


def test_encoder_with_added_tokens_as_plain_text(tokenizer):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in tokens.Encoder(tokenizer, plain=True).encode(TEXTS)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]
    assert 50256 not in sum(got, [])


def test_encoder_memory_is_bounded_in_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    e = tokens.Encoder(tokenizer)
    rng = random.Random(2)
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(60)) for _ in range(10)]
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(texts)] == [
            ids_of(tokenizer, t, 0)[:-1] for t in texts]
        assert 0 < sum(tokens.ENTRY_BYTES + len(c) + len(v) for c, v in e.known.items()) <= 20_400


def test_encoder_gives_a_word_to_the_model_once(tokenizer):
    """Marks after a word are a piece of their own; every letter that is cut by is one for the library, too."""
    import re
    e = tokens.Encoder(tokenizer)
    texts = ["a zxqword, a zxqword. a zxqword!? (zxqword) zxqword's", "a zxqword; Привет, 中文... 12, 3.5 ² Ⅷ. x\u0301y, \u1e9f. ' 's, 're."]
    for _ in range(2):
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(texts)] == [ids_of(tokenizer, t, 0)[:-1] for t in texts]
    assert {" zxqword", ",", "."} <= set(e.known) and not {" zxqword,", " zxqword.", " zxqword;"} & set(e.known)
    letters = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), tokens._LETTERS)
    every = "".join(chr(c) for a, b in re.findall("(.)-(.)", letters) for c in range(ord(a), ord(b) + 1)) + re.sub(".-.", "", letters)
    assert len(every) > 40_000 and len(library(tokenizer).pre_tokenizer.pre_tokenize_str(every)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé中1²Ⅷ\u0301\u02b0'.,-_~| \n", max_size=20), max_size=4))
def test_encoder_on_any_marks(texts):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in tokens.encoder(path).encode(texts)]
    assert got == [x.ids for x in library(path).encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets_what_it_meets_least(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    e = tokens.Encoder(tokenizer)
    for i in range(12):
        late = " often seldom" if i > 1 else ""
        texts = [" ".join(f"{a}{b}{'abcdefghijkl'[i]}" for a in "qwertz" for b in "yxcvb") + late]
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(texts)] == [ids_of(tokenizer, t, 0)[:-1] for t in texts]
    assert {" often", " seldom"} <= set(e.known) and " qya" not in e.known


def check_packing(rows, texts, tokenizer, capacity):
    want = Counter()
    for i, t in texts:
        ids = ids_of(tokenizer, t, 0)
        for k, (s, n) in enumerate(packing.cut_points(len(ids), capacity)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s:s + n], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(docs, doc_rows, tokenizer):
    rows = packing.pack(docs.repartition(5), tokenizer).collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in doc_rows], tokenizer, 2048)
    assert used <= least * 1.02 + 1


def test_one_partition_of_several_flushes_is_merged(spark, tokenizer, monkeypatch):
    """Bins that were closed by different flushes of one task meet: half-full ones, then small ones."""
    monkeypatch.setattr(packing, "NODE_ITEMS", 400)
    texts = ["a " * 1100] * 400 + ["b " * 700] * 400
    rows = list(enumerate(texts))
    one = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer).collect()
    assert len({r.sequence_id for r in one}) == 400
    check_packing(one, rows, tokenizer, 2048)


def test_packing_edges(edge, none, tokenizer):
    rows = packing.pack(edge, tokenizer).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in edge.collect()], tokenizer, 2048)
    assert packing.pack(none, tokenizer).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_fills_bins(sizes):
    place, offset, fill = packing.best_fit(sizes, 20)
    bins = defaultdict(list)
    for p, o, s in zip(place, offset, sizes):
        bins[p].append((o, s))
    for b, items in bins.items():
        assert sum(s for _, s in items) == fill[b] <= 20
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
    assert sum(f <= 10 for f in fill) <= 1  # two bins no fuller than half would have been one


def check_token_rows(rows, docs, tokenizer):
    at, want = 0, []
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    for i, t, _ in sorted(map(tuple, texts), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = ids_of(tokenizer, t, 2)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files(docs, doc_rows, tokenizer, spark, tmp_path):
    manifest = tokenfile.write_tokens(docs, tokenizer, str(tmp_path / "t"), file_ids=20_000).cache()
    assert manifest.count() > 3
    rows = tokenfile.read_tokens(manifest).collect()
    check_token_rows(rows, docs, tokenizer)


def test_rows_of_one_id_are_spread_over_files(spark, tokenizer, tmp_path):
    """A third of all rows without an id, another third equal: several tasks write them, in the stated order."""
    rows = [(None, f"text {i}") for i in range(300)] + [(4, "the same text")] * 300 + [(i, f"t{i}") for i in range(10, 310)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = tokenfile.write_tokens(df, tokenizer, str(tmp_path / "t")).cache()
    assert manifest.select("part").distinct().count() >= 6
    check_token_rows(tokenfile.read_tokens(manifest).collect(), df, tokenizer)


def test_token_file_edges(edge, none, tokenizer):
    check_token_rows(tokenfile.round_trip(edge, tokenizer).collect(), edge, tokenizer)
    assert tokenfile.round_trip(none, tokenizer).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=80), min_size=1, max_size=30), st.sampled_from([5, 70_000]))
def test_repair_round_trip(documents, top):
    documents = [[top if x == 3 else x for x in d] for d in documents]
    out = io.BytesIO()
    tokenfile.write_file(out, list(range(len(documents))), [np.array(d, dtype="<u4").tobytes() for d in documents])
    f = tokenfile.TokenFile(out.getvalue())
    assert [f.document(i).tolist() for i in range(len(documents))] == documents
    assert [ids.tolist() for _, ids in f.documents(step=7)] == documents
    flat = [x for d in documents for x in d]
    a, b = len(flat) // 3, len(flat) * 2 // 3
    assert f.ids(a, b).tolist() == flat[a:b]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(2, 5), st.integers(0, 3))
def test_repair_leaves_no_frequent_pair(documents, least, bits):
    """Also where many pairs share a hash cell: rules expand to the ids, and no pair within a document is left often enough."""
    held, tokenfile.TABLE_BITS = tokenfile.TABLE_BITS, bits + 1
    try:
        ids = np.array(sum(documents, []), dtype="<u4")
        last = np.zeros(len(ids), dtype=bool)
        last[np.cumsum([len(d) for d in documents]) - 1] = True
        seq, ends, rules = tokenfile.repair(ids, last, 5, least)
    finally:
        tokenfile.TABLE_BITS = held
    flat, start, length = tokenfile.expansions(5, rules)
    assert np.concatenate([flat[start[s]:start[s] + length[s]] for s in seq]).tolist() == ids.tolist()
    assert ends.sum() == len(documents) and len(rules) == len({tuple(r) for r in rules.tolist()})
    left = Counter()
    for d in np.split(seq, np.flatnonzero(ends) + 1):
        before, skip = None, False
        for pair in zip(d.tolist(), d.tolist()[1:]):
            skip = pair == before and pair[0] == pair[1] and not skip  # every other one of a run
            left[pair] += not skip
            before = pair
    assert max(left.values(), default=0) < least


def test_repair_looks_at_changes_only(monkeypatch):
    """Many rounds over phrases of phrases: rounds that replace little look at few places, and still leave no frequent pair."""
    rng = np.random.default_rng(9)
    phrases = [rng.integers(0, 3000, 2) for _ in range(300)]
    for _ in range(1200):
        phrases.append(np.concatenate([phrases[i] for i in rng.integers(max(0, len(phrases) - 900), len(phrases), 2)])[:200])
    docs = [np.concatenate([phrases[i] for i in (1500 * rng.random(60) ** 2).astype(int)]) for _ in range(60)]
    docs += [np.repeat(rng.integers(0, 3000, 4), rng.integers(1, 9, 4)) for _ in range(500)]
    ids = np.concatenate(docs).astype("<u4")
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(list(map(len, docs))) - 1] = True
    looked: list[int] = []
    rounds = tokenfile._open
    monkeypatch.setattr(tokenfile, "_open", lambda *a: looked.append(len(a[2])) or rounds(*a))
    seq, ends, rules = tokenfile.repair(ids, last, 3000)
    assert len(looked) > 3 and sum(looked[1:]) < 2 * len(ids)
    flat, start, length = tokenfile.expansions(3000, rules)
    assert np.concatenate([flat[start[s]:start[s] + length[s]] for s in seq]).tolist() == ids.tolist()
    assert (np.cumsum(length[seq])[ends] - 1).tolist() == np.flatnonzero(last).tolist()
    pairs = np.stack((seq[:-1], seq[1:]))[:, ~ends[:-1]]
    pairs = pairs[:, pairs[0] != pairs[1]]
    assert np.unique(pairs, axis=1, return_counts=True)[1].max() < tokenfile.MIN_PAIRS


def test_repair_of_a_long_passage():
    """A passage of 1,000 ids in 30 documents becomes a few symbols; a file may need wide symbols."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 60_000, 1000)
    docs = [np.concatenate((rng.integers(0, 60_000, 20), passage)).astype("<u4") for _ in range(30)]
    docs += [np.repeat(rng.integers(0, 60_000, 400), 2).astype("<u4")] * 12 + [np.array([60_000 - 1], dtype="<u4")]
    docs += [np.arange(i, 60_000, 7, dtype="<u4") for i in range(7)] * 12
    out = io.BytesIO()
    tokenfile.write_file(out, list(range(len(docs))), [d.tobytes() for d in docs])
    f = tokenfile.TokenFile(out.getvalue())
    assert max(f._length) >= 500 and len(f.symbols) < 5000
    assert all(np.array_equal(f.document(i), d) for i, d in enumerate(docs))


def test_repair_compresses_and_notices_damage():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 500, 20)
    ids = np.concatenate([phrase, rng.integers(0, 500, 5)] * 400).astype("<u4")
    out = io.BytesIO()
    tokenfile.write_file(out, [1], [ids.tobytes()])
    f = tokenfile.TokenFile(out.getvalue())
    assert len(f.symbols) < 0.4 * len(ids) and (f.document(0) == ids).all()
    bad = bytearray(out.getvalue())
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenfile.TokenFile(bytes(bad))


# 5 --------------------------------------------------------------------------------------------------------------------
def water(sizes, share=1.5):
    """Targets by sharing again and again what is over."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return capped
        left, weight = budget - sum(capped.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight >= 2 * sizes[s]]
        if not over:
            return capped | {s: left * weights[s] / weight for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    goal = water(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= len(sizes) + 1


def test_mix(docs, doc_rows):
    rows = mixing.mix(docs).collect()
    check_mix(rows)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r["doc_id"], len(brute.words(r["text"]))) for r in doc_rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_many_buckets(docs, monkeypatch):
    want = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()} == want


def test_mix_edges(edge, none, spark):
    rows = mixing.mix(edge).collect()
    assert len(rows) == EDGE_ROWS
    check_mix(rows)
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    assert Counter(r.text for r in out.collect()) <= Counter({r.text: 2 for r in edge.collect()} | {"a b c d e f g h": 4})
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []
    blank = edge.where("doc_id in (2, 3, 4)")
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}
    assert mixing.mixed_documents(blank).collect() == []


def test_mixed_documents_are_whole(docs, doc_rows):
    """Each as often as it was taken, to the nearest whole; the sources' words stay near their targets."""
    rows, texts = mixing.mix(docs).collect(), {r["doc_id"]: r["text"] or "" for r in doc_rows}
    got = mixing.mixed_documents(docs).collect()
    assert all(r.text == texts[r.doc_id] for r in got)
    times = Counter(r.doc_id for r in got)
    assert times == Counter({r.doc_id: math.floor(r.taken / r.size + 0.5) for r in rows if r.size and 2 * r.taken >= r.size})
    words, target = Counter(), {r.source: r.target for r in rows}
    for r in got:
        words[r.source] += len(brute.words(r.text))
    longest = max(r.size for r in rows)
    assert all(abs(words[s] - t) <= longest for s, t in target.items())


# 6 --------------------------------------------------------------------------------------------------------------------
def test_lookup_table_is_even_and_stable():
    names = [f"n{i}" for i in range(10)]
    full = sharding.lookup_table(names, 1009)
    held = Counter(full)
    assert max(held.values()) - min(held.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.15 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement(edge, none, spark, tmp_path):
    names = ["a", "b", "c"]
    rows = sharding.placed(edge, "doc_id", names, 101).collect()
    table = sharding.lookup_table(names, 101)
    assert len(rows) == EDGE_ROWS
    for r in rows:
        assert r.slot == sharding.digest60("" if r.doc_id is None else str(r.doc_id)) % 101 and r.shard == names[table[r.slot]]
    assert sharding.placed(none, "doc_id", names).collect() == []
    sharding.write_shards(edge.select("doc_id", "text"), "doc_id", names, str(tmp_path / "s"), 101)
    assert spark.read.parquet(str(tmp_path / "s")).count() == EDGE_ROWS


# 8 --------------------------------------------------------------------------------------------------------------------
def personal_texts():
    rng = random.Random(9)
    out = ["".join(rng.choice("aZ0911..@@%+-- 2(é\U0001d4b3") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += ["".join(rng.choice("01234567890 -.+") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for _ in range(200):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 18)))
        d += next(c for c in "0123456789" if brute.luhn(d + c))
        out.append(rng.choice(["x ", "1", "- ", "é"]) + "".join(c + rng.choice(["", "", "-", " "]) for c in d)
                   + rng.choice(["", "x", ".5", "--1"]))
    return out + ["a@b.c-d_x@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300", "+1 (234) 567-8901", "a" * 200_000, "1." * 50_000, "+" + "(" * 50_000]


def check_base(rows, texts):
    for r in rows:
        spans = brute.base_spans(texts[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k, _ in brute.PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans


def test_personal_data_matches_the_plain_patterns(spark):
    texts = personal_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sanitise.report(sanitise.find(df)).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_terms_that_disclose_an_entity(spark):
    """`Zorblatt` occurs only beside one address, in different passages; `the` occurs everywhere."""
    texts = ["we met Zorblatt the agent at z@corp.example yesterday", "mail Zorblatt or the office via z@corp.example now",
             "the weather is fine"] + [f"the report number {i} was sent by the clerk to c{i}@mail.example" for i in range(30)]
    texts += ["the copy said hello to k@mail.example" for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in sanitise.report(sanitise.find(df)).collect()}
    for i in (0, 1):
        at = texts[i].index("Zorblatt")
        assert f"term:{at}:{at + 8}" in found[i] and found[i].count("term") == 1
    assert all("term" not in s for i, s in found.items() if i > 1)  # copies are one piece of evidence
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df).collect()}
    assert clean[0] == "we met [REMOVED] the agent at [EMAIL] yesterday" and clean[2] == texts[2]


def test_disclosing_terms_are_found_wherever_they_stand(spark):
    """Two-letter `Qx` is far from the address it goes with, stands twice, and once in a document without it."""
    far = [" ".join(f"{'abcdefgh'[i]}{'word'}{k % 7}" for k in range(60)) for i in range(3)]
    texts = [f"{far[0]} Qx went. {far[1]} mail z@corp.example or Zorblatt. {far[0]}", f"{far[1]} saw qx. {far[2]} to z@corp.example, {far[1]} QX",
             f"{far[2]} write to z@corp.example and Zorblatt. {far[0]} then Zorblatt {far[1]} on"]
    texts += [f"only Qx {far[0]}"] + [f"{far[i % 3]} number {i} to c{i}@mail.example" for i in range(60)]
    texts += [f"{far[0]} Unseen {far[1]} k@mail.example" for _ in range(5)]
    texts += [f"{far[2]} Solo {far[0]} s@mail.example"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term")] for r in sanitise.report(sanitise.find(df)).collect()}
    want = {i: [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)\b(qx|zorblatt)\b", t)] for i, t in enumerate(texts)}
    assert found == want and [len(want[i]) for i in range(5)] == [2, 2, 2, 1, 0]
    clean = {r.doc_id: r.text for r in sanitise.sanitised(df).collect()}
    assert clean[2].count("[REMOVED]") == 2 and clean[4] == f"{far[0]} number 0 to [EMAIL]"
    assert "Unseen" in clean[64] and "Solo" in clean[69]


def plainly(text, spans):
    """``text`` with (start, stop, label) replaced, overlapping ones as one."""
    out, at = [], 0
    for start, stop, label in sorted(spans):
        if start >= at:
            out += [text[at:start], label]
        at = max(at, stop)
    return "".join(out + [text[at:]])


def test_spans_are_replaced_anywhere(spark):
    """Spans at the edges of parts and of blocks of spans, overlapping ones, none, and characters of any width."""
    rng = random.Random(8)
    rows = []
    for n, k in [(0, 0), (5, 1), (sanitise.PART, 3), (4 * sanitise.PART + 7, 40), (9000, 700), (300, 0)]:
        text = "".join(rng.choice("ab\n é\U0001d4b3") for _ in range(n))
        starts = sorted({0, n - 1, sanitise.PART - 1, sanitise.PART, *rng.sample(range(n), min(n, k))} & set(range(n))) if k else []
        rows.append((text, [(s, min(n, s + rng.choice([1, 2, 9, 1500 if rng.random() < .02 else 3])), f"[{s}]") for s in starts]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:bigint,stop:bigint,label:string>>")
    got = sanitise._with_replaced(df, "out", "text", "spans", "s.label").collect()
    assert [r.out for r in got] == [plainly(*r) for r in rows]


def test_many_spans_in_one_text(spark):
    """Time grows with the text: lists of 2,000 and 16,000 addresses and names, and a long text with few."""
    import time

    def contacts(n):
        return " ".join(f"write to Person{i} at p{i}@mail{i % 97}.example or é," for i in range(n))
    took = []
    for n in (2_000, 2_000, 16_000):
        texts = [contacts(n), f"once more Person7 and p7@mail7.example, then {n}"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        begin = time.perf_counter()
        rows = {r.doc_id: r for r in sanitise.sanitised(df).collect()}
        took.append(time.perf_counter() - begin)
        assert rows[0].text.count("[EMAIL]") == n and rows[1].text.count("[EMAIL]") == 1
        assert not brute.base_spans(rows[0].text[:20_000]) and rows[0].text.endswith("or é,")
    assert took[2] < 8 * 2.5 * took[1] + 10


def test_sanitise_edges(edge, none):
    rows = sanitise.report(sanitise.find(edge)).collect()
    assert len(rows) == EDGE_ROWS and {r.spans for r in rows} == {""}
    out = sanitise.sanitised(edge)
    assert out.columns == edge.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == Counter((r.doc_id, r.text, r.n_chars) for r in edge.collect())
    assert sanitise.report(sanitise.find(none)).collect() == [] and sanitise.sanitised(none).collect() == []


# 9 --------------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "#x", "été"]), max_size=60), min_size=1, max_size=5))
def test_repeated_windows_by_definition(lists):
    texts = [" ".join(w) for w in lists]
    m = quality.measure([t.encode() for t in texts])
    assert m["n_repeat_words"].tolist() == [brute.repeat_words(brute.words(t)) for t in texts]
    assert m["word_chars"].tolist() == [sum(len(x) for x in w) for w in lists]
    assert m["n_symbols"].tolist() == [t.count("#") for t in texts]


def test_quality_edges(edge, none):
    rows = {(r.doc_id, r.n_words): r for r in quality.ledger(edge).collect()}
    assert quality.ledger(edge).count() == EDGE_ROWS
    line = rows[7, 6]
    assert (line.n_dup_lines, line.n_lines, line.word_chars) == (2, 4, 20)
    assert rows[6, 40_000].failure_bits == 0 and rows[2, 0].failure_bits & 1
    data = "data:" + "x" * 5000
    chinese = "中文的句子没有空格" * 120 + "。"
    plain = " ".join(f"word{i}" for i in range(400))
    planted = [(1, plain + " " + data), (2, (chinese + " ") * 25), (3, "ภาษาไทยไม่เว้นวรรค" * 100 + " " + "คำ " * 30), (4, data + " " + " ".join("abcdefghijklmnopqrstuvwxyz")),
               (5, " ".join(f"{'long' * 9}{i}" for i in range(40)))]
    found = {r.doc_id: r.failure_bits for r in quality.ledger(edge.sparkSession.createDataFrame(planted, "doc_id long, text string")).collect()}
    bit = {name: 1 << i for i, (name, _) in enumerate(quality.RULES)}
    assert not found[1] and found[4] == bit["giant_words"] and found[5] == bit["long_words"]
    assert not (found[2] | found[3]) & (bit["giant_words"] | bit["long_words"])
    kept = quality.keep_passing(edge)
    assert kept.columns == edge.columns and [r.doc_id for r in kept.collect()] == [6]
    assert quality.ledger(none).collect() == [] and quality.keep_passing(none).collect() == []


def test_policies_and_ablations(docs):
    book = quality.ledger(docs).cache()
    total = book.count()
    masks = {p: quality.mask_of(r) for p, r in quality.POLICIES.items()}
    rows = [(r.doc_id, r.failure_bits) for r in book.collect()]
    for policy, mask in masks.items():
        assert book.where(quality.kept_under(policy)).count() == sum(not b & mask for _, b in rows)
    table = {r.rule: (r.failed, r.only_this) for r in quality.stored(docs)[1].collect()}
    judged = {r.doc_id: r for r in quality.verdicts(quality.stored(docs)[0]).collect()}
    assert all(judged[d][f"kept_{p}"] == (not b & mask) for d, b in rows for p, mask in masks.items())
    for i, (rule, _) in enumerate(quality.RULES):
        want = (sum(b >> i & 1 for _, b in rows), sum(b == 1 << i for _, b in rows))
        assert table.get(rule, (0, 0)) == want
    assert {r.doc_id for r in quality.keep_passing(docs).collect()} == {d for d, b in rows if not b & masks["v2"]} and total


# 10 -------------------------------------------------------------------------------------------------------------------
PAGES = [(1, "http://a/?q=é \r\nX: y", "same payload " * 20), (2, None, "same payload " * 20), (3, "u", None), (4, "u", None),
         (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100),
         (1, "again", "same payload " * 20), (9, "u", "\U0001f600" * 25), (None, None, "z" * 500), (None, None, "z" * 500),
         (10, "u", "long " * 200_000)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "path": F.lit("x")})
    manifest = warc.write_archives(df.repartition(3), str(tmp_path / "w"), archive_bytes=4000).cache()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, len(r.payload))
                  for r in warc.read_archives(manifest, payload=True).collect())
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = least.get(h or "")
        again = len(data) >= 100 and first is not None and i != first
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None,
             0 if again else len(data)] += 1
    assert got == want
    assert warc.round_trip(df.where("false")).collect() == []


def test_archive_reader_checks_what_it_reads():
    import zstandard
    records = [warc.record_bytes(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in range(50)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    data = out.getvalue()
    assert list(warc.read_archive(io.BytesIO(data))) == records
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])
    smaller = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size:]
    assert list(warc.read_archive(io.BytesIO(smaller))) == records  # the dictionary itself compressed
    for bad in (data[8 + size:], data[:20], data[:-5]):
        with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    good = records[0]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 9", b"Content-Length: 8"),
                good.replace(b"payload 0", b"payload 9"), good.replace(b"WARC-Type: response", b"WARC-Type: resource"),
                good.replace(b"X-Page-ID: 0", b"X-Page-ID: x"), good.replace(b"WARC-Target-URI: u\r\n", b"")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)
