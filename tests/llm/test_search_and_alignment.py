"""Fingerprints, ranked search and alignment against plain Python."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import alignment, lexical, oneperm

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# 11 -------------------------------------------------------------------------------------------------------------------
def shingles(text, k=5):
    w = [x.lower() for x in text.encode().split()]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_compared(rows, texts, tolerance):
    """``texts``: (doc_id, text) without repeated ids, in any order."""
    order = sorted(((i is None, -(i or 0), t) for i, t in texts))
    ids, texts = [None if n else -i for n, i, _ in order], [t for _, _, t in order]
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(texts)
    scheme = oneperm.OnePermutation()
    for i, t, after in zip(ids, texts, texts[1:] + texts[:1]):
        r, n = got[i], len(t) // 3
        new = t[:len(t) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [p.hex() for p in scheme.packed([t.encode(), new.encode()])]
        assert abs(r.near_edited - jaccard(shingles(t), shingles(new))) < tolerance
        assert abs(r.near_next - jaccard(shingles(t), shingles(after))) < tolerance


def test_compared_documents(docs, doc_rows):
    rows = oneperm.compared(docs.repartition(3)).collect()
    check_compared(rows, [(r["doc_id"], r["text"] or "") for r in doc_rows], 0.12)


def test_compared_edges(edge, none, spark):
    rows = oneperm.compared(edge).collect()
    assert len(rows) == edge.count()
    by_text = {}
    for r in edge.collect():
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    scheme = oneperm.OnePermutation()
    want = Counter((i, len(t), scheme.packed([t.encode()])[0].hex()) for t, ids in by_text.items() for i in ids)
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in rows) == want
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert all(r.fingerprint == r.edited_fingerprint == "" and r.near_edited == 1 for r in rows if not r.n_chars)
    assert oneperm.compared(none).collect() == []
    lone = oneperm.compared(spark.createDataFrame([(3, "one two three four five six seven")], "doc_id long, text string"))
    r, = lone.collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"one two three four fiv" + b"one two thr").hexdigest()
    few = [(4, "a b c"), (9, ""), (5, "a b c"), (7, "x y z u v w")]
    check_compared(oneperm.compared(spark.createDataFrame(few, "doc_id long, text string").repartition(4)).collect(), few, 0.12)


def test_a_hot_id_is_spread(spark):
    """Rows of one id, and equal rows, take part one by one, over several ranges."""
    rows = [(None, f"text number {i % 50} of the id that many rows share") for i in range(400)] + [(1, "a b c d e f")] * 200
    got = oneperm.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert Counter(r.doc_id for r in got) == {None: 400, 1: 200}
    assert Counter(r.fingerprint for r in got) == Counter(
        p.hex() for p in oneperm.OnePermutation().packed([t.encode() for _, t in rows]))
    alike = [r.near_next for r in got if r.doc_id == 1]
    assert sum(x == 1 for x in alike) == 199  # the last one is followed by another id


@pytest.mark.parametrize("bins, bits", [(64, 1), (256, 2), (512, 4), (128, 8)])
def test_likeness_is_unbiased(bins, bits):
    rng = random.Random(bins)
    scheme = oneperm.OnePermutation(bins=bins, bits=bits, shingle=1)
    for common in (0, 300, 900):
        found = []
        for trial in range(60):
            words = [f"w{rng.getrandbits(60)}" for _ in range(common)]
            pair = [" ".join(words + [f"{side}{rng.getrandbits(60)}" for _ in range((1200 - common) // 2)]).encode() for side in "xy"]
            found.append(scheme.likeness(*[[p] for p in scheme.packed(pair)])[0])
        true = common / 1200
        spread = math.sqrt((true + (1 - true) * 2 ** -bits) * (1 - true) / bins / 60) / (1 - 2 ** -bits)
        assert -4 * spread <= np.mean(found) - true <= 4 * spread + (0.6 / math.sqrt(bins) / (1 - 2 ** -bits) if not common else 0)


def test_densification_by_definition():
    """Each empty bin takes the value of the first full one of its own order, however few are full."""
    scheme = oneperm.OnePermutation(bins=64)
    order, place = oneperm._orders(64, scheme.seed)
    texts = [" ".join(f"w{i}" for i in range(n)).encode() for n in (1, 3, 5, 6, 9, 20, 60, 200)]
    values, some = scheme.values(texts)
    assert some.all()
    hashes, count = oneperm.shingle_hashes(texts)
    start = 0
    for row, n in zip(values.tolist(), count.tolist()):
        least = {}
        for h in hashes[start:start + n].tolist():
            least[h >> 58] = min(h, least.get(h >> 58, h))
        start += n
        assert row == [least[b] if b in least else least[next(int(s) for s in order[:, b] if int(s) in least)] for b in range(64)]
    assert scheme.values([b"", b" \n"])[1].tolist() == [False, False]


def test_fingerprint_scheme_refuses_odd_sizes():
    for bad in ({"bins": 100}, {"bits": 3}, {"bins": 1, "bits": 4}):
        with pytest.raises(ValueError):
            oneperm.OnePermutation(**bad)


def test_fingerprints_alone(edge):
    scheme = oneperm.OnePermutation()
    got = Counter((r.doc_id, bytes(r.fingerprint)) for r in oneperm.fingerprinted(edge).collect())
    assert got == Counter((r.doc_id, scheme.packed([(r.text or "").encode()])[0]) for r in edge.collect())


# 12 -------------------------------------------------------------------------------------------------------------------
def search(texts, items, k):
    import re
    cut = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def of(text):
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in cut.findall(text or "")]
    docs = [(i, len(of(t)), Counter(of(t))) for i, t in texts]
    n_docs, total = sum(n > 0 for _, n, _ in docs), sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in docs:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total))) for t in set(of(text)) if t in c)
            if score:
                found.append((-score, i is None, i or 0))
        out.extend((item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k]))
    return Counter(out)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranked_search(spark, docs, doc_rows, k):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = lexical.ranked(docs, items, k).collect()
    assert Counter(map(tuple, got)) == search([(r["doc_id"], r["text"]) for r in doc_rows], [(r.item_id, r.text) for r in items.collect()], k)


def test_ranked_search_edges(spark, edge, none):
    rows = [(1, "a B another ÉTÉ été"), (1, "a B another ÉTÉ été"), (None, "id"), (3, None), (4, "!!"), (5, "line café 中"), (6, "nowhere")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "rank", "score", "n", "item")})
    got = lexical.ranked(edge, items, 3).collect()
    assert Counter(map(tuple, got)) == search([(r.doc_id, r.text) for r in edge.collect()], rows, 3)
    assert lexical.ranked(none, items).collect() == []
    assert lexical.ranked(edge, items.limit(0)).collect() == []


def test_ranked_search_in_blocks_and_runs(spark, docs, doc_rows, monkeypatch):
    """Many ties, more items than a block holds, more postings than a run."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)
    monkeypatch.setattr(lexical, "RUN_POSTINGS", 40)
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 6)))) for i in range(150)]
    items = [(i, " ".join(rng.sample("abcdefghijklmno", rng.randint(1, 9)) + [f"own{i}"])) for i in range(6)]
    got = lexical.ranked(spark.createDataFrame(texts, "doc_id long, text string").repartition(2),
                         spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert Counter(map(tuple, got)) == search(texts, items, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=4, max_size=4), min_size=1, max_size=25), st.integers(1, 5), st.data())
def test_best_positions_find_the_best(matrix, k, data):
    """Lists with many equal impacts: never stop while an unread document could still equal the k-th."""
    tf = np.array(matrix) * np.array(data.draw(st.lists(st.lists(st.booleans(), min_size=4, max_size=4), min_size=len(matrix), max_size=len(matrix))))
    doc, term = np.nonzero(tf)
    ids = np.array(data.draw(st.permutations(range(len(tf)))))
    weights = np.array([3, 0, 1, 2])
    lists = lexical.ImpactLists(ids, np.zeros(len(ids), bool), np.concatenate(([0], np.cumsum((tf > 0).sum(axis=1)))), term, tf[doc, term], weights)
    for query in ([0, 1, 2, 3], [2], [1], [0, 3]):
        best = lexical.Best(k)
        lists.search(np.array(query), best)
        score = (tf[:, query] * weights[query]).sum(axis=1)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s)[:k]
        assert list(zip((-best.score).tolist(), best.doc.tolist())) == want


def test_reading_stops_early():
    """Lists that agree on the best documents are read only near their tops."""
    n = 20_000
    impact = np.repeat(np.arange(n, 0, -1), 3)
    lists = lexical.ImpactLists(np.arange(n), np.zeros(n, bool), np.arange(n + 1) * 3, np.tile([0, 1, 2], n), impact, np.array([1, 1, 1]))
    best = lexical.Best(10)
    lists.search(np.array([0, 1, 2]), best)
    assert best.doc.tolist() == list(range(10)) and lists.accesses <= 3 * 2 * lexical.STEP


# 13 -------------------------------------------------------------------------------------------------------------------
def align(texts):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] by the plain rules."""
    pair = alignment.Pair(A, B)
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    per, count = [], Counter()
    for i, text in texts:
        text = text or ""
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        sides = [[pair.a_bytes[x] for x in a], [pair.b_bytes[x] for x in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            per.append((i, 0, 0, [], Counter()))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [bisect.bisect(e, cut) for e in ends]
            groups.append((a[at[0]:to[0]], b[at[1]:to[1]]))
            at = to
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        per.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return Counter((i, na, nb, len(groups), sum(links.values()), sum(v for p, v in links.items() if count[p] == best[p[0]]),
                    sum(v * count[p] for p, v in links.items()),
                    hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()
                    if groups else "") for i, na, nb, groups, links in per)


def test_alignment(docs, doc_rows):
    got = alignment.aligned(docs.repartition(3), A, B).collect()
    assert Counter(map(tuple, got)) == align([(r["doc_id"], r["text"]) for r in doc_rows])


def test_alignment_edges(edge, none, spark):
    got = alignment.aligned(edge, A, B).collect()
    assert Counter(map(tuple, got)) == align([(r.doc_id, r.text) for r in edge.collect()])
    assert alignment.aligned(none, A, B).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.aligned(empty, A, B).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}


def test_alignment_of_awkward_texts(spark, monkeypatch):
    """Marks of the vocabularies themselves, byte pieces, long groups, several chunks and blocks."""
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 60)
    monkeypatch.setattr(alignment, "EXPAND", 50)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 4)
    rng = random.Random(6)
    texts = ["<|endoftext|>", "<s> </s> <unk>", "<0x41>", "a▁b", "  two  blanks ", "tab\tnew\nline\r\n", "中文字 é \U0001f600\U0001f601", "\x00\x01",
             "0123456789" * 30, "aaaa" * 100, "".join(rng.choices("abcxyz0189-_", k=600)), "the the the the", "the cat the cat"]
    rows = list(enumerate(texts * 2))
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), A, B).collect()
    want = align(rows)
    assert Counter(map(tuple, got)) == want
    assert sum(r[1] > 0 for r in want) >= 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_pointer_jumping_labels_components(a, b):
    short = min(sum(a), sum(b))
    a, b = [np.unique(np.minimum(np.cumsum(x), short)) for x in (a, b)]
    root = alignment.terminals(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    group = np.searchsorted(common, np.concatenate((a, b)))
    assert [int(np.searchsorted(common, b[r - len(a)])) for r in root] == group.tolist()
    assert set((root - len(a)).tolist()) == {b.tolist().index(c) for c in common}
