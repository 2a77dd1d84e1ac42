"""Hash trees and bitmaps of unscored pairs against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import hashtree as ht
from tessera.operators import matching as mt

COLS = ["k", "v"]


def differing(a, b):
    """{key: (state, rows only in a, rows only in b)} of two lists of rows."""
    out = {}
    one, two = Counter(a), Counter(b)
    for row in one.keys() | two.keys():
        k = "~NULL~" if row[0] is None else str(row[0])
        lost, added = max(one[row] - two[row], 0), max(two[row] - one[row], 0)
        if lost + added:
            x, y = out.get(k, (0, 0))
            out[k] = (x + lost, y + added)
    return {k: ("lost" if not y else "added" if not x else "changed", x, y) for k, (x, y) in out.items()}


@pytest.mark.parametrize("digits", [1, 3])
def test_differing_keys(spark, digits):
    rng = random.Random(digits)
    rows = [(i, rng.choice([None, "a", "b"])) for i in range(300)] + [(None, "x")] * 3 + [(7, "same")] * 5
    copy = [r for i, r in enumerate(rows) if i % 50 != 3]
    copy = [(k, "edited") if k in (11, 170) else (k, v) for k, v in copy] + [(900, None), (7, "same"), (None, "x")]
    a, b = (spark.createDataFrame(x, "k long, v string") for x in (rows, copy))
    got = {r.key: (r.state, r.rows_a, r.rows_b) for r in ht.compare(a, b, COLS, "k", digits=digits).collect()}
    assert got == differing(rows, copy) and {s for s, *_ in got.values()} == {"lost", "added", "changed"}


def test_only_differing_branches_are_read(spark, tmp_path):
    a = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 777, "other").otherwise(F.col("v")))
    paths = [str(tmp_path / x) for x in "ab"]
    for df, path in zip((a, b), paths):
        ht.build(df, path, COLS, "k", digits=3, ranges=32)
    assert ht.root(spark, paths[0])[0] == ht.root(spark, paths[1])[0] == 20_000
    assert ht.root(spark, paths[0])[1] != ht.root(spark, paths[1])[1]
    leaves = ht.differing_leaves(spark, *paths)
    assert leaves.count() == 2  # the old row's and the new row's
    for path in paths:
        assert spark.read.parquet(f"{path}/files").count() >= 24 and len(ht.files_of(spark, path, leaves)) <= 3
    assert [tuple(r) for r in ht.differing_keys(spark, *paths).collect()] == [("777", "changed", 1, 1)]
    # the same rows in another order and partitioning have the same tree
    ht.build(a.repartition(5, "v").orderBy(F.desc("v")), str(tmp_path / "c"), COLS, "k", digits=3, ranges=4)
    assert ht.root(spark, str(tmp_path / "c")) == ht.root(spark, paths[0])
    assert ht.differing_keys(spark, paths[0], str(tmp_path / "c")).count() == 0


def test_trees_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, v string")
    some = spark.createDataFrame([(1, "a"), (1, "a")], "k long, v string")
    for name, df in (("e", empty), ("f", empty), ("s", some)):
        ht.build(df, str(tmp_path / name), COLS, "k", digits=2)
    e, f, s = (str(tmp_path / n) for n in "efs")
    assert ht.root(spark, e) == (0, None) and ht.differing_keys(spark, e, f).count() == 0
    assert [tuple(r) for r in ht.differing_keys(spark, e, s).collect()] == [("1", "added", 0, 2)]
    assert [tuple(r) for r in ht.differing_keys(spark, s, e).collect()] == [("1", "lost", 2, 0)]
    ht.build(some, str(tmp_path / "deep"), COLS, "k", digits=3)
    with pytest.raises(ValueError):
        ht.differing_keys(spark, s, str(tmp_path / "deep"))


def test_unscored_pairs_from_bitmaps(spark, monkeypatch):
    """Over 32,768 postings, so positions fall in two buckets; users with no, some and all verdicts."""
    postings = spark.range(33_000).select((F.col("id") * 3).alias("posting_id"), F.lit("x").alias("position"))
    rng = random.Random(1)
    seen = {(1, 3 * p) for p in rng.sample(range(33_000), 500)} | {(2, 0), (2, 98_997), (2, 98_301), (2, 98_304), (2, 5)} | {(9, 3)}
    rows = [(u, p, 1) for u, p in seen] + [(1, None, 1), (None, 3, 1)]
    matches = spark.createDataFrame(rows * 2, "user_id long, posting_id long, score int").unionByName(
        postings.select(F.lit(4).cast("long").alias("user_id"), "posting_id", F.lit(1).alias("score")))
    users = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (3,)], "user_id long")
    scored, positions = mt.unscored_bitmaps(postings, users, matches)
    assert scored.count() == 2 + 2 + 2
    every = {3 * p for p in range(33_000)}
    want = {u: every - {p for v, p in seen if v == u} for u in (1, 2, 3)} | {4: set()}
    assert {r.user_id: r.unscored for r in mt.unscored_in_bitmaps(scored, positions, users).collect()} == {u: len(p) for u, p in want.items()}
    got = mt.expand_unscored(scored, positions, users)
    assert got.columns == ["posting_id", "user_id"]
    by = {}
    for r in got.collect():
        by.setdefault(r.user_id, []).append(r.posting_id)
    assert {u: sorted(p) for u, p in by.items()} == {u: sorted(p) for u, p in want.items() if p}
    none, where = mt.unscored_bitmaps(postings.limit(0), users, matches)
    assert none.count() == 0 and mt.expand_unscored(none, where, users).count() == 0


def test_unscored_pairs_are_not_shuffled(spark):
    """Without broadcasts, pairs are written out above the last exchange; bits at the edges of octets, words, blocks and buckets."""
    postings = spark.range(40_000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("posting_id"))
    edges = [0, 7, 8, 31, 32, 63, 4095, 4096, 32_767, 32_768, 39_999]
    matches = spark.createDataFrame([(u, f"p{e:06d}") for u in (1, 2) for e in edges[u - 1:]], "user_id long, posting_id string")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mt.expand_unscored(*mt.unscored_bitmaps(postings, users, matches), users)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "Exchange" not in plan[:plan.index("Generate")]
        left = {u: set() for u in (1, 2, 3)}
        for r in got.collect():
            left[r.user_id].add(int(r.posting_id[1:]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert left == {u: set(range(40_000)) - set(edges[u - 1:] if u < 3 else ()) for u in (1, 2, 3)}


def test_unscored_pairs_query_covers_every_user(spark, tmp_path):
    """The registered query and its twin: all postings of every user with a verdict, not of a part of the users."""
    n, users = 70, [*range(1, 24), 33]
    at = {(u, (u * 7 + i * 3) % n) for u in users for i in range(u % 5 + 1)} | {(90, 4)}
    spark.createDataFrame([(u,) for u in users], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(p + n * u, u) for u, p in at], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((p, u) for u in users for p in range(n) if (u, p) not in at)
    got = E.queries()["j12_unscored_pairs"](spark, str(tmp_path))
    assert sorted((r.posting_id, r.user_id) for r in got.collect()) == want
    con = duckdb.connect()
    for t in ("customer", "events", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(E.oracle_sql()["j12_unscored_pairs"]).fetchall()) == want


def test_tasks_that_write_pairs_grow_with_them(spark, monkeypatch):
    """More users, more groups and tasks; a block's words are made once a row, below the explosion, and blocks come in order."""
    postings = spark.range(9_000).select(F.col("id").alias("posting_id"))
    matches = spark.createDataFrame([(u, p) for u in range(50) for p in (u, 4095 + u, 8_999)], "user_id long, posting_id long")
    many = spark.range(400_000).select(F.col("id").alias("user_id"))
    plan = mt.expand_unscored(*mt.unscored_bitmaps(postings, many, matches), many)._jdf.queryExecution().executedPlan().toString()
    tasks = {int(x) for x in re.findall(r"hashpartitioning\(_block#\w+, _group#\w+, (\d+)\)", plan)}
    assert tasks == {3 * 391 // mt.TASK_CELLS}
    assert "conv(" not in plan[:plan.index("Generate")] and plan.index("SortMergeJoin [_block") > plan.index("Generate")
    monkeypatch.setattr(mt, "GROUP_USERS", 2)
    few = many.where("user_id < 50")
    got = mt.expand_unscored(*mt.unscored_bitmaps(postings, few, matches), few).groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("posting_id").alias("d"), F.sum("posting_id").alias("s")).collect()
    left = {u: 9_000 - len({u, 4095 + u, 8_999}) for u in range(50)}
    assert {r.user_id: (r.n, r.d, r.s) for r in got} == {u: (n, n, 8_999 * 4_500 - sum({u, 4095 + u, 8_999})) for u, n in left.items()}
