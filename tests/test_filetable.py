"""File-level changes, exclusive commits and conflicts of concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import filechanges as fc
from tessera.sources import filetable as ft
from tessera.sources import publish as pub


def table(spark, root, rows=4000, files=40):
    df = spark.range(rows).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("active").alias("status"))
    ft.create(df, root, "k", files)
    return df


def values(spark, root):
    return {r.k: (r.v, r.status) for r in ft.read(spark, root).collect()}


def paths(spark, root):
    return {r.path for r in ft.current(spark, root).files(spark).collect()}


def test_a_small_change_rewrites_few_files(spark, tmp_path):
    """1 % of the keys, one run of them: a like share of the files; the others are the same files."""
    root = str(tmp_path / "t")
    table(spark, root)
    want, before = values(spark, root), paths(spark, root)
    assert len(before) >= 35
    new = spark.range(1000, 1040).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    done = fc.upsert(spark, root, new, ["v"], {"status": "new"})
    assert done.rewritten <= 2 and done.kept == len(before) - done.rewritten and done.version == 2
    assert len(before & paths(spark, root)) == done.kept
    want |= {k: (-1, "active") for k in range(1000, 1040)}
    assert values(spark, root) == want
    assert {r.k: r.v for r in ft.read(spark, root, ft.at_version(spark, root, 1)).collect()} == {k: 2 * k for k in range(4000)}
    # marks, removals, a key of a type that has to be cast, keys that aren't there, and inserts beyond all files
    done = fc.mark(spark, root, spark.createDataFrame([("17",), (None,), ("99999",)], "k string"), "excluded")
    assert done.rewritten == 1
    want[17] = (34, "excluded")
    assert fc.delete(spark, root, spark.createDataFrame([(17,), (3999,)], "k long")).rewritten == 2
    del want[17], want[3999]
    done = fc.upsert(spark, root, spark.createDataFrame([(70_000, 5, "new")], "k long, v long, status string"), ["v"])
    assert done.rewritten == 0 and done.added == 1
    want[70_000] = (5, "new")
    assert values(spark, root) == want
    assert fc.delete(spark, root, spark.createDataFrame([], "k long")).version == ft.current(spark, root).number
    # every file's listing tells its rows
    listed = ft.current(spark, root).files(spark).collect()
    assert sum(r.rows for r in listed) == len(want) and all(r.low <= r.high for r in listed)


def test_null_and_repeated_keys_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    ft.create(spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4)], "k long, v long"), root, "k", 2)
    fc.delete(spark, root, spark.createDataFrame([(5,), (None,)], "k long"))
    assert sorted((r.k, r.v) for r in ft.read(spark, root).collect()) == [(None, 1), (None, 2)]
    empty = str(tmp_path / "e")
    ft.create(spark.createDataFrame([], "a string, b string, v long"), empty, ("a", "b"))
    assert ft.read(spark, empty).count() == 0
    fc.upsert(spark, empty, spark.createDataFrame([("x", None, 1), ("x", "y", 2)], "a string, b string, v long"), ["v"])
    fc.upsert(spark, empty, spark.createDataFrame([("x", "y", 7)], "a string, b string, v long"), ["v"])
    assert sorted((r.a, r.b or "", r.v) for r in ft.read(spark, empty).collect()) == [("x", "", 1), ("x", "y", 7)]
    with pytest.raises(pub.StaleVersion):
        ft.create(spark.range(1).toDF("k"), root, "k")


def test_writers_of_one_version(spark, tmp_path):
    """Other files: joined. Same file, other keys: computed anew. The same key: refused."""
    root = str(tmp_path / "t")
    table(spark, root, 400, 8)
    base = ft.current(spark, root)

    def put(keys, v):
        return fc.upsert(spark, root, spark.createDataFrame([(k, v) for k in keys], "k long, v long"), ["v"], {"status": "new"}, base=base)
    put([10], -1)
    assert put([390], -2).version == 3
    assert put([11], -3).version == 4
    with pytest.raises(ft.KeyConflict):
        put([390, 200], -4)
    with pytest.raises(ft.KeyConflict):
        put([10], -5)
    put([1000], -6)
    with pytest.raises(ft.KeyConflict):
        put([1000], -7)  # both insert it
    got = values(spark, root)
    assert (got[10][0], got[11][0], got[390][0], got[200][0], got[1000][0]) == (-1, -3, -2, 400, -6) and len(got) == 401


def test_writers_at_the_same_time(spark, tmp_path):
    root = str(tmp_path / "t")
    table(spark, root, 200, 4)
    base, failed = ft.current(spark, root), []

    def write(i):
        try:
            fc.upsert(spark, root, spark.createDataFrame([(50 * i + 3, -i), (7, -i)] if i else [(20, 0)], "k long, v long"), ["v"], base=base)
        except ft.KeyConflict:
            failed.append(i)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = values(spark, root)
    won = {1, 2, 3} - set(failed)
    assert len(failed) == 2 and 0 not in failed  # of those that set key 7, one
    i, = won
    assert (got[7][0], got[50 * i + 3][0], got[20][0]) == (-i, -i, 0)
    assert all(got[50 * j + 3][0] == 2 * (50 * j + 3) for j in failed)
    assert ft.current(spark, root).number == 3


def test_a_manifest_is_claimed_once(spark, tmp_path):
    folder = str(tmp_path / "m")
    won = []

    def run(i):
        if pub.commit_manifest(spark, folder, {"version": 1, "by": i}):
            won.append(i)
    threads = [threading.Thread(target=run, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and pub.newest_manifest(spark, folder) == {"version": 1, "by": won[0]}
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")] == ["v=1.json"]


def test_publishers_of_one_version(spark, tmp_path):
    """Both pass the first look; one commits, the other is refused and leaves nothing; the tables are of one writer."""
    root = str(tmp_path / "p")
    pub.publish({"a": spark.range(1), "b": spark.range(1)}, root)
    both, result = threading.Barrier(2), {}
    seen = pub.commit_manifest

    def slow(*args):
        both.wait(60)
        return seen(*args)

    def run(i):
        try:
            pub.publish({"a": spark.range(10 * i), "b": spark.range(100 * i)}, root, base_version=1)
            result[i] = "done"
        except pub.StaleVersion:
            result[i] = "stale"
    pub.commit_manifest = slow
    try:
        threads = [threading.Thread(target=run, args=(i,)) for i in (1, 2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        pub.commit_manifest = seen
    assert sorted(result.values()) == ["done", "stale"]
    i = next(i for i, r in result.items() if r == "done")
    assert pub.read_published(spark, root, "a").count() == 10 * i and pub.read_published(spark, root, "b").count() == 100 * i
    assert pub.current_version(spark, root) == 2 and len(list((tmp_path / "p" / "a").glob("v=*"))) == 2
    pub.publish({"b": spark.range(3)}, root)  # without a base: on top of whatever is there
    assert pub.read_published(spark, root, "a").count() == 10 * i and pub.read_published(spark, root, "b").count() == 3
