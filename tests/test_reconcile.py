"""Invertible Bloom lookup tables against EXCEPT ALL both ways."""

import random
from collections import Counter

import pytest

from tessera.operators import reconcile as rec

SCHEMA = "k long, v string, x double, d date"


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, rng.randrange(50)]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0.5, 1.0]), None) for _ in range(n)]


def check(spark, a, b, **sizes):
    got = rec.reconcile(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), **sizes).collect()
    lost, added = Counter(a) - Counter(b), Counter(b) - Counter(a)
    assert Counter({(r.side, tuple(r)[:4]): r.n for r in got}) == Counter(
        {("lost", k): n for k, n in lost.items()} | {("added", k): n for k, n in added.items()})
    return lost, added


@pytest.mark.parametrize("buckets, cells", [(64, 16), (2, 4), (1, 48)])
def test_reconciled_equals_except_all(spark, buckets, cells):
    """Repeated rows in differing numbers, nulls that change places; with few cells, buckets fall back to their rows."""
    base = rows(3, 1500)
    a = base + [(1, None, None, None), (None, "1", None, None)] * 3 + [(7, "twice", 0.0, None)] * 4
    b = base[20:] + [(1, None, None, None)] * 2 + [(None, "1", None, None)] * 5 + [(7, "twice", 0.0, None)] + rows(4, 25)
    lost, added = check(spark, a, b, buckets=buckets, cells=cells)
    assert len(lost) > 5 and len(added) > 5


def test_equal_and_empty_copies(spark):
    base = rows(5, 300)
    check(spark, base, list(reversed(base)))
    check(spark, [], [])
    check(spark, base, [], buckets=4, cells=8)
    check(spark, [], base)


def test_only_sums_and_differing_rows_are_kept(spark):
    """The sums that are left tell the differing rows, and only those."""
    a = [(i, f"row {i}", None, None) for i in range(5000)]
    b = [r for r in a if r[0] not in (17, 4000)] + [(17, "new", None, None)]
    one, two = (rec.sketch(spark.createDataFrame(x, SCHEMA), s, 16, 48) for x, s in ((a, 1), (b, -1)))
    from pyspark.sql import functions as F
    left = one.unionByName(two).groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in rec._SUMS]).where(
        " or ".join(f"{c} <> 0" for c in rec._SUMS)).collect()
    assert 0 < len(left) <= 9
    by = {}
    for r in left:
        by.setdefault(r.bucket, {})[r.cell] = [r[c] for c in rec._SUMS]
    found = [rec.decode(cells, bucket, 16, 48) for bucket, cells in by.items()]
    assert all(whole for _, whole in found) and Counter(n for f, _ in found for *_, n in f) == {1: 2, -1: 1}
