"""Transitive deletions against a plain walk of the rows."""

import random

import pytest

from tessera.operators import cascade as cas

FK = cas.ForeignKey


def plain(tables, fks, targets, root):
    """(accepted, refused, {table: rows left}) with rows as dicts, one target at a time against the state before."""
    def reach(start):
        gone = {name: set() for name in tables}
        todo = [(root, i) for i, r in enumerate(tables[root][0]) if r[tables[root][1]] in start]
        while todo:
            name, i = todo.pop()
            if i in gone[name]:
                continue
            gone[name].add(i)
            key = tables[name][1]
            if key is None or tables[name][0][i][key] is None:
                continue
            todo += [(fk.child, j) for fk in fks if fk.parent == name and fk.action == "c"
                     for j, r in enumerate(tables[fk.child][0]) if r[fk.column] == tables[name][0][i][key]]
        return gone

    def stopped(gone, together):
        for fk in fks:
            if fk.action in "ra":
                rows, (parents, key) = tables[fk.child], tables[fk.parent]
                keys = {parents[i][key] for i in gone[fk.parent]}
                for i, r in enumerate(rows[0]):
                    own = fk.child == fk.parent and r[rows[1]] == r[fk.column]
                    if r[fk.column] is not None and r[fk.column] in keys and not own and not (
                            fk.action == "a" and i in together[fk.child]):
                        return True
        return False
    accepted, refused = {t for t in targets if t is not None}, set()
    while True:
        gone = reach(accepted)
        new = {t for t in accepted if stopped(reach({t}), gone)}
        if not new:
            break
        accepted, refused = accepted - new, refused | new
    left = {}
    for name, (rows, _) in tables.items():
        left[name] = []
        for i, r in enumerate(rows):
            if i in gone[name]:
                continue
            r = dict(r)
            for fk in fks:
                keys = {tables[fk.parent][0][j][tables[fk.parent][1]] for j in gone[fk.parent]}
                if fk.child == name and fk.action in "nd" and r[fk.column] is not None and r[fk.column] in keys:
                    r[fk.column] = fk.default
            left[name].append(r)
    return accepted, refused, left


def check(spark, tables, schemas, fks, targets, root):
    frames = {n: (spark.createDataFrame([tuple(r.values()) for r in rows], schemas[n]), key) for n, (rows, key) in tables.items()}
    done = cas.cascade_delete(frames, fks, spark.createDataFrame([(t,) for t in targets], "target_id long"), root)
    accepted, refused, left = plain(tables, fks, targets, root)
    assert {r.key for r in done.accepted.collect()} == accepted and {r.key for r in done.refused.collect()} == refused
    for name, (df, _) in frames.items():
        got = done.tables.get(name, df)
        assert got.columns == df.columns
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r.values()) for r in left[name]))), name
    return done


SCHEMAS = {"users": "id long, boss long", "teams": "team long, owner long", "members": "team long, user long, note string",
           "logs": "user long", "holds": "team long"}
GRAPH = [FK("users", "boss", "users", "c"), FK("teams", "owner", "users", "c"), FK("members", "team", "teams", "c"),
         FK("members", "user", "users", "n"), FK("logs", "user", "users", "d", 0), FK("holds", "team", "teams", "r")]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Self-references, cycles, chains, restricting keys two levels below, set null and set default."""
    rng = random.Random(seed)

    def ref(n):
        return rng.choice([None, *range(1, n + 1)])
    tables = {"users": ([{"id": i, "boss": ref(14)} for i in range(1, 15)], "id"),
              "teams": ([{"team": i, "owner": ref(14)} for i in range(1, 11)], "team"),
              "members": ([{"team": ref(10), "user": ref(14), "note": f"n{i}"} for i in range(25)], None),
              "logs": ([{"user": ref(14)} for _ in range(20)], None),
              "holds": ([{"team": rng.choice([None, 2, 5])} for _ in range(2)], None)}
    check(spark, tables, SCHEMAS, GRAPH, [rng.randint(1, 16) for _ in range(4)] + [None], "users")


def test_a_long_chain_and_a_cycle(spark):
    chain = [{"id": i, "boss": i - 1 if i > 1 else None} for i in range(1, 9)]
    ring = [{"id": 20, "boss": 22}, {"id": 21, "boss": 20}, {"id": 22, "boss": 21}, {"id": 30, "boss": 30}]
    tables = {"users": (chain + ring, "id"), "logs": ([{"user": 8}, {"user": 22}, {"user": None}], None)}
    fks = [FK("users", "boss", "users", "c"), FK("logs", "user", "users", "c")]
    check(spark, tables, SCHEMAS, fks, [5, 20, 30], "users")


def test_a_restricting_key_refuses_the_targets_above_only(spark):
    tables = {"users": ([{"id": 1, "boss": None}, {"id": 2, "boss": 1}, {"id": 3, "boss": None}], "id"),
              "teams": ([{"team": 7, "owner": 2}, {"team": 8, "owner": 3}], "team"), "holds": ([{"team": 7}], None)}
    fks = [FK("users", "boss", "users", "c"), FK("teams", "owner", "users", "c"), FK("holds", "team", "teams", "a")]
    done = check(spark, tables, SCHEMAS, fks, [1, 3], "users")
    assert {r.key for r in done.refused.collect()} == {1}
    impact = {(r.tbl, r.column): r.rows for r in done.impact.collect()}
    assert impact == {("users", "boss"): 0, ("teams", "owner"): 1, ("holds", "team"): 0}


def test_no_action_counts_the_rows_that_are_left(spark):
    """Member rows go with their team, so their no-action key on the user holds nothing back; one of another team does."""
    tables = {"users": ([{"id": i, "boss": None} for i in (1, 2, 3)], "id"), "teams": ([{"team": 7, "owner": 1}, {"team": 8, "owner": None}], "team"),
              "members": ([{"team": 7, "user": 1, "note": "a"}, {"team": 8, "user": 2, "note": "b"}, {"team": 7, "user": 3, "note": "c"}], None)}
    fks = [FK("teams", "owner", "users", "c"), FK("members", "team", "teams", "c"), FK("members", "user", "users", "a")]
    done = check(spark, tables, SCHEMAS, fks, [1, 2, 3], "users")
    assert {r.key for r in done.refused.collect()} == {2}
    assert {r.key for r in check(spark, tables, SCHEMAS, fks, [3], "users").refused.collect()} == {3}
    fks[2] = FK("members", "user", "users", "r")
    assert {r.key for r in check(spark, tables, SCHEMAS, fks, [1, 2, 3], "users").refused.collect()} == {1, 2, 3}


def test_nothing_to_delete(spark):
    tables = {"users": ([{"id": 1, "boss": None}], "id"), "logs": ([{"user": 1}], None)}
    check(spark, tables, SCHEMAS, [FK("logs", "user", "users", "r")], [], "users")
    check(spark, tables, SCHEMAS, [FK("logs", "user", "users", "r")], [None, 9], "users")


def test_graphs_that_make_no_sense_are_refused(spark):
    users = (spark.createDataFrame([], "id long, boss long"), "id")
    logs = (spark.createDataFrame([], "user long"), None)
    for fks in ([FK("logs", "user", "users", "x")], [FK("logs", "user", "users", "d")], [FK("logs", "user", "nobody", "c")],
                [FK("users", "boss", "logs", "c")], [FK("users", "id", "users", "n")]):
        with pytest.raises(ValueError):
            cas.CascadeGraph({"users": users, "logs": logs}, fks)
