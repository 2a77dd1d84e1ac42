"""Deletions that follow the foreign-key graph to its end.

A key's rows are found level by level: the rows a deletion reaches are kept as key values per table, and each
round joins only the values new in the round before with the children that reference them, so
self-references and cycles end by themselves. Tables that nothing references need no round: their rows follow from
the reached parents at the end. A restricting key anywhere below refuses the targets above it: refusals
climb the same edges, and what is deleted is reached again from the remaining targets alone. Rounds are as
many as the graph of rows is deep; what they reached is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import checkpoint_dir
from tessera.sources.publish import scratch_path

EFFECTS = {"c": "deleted", "n": "nulled", "d": "reassigned", "r": "blocks", "a": "blocks"}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` references the key of ``parent``; ``action`` is c, n, d, r or a, ``default`` is for d."""
    child: str
    column: str
    parent: str
    action: str
    default: object = None


class Keys:
    """Key values per table; each round's new ones are written once to the shared folder and all are read together."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}
        self.schema: dict[str, StructType] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.paths

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema[name]).parquet(*self.paths[name])

    def add(self, name: str, keys: DataFrame) -> DataFrame | None:
        """Keep those of ``keys`` (one column, ``key``) that aren't here yet; returns them, or null where there are none."""
        new = keys.distinct()
        if name in self:
            new = new.join(self[name], "key", "left_anti")
        checkpoint_dir(self.spark)
        path = scratch_path(self.spark, "cascade")
        new.write.parquet(path)
        kept = self.spark.read.schema(new.schema).parquet(path)
        if kept.isEmpty():
            return None
        self.paths.setdefault(name, []).append(path)
        self.schema[name] = new.schema
        return kept


@dataclass
class Cascade:
    """What deleting the targets does: ``accepted`` and ``refused`` targets (key), the keys it ``reached`` in every table that
    is referenced, and ``tables`` as they are afterwards (those that change only)."""
    accepted: DataFrame
    refused: DataFrame
    reached: Keys
    tables: dict[str, DataFrame]
    impact: DataFrame


class CascadeGraph:
    """Tables as {name: (DataFrame, key column or null)}; a referenced table needs its key column.

    A null reference references nothing. Rows equal in their key are one for every reference to it.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame, str | None]], fks: list[ForeignKey]):
        self.tables, self.fks = tables, fks
        for fk in fks:
            if fk.action not in EFFECTS:
                raise ValueError(f"unknown foreign-key action {fk.action!r}")
            if fk.action == "d" and fk.default is None:
                raise ValueError("set default needs a supplied default")
            for name in (fk.child, fk.parent):
                if name not in tables:
                    raise ValueError(f"no table {name} for the key on {fk.child}.{fk.column}")
            if tables[fk.parent][1] is None:
                raise ValueError(f"{fk.parent} is referenced and needs a key column")
        cleared = {(fk.child, fk.column) for fk in fks if fk.action in "nd"}
        for name in {fk.parent for fk in fks}:
            if (name, tables[name][1]) in cleared:
                raise ValueError(f"a key would clear {name}.{tables[name][1]}, which is itself referenced")
        self.spark = next(iter(tables.values()))[0].sparkSession

    def _staying(self, name: str, reached: Keys) -> DataFrame:
        """The rows of a table that don't go."""
        df, key = self.tables[name]
        rest = df.join(reached[name].withColumnRenamed("key", key), key, "left_anti") if name in reached else df
        for fk in self.fks:
            # reached rows of this table have gone already; rows without a key of their own go by their reference
            if fk.child == name and fk.action == "c" and fk.parent in reached:
                rest = rest.join(reached[fk.parent].withColumnRenamed("key", fk.column), fk.column, "left_anti")
        return rest if rest is df else rest.select(*df.columns)

    def _edges(self, fk: ForeignKey, rows: DataFrame | None = None) -> DataFrame:
        """(below, above): the referencing rows' own keys and the keys they reference, a row's own aside."""
        df, key = self.tables[fk.child]
        df = df if rows is None else rows
        own = F.col(key) if key else F.lit(None)
        rows = df.select(own.alias("below"), F.col(fk.column).alias("above")).where("above is not null")
        return rows.where("not below <=> above") if fk.child == fk.parent else rows

    def _inner(self) -> list[ForeignKey]:
        """Cascading keys whose children are referenced themselves."""
        parents = {fk.parent for fk in self.fks}
        return [fk for fk in self.fks if fk.action == "c" and fk.child in parents]

    def reach(self, root: str, targets: DataFrame) -> Keys:
        """The keys that deleting the ``targets`` (key) of ``root`` deletes, by table."""
        reached = Keys(self.spark)
        found = {root: targets.where("key is not null")}
        while found:
            new = {name: reached.add(name, keys) for name, keys in found.items()}
            found = {}
            for fk in self._inner():
                if new.get(fk.parent) is not None:
                    hit = self._edges(fk).join(new[fk.parent].withColumnRenamed("key", "above"), "above", "left_semi")
                    keys = hit.select(F.col("below").alias("key")).where("key is not null")
                    found[fk.child] = keys if fk.child not in found else found[fk.child].unionByName(keys)
        return reached

    def blocked(self, reached: Keys) -> Keys:
        """The reached keys that can't go: a restricting key references them, or a row that must go with them can't."""
        blocked = Keys(self.spark)
        found: dict[str, DataFrame] = {}

        def add(name: str, keys: DataFrame) -> None:
            found[name] = keys if name not in found else found[name].unionByName(keys)
        for fk in self.fks:
            if fk.action in "ra" and fk.parent in reached:
                rows = self._edges(fk, self._staying(fk.child, reached) if fk.action == "a" else None)
                add(fk.parent, reached[fk.parent].join(rows.select(F.col("above").alias("key")), "key", "left_semi"))
        while found:
            new = {name: blocked.add(name, keys) for name, keys in found.items()}
            found.clear()
            for fk in self._inner():
                if new.get(fk.child) is not None and fk.parent in reached:
                    hit = self._edges(fk).join(new[fk.child].withColumnRenamed("key", "below"), "below", "left_semi")
                    add(fk.parent, reached[fk.parent].join(hit.select(F.col("above").alias("key")), "key", "left_semi"))
        return blocked

    def impact(self, reached: Keys) -> DataFrame:
        """(tbl, column, action, effect, rows): the rows each key deletes, changes or is blocked by, at any level.

        A row that several keys reach is counted under each; one that goes by one key isn't counted as changed by another.
        """
        out = None
        for fk in sorted(self.fks, key=lambda k: (k.child, k.column, k.parent)):
            hit = self._edges(fk)
            if fk.parent in reached:
                hit = hit.join(reached[fk.parent].withColumnRenamed("key", "above"), "above", "left_semi")
                if fk.action in "nd" and fk.child in reached:
                    hit = hit.join(reached[fk.child].withColumnRenamed("key", "below"), "below", "left_anti")
            else:
                hit = hit.where(F.lit(False))
            part = hit.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(fk.child).alias("tbl"), F.lit(fk.column).alias("column"), F.lit(fk.action).alias("action"),
                F.lit(EFFECTS[fk.action]).alias("effect"), "rows")
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], "tbl string, column string, action string, effect string, rows long")
        return out

    def remaining(self, reached: Keys) -> dict[str, DataFrame]:
        """The tables without the rows that go, and with the references to them cleared or set."""
        out: dict[str, DataFrame] = {}
        for name, (df, _) in self.tables.items():
            rest = self._staying(name, reached)
            for fk in self.fks:
                if fk.child == name and fk.parent in reached and fk.action in "nd":
                    gone = reached[fk.parent].withColumnRenamed("key", fk.column).withColumn("_gone", F.lit(True))
                    value = F.when(F.col("_gone"), F.lit(fk.default)).otherwise(F.col(fk.column)).cast(df.schema[fk.column].dataType)
                    rest = rest.join(gone, fk.column, "left").select(*[value.alias(c) if c == fk.column else F.col(c) for c in df.columns])
            if rest is not df:
                out[name] = rest
        return out


def cascade_delete(tables: dict[str, tuple[DataFrame, str | None]], fks: list[ForeignKey], targets: DataFrame, root: str,
                   target_col: str = "target_id") -> Cascade:
    """Delete the ``targets`` (keys of ``root``) and all that their keys say must go or change with them.

    A target that a restricting key stands against at any level is refused and nothing of it goes, unless another
    target takes it along. A restrict key counts the rows before the deletion, a no-action key those that are left
    after it, so a row that goes itself holds nothing back by the latter. A null target is ignored; one that is no key
    of ``root`` deletes nothing and is accepted. Targets are refused until what the others reach can go, round by round.
    """
    graph = CascadeGraph(tables, fks)
    if tables[root][1] is None:
        raise ValueError(f"{root} needs a key column")
    kind = tables[root][0].schema[tables[root][1]].dataType
    accepted = targets.select(F.col(target_col).cast(kind).alias("key")).where("key is not null").distinct()
    empty = accepted.where(F.lit(False))
    refused = Keys(graph.spark)
    while True:
        reached = graph.reach(root, accepted)
        blocked = graph.blocked(reached)
        if root not in blocked:
            break
        asked = Keys(graph.spark)
        held = reached[root].join(accepted, "key", "left_semi")
        refused.add(root, held.join(blocked[root], "key", "left_semi"))
        asked.add(root, held.join(blocked[root], "key", "left_anti"))
        accepted = asked[root] if root in asked else empty
    return Cascade(accepted, refused[root] if root in refused else empty, reached, graph.remaining(reached), graph.impact(reached))
