"""References to records that are not there: direct orphans, and those that inherit it.

Each table of a foreign-key graph may refer to one parent by key, at a time, and may itself be a
parent whose rows are there from a begin (inclusive) until an end (exclusive; null: for good).

A reference is a *direct* orphan if no parent row of its key is there at its time, an *inherited* one
if some are, but each of those is an orphan itself. The cascade goes down the graph level by level until
no table refers to one of the level before: the orphans of a level are written, and the rows behind them are
found by a semi-join and taken off the counts of sound parents of the next level.

Whether a parent is there is no join between references and intervals, which would be quadratic in a
hot key, but one ordered pass per key over begins, ends and references with running counts (``slots``): a
key is cut into slots of bounded row count, each started with the counts before it.

Null rules: a row with a null key or null time refers to nothing and is left out; a parent row with a
null begin is never there, but its key exists; an end at or before its begin: never there either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.operators.slots import SLOT_ROWS, slot_running_sums
from slicewright.session import materialize

COUNTS = ("d_all", "d_sound", "d_begun")


@dataclass
class Node:
    """A table of the graph: ``rows`` has key and begin, for parents also end; ``parent`` names what it refers to.

    ``refers``: a boolean column of ``rows`` telling which rows refer to the parent (default: all).
    ``serves``: which rows can be referred to (default: all).
    """

    name: str
    rows: DataFrame
    key: str
    begin: str
    end: str | None = None
    parent: str | None = None
    refers: str | None = None
    serves: str | None = None


def _levels(nodes: dict[str, Node]) -> list[list[Node]]:
    depth: dict[str, int] = {}

    def of(name: str, trail: tuple[str, ...] = ()) -> int:
        if name in trail:
            raise ValueError(f"the references run in a circle: {' -> '.join((*trail, name))}")
        if name not in depth:
            up = nodes[name].parent
            depth[name] = 0 if up is None else 1 + of(up, (*trail, name))
        return depth[name]

    for name in nodes:
        of(name)
    return [[nodes[n] for n in sorted(depth) if depth[n] == d] for d in range(max(depth.values(), default=0) + 1)]


def _references(node: Node) -> DataFrame:
    rows = node.rows.where(F.col(node.refers)) if node.refers else node.rows
    out = rows.select(F.lit(node.name).alias("ref_table"), F.col(node.key).alias("key"), F.col(node.begin).alias("t"))
    return out.where(F.col("key").isNotNull() & F.col("t").isNotNull())


def _targets(node: Node) -> DataFrame:
    rows = node.rows.where(F.col(node.serves)) if node.serves else node.rows
    end = F.col(node.end) if node.end else F.lit(None).cast(rows.schema[node.begin].dataType)
    out = rows.select(F.col(node.key).alias("key"), F.col(node.begin).alias("b"), end.alias("e"), (F.col(node.refers) if node.refers else F.lit(node.parent is not None)).alias("refers"))
    return out.where(F.col("key").isNotNull())


def _turns(targets: DataFrame, counted: dict[str, int]) -> DataFrame:
    """key, t, pri and counts of the begins and ends of targets; ``counted`` tells what a target that is there adds to d_all and d_sound."""
    there = F.col("b").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("b")))
    one = F.when(there, 1).otherwise(0)
    begun = F.when(F.col("b").isNotNull(), 1).otherwise(0) if counted["d_all"] else F.lit(0)
    begins = targets.select("key", F.col("b").alias("t"), F.lit(0).alias("pri"), *((one * k).alias(c) for c, k in counted.items()), begun.alias("d_begun"))
    ends = targets.where(there & F.col("e").isNotNull()).select("key", F.col("e").alias("t"), F.lit(0).alias("pri"), *(F.lit(-k).alias(c) for c, k in counted.items()), F.lit(0).alias("d_begun"))
    return begins.unionByName(ends)


def _judge(refs: DataFrame, up: Node, orphans: DataFrame | None, slot_rows: int) -> DataFrame:
    """ref_table, key, t, state and kind of each reference to ``up`` that is an orphan; ``orphans`` has those of its own level."""
    targets = _targets(up)
    events = _turns(targets, {"d_all": 1, "d_sound": 1})
    if orphans is not None:
        bad = orphans.where(F.col("ref_table") == up.name).select("key", F.col("t").alias("b"))
        events = events.unionByName(_turns(targets.where("refers").join(bad, ["key", "b"], "left_semi"), {"d_all": 0, "d_sound": -1}))
    events = events.withColumn("ref_table", F.lit(None).cast("string"))
    events = events.unionByName(refs.select("key", "t", F.lit(1).alias("pri"), *(F.lit(0).alias(c) for c in COUNTS), "ref_table"))
    judged = slot_running_sums(events, "key", "t", ["pri"], list(COUNTS), slot_rows).where("pri = 1 and n_d_sound = 0")
    kind = F.when(F.col("n_d_all") == 0, "direct").otherwise("inherited")
    known = F.when(F.col("n_d_all") > 0, "unsound").when(F.col("n_d_begun") > 0, "deleted")
    found = materialize(judged.select("ref_table", "key", "t", known.alias("state"), kind.alias("kind")), "judged")
    # of the rest no target began: late if the key has one at all; only these few names are met with the targets again
    open_names = found.where("state is null").select("key").distinct()
    late = targets.select("key").join(open_names, "key", "left_semi").distinct().withColumn("late", F.lit("late"))
    return found.join(late, "key", "left").select("ref_table", "key", "t", F.coalesce("state", "late", F.lit("absent")).alias("ref_state"), "kind")


def orphan_cascade(tables: list[Node], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Orphan references as ``ref_table, key, t, ref_state, kind``.

    ``ref_state``: ``absent`` (no parent row has the key), ``late`` (all begin later), ``deleted`` (some
    began, none is left), or ``unsound`` for inherited orphans. Empty tables give no rows (as parents:
    everything is absent). Repeated rows repeat in the result.
    """
    nodes = {n.name: n for n in tables}
    found: dict[str, DataFrame] = {}
    for level in _levels(nodes)[1:]:
        for parent in sorted({n.parent for n in level}):
            children = [n for n in level if n.parent == parent]
            refs = _references(children[0])
            for n in children[1:]:
                refs = refs.unionByName(_references(n))
            orphans = materialize(_judge(refs, nodes[parent], found.get(parent), slot_rows), "orphans")
            for n in children:
                found[n.name] = orphans
    distinct = list({id(x): x for x in found.values()}.values())
    if not distinct:
        raise ValueError("no table refers to another")
    out = distinct[0]
    for x in distinct[1:]:
        out = out.unionByName(x)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and kind."""
    return orphans.groupBy("ref_table", F.date_format("t", "yyyy-MM").alias("ref_month"), "kind", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("key").alias("n_keys"))
