"""Splits that keep related records together.

Records that share a patient or a case, directly or through others, form a component; each component goes to
one split. Components come from a frontier breadth-first search: the adjacency lists lie hash-partitioned by
node, the list of a hub in several parts; every node that precedes all its neighbours is a seed, and all seeds
expand at once, each node keeping the least seed that reaches it first; seeds that met are the edges of a small
graph of labels, which is merged in turn: in one task if it has at most ``SMALL_GRAPH`` edges, else by the same
search. Nodes are ordered by their hash. The least node of a component is a seed in any search, so a component
is named after it whichever way the labels are merged.

Ids are compared without surrounding spaces and ignoring case; null ids relate nothing; patient and case ids
are different name spaces. Repeated rows count as often as they come in weights and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.operators.catalog import plain
from slicewright.operators.prefix import hash_running_sum
from slicewright.session import bucketed, discard, materialize, share_package

#: Edges of a graph of labels that one task may merge; checked before it does. More are merged by search, to the same result.
SMALL_GRAPH = 400_000
#: Neighbours in one part of an adjacency list; a hub has several parts, which lie apart.
LIST_PART = 100_000
#: A component above this part of all rows is placed on its own; there are at most 1 / LARGE_PART of them.
LARGE_PART = 0.01


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in parent]}, columns=["node", "component"])


def _ranked(c: str) -> Column:
    """A node with its hash in front, as bytes: their order is the order of nodes, the same in every search."""
    return F.concat(F.unhex(F.lpad(F.hex(F.xxhash64(c)), 16, "0")), F.encode(c, "UTF-8"))


def components(edges: DataFrame, small_graph: int = SMALL_GRAPH, list_part: int = LIST_PART) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``, two string columns; edges with a null and loops are ignored.

    The component is named after its node with the least hash. Nodes without an edge to another are not in the result.
    """
    share_package(edges.sparkSession)
    pairs = edges.where("a <> b").distinct().select(_ranked("a").alias("a"), _ranked("b").alias("b"))
    found = _search(materialize(pairs, "edges"), small_graph, list_part)
    plain_text = lambda c: F.decode(F.substring(c, 9, 1 << 30), "UTF-8").alias(c)
    return found.select(plain_text("node"), plain_text("component"))


def _spread(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows`` with the number of parts of the list of their node."""
    return rows.join(hubs, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _met_lists(labelled: DataFrame, hubs: DataFrame, lists: DataFrame) -> DataFrame:
    """``labelled(node, label)`` met with the adjacency lists of its nodes: the lists stay where they lie."""
    return _spread(labelled, hubs).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(lists, ["node", "part"])


def _search(pairs: DataFrame, small_graph: int, list_part: int) -> DataFrame:
    """(node, component) of the graph of the edges ``a, b``; an edge may come in both directions."""
    spark = pairs.sparkSession
    edges = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    nodes = materialize(edges.groupBy("node").agg(F.min("other").alias("least"), F.ceil(F.count(F.lit(1)) / list_part).cast("int").alias("parts")), "nodes")
    hubs = materialize(nodes.where("parts > 1").select("node", "parts"), "hubs")
    lists = bucketed(_spread(edges, hubs).select("node", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other"), ["node", "part"], "adjacency")
    hops = [materialize(nodes.where("node < least").select("node", F.col("node").alias("label")), "frontier")]
    while True:
        # the neighbours of a hop lie in it, in the one before or in the next: only these two have to be told apart
        step = _met_lists(hops[-1], hubs, lists).select(F.col("other").alias("node"), "label", F.lit(False).alias("seen"))
        for h in hops[-2:]:
            step = step.unionByName(h.withColumn("seen", F.lit(True)))
        reached = step.groupBy("node").agg(F.min("label").alias("label"), F.bool_or("seen").alias("seen"))
        frontier = materialize(reached.where("not seen").drop("seen"), "frontier")
        if frontier.isEmpty():
            break
        hops.append(frontier)
    labels = hops[0]
    for h in hops[1:]:
        labels = labels.unionByName(h)
    once = _met_lists(labels, hubs, lists).where("node < other").select("label", F.col("other").alias("node"))
    met = once.join(labels.select("node", F.col("label").alias("other_label")), "node").where("label <> other_label")
    small = materialize(met.select(F.least("label", "other_label").alias("a"), F.greatest("label", "other_label").alias("b")).distinct(), "labels")
    if small.count() <= small_graph:
        merged = materialize(small.repartition(1).mapInPandas(_merge, "node binary, component binary"), "merged")
    else:
        merged = _search(small, small_graph, list_part)
    named = labels.join(merged.select(F.col("node").alias("label"), "component"), "label", "left")
    out = materialize(named.select("node", F.coalesce("component", "label").alias("component")), "components")
    discard(spark, [pairs, nodes, hubs, lists, small, merged, frontier, *hops])
    return out


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows with their patient and case as nodes, and the node that stands for the row (null if it has no id)."""
    p = F.concat(F.lit("p:"), plain("patient_id"))
    c = F.concat(F.lit("c:"), plain("case_id"))
    return rows.withColumn("_p", p).withColumn("_c", c).withColumn("_node", F.coalesce("_c", "_p"))


def related_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slice_name, patient_id, case_id, split where there is one, and ``_node`` of each row; node and component of the linked nodes)."""
    noded = _nodes(rows.select(*(x for x in ("slice_name", "patient_id", "case_id", "split") if x in rows.columns)))
    edges = noded.where("_p is not null and _c is not null").select(F.col("_p").alias("a"), F.col("_c").alias("b"))
    return noded, components(edges)


def split_conflicts(rows: DataFrame) -> DataFrame:
    """slice_name of each row in a related group that holds two or more different non-null splits, distinct.

    ``rows``: slice_name, patient_id, case_id, split. Rows with both ids null have no group; a null
    slice_name names no slice. A hot case is folded before it is shuffled: splits are gathered per node as
    least and greatest, then per component.
    """
    noded, comp = related_rows(rows)
    per_node = noded.where("_node is not null").groupBy("_node").agg(F.min(plain("split")).alias("lo"), F.max(plain("split")).alias("hi"))
    named = per_node.join(comp.withColumnRenamed("node", "_node"), "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    bad = named.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("component")
    nodes = named.join(bad, "component", "left_semi").select("_node")
    return noded.where("slice_name is not null").select("slice_name", "_node").join(nodes, "_node", "left_semi").select("slice_name").distinct()


def assign_splits(weights: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``weights(component, weight)`` with ``new_split``, in the proportions of ``shares``.

    Components above LARGE_PART of all weight, at most a hundred, are placed first, the largest first, each
    where most is missing; the others follow in the order of their hash, cut where the shares that are left
    end. The result depends on the components and weights alone.
    """
    spark = weights.sparkSession
    total = weights.agg(F.sum("weight")).collect()[0][0] or 0
    large = weights.where(F.col("weight") > LARGE_PART * total).orderBy(F.desc("weight"), "component").limit(int(1 / LARGE_PART)).collect() if total else []
    left = {s: share * total for s, share in shares.items()}
    placed = []
    for r in large:
        s = max(left, key=lambda k: left[k])
        left[s] -= r["weight"]
        placed.append((r["component"], s))
    room = {s: max(0.0, x) for s, x in left.items()}
    rest_total = sum(room.values()) or 1.0
    rest = weights.where(F.col("weight") <= LARGE_PART * total)
    rest_weight = rest.agg(F.sum("weight")).collect()[0][0] or 1
    run = hash_running_sum(rest, [], F.xxhash64("component"), ["component"], "weight", "_run")
    middle = (F.col("_run") - F.col("weight") / 2) / F.lit(float(rest_weight))
    names = list(shares)
    choice, upto = F.lit(names[-1]), 0.0
    cuts = []
    for s in names[:-1]:
        upto += room[s] / rest_total
        cuts.append((s, upto))
    for s, cut in reversed(cuts):
        choice = F.when(middle < cut, s).otherwise(choice)
    out = run.select("component", "weight", choice.alias("new_split"))
    if placed:
        fixed = spark.createDataFrame(placed, "component string, new_split string")
        out = out.unionByName(weights.join(F.broadcast(fixed), "component").select("component", "weight", "new_split"))
    return out


def keep_together(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """slice_name, case_id, patient_id, component and new_split of every row.

    A row without ids is its own component, by slice_name; without one as well it goes with all such rows.
    """
    noded, comp = related_rows(rows)
    lone = F.concat(F.lit("s:"), F.coalesce("slice_name", F.lit("")))
    noded = noded.withColumn("_node", F.coalesce("_node", lone))
    per_node = noded.groupBy("_node").agg(F.count(F.lit(1)).alias("weight"))
    named = per_node.join(comp.withColumnRenamed("node", "_node"), "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    named = materialize(named, "node-weights")
    placed = assign_splits(named.groupBy("component").agg(F.sum("weight").alias("weight")), shares)
    by_node = named.select("_node", "component").join(placed.select("component", "new_split"), "component")
    return noded.join(by_node, "_node").select("slice_name", "case_id", "patient_id", "component", "new_split")
