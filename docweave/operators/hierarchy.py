"""Parent–child links to full hierarchies, by pointer doubling.

Nodes are numbered once; after that only numbers move. Every node that is a parent holds a pointer to an ancestor. A
round joins each unresolved one with the node it points to: a resolved target completes it, any other doubles its
jump. After k rounds every node with a root at most 2**k links away is resolved; as depths have no gaps, a round that
resolves nothing leaves only nodes that lead into cycles. Once their jump is at least as long as their largest number
in any scope, the nodes they point to are exactly those on cycles (the jump permutes each cycle). Nodes without
children take no part in the rounds; one join gives them what their parents have.

Defined results
* a null parent makes a root; a parent that names no node of the same scope makes an orphan, which is the root
  of what hangs below it;
* repeated rows of one key count once: the row with the greatest (version, parent, attributes) wins;
* rows with a null scope or node id are no nodes and are left out;
* nodes on or below a cycle have null root, depth and path;
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import cut_lineage, free


def nodes(df: DataFrame, scope: str = "document_id", node: str = "unit_id", parent: str = "parent_id", version: str | None = "loaded_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per node: scope, node, parent, and the columns in keep."""
    picked = F.struct(*([F.col(version)] if version else []), F.col(parent).alias("parent"), *[F.col(c) for c in keep])
    return (
        df.where(F.col(scope).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(scope).alias("scope"), F.col(node).alias("node"))
        .agg(F.max(picked).alias("w"))
        .select("scope", "node", F.col("w.parent").alias("parent"), *[F.col(f"w.{c}").alias(c) for c in keep])
    )


def linked(tree: DataFrame) -> DataFrame:
    """scope, node, id, pointer (the parent's id; null for roots and orphans) and orphan of every node; written once.

    tree: the result of ``nodes``. The numbers are fixed by writing them before they are read again.
    """
    numbered = cut_lineage(tree.select("scope", "node", "parent", F.monotonically_increasing_id().alias("id")))
    up = numbered.select("scope", F.col("node").alias("parent"), F.col("id").alias("pointer"))
    out = cut_lineage(numbered.join(up, ["scope", "parent"], "left").select("scope", "node", "id", "pointer", (F.col("parent").isNotNull() & F.col("pointer").isNull()).alias("orphan")))
    free(numbered)
    return out


def _parents(links: DataFrame) -> DataFrame:
    return links.where("pointer is not null").select(F.col("pointer").alias("id")).distinct()


def _most_in_a_scope(links: DataFrame, stuck: DataFrame) -> int:
    return links.join(stuck.select("id"), "id", "left_semi").groupBy("scope").count().agg(F.max("count")).first()[0] or 0


def unresolved(links: DataFrame) -> DataFrame:
    """id and pointer of every parent on or below a cycle; the pointers are the nodes on cycles.

    links: the result of ``linked``. Both sides of a round's join grow with the data, so it is a merge at every size.
    A node whose target isn't open is resolved and leaves, so a round moves only
    the nodes deeper than those before it.
    """
    open_ = cut_lineage(links.where("pointer is not null").select("id", "pointer").join(_parents(links).hint("merge"), "id", "left_semi"))
    count, jump, most = open_.count(), 1, None
    while count:
        target = open_.select(F.col("id").alias("pointer"), F.col("pointer").alias("next"))
        stepped = cut_lineage(open_.join(target.hint("merge"), "pointer").select("id", F.col("next").alias("pointer")))
        free(open_)
        before, open_, jump = count, stepped, jump * 2
        count = open_.count()
        if count == before:  # only nodes that lead into cycles are open
            most = _most_in_a_scope(links, open_) if most is None else most
            if jump >= most:
                break
    return open_


def faults(tree: DataFrame) -> DataFrame:
    """scope, node and the fault of its links: orphan, cycle or below_cycle. tree: the result of ``nodes``."""
    links = linked(tree)
    stuck = unresolved(links)
    on = stuck.select(F.col("pointer").alias("id"), F.lit(True).alias("on")).distinct()
    bad = links.join(stuck.select(F.col("id").alias("pointer")), "pointer", "left_semi").join(on, "id", "left")
    return (
        links.where("orphan").select("scope", "node", F.lit("orphan").alias("fault"))
        .unionByName(bad.select("scope", "node", F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("fault")))
    )


def resolve(tree: DataFrame) -> DataFrame:
    """scope, node, root, orphan, on_cycle, below_cycle, depth and path (array of nodes from the root on).

    tree: the result of ``nodes``. Each round writes what it resolves once; the number of rounds is the logarithm of
    the greatest depth.
    """
    links = linked(tree)
    # the segment of the path from below the pointer (or from the root on) down to the node
    state = links.select("id", "pointer", F.when(F.col("pointer").isNull(), F.col("node")).alias("root"), F.array("node").alias("path")).join(_parents(links).hint("merge"), "id", "left_semi")
    state = cut_lineage(state)
    open_, done = cut_lineage(state.where("pointer is not null").drop("root")), [state.where("pointer is null")]
    count, jump, most = open_.count(), 1, None
    while count:
        known = open_.select("id", "pointer", F.lit(None).cast("string").alias("root"), "path")
        for part in done if most is None else ():  # else open nodes point at each other alone
            known = known.unionByName(part)
        target = known.select(F.col("id").alias("pointer"), F.col("pointer").alias("next"), "root", F.col("path").alias("above"))
        stepped = cut_lineage(open_.join(target.hint("merge"), "pointer").select("id", F.col("next").alias("pointer"), "root", (F.concat("above", "path") if most is None else F.col("path")).alias("path")))
        free(open_)
        done.append(stepped.where("pointer is null"))
        before, open_ = count, cut_lineage(stepped.where("pointer is not null").drop("root"))
        count, jump = open_.count(), jump * 2
        if count == before:
            most = _most_in_a_scope(links, open_) if most is None else most
            if jump >= most:
                break
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    on = open_.select(F.col("pointer").alias("id"), F.lit(True).alias("on")).distinct()
    stuck = open_.select(F.col("id").alias("pointer"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("array<string>").alias("above"), F.lit(True).alias("stuck"))
    above = known.select(F.col("id").alias("pointer"), "root", F.col("path").alias("above"), F.lit(False).alias("stuck")).unionByName(stuck)
    top, stuck_ = F.col("pointer").isNull(), F.coalesce("stuck", F.lit(False))
    out = links.join(above, "pointer", "left").join(on, "id", "left")
    path = F.when(top, F.array("node")).otherwise(F.concat("above", F.array("node")))
    on_cycle = stuck_ & F.coalesce("on", F.lit(False))
    return out.select("scope", "node", F.when(top, F.col("node")).otherwise(F.col("root")).alias("root"), "orphan", on_cycle.alias("on_cycle"), (stuck_ & ~on_cycle).alias("below_cycle"), F.when(path.isNotNull(), F.size(path) - 1).alias("depth"), path.alias("path"))


def descendants(resolved: DataFrame) -> DataFrame:
    """All pairs of a node and one of its descendants with their distance; as many rows as the depths' sum."""
    up = F.transform(F.slice("path", 1, F.size("path") - 1), lambda a, i: F.struct(a.alias("ancestor"), (F.col("depth") - i).cast("int").alias("distance")))
    return resolved.where("depth > 0").select("scope", F.col("node").alias("descendant"), F.explode(up).alias("p")).select("scope", F.col("p.ancestor").alias("ancestor"), "descendant", F.col("p.distance").alias("distance"))
