"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import Rounds


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of a proper link.

    Rounds of parallel hooking and shortcutting over a parent table: every
    node hooks onto its smallest neighbour if that is smaller, parents are
    replaced by their parents twice (a join with itself each), and the links
    are rewritten to the new parents; links within one node go away. A
    component's smallest node is never rewritten, so it is what remains. The
    rounds end when no link is left. A round writes two tables to the shared
    checkpoint folder, the parents, and the links that are left with the roots
    so far; the links are counted as they are written. Links with a NULL end or
    equal ends join nothing and are left out; repeated links count once.
    """
    proper = links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") < F.col("y"))).distinct()
    tables = Rounds(links.sparkSession)
    ends = proper.select(F.explode(F.array("x", "y")).alias("x")).distinct()
    state, left = _measured(tables, proper, ends.select("x", F.col("x").alias("y")))
    while left:
        edges = state.where("edge").select(F.col("x").alias("a"), F.col("y").alias("b"))
        parents = tables.write("parents", _shortcut(_shortcut(_hook(edges))))
        up_a, up_b = (parents.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}")) for end in ("a", "b"))
        moved = edges.join(up_a, "a").join(up_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y")).distinct()
        up = parents.select(F.col("node").alias("y"), "parent")
        state, left = _measured(tables, moved, state.where("not edge").join(up, "y", "left").select("x", F.coalesce("parent", "y").alias("y")))
    tables.drop("parents")
    return state.where("not edge").select(F.col("x").alias("node"), F.col("y").alias("root"))


def _measured(tables: Rounds, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Links (``x``, ``y``) and roots (node ``x``, root ``y``) as one table, and how many links it has."""
    both = edges.select(F.lit(True).alias("edge"), "x", "y").union(roots.select(F.lit(False), "x", "y"))
    table, seen = tables.write_measured("state", both, n=F.count(F.when(F.col("edge"), 1)))
    return table, seen["n"]


def _hook(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    return both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent"))


def _shortcut(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(above, "parent").select("node", F.col("grand").alias("parent"))
