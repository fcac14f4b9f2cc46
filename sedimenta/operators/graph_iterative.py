"""Graph algorithms that take rounds. Each round's table is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.graph import NODE
from sedimenta.operators.skew import heavy_keys, skew_join
from sedimenta.session import Rounds


def pagerank(e: DataFrame, keys: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """``tx`` and ``rank``: a walk from transaction to attribute to transaction; sums to 1.

    Mass of transactions without attributes is dealt to all evenly. Ends after
    ``rounds``, or when the ranks move less than ``tolerance`` in sum. A round
    is one job: what the linked transactions hold, all that a round passes on,
    and how far the ranks moved are summed up as they are written.
    """
    n = keys.count()
    if not n:
        return keys.select("tx", F.lit(0.0).alias("rank"))
    own = e.groupBy("tx").agg(F.count("*").alias("k"))
    sized = e.join(own, "tx")
    nodes = sized.groupBy(*NODE).agg(F.count("*").alias("d"))
    tables = Rounds(e.sparkSession)
    links = tables.write("links", sized.join(nodes, NODE).withColumn("node", F.xxhash64(*NODE)).select("tx", "node", "k", "d"))
    linked = links.select("tx").distinct().withColumn("linked", F.lit(True))
    ranks, sums = tables.write_measured("ranks", keys.select("tx").join(linked, "tx", "left").select("tx", F.lit(1.0 / n).alias("rank"), "linked"), passed=F.sum(F.when(F.col("linked"), F.col("rank"))))
    for _ in range(rounds):
        spare = (1.0 - (1 - damping) - damping * sums["passed"]) / n
        to_node = links.join(ranks.select("tx", "rank"), "tx").groupBy("node").agg((F.sum(F.col("rank") / F.col("k")) / F.first("d")).alias("m"))
        gained = links.join(to_node, "node").groupBy("tx").agg(F.sum("m").alias("g"))
        now = (1 - damping) / n + damping * F.coalesce("g", F.lit(0.0)) + spare
        moved = ranks.withColumnRenamed("rank", "was").join(gained, "tx", "left").select("tx", now.alias("rank"), "linked", F.abs(now - F.col("was")).alias("step"))
        ranks, sums = tables.write_measured("ranks", moved, passed=F.sum(F.when(F.col("linked"), F.col("rank"))), step=F.sum("step"))
        if sums["step"] < tolerance:
            break
    tables.drop("links")
    return ranks.select("tx", "rank")


def connected_nodes(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each end of the pairs (columns ``a`` and ``b``).

    Alternates large-star and small-star (Kiveris et al. 2014): every node
    links its larger neighbours, then its smaller ones, to the smallest it
    knows, until nothing changes. A component's smallest node gathers its links;
    such heavy nodes meet their minimum by broadcast.
    """

    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        side = both.where(F.col("v") > F.col("u") if larger else F.col("v") < F.col("u"))
        out = skew_join(side, low, ["u"], heavy_keys(side, ["u"])).select(F.col("v").alias("b"), F.col("m").alias("a"))
        if not larger:
            out = out.union(low.select(F.col("u").alias("b"), F.col("m").alias("a")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tables = Rounds(pairs.sparkSession)
    mark = {"n": F.count("*"), "hash": F.bit_xor(F.xxhash64("a", "b"))}
    links, state = tables.write_measured("links", pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), **mark)
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    while True:
        was = state
        links, state = tables.write_measured("links", star(star(links, True), False), **mark)
        if was == state:
            break
    found = links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a").distinct())
    rest = alone.join(found.select("node"), "node", "left_anti")
    return found.union(rest.select("node", F.col("node").alias("root")))


def component_sizes(e: DataFrame, keys: DataFrame) -> DataFrame:
    """``tx`` and ``graph_component_size``: transactions and attribute nodes of its component; 1 without edges.

    Runs over attribute nodes only: a transaction links its first node with
    each of its nodes, so the graph has as many nodes as there are attributes.
    """
    node = F.xxhash64(*NODE)
    named = e.select("tx", node.alias("node"))
    first = named.groupBy("tx").agg(F.min("node").alias("a"))
    pairs = named.join(first, "tx").select("a", F.col("node").alias("b")).distinct()
    roots = Rounds(e.sparkSession).write("roots", connected_nodes(pairs))
    of_tx = first.join(roots, first["a"] == roots["node"]).select("tx", "root")
    sizes = of_tx.groupBy("root").agg(F.count("*").alias("t")).join(roots.groupBy("root").agg(F.count("*").alias("n")), "root")
    each = of_tx.join(sizes, "root").select("tx", (F.col("t") + F.col("n")).alias("s"))
    return keys.select("tx").join(each, "tx", "left").select("tx", F.coalesce("s", F.lit(1)).alias("graph_component_size"))


def core_numbers(pairs: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """``node`` and ``core`` of an undirected graph of pairs ``a``, ``b``, without weights.

    Every node's guess, first its degree, becomes the h-index of its
    neighbours' guesses until nothing changes (Montresor et al. 2013). A guess
    can only change if a neighbour's did, so a round looks at the neighbours of
    the nodes that changed in the one before. The h-index comes from counts of
    neighbours by guess: a node's neighbours are never collected, and the counts
    are partial before the shuffle.
    """
    tables = Rounds(pairs.sparkSession)
    proper = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = tables.write("both", proper.select(F.col("a").alias("u"), F.col("b").alias("v")).union(proper.select("b", "a")))
    guess = tables.write("cores", both.groupBy("u").agg(F.count("*").alias("core"), F.lit(True).alias("changed")))
    for _ in range(most_rounds):
        near = guess.select(F.col("u").alias("v"), F.col("core").alias("c"), "changed")
        touched = both.join(near.where("changed"), "v", "left_semi").select("u").distinct()
        seen = both.join(touched, "u").join(near.drop("changed"), "v").join(guess.drop("changed"), "u")
        counted = seen.groupBy("u", "core", F.least("c", "core").alias("c")).agg(F.count("*").alias("n"))
        # neighbours with a guess of c or more, for each c that occurs
        items = counted.groupBy("u", "core").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), "n"))).alias("x"))
        zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("h"))
        last = F.aggregate("x", zero, lambda s, i: F.struct((s["upto"] + i["n"]).alias("upto"), F.greatest(s["h"], F.least(-i["d"], s["upto"] + i["n"])).cast("long").alias("h")))
        lower = items.select("u", last["h"].alias("h"))
        moved = F.coalesce(F.col("h") < F.col("core"), F.lit(False))
        guess, seen = tables.write_measured("cores", guess.drop("changed").join(lower, "u", "left").select("u", F.when(moved, F.col("h")).otherwise(F.col("core")).alias("core"), moved.alias("changed")), n=F.count(F.when(F.col("changed"), 1)))
        if not seen["n"]:
            break
    tables.drop("both")
    return guess.select(F.col("u").alias("node"), "core")


def louvain(pairs: DataFrame, resolution: float = 1.0, sweeps: int = 8, levels: int = 10, least_move: float = 0.01, seed: int = 5) -> DataFrame:
    """``node`` and ``community`` of the weighted graph ``a``, ``b``, ``weight``, by modularity (Blondel et al. 2008).

    Local moves run in rounds over tables of links: in each, half of the nodes,
    drawn by a seeded hash, look at the communities of their neighbours and move
    to the one with the greatest gain, the smallest of several; the other half
    stays, so neighbours rarely swap places. When a sweep over both halves moves
    less than ``least_move`` of the nodes, or after ``sweeps``, communities
    become nodes of a smaller graph and the same begins again, until nothing
    moves. The sums are of whole weights, so the result is the same on any
    number of executors. A community is named by its smallest node; pairs of a
    node with itself count as loops.
    """
    tables = Rounds(pairs.sparkSession)
    own = pairs.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"), (2 * F.col("weight")).alias("w"))
    two = pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    links = tables.write("links", two.union(two.select("v", "u", "w")).union(own).groupBy("u", "v").agg(F.sum("w").alias("w")))
    member = tables.write("member", links.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")))
    for level in range(levels):
        state, seen = tables.write_measured("state", links.groupBy("u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u")), n=F.count("*"), total=F.sum("k"))
        if not seen["n"] or not seen["total"]:
            break
        state, moves = _local_moves(tables, links, state, seen["n"], float(seen["total"]), resolution, sweeps, least_move, seed + 100 * level)
        if not moves:
            break
        up = state.select(F.col("u").alias("community"), F.col("c").alias("above"))
        member = tables.write("member", member.join(up, "community").select("node", F.col("above").alias("community")))
        ends = [state.select(F.col("u").alias(end), F.col("c").alias(f"c{end}")) for end in ("u", "v")]
        moved = links.join(ends[0], "u").join(ends[1], "v")
        links = tables.write("links", moved.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    tables.drop("links", "state")
    first = member.groupBy("community").agg(F.min("node").alias("first"))
    return member.join(first, "community").select("node", F.col("first").alias("community"))


def _local_moves(tables: Rounds, links: DataFrame, state: DataFrame, n: int, total: float, resolution: float, sweeps: int, least_move: float, seed: int) -> tuple[DataFrame, int]:
    """Communities ``c`` of the nodes after rounds of moves, and how many moves there were."""
    every = 0
    for sweep in range(sweeps):
        in_sweep = 0
        for half in (0, 1):
            mine = F.pmod(F.xxhash64("u", F.lit(seed + sweep)), F.lit(2)) == half
            sizes = state.groupBy("c").agg(F.sum("k").alias("size"))
            near = links.where(mine & (F.col("u") != F.col("v"))).join(state.select(F.col("u").alias("v"), "c"), "v").select("u", "c", F.col("w").cast("long").alias("w"))
            stay = state.where(mine).select("u", "c", F.lit(0).cast("long").alias("w"))
            ways = near.union(stay).groupBy("u", "c").agg(F.sum("w").alias("w"))
            at_home = F.col("c") == F.col("home")
            rest = F.col("size") - F.when(at_home, F.col("k")).otherwise(0)
            gain = F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(total)
            judged = ways.join(state.select("u", "k", F.col("c").alias("home")), "u").join(sizes, "c").select("u", "c", gain.alias("gain"), at_home.alias("at_home"))
            best = judged.groupBy("u").agg(F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("to"), F.max("gain").alias("most"), F.max(F.when(F.col("at_home"), F.col("gain"))).alias("now"))
            goes = best.where(F.col("most") > F.col("now") + 1e-12).select("u", "to")
            state, seen = tables.write_measured("state", state.join(goes, "u", "left").select("u", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), n=F.count(F.when(F.col("moved"), 1)))
            in_sweep, state = in_sweep + seen["n"], state.drop("moved")
        every += in_sweep
        if in_sweep <= least_move * n:
            break
    return state, every
