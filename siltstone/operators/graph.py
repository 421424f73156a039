"""Directed graphs as edge tables (src, dst, flags): consolidation, degrees, reachability, components, order.

Loops over frontiers write each step to the shared folder, so lineage stays short and a lost executor costs one step.
Once no more than AT_ONCE edges are left, one task goes the rest of the way in memory, and the number of steps no longer
matters. The joins of the loops are never broadcast: what many steps send to the driver would add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from siltstone.session import Scratch, ship

#: What an edge is.
SYNC, ASYNC, CROSS_MODULE, DEFINES, USES, RETURNS = 1, 2, 4, 8, 16, 32
#: Hops of a job, and jobs after which what has been seen is written as one table.
HOPS, ROUNDS = 3, 8
#: Edges that one task holds in memory.
AT_ONCE = 1_000_000


def consolidate(edges: DataFrame, *keys: str) -> DataFrame:
    """Parallel edges counted."""
    return edges.groupBy(*keys).agg(F.count("*").alias("calls"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """One edge for each pair, flags of parallel ones OR-ed."""
    return edges.groupBy("src", "dst").agg(F.bit_or("flags").alias("flags"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])


def row_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, row_offset): edges of all smaller nodes, in two steps so that no task orders all nodes.

    Nodes are cut into ranges by value; a range's sum comes from partial sums, the running sum inside it from its own
    window.
    """
    degree = degrees(nodes, edges).select("node", "out_degree", F.expr("node DIV 4096").alias("part"))
    sums = degree.groupBy("part").agg(F.sum("out_degree").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    held = degree.join(sums.select("part", before.alias("before")), "part")
    return held.select("node", (F.col("before") + F.coalesce(F.sum("out_degree").over(inside), F.lit(0))).alias("row_offset"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "flags")


def existing(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Those (src, dst) of `asked` that are edges."""
    return asked.join(edges, ["src", "dst"], "left_semi")


def existing_pairs(edges: DataFrame) -> DataFrame:
    """Every (src, dst) that is an edge, once: what to start from where more pairs are asked for than there are edges."""
    return edges.select("src", "dst").distinct()


def pack(src: Column, dst: Column) -> Column:
    return F.shiftleft(src.cast("long"), 32).bitwiseOR(dst.cast("long"))


def unpack(edge: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(edge, 32), edge.bitwiseAND(F.lit(0xFFFFFFFF))


def uncalled(nodes: DataFrame, edges: DataFrame, entry_points: list | None = None) -> DataFrame:
    """Nodes that nothing calls and that are no entry point."""
    out = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return out.where(~F.col("node").isin(entry_points)) if entry_points else out


def crossing(edges: DataFrame, src_part: Column, dst_part: Column) -> DataFrame:
    return edges.where(src_part != dst_part)


def splice(edges: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """The out-edges of changed nodes (column node) replaced by new ones."""
    return edges.join(changed.select(F.col("node").alias("src")), "src", "left_anti").unionByName(new)


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """(node, hops): everything that the seeds (column node) reach, themselves included, by a frontier loop."""
    scratch = Scratch(edges.sparkSession, "reach")
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps, n = scratch.keep_counting(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), F.lit(True))
    seeds = scratch.keep(seeds.select("node").distinct())
    kinds = {steps.schema["node"].dataType, steps.schema["next"].dataType, seeds.schema["node"].dataType}
    if n > AT_ONCE or len(kinds) > 1:
        return _spread(seeds.withColumn("hops", F.lit(0)), steps, "hops", F.col("hops") + 1, scratch)
    (kind,) = kinds
    # Seeds without an edge reach themselves; only the others are sent to the task.
    starts = seeds.join(steps.select("node"), "node", "left_semi")
    given = steps.unionByName(starts.select("node", F.lit(None).cast(kind).alias("next"), F.lit(True).alias("seed")), allowMissingColumns=True)
    found = _in_one_task(given.select("node", "next", "seed"), _hops, [("node", kind), ("hops", IntegerType())])
    rest = seeds.join(steps.select("node"), "node", "left_anti").select("node", F.lit(0).alias("hops"))
    return scratch.keep(found.unionByName(rest).groupBy("node").agg(F.min("hops").alias("hops")))


def _in_one_task(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: list[tuple]) -> DataFrame:
    """What `solve` makes of all rows together; of no rows it is not asked."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    out = StructType()
    for name, kind in schema:
        out = out.add(name, kind)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held)).cast(arrow).to_batches(max_chunksize=65_536)

    return rows.repartition(1).mapInArrow(run, out)


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct values of the columns together in their order, null behind them, and each column as places in it."""
    every = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    every = every.combine_chunks() if isinstance(every, pa.ChunkedArray) else every
    coded = every.dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = np.append(rank, len(rank))[coded.indices.fill_null(len(rank)).to_numpy(zero_copy_only=False)]
    values = pa.concat_arrays([coded.dictionary.take(pa.array(order)), pa.nulls(1, every.type)])
    return values, np.split(places, np.cumsum([len(c) for c in columns])[:-1])


def _rows_of(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each node's edges, and where they lead."""
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[np.argsort(src, kind="stable")]


def _hops(given: pa.Table) -> pa.Table:
    """(node, hops) that rows with `seed` reach by those without."""
    names, (node, following) = _numbered(given["node"], given["next"])
    seed = given["seed"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    real = ~seed & (node < len(names) - 1)  # nothing goes on from a null
    offsets, ends = _rows_of(node[real], following[real], len(names))
    hops = np.full(len(names), -1, np.int64)
    front, at = np.unique(node[seed]), 0
    while len(front):
        hops[front] = at
        counts = offsets[front + 1] - offsets[front]
        where = np.repeat(offsets[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        met = np.unique(ends[where])
        front, at = met[hops[met] < 0], at + 1
    reached = np.flatnonzero(hops >= 0)
    return pa.table({"node": names.take(pa.array(reached)), "hops": pa.array(hops[reached], pa.int32())})


def _components(given: pa.Table) -> pa.Table:
    """(node, component) of the edges (src, dst), by Tarjan's algorithm with its own stack."""
    names, (src, dst) = _numbered(given["src"], given["dst"])
    n = len(names) - 1
    offsets, ends = (x.tolist() for x in _rows_of(src, dst, n))
    index, low, open_, component = [-1] * n, [0] * n, [], [-1] * n
    after = offsets[:-1]
    made = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        way = [root]
        index[root] = low[root] = made
        made += 1
        open_.append(root)
        while way:
            v = way[-1]
            if after[v] < offsets[v + 1]:
                w = ends[after[v]]
                after[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = made
                    made += 1
                    open_.append(w)
                    way.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == index[v]:
                members = [open_.pop()]
                while members[-1] != v:
                    members.append(open_.pop())
                least = min(members)
                for w in members:
                    component[w] = least
    return pa.table({"node": names[:n], "component": names.take(pa.array(component))})


def _spread(seeds: DataFrame, steps: DataFrame, column: str, after: Column, scratch: Scratch) -> DataFrame:
    """`seeds` (node, column) and what they reach by `steps` (node, next), with the least of column; each hop makes `after` of it.

    A job goes several hops, each without the nodes of earlier jobs, and writes what is new; what has been seen is
    written as one table now and then, so that the plan stays short however far it is.
    """
    seen = frontier = scratch.keep(seeds)
    rounds = 0
    while True:
        hop, found = frontier, None
        for _ in range(HOPS):
            met = hop.join(steps.hint("merge"), "node").select(F.col("next").alias("node"), after.alias(column))
            hop = met.groupBy("node").agg(F.min(column).alias(column)).join(seen.select("node").hint("merge"), "node", "left_anti")
            found = hop if found is None else found.unionByName(hop)
        frontier, n = scratch.keep_counting(found.groupBy("node").agg(F.min(column).alias(column)), F.lit(True))
        if not n:
            return seen
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % ROUNDS == 0:
            seen = scratch.keep(seen)


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Rounds of colouring: each node takes the smallest node that reaches it; what reaches back to its colour inside the
    colour is that colour's component, and leaves the graph. Nodes on no cycle are trimmed at once, and one task finds
    the rest when no more than AT_ONCE edges are left.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    everything = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    everything = (everything.unionByName(nodes.select("node")) if nodes is not None else everything).distinct()
    live, n = scratch.keep_counting(edges.where("src <> dst").select("src", "dst").distinct(), F.lit(True))
    done: list[DataFrame] = []
    while True:
        if n > AT_ONCE:
            live, n = _trim(live, scratch)
        if not n:
            break
        if n <= AT_ONCE:
            kind = live.schema["src"].dataType
            done.append(scratch.keep(_in_one_task(live, _components, [("node", kind), ("component", kind)])))
            break
        colour = _least_reaching(live, scratch)
        inside = _same(live, colour)
        home = reachable_within(inside, colour, scratch)
        done.append(home)
        gone = home.select("node")
        live = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
        live, n = scratch.keep_counting(live.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), F.lit(True))
    found = done[0] if done else everything.limit(0).withColumn("component", F.col("node"))
    for more in done[1:]:
        found = found.unionByName(more)
    return everything.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _trim(live: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Drop nodes without an edge in or out until none is left; the edges that stay, and their number."""
    before = None
    while True:
        kept = live.join(live.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
        kept = kept.join(live.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").select("src", "dst")
        live, after = scratch.keep_counting(kept, F.lit(True))
        if after == before or after <= AT_ONCE:
            return live, after
        before = after


def _least_reaching(live: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, colour): the smallest node from which each node is reached.

    A node sends to itself as well, so that several hops are one chain of joins in a job.
    """
    colour = scratch.keep(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    steps = scratch.keep(live.unionByName(colour.select(F.col("node").alias("src"), F.col("node").alias("dst"))).withColumnRenamed("src", "node"))
    while True:
        after = colour
        for _ in range(HOPS):
            after = steps.hint("merge").join(after, "node").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))
        after = after.join(colour.withColumnRenamed("colour", "was").hint("merge"), "node")
        after, moved = scratch.keep_counting(after, F.col("colour") < F.col("was"))
        colour = after.select("node", "colour")
        if not moved:
            return colour


def _same(live: DataFrame, colour: DataFrame) -> DataFrame:
    a = colour.select(F.col("node").alias("src"), F.col("colour").alias("at_src"))
    b = colour.select(F.col("node").alias("dst"), F.col("colour").alias("at_dst"))
    return live.join(a, "src").join(b, "dst").where("at_src = at_dst").select("src", "dst")


def reachable_within(inside: DataFrame, colour: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): nodes that reach the root of their colour along edges inside it."""
    steps = scratch.keep(inside.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    roots = colour.where("node = colour").select("node", F.col("colour").alias("component"))
    return _spread(roots, steps, "component", F.col("component"), scratch)


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between components, flags OR-ed."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("src_c"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("dst_c"))
    out = edges.join(a, "src").join(b, "dst").where("src_c <> dst_c")
    return simple_graph(out.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"), "flags"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(node, level): longest path from a source; None if there is a cycle."""
    scratch = Scratch(edges.sparkSession, "topo")
    live = scratch.keep(edges.select("src", "dst").distinct())
    rest = scratch.keep(nodes.select("node").distinct())
    out, level, left = None, 0, rest.count()
    while left:
        free, n = scratch.keep_counting(rest.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)), F.lit(True))
        if not n:
            return None
        out = free if out is None else out.unionByName(free)
        left -= n
        if left:
            live = scratch.keep(live.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
            rest = scratch.keep(rest.join(free.select("node"), "node", "left_anti"))
        level += 1
    return out if out is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)
