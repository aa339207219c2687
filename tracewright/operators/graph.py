"""Queries over an edge table ``(src, dst, kind, transform, id)``.

Traversals are frontier loops: each hop joins the frontier with the distinct
adjacency and drops what was reached before; the state is one row per node.

A loop takes a round of jobs for each hop, and lineage graphs are long chains.
So weakly connected parts of at most ``LOCAL`` steps are each solved inside one
task, many small parts to a task, and only larger parts go round in hops.
Before that, what cannot lie on a cycle is trimmed off from both ends while that
pays, so that the rounds see only a fraction of wide graphs.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import cut

#: Steps that one task may hold.
LOCAL = 1_000_000
#: Trimming goes on while a round leaves no more than this share of the steps.
PAYS = 0.8


def merge_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each (src, dst, kind, transform): the first by ``order``."""
    w = Window.partitionBy("src", "dst", "kind", "transform").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nodes(edges: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``(id, is_output)`` of all columns and edge ends; the flag is true if any model says so."""
    ends = edges.select(F.col("src").alias("id"), F.lit(False).alias("is_output")).union(edges.select("dst", F.lit(False)))
    if columns is not None:
        ends = ends.union(columns.select("id", "is_output"))
    return ends.groupBy("id").agg(F.max("is_output").alias("is_output"))


def adjacency(edges: DataFrame, direction: str = "DOWNSTREAM") -> DataFrame:
    """Distinct ``(src, dst)`` steps of a direction; parallel edges count once."""
    down = edges.select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("DOWNSTREAM", "UPSTREAM", "BOTH"):
        raise ValueError(f"invalid_direction: {direction}")
    return {"DOWNSTREAM": down, "UPSTREAM": up, "BOTH": down.union(up)}[direction].distinct()


def _weak_parts(steps: DataFrame) -> DataFrame:
    """``(id, part)``: the smallest id of each weakly connected part, by alternating star contraction."""
    now, mark = cut(steps.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()), None
    while True:
        flow = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = flow.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = flow.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(wide.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == mark:
            break
        mark = sign
    return now.select(F.col("a").alias("id"), F.col("b").alias("part")).union(now.select("b", "b").distinct())


def _dealt(steps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(src, dst, bin)`` of the parts that fit one task each, bins of about ``LOCAL`` steps at most; and the steps of the larger parts, or None."""
    total = steps.count()
    if total <= LOCAL:
        return steps.select("src", "dst", F.lit(0).alias("bin")), None
    placed = cut(steps.join(_weak_parts(steps).withColumnRenamed("id", "src"), "src"))
    sizes = cut(placed.groupBy("part").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > LOCAL).select("part")
    bins = max(1, 2 * total // LOCAL)
    small = placed.join(large, "part", "left_anti").select("src", "dst", F.pmod(F.xxhash64("part"), F.lit(bins)).cast("int").alias("bin"))
    return small, placed.join(large, "part", "left_semi").select("src", "dst") if large.take(1) else None


def _sizes(steps: DataFrame) -> tuple[int, int, int]:
    """How many steps there are, and about how many distinct sources and targets."""
    return tuple(steps.agg(F.count("*"), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first())


def _ends(steps: DataFrame, c: str) -> DataFrame:
    """The distinct ``(end)`` of a column, stored, so that few of them are broadcast and the steps not shuffled."""
    return cut(steps.select(F.col(c).alias("end")).distinct())


def _trimmed(steps: DataFrame) -> DataFrame:
    """The distinct steps left when those that nothing leads to, or that lead to nothing, are dropped while it pays; every cycle stays."""
    n, a, b = _sizes(steps)
    while n > LOCAL:
        before = n
        for here, there in (("src", "dst"), ("dst", "src")) if a < b else (("dst", "src"), ("src", "dst")):
            steps = cut(steps.join(_ends(steps, here), F.col(there) == F.col("end"), "left_semi"))
            n, a, b = _sizes(steps)
            if n <= LOCAL:
                break
        if n > PAYS * before:
            break
    return cut(steps.distinct())


def _numbered(f: pd.DataFrame) -> tuple[list[str], list[list[int]]]:
    """``(ids, successors)`` of the steps of a frame; ids in order."""
    both = pd.concat([f["src"], f["dst"]])
    code, ids = pd.factorize(both, sort=True)
    after: list[list[int]] = [[] for _ in ids]
    for a, b in zip(code[: len(f)].tolist(), code[len(f) :].tolist()):
        after[a].append(b)
    return list(ids), after


def _strong(after: list[list[int]]) -> list[int]:
    """The smallest member of each node's strongly connected component, with an explicit stack."""
    n = len(after)
    index, low, out, on, stack, count = [-1] * n, [0] * n, [0] * n, [False] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            elif on[w := after[v][i - 1]]:
                low[v] = min(low[v], low[w])
            while i < len(after[v]) and index[after[v][i]] >= 0:
                if on[w := after[v][i]]:
                    low[v] = min(low[v], index[w])
                i += 1
            if i < len(after[v]):
                work += [(v, i + 1), (after[v][i], 0)]
            elif low[v] == index[v]:
                at = len(stack) - 1
                while stack[at] != v:
                    at -= 1
                least = min(stack[at:])
                for w in stack[at:]:
                    out[w], on[w] = least, False
                del stack[at:]
    return out


def _local_components(f: pd.DataFrame) -> pd.DataFrame:
    ids, after = _numbered(f)
    return pd.DataFrame({"id": ids, "component": [ids[c] for c in _strong(after)]}, dtype=object)


def _local_layers(f: pd.DataFrame) -> pd.DataFrame:
    starts = f["src"].isna()
    ids, after = _numbered(f[~starts])
    strong = _strong(after)
    size = pd.Series(strong).value_counts()
    cyclic = [size[c] > 1 for c in strong]
    depth, waits = [0] * len(ids), [0] * len(ids)
    for a, xs in enumerate(after):
        after[a] = [] if cyclic[a] else [b for b in xs if not cyclic[b]]
        for b in after[a]:
            waits[b] += 1
    at = {x: i for i, x in enumerate(ids)} if starts.any() else {}
    for x, d in zip(f["dst"][starts], f["depth"][starts]):
        depth[at[x]] = int(d)
    ready = [i for i, n in enumerate(waits) if not n]
    while ready:
        a = ready.pop()
        for b in after[a]:
            depth[b] = max(depth[b], depth[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return pd.DataFrame({"id": pd.Series(ids, dtype=object), "depth": pd.array(depth, "int32")})


def _local_reach(depth: int | None):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        starts = f["src"].isna()
        ids, after = _numbered(f[~starts])
        at = {x: i for i, x in enumerate(ids)}
        front = [at[x] for x in f["dst"][starts]]
        seen, hop = dict.fromkeys(front, 0), 0
        while front and (depth is None or hop < depth):
            hop += 1
            new = []
            for a in front:
                for b in after[a]:
                    if b not in seen:
                        seen[b] = hop
                        new.append(b)
            front = new
        return pd.DataFrame({"id": pd.Series([ids[i] for i in seen], dtype=object), "distance": pd.array(list(seen.values()), "int32")})

    return run


def impact(edges: DataFrame, origin: str | DataFrame, direction: str = "DOWNSTREAM", depth: int | None = None) -> DataFrame:
    """``(id, distance)`` of everything reachable; the origin has distance 0, and stands alone if it is unknown."""
    spark, step = edges.sparkSession, cut(adjacency(edges, direction))
    start = spark.createDataFrame([(origin,)], "id string") if isinstance(origin, str) else origin.select("id").distinct()
    if step.count() <= LOCAL:
        ends = step.select(F.col("src").alias("id")).union(step.select("dst")).distinct()
        known = start.join(ends, "id", "left_semi").select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst"))
        near = step.unionByName(known).withColumn("bin", F.lit(0)).groupBy("bin").applyInPandas(_local_reach(depth), "id string, distance int")
        return near.union(start.join(ends, "id", "left_anti").withColumn("distance", F.lit(0)))
    front = cut(start.withColumn("distance", F.lit(0)))
    hops, hop = [front], 0
    while depth is None or hop < depth:
        seen = reduce(DataFrame.union, hops)
        new = cut(front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not new.take(1):
            break
        hop += 1
        front = new.withColumn("distance", F.lit(hop))
        hops.append(front)
        if len(hops) > 16:  # so that the plan stays short
            hops = [cut(reduce(DataFrame.union, hops))]
    return reduce(DataFrame.union, hops)


def truncated(edges: DataFrame, reached: DataFrame, depth: int, direction: str = "DOWNSTREAM") -> bool:
    """Whether a node at the depth limit still has a neighbour that was not reached."""
    front = reached.where(F.col("distance") == depth)
    step = adjacency(edges, direction)
    return bool(front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).join(reached, "id", "left_anti").take(1))


def shortest_path(edges: DataFrame, start: str, end: str, direction: str = "DOWNSTREAM") -> DataFrame:
    """``(step, id)`` of the path with the fewest edges, by node list the smallest; no rows if there is none."""
    spark, step = edges.sparkSession, cut(adjacency(edges, direction))
    front = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = cut(front.select("id"))
    while True:
        hit = front.where(F.col("id") == end)
        if hit.take(1):
            return hit.select(F.posexplode("path").alias("step", "id"))
        new = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id"), "path").join(seen, "id", "left_anti")
        front = cut(new.groupBy("id").agg(F.min("path").alias("path")).select("id", F.concat("path", F.array("id")).alias("path")))
        if not front.take(1):
            return front.select(F.posexplode("path").alias("step", "id"))
        seen = cut(seen.union(front.select("id")))


def _spread_min(steps: DataFrame, colour: DataFrame) -> DataFrame:
    """Smallest colour that reaches each node along ``steps``, within colours ``(id, c)``; each round only changed nodes speak."""
    front = colour
    while True:
        came = steps.join(front, steps["src"] == front["id"]).groupBy("dst").agg(F.min("c").alias("m"))
        new = cut(colour.join(came, colour["id"] == came["dst"], "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("changed")))
        colour, front = new.select("id", "c"), new.where("changed").select("id", "c")
        if not front.take(1):
            return colour


def _colouring(steps: DataFrame) -> DataFrame:
    """Strong components ``(id, component)`` of steps that no task can hold.

    The smallest id that reaches each node is spread forward; the nodes of a
    colour that also reach that id backward are one component, and leave.  Rounds
    go on until no node is left; ends of chains leave first.
    """
    left = cut(steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct())
    out = None
    while left.take(1):
        live = steps.join(left.withColumnRenamed("id", "src"), "src").join(left.withColumnRenamed("id", "dst"), "dst").select("src", "dst")
        inner = cut(live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        core = inner.select(F.col("src").alias("id")).union(inner.select("dst")).distinct()
        done = left.join(core, "id", "left_anti").select("id", F.col("id").alias("component"))
        if inner.take(1):
            ahead = _spread_min(inner, cut(core.select("id", F.col("id").alias("c"))))
            same = inner.join(ahead.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(ahead.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
            back = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            reach = cut(ahead.where("id = c").select("id", F.col("c").alias("component")))
            front = reach
            while front.take(1):
                new = front.join(back, front["id"] == back["src"]).select(F.col("dst").alias("id"), "component").distinct().join(reach, "id", "left_anti")
                front = cut(new)
                reach = cut(reach.union(front))
            done = done.union(reach)
        done = cut(done)
        out = done if out is None else out.union(done)
        left = cut(left.join(done, "id", "left_anti"))
    return out


def _cored(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of the nodes that trimming leaves; every other node is a component of its own."""
    small, large = _dealt(_trimmed(edges.select("src", "dst").where("src <> dst")))
    done = small.groupBy("bin").applyInPandas(_local_components, "id string, component string")
    return cut(done if large is None else done.union(_colouring(cut(large))))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node: its strongly connected component, by the smallest member."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.join(_cored(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """``(component, size, self_loop, members)`` of each component of several nodes and each self-loop."""
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    own = _cored(edges).join(loops, "id", "full").select("id", F.coalesce("component", "id").alias("component"), "loop")
    rows = own.groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.max("loop"), F.lit(False)).alias("self_loop"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))
    return rows.where("size > 1 OR self_loop")


def cycle_list(edges: DataFrame) -> DataFrame:
    """``(first, size, members)``: a row for each component of several nodes, and one of its own for each self-loop, also inside such a component."""
    own = _cored(edges).groupBy(F.col("component").alias("first")).agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members")).where("size > 1")
    loops = edges.where("src = dst").select(F.col("src").alias("first")).distinct()
    return own.union(loops.select("first", F.lit(1).cast("long"), F.col("first")))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def visible(edges: DataFrame, hidden: tuple[str, ...] = ("PREDICATE", "GROUP_BY", "ORDER_BY", "SOURCE")) -> DataFrame:
    """Edges of the kinds that are not hidden."""
    return edges.where(~F.col("kind").isin(*hidden)) if hidden else edges


def collapse(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges that touch none of ``hidden(id)``."""
    return edges.join(hidden.withColumnRenamed("id", "src"), "src", "left_anti").join(hidden.withColumnRenamed("id", "dst"), "dst", "left_anti")


def ownership(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Display edges ``own:<id>`` to columns without incoming edges, from their table's node if ``tables(id)`` has it."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    roots = ids.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").join(tables, "id", "left_anti")
    owner = roots.withColumn("table", F.concat(F.lit("table:"), F.regexp_extract("id", r"^(.*)\.[^.]*$", 1)))
    return owner.join(tables.withColumnRenamed("id", "table"), "table", "left_semi").select(F.concat(F.lit("own:"), "id").alias("id"), F.col("table").alias("src"), F.col("id").alias("dst"))


def unique_edge_ids(edges: DataFrame, order: str) -> DataFrame:
    """Repeated edge ids get ``#2``, ``#3``, ... in ``order``."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return edges.withColumn("id", F.when(n == 1, F.col("id")).otherwise(F.concat_ws("#", "id", n.cast("string"))))


def layers(edges: DataFrame) -> DataFrame:
    """``(id, depth)``: the longest path from a root; nodes on or behind a cycle keep the depth that their acyclic part gives."""
    steps = edges.select("src", "dst").where("src <> dst")
    ids = edges.select(F.col("src").alias("id"), F.lit(0).alias("depth"))
    if steps.count() <= LOCAL:
        own = steps.distinct().select("src", "dst", F.lit(0).alias("bin"), F.lit(None).cast("int").alias("depth"))
        found, ends = own.groupBy("bin").applyInPandas(_local_layers, "id string, depth int"), edges
    else:
        comp = _cored(edges)
        loops = comp.groupBy("component").count().where("count > 1").select("component")
        cyclic = cut(comp.join(loops, "component", "left_semi").select("id"))
        around = bool(cyclic.take(1))
        found = _wide_layers(cut(collapse(steps, cyclic)) if around else steps)
        ends = edges if around else edges.where("src = dst OR src IS NULL OR dst IS NULL")  # the targets of all other steps are found
    return ids.union(ends.select("dst", F.lit(0))).union(found).groupBy("id").agg(F.max("depth").alias("depth"))


def _highest(*parts: DataFrame) -> DataFrame:
    return cut(reduce(DataFrame.union, parts).groupBy("id").agg(F.max("depth").alias("depth")))


def _behind(steps: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, depth)`` of the targets of steps whose sources have the depths ``known``, or 0."""
    return steps.join(known, F.col("src") == F.col("id"), "left").groupBy("dst").agg((F.max(F.coalesce("depth", F.lit(0))) + 1).alias("depth")).select(F.col("dst").alias("id"), "depth")


def _wide_layers(steps: DataFrame) -> DataFrame:
    """``(id, depth)`` of at least every target of acyclic steps; a node's depth is the highest of its rows.

    While it pays, steps into leaves are put aside, to be looked up when the
    depths of their sources are known, and steps out of roots, whose depths are
    known, leave a least depth at their targets.
    """
    aside, least, stalled = [], steps.sparkSession.createDataFrame([], "id string, depth int"), None
    n, a, b = _sizes(steps)
    while n > LOCAL:
        here = {"src": "dst", "dst": "src"}[stalled] if stalled else "src" if a < b else "dst"
        there = "dst" if here == "src" else "src"
        told = cut(steps.join(_ends(steps, here), F.col(there) == F.col("end"), "left").select("src", "dst", F.col("end").isNotNull().alias("stays")), by="stays")
        steps, off = told.where("stays").select("src", "dst"), told.where("NOT stays").select("src", "dst")
        if here == "src":
            aside.append(off)
        else:
            least = _highest(least, _behind(off, least))
        before = n
        n, a, b = _sizes(steps)
        if n > PAYS * before:
            if stalled:
                break
            stalled = here
        else:
            stalled = None
    small, large = _dealt(cut(steps.distinct()))
    bins = small.select(F.col("src").alias("id"), "bin").union(small.select("dst", "bin")).distinct()
    rows = small.withColumn("depth", F.lit(None).cast("int")).union(least.join(bins, "id").select(F.lit(None).cast("string"), "id", "bin", "depth"))
    known = _highest(least, rows.groupBy("bin").applyInPandas(_local_layers, "id string, depth int"), *([] if large is None else [_long_layers(cut(large), least)]))
    for off in aside[:0:-1]:
        known = _highest(known, _behind(off, known))
    return known.union(_behind(aside[0], known)) if aside else known


def _long_layers(steps: DataFrame, least: DataFrame) -> DataFrame:
    """The layers of acyclic steps that no task can hold, from the depths ``least`` on; each round only the nodes that moved speak."""
    depth = cut(steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct().join(least, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth")))
    front = depth
    while True:
        came = steps.join(front, steps["src"] == front["id"]).groupBy("dst").agg((F.max("depth") + 1).alias("m"))
        new = cut(depth.join(came, depth["id"] == came["dst"], "left").select("id", F.greatest("depth", F.coalesce("m", "depth")).alias("depth"), (F.coalesce("m", "depth") > F.col("depth")).alias("moved")))
        depth, front = new.select("id", "depth"), new.where("moved").select("id", "depth")
        if not front.take(1):
            return depth


def layout(edges: DataFrame) -> DataFrame:
    """``(id, depth, row)``: the layers, each in the order of its ids."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = cut(layers(edges).repartitionByRange(parts, "depth", "id").withColumn("_part", F.spark_partition_id()))
    ahead = told.groupBy("depth", "_part").count().withColumn("_ahead", F.coalesce(F.sum("count").over(Window.partitionBy("depth").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    near = F.row_number().over(Window.partitionBy("depth", "_part").orderBy("id"))  # a layer may be too wide for one task
    return told.withColumn("_near", near).join(F.broadcast(ahead), ["depth", "_part"]).select("id", "depth", (F.col("_ahead") + F.col("_near") - 1).cast("int").alias("row"))
