"""Full hierarchies from parent-child links of unknown depth.

The links are walked with splitters.  A node is a splitter if its hash says so,
if it has no parent, or if it has several; every other node has one parent, so
the walk from it is a plain pointer chase that ends at the next splitter.  The
walks are far shorter than the hierarchy is deep, and their strides quadruple.
What remains is a small pointer graph of splitters.  If it has few enough links for
one task, that task solves it; a larger one is walked again down to the nodes with
several parents, and what is still too large is settled from the top in rounds.
Paths are then put together from the pieces.  Circles without a splitter, whose
walks never end, are found when a round of strides settles nothing, and handled
apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.plans.scratch import Scratch, rows

#: One node in so many is a splitter by its hash.
SPLITTER_EVERY = 8
#: A reduced graph of up to so many links is solved in one task; its pieces stay where
#: they are, so a link is two ids there.
SOLO = 500_000


def _is_splitter(node: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("splitter"), node), F.lit(every)) == 0


@dataclass
class Walks:
    """Walks that ended, ``(id, stop, piece)``: ``piece`` lists the nodes below
    ``stop`` down to ``id``; and the starts ``(id,)`` whose walks never end."""

    ended: DataFrame
    endless: DataFrame
    n_endless: int


def _stride(state: DataFrame, known: DataFrame) -> DataFrame:
    """Carry every pointer on to where its stop points, if that is known to point on."""
    on = known.select(F.col("id").alias("via"), F.col("stop").alias("stop2"), F.col("piece").alias("piece2"), F.col("done").alias("done2"))
    moved = F.col("via").isNotNull()
    return state.join(on, state["stop"] == on["via"], "left").select(
        "id",
        F.when(moved, F.col("stop2")).otherwise(F.col("stop")).alias("stop"),
        F.when(moved, F.concat("piece2", "piece")).otherwise(F.col("piece")).alias("piece"),
        F.coalesce("done2", "done").alias("done"),
    )


def walk(pointers: DataFrame, scratch: Scratch, name: str) -> Walks:
    """Follow ``(id, stop, piece)`` pointers until ``stop`` has no pointer itself.

    A round follows the pointers twice.  A node at distance d implies one at every
    smaller distance, and a round settles those up to a distance that grows, so a
    round that settles nothing proves that the rest go in circles.
    """
    first = pointers.alias("a").join(pointers.select(F.col("id").alias("to")).alias("b"), F.col("a.stop") == F.col("b.to"), "left")
    state, seen = scratch.save(first.select("id", "stop", "piece", F.col("to").isNull().alias("done")), f"{name}-walk", open=F.count_if(~F.col("done")))
    done, going, open_ = [state.where("done")], state.where("not done"), seen["open"]
    while open_:
        known = going
        for part in done:
            known = known.unionByName(part)
        step = _stride(_stride(going, known), known)
        state, seen = scratch.save(step, f"{name}-walk", open=F.count_if(~F.col("done")))
        if seen["open"] == open_:
            break
        done.append(state.where("done"))
        going, open_ = state.where("not done"), seen["open"]
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    return Walks(ended.select("id", "stop", "piece"), going.select("id"), open_)


def rings(pointers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members ``(id, ring)`` of the circles among pointers that all stay inside.

    ``(id, stop)`` maps every node to a node of the same table.  Strides double and
    carry the least id met; the image of the map shrinks to the nodes in circles.
    Two equal image sizes in a row prove that it is final.  ``ring`` is the least
    member, known once it agrees along every pointer.
    """
    state = pointers.select("id", "stop", F.col("id").alias("least"), F.col("stop").alias("next"))
    state, last = scratch.save(state, f"{name}-ring"), -1
    while True:
        image = state.select(F.col("stop").alias("id")).distinct()
        image, seen = scratch.save(image, f"{name}-image", n=rows())
        inside = state.join(image, "id", "left_semi")
        if seen["n"] == last:
            far = inside.select(F.col("id").alias("to"), F.col("least").alias("far"))
            differs = inside.join(far, inside["next"] == far["to"]).where("least != far")
            if differs.isEmpty():
                return inside.select("id", F.col("least").alias("ring"))
        last = seen["n"]
        far = state.select(F.col("id").alias("to"), F.col("stop").alias("stop2"), F.col("least").alias("least2"))
        step = state.join(far, state["stop"] == far["to"]).select("id", F.col("stop2").alias("stop"), F.least("least", "least2").alias("least"), "next")
        done = state
        state = scratch.save(step, f"{name}-ring")
        scratch.drop(done, image)


def strong_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of the nodes in circles of ``(child, parent)`` edges.

    Nodes without parents or without children are peeled off until none is left.
    In the rest every node takes the greatest id among its ancestors and itself;
    those that the owner of that id reaches backwards within its colour are the
    owner's component.  Found components leave, and it starts again.
    """
    found = []
    edges, seen = scratch.save(edges.distinct(), "core", n=rows())
    while True:
        n_edges = seen["n"]
        # peel
        while True:
            kids = edges.select(F.col("child").alias("k")).distinct()
            folks = edges.select(F.col("parent").alias("k")).distinct()
            kept = edges.join(kids, edges["parent"] == kids["k"], "left_semi").join(folks, edges["child"] == folks["k"], "left_semi")
            kept, seen = scratch.save(kept, "core", n=rows())
            scratch.drop(edges)
            edges, before = kept, n_edges
            n_edges = seen["n"]
            if n_edges in (0, before):
                break
        if not seen["n"]:
            break
        # colours: the greatest ancestor
        colour = scratch.save(edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct().select("id", F.col("id").alias("colour")), "colour")
        while True:
            up = colour.select(F.col("id").alias("parent"), F.col("colour").alias("c2"))
            best = edges.join(up, "parent").groupBy(F.col("child").alias("id")).agg(F.max("c2").alias("c2"))
            step = colour.join(best, "id", "left").select("id", F.greatest("colour", F.coalesce("c2", "colour")).alias("new"), (F.col("c2") > F.col("colour")).alias("moved"))
            step, seen = scratch.save(step, "colour", moved=F.count_if("moved"))
            scratch.drop(colour)
            colour = step.select("id", F.col("new").alias("colour"))
            colour._scratch_path = step._scratch_path
            if not seen["moved"]:
                break
        # backwards from each owner, within its colour
        pairs = edges.join(colour.select(F.col("id").alias("child"), F.col("colour").alias("cc")), "child").join(
            colour.select(F.col("id").alias("parent"), F.col("colour").alias("pc")), "parent"
        )
        same = scratch.save(pairs.where("cc = pc").select("child", "parent"), "same")
        owners = colour.where("id = colour")
        reached, front = owners, owners
        while True:
            more = front.join(same, front["id"] == same["child"]).select(F.col("parent").alias("id"), "colour").distinct()
            more = more.join(reached.select("id"), "id", "left_anti")
            more, seen = scratch.save(more, "reached", n=rows())
            if not seen["n"]:
                break
            reached, front = reached.unionByName(more), more
        loops = edges.where("child = parent").select(F.col("child").alias("id"))
        sizes = reached.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        real = reached.join(sizes, "colour").join(loops.withColumn("loop", F.lit(True)).distinct(), "id", "left")
        part = scratch.save(real.where("n > 1 or loop").select("id", F.col("colour").alias("component")), "component")
        found.append(part)
        gone = scratch.save(reached.select("id"), "gone")
        rest = edges.join(gone, edges["child"] == gone["id"], "left_anti").join(gone, edges["parent"] == gone["id"], "left_anti")
        edges, seen = scratch.save(rest, "core", n=rows())
    if not found:
        return edges.select(F.col("child").alias("id"), F.col("child").alias("component"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _settle_in_rounds(legs: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Top-down over the nodes with several parents, one level of them a round.

    ``legs`` has ``(id, stop, piece)`` for each parent link, ``stop`` null if the link
    leads into a splitterless circle.  A node settles when all its legs stop at
    settled nodes; the paths found for it until then wait in one table.  Returns
    the paths ``(id, root, path)`` of the settled, one row per path, and the legs of
    the others.
    """
    front = roots.select("id", F.col("id").alias("root"), F.array("id").alias("path"))
    open_ = legs
    waiting = legs.select("id", F.col("id").alias("root"), F.col("piece").alias("path")).where("false")
    settled: list[DataFrame] = []
    while True:
        stops = front.select(F.col("id").alias("stop")).distinct()
        hit = open_.join(front.select(F.col("id").alias("stop"), "root", "path"), "stop")
        paths = scratch.save(waiting.unionByName(hit.select("id", "root", F.concat("path", "piece").alias("path"))), "waiting")
        rest, seen = scratch.save(open_.join(stops, "stop", "left_anti").select("id", "stop", "piece"), "open", n=rows())
        held = rest.select("id").distinct()
        ready, got = scratch.save(paths.join(held, "id", "left_anti"), "ready", n=rows())
        if not got["n"]:
            break
        settled.append(ready)
        if len(settled) == 16:  # keeps the plan of the union short
            merged = settled[0]
            for part in settled[1:]:
                merged = merged.unionByName(part)
            settled = [scratch.save(merged, "settled")]
        front, open_, waiting = ready, rest, paths.join(held, "id", "left_semi")
        if not seen["n"]:
            break
    out = waiting.where("false")
    for part in settled:
        out = out.unionByName(part)
    return out, legs.join(out.select("id").distinct(), "id", "left_anti")


def _solve_links(ids: list[str], stops: list[str | None], leg: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[str], dict[int, str]]:
    """Solve a graph of links ``id -> stop`` in memory.

    Returns the paths, each as the path above it (or -1), its last link, its node (or
    -1, if the node never settles) and its top, the names of the nodes, and for each
    node in a circle the least name among those that are both its ancestors and
    descendants.
    """
    names: list[str] = []
    code: dict[str, int] = {}

    def at(name: str) -> int:
        k = code.setdefault(name, len(names))
        if k == len(names):
            names.append(name)
        return k

    child = [at(x) for x in ids]
    parent = [-1 if x is None else at(x) for x in stops]
    n = len(names)
    missing = [0] * n  # links whose upper end is not settled
    below: list[list[int]] = [[] for _ in range(n)]
    for k, (c, p) in enumerate(zip(child, parent)):
        missing[c] += 1
        if p >= 0:
            below[p].append(k)
    has = [m > 0 for m in missing]
    above_path: list[int] = []
    last_leg: list[int] = []
    node_of: list[int] = []
    top_of: list[int] = []
    of_node: list[list[int]] = [[] for _ in range(n)]
    ready = [v for v in range(n) if not has[v]]
    while ready:
        v = ready.pop()
        for k in below[v]:
            c = child[k]
            for above in of_node[v] if has[v] else [-1]:
                of_node[c].append(len(node_of))
                above_path.append(above)
                last_leg.append(leg[k])
                node_of.append(c)
                top_of.append(v if above < 0 else top_of[above])
            missing[c] -= 1
            if not missing[c]:
                ready.append(c)
    node_of = [-1 if missing[v] else v for v in node_of]
    # what is left is in a circle or below one: components by depth-first search
    ups: dict[int, list[int]] = {}
    for c, p in zip(child, parent):
        if missing[c] and p >= 0 and missing[p]:
            ups.setdefault(c, []).append(p)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    circle: dict[int, str] = {}
    for start in ups:
        if start in order:
            continue
        work = [(start, iter(ups.get(start, ())))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for p in rest:
                if p not in order:
                    order[p] = low[p] = len(order)
                    stack.append(p)
                    on.add(p)
                    work.append((p, iter(ups.get(p, ()))))
                    break
                if p in on:
                    low[v] = min(low[v], order[p])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or v in ups.get(v, ()):
                        least = min(names[x] for x in part)
                        circle.update((x, least) for x in part)
    return above_path, last_leg, node_of, top_of, names, circle


def _solve_alone(legs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paths ``(id, root, path)`` and circles ``(id, component)`` of ``legs`` ``(leg, id,
    stop, piece)`` that are few enough for one task, which gets their ends alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leg, ids, stops = [], [], []
        for b in batches:
            leg += b.column(0).to_pylist()
            ids += b.column(1).to_pylist()
            stops += b.column(2).to_pylist()
        above, last, node, top, names, circle = _solve_links(ids, stops, leg)
        columns = ["no", "id", "root", "legs"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], columns)

        for k in range(len(node)):
            if node[k] < 0:
                continue
            path, j = [], k
            while j >= 0:
                path.append(last[j])
                j = above[j]
            held.append((k, names[node[k]], names[top[k]], path[::-1]))
            size += len(path)
            if size > 1 << 18:
                yield flush()
                held, size = [], 0
        held += [(None, names[v], least, None) for v, least in circle.items()]
        if held:
            yield flush()

    solved = legs.select("leg", "id", "stop").repartition(1).mapInArrow(run, "no long, id string, root string, legs array<long>")
    solved = scratch.save(solved, "solved")
    steps = solved.where("no is not null").select("no", "id", "root", F.posexplode("legs").alias("at", "leg")).join(legs.select("leg", "piece"), "leg")
    paths = steps.groupBy("no").agg(F.first("id").alias("id"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    paths = paths.select("id", "root", F.concat(F.array("root"), F.flatten(F.col("p.piece"))).alias("path"))
    return paths, solved.where("no is null").select("id", F.col("root").alias("component"))


def _solve(legs: DataFrame, n: int, roots: DataFrame, scratch: Scratch, solo: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(paths, unsettled legs, circles)`` of a reduced graph of ``n`` legs."""
    if n <= solo:
        paths, components = _solve_alone(legs, scratch)
        inside = legs.where("stop is not null").join(components, "id")
        return scratch.save(paths, "paths"), inside, components
    paths, unsettled = _settle_in_rounds(legs, roots, scratch)
    return paths, unsettled, strong_components(unsettled.where("stop is not null").select(F.col("id").alias("child"), F.col("stop").alias("parent")), scratch)


def hierarchy(links: DataFrame, nodes: DataFrame, splitter_every: int = SPLITTER_EVERY, solo: int = SOLO) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solve ``links`` ``(parent, child)`` over ``nodes`` ``(id)``.

    Both must be distinct and without nulls, and ``nodes`` hold every id of the
    links.  Returns three tables:

    * ``tree`` ``(id, root, depth, path)``: one row per path from a parentless node
      down to ``id``, for nodes neither in nor below a circle;
    * ``circle`` ``(id, root)``: nodes that are their own ancestors, with the least
      id among those that are both ancestors and descendants;
    * ``below`` ``(id)``: the rest, which have an ancestor in a circle.

    Empty links make every node a tree of its own; a link from a node to itself is
    a circle of one.  Reduced graphs of at most ``solo`` links are solved in one task.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    hashed = _is_splitter(F.col("id"), splitter_every)
    parents = links.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n_parents"), F.min("parent").alias("parent"))
    info = nodes.join(parents, "id", "left").select("id", "parent", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), hashed.alias("hashed"))
    info = scratch.save(info, "nodes")
    roots = info.where("n_parents = 0").select("id")
    single = info.where("n_parents = 1")
    junctions = info.where("n_parents > 1").select("id")

    # every node to its next splitter
    pointer = lambda t: t.select("id", F.col("parent").alias("stop"), F.array("id").alias("piece"))
    low = walk(pointer(single.where("not hashed")), scratch, "low")

    # one leg per parent link of the splitters that have parents
    starts = pointer(single.where("hashed")).unionByName(
        links.join(junctions, links["child"] == junctions["id"], "left_semi").select(
            F.col("child").alias("id"), F.col("parent").alias("stop"), F.array("child").alias("piece")
        )
    )

    def extend(legs: DataFrame, walks: Walks, name: str) -> tuple[DataFrame, dict]:
        """Carry legs on over the walk that starts at their stop; null stop if it never ends."""
        on = walks.ended.select(F.col("id").alias("via"), F.col("stop").alias("stop2"), F.col("piece").alias("piece2"))
        out = legs.join(on, legs["stop"] == on["via"], "left")
        out = out.select("id", F.coalesce("stop2", "stop").alias("stop"), F.concat(F.coalesce("piece2", F.array().cast("array<string>")), "piece").alias("piece"))
        if walks.n_endless:
            lost = walks.endless.select(F.col("id").alias("lost"))
            out = out.join(lost, out["stop"] == lost["lost"], "left").select(
                "id", F.when(F.col("lost").isNull(), F.col("stop")).alias("stop"), "piece"
            )
        return scratch.save(out.withColumn("leg", F.monotonically_increasing_id()), name, n=rows())

    legs, seen = extend(starts, low, "legs")
    alone = seen["n"] <= solo
    if alone:
        inner_legs, n_legs, high = legs, seen["n"], None
    else:
        is_single = single.where("hashed").select("id")
        reduced = legs.join(is_single, "id", "left_semi").drop("leg")
        into_circle = reduced.where("stop is null").select("id")
        high = walk(reduced.where("stop is not null"), scratch, "high")
        # walks that ended at a splitter which itself leads into a splitterless circle
        bad = scratch.save(into_circle, "bad")
        inner_legs, seen = extend(legs.join(junctions, "id", "left_semi").drop("leg"), high, "junction_legs")
        n_legs = seen["n"]
        inner_legs = inner_legs.join(bad.select(F.col("id").alias("b")), F.col("stop") == F.col("b"), "left").select(
            "leg", "id", F.when(F.col("b").isNull(), F.col("stop")).alias("stop"), "piece"
        )

    paths, unsettled, components = _solve(inner_legs, n_legs, roots, scratch, solo)
    top = roots.select("id", F.col("id").alias("root"), F.array("id").alias("path")).unionByName(paths)

    # expand: hashed splitters from the tops, then the rest from all splitters
    def expand(walks: Walks, above: DataFrame) -> DataFrame:
        above = above.select(F.col("id").alias("stop"), "root", F.col("path").alias("above"))
        return walks.ended.join(above, "stop").select("id", "root", F.concat("above", "piece").alias("path"))

    middle = top if high is None else scratch.save(top.unionByName(expand(high, top)), "splitter_paths")
    tree = middle.unionByName(expand(low, middle))
    tree = scratch.save(tree.select("id", "root", (F.size("path") - 1).alias("depth"), "path"), "tree")

    # circles without a splitter, circles of hashed splitters, circles through junctions
    circles = []
    if low.n_endless:
        inner = single.join(low.endless, "id", "left_semi").select("id", F.col("parent").alias("stop"))
        if low.n_endless <= solo:
            around = _solve_alone(inner.select(F.lit(0).cast("long").alias("leg"), "id", "stop", F.array("id").alias("piece")), scratch)[1]
            circles.append(around.select("id", F.col("component").alias("root")))
        else:
            circles.append(rings(inner, scratch, "low").select("id", F.col("ring").alias("root")))
    if high is not None and high.n_endless:
        inner = scratch.save(reduced.join(high.endless, "id", "left_semi"), "endless")
        around = rings(inner.select("id", "stop"), scratch, "high")
        members = around.join(inner, "id").select("ring", F.explode("piece").alias("id"))
        circles.append(_least(members))
    ends = components.select(F.col("id").alias("stop"), F.col("component").alias("c2"))
    inside = (unsettled if "component" in unsettled.columns else unsettled.join(components, "id")).join(ends, "stop").where("component = c2")
    circles.append(_least(inside.select(F.col("component").alias("ring"), F.explode("piece").alias("id")).distinct()))
    circle = circles[0]
    for part in circles[1:]:
        circle = circle.unionByName(part)
    circle = scratch.save(circle, "circle")
    settled = tree.select("id").union(circle.select("id"))
    below = info.select("id").join(settled, "id", "left_anti")
    return tree, circle, below


def _least(members: DataFrame) -> DataFrame:
    least = members.groupBy("ring").agg(F.min("id").alias("root"))
    return members.join(least, "ring").select("id", "root")


def _solve_chains(ids: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`hierarchy` over trimmed keys; ``ids`` are those of the catalog."""
    ends = parents.select(F.trim("chain_id_parent").alias("parent"), F.trim("chain_id_child").alias("child"))
    links = ends.where("parent is not null and child is not null").distinct()
    nodes = ids.select("id").union(ends.select("parent")).union(ends.select("child")).where("id is not null").distinct()
    return hierarchy(Scratch(parents.sparkSession, "chains").save(links, "links"), nodes)


def chain_descendants(chains: DataFrame, parents: DataFrame) -> DataFrame:
    """``(ancestor, id, distance)``: all descendants of every chain of a tree, at each
    distance at which they stand below it.  Chains in or below a circle have none
    and are none; keys are treated as by :func:`chain_hierarchy`."""
    return descendants(_solve_chains(chains.select(F.trim("id").alias("id")), parents)[0])


def chain_hierarchy(chains: DataFrame, parents: DataFrame) -> DataFrame:
    """Paths, levels and circles of a catalog of chains and its parent links.

    ``(chain_id, kind, root_id, depth, chain_path)`` with kinds ``tree``, ``level``
    (a tree row again, if some catalog row has another non-null level), ``cycle``
    and ``below``; depth -1 and an empty path for the last two.  Ids are trimmed of
    spaces and compared as they are; links with a null end do not count, but their
    other end is a node; repeated links and rows change nothing.
    """
    catalog = chains.select(F.trim("id").alias("id"), "level").groupBy("id").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    tree, circle, below = _solve_chains(catalog, parents)
    leveled = tree.join(catalog, "id", "left")
    kinds = F.when((F.col("lo") != F.col("depth")) | (F.col("hi") != F.col("depth")), F.array(F.lit("tree"), F.lit("level"))).otherwise(F.array(F.lit("tree")))
    found = leveled.select(
        F.col("id").alias("chain_id"), F.explode(kinds).alias("kind"), F.col("root").alias("root_id"), "depth", F.array_join("path", " > ").alias("chain_path")
    )
    no = [F.lit(-1).alias("depth"), F.lit("").alias("chain_path")]
    return found.unionByName(circle.select(F.col("id").alias("chain_id"), F.lit("cycle").alias("kind"), F.col("root").alias("root_id"), *no)).unionByName(
        below.select(F.col("id").alias("chain_id"), F.lit("below").alias("kind"), F.lit("").alias("root_id"), *no)
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All ``(ancestor, id, distance)`` pairs of solved tree paths, distinct."""
    pairs = tree.select("id", F.posexplode("path").alias("at", "ancestor"), "depth")
    return pairs.where("at < depth").select("ancestor", "id", (F.col("depth") - F.col("at")).alias("distance")).distinct()
