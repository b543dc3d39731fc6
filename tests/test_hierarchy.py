import random
from collections import defaultdict
from datetime import datetime

import pytest

import strandworks.operators.hierarchy as H
from strandworks.operators.hierarchy import chain_hierarchy, descendants, hierarchy

CHAINS = "id string, chain_type int, level int, root string, added_at timestamp"
PARENTS = "chain_id_parent string, chain_id_child string, added_at timestamp, id string"


def brute(chains, parents):
    trim = lambda x: None if x is None else x.strip(" ")
    links = {(trim(a), trim(b)) for a, b in parents if a is not None and b is not None}
    nodes = {trim(x) for x in [i for i, _ in chains] + [x for p in parents for x in p] if x is not None}
    levels = defaultdict(set)
    for i, level in chains:
        if i is not None and level is not None:
            levels[trim(i)].add(level)
    above = defaultdict(list)
    for a, b in links:
        above[b].append(a)

    def ancestors(n):
        seen, todo = set(), list(above[n])
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += above[u]
        return seen

    anc = {n: ancestors(n) for n in nodes}
    circle = {n for n in nodes if n in anc[n]}

    def paths(n):
        return [p + (n,) for q in above[n] for p in paths(q)] if above[n] else [(n,)]

    out = set()
    for n in nodes:
        if n in circle:
            out.add((n, "cycle", min(m for m in anc[n] | {n} if m == n or n in anc[m]), -1, ""))
        elif anc[n] & circle:
            out.add((n, "below", "", -1, ""))
        else:
            for p in paths(n):
                row = (p[0], len(p) - 1, " > ".join(p))
                out.add((n, "tree", *row))
                if any(level != len(p) - 1 for level in levels[n]):
                    out.add((n, "level", *row))
    return out


def run(spark, chains, parents):
    c = spark.createDataFrame([(i, 1, level, "x", None) for i, level in chains], CHAINS)
    p = spark.createDataFrame([(a, b, datetime(2024, 1, 1), "x") for a, b in parents], PARENTS)
    rows = [tuple(r) for r in chain_hierarchy(c, p).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_shapes_nulls_and_clashing_columns(spark):
    chains = [("r", 0), (" a ", 5), ("a", None), ("z", None), (None, 3), ("", 0)]
    parents = [("r", "a"), ("r ", " a"), ("a", "b"), ("c", "b"), ("x", "y"), ("y", "x"), ("y", "w"), ("s", "s"), ("s", "t"), (None, "n"), ("m", None)]
    assert run(spark, chains, parents) == brute(chains, parents)


def test_empty(spark):
    assert run(spark, [], []) == set()


@pytest.mark.parametrize(("seed", "solo"), [(0, 1000), (1, 1000), (2, 20), (3, 0)])
def test_random_graphs(spark, seed, solo, monkeypatch):
    """With the reduced graph solved alone, after a second walk, and in rounds."""
    monkeypatch.setattr(H.hierarchy, "__defaults__", (8, solo))
    rng = random.Random(seed)
    n = 60
    parents = [(f"n{rng.randrange(max(1, i - 9), i + 1)}", f"n{i}") for i in range(1, n)]
    parents += [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(5)]
    # long chains, and a circle of single-parent nodes with a tail
    parents += [(f"c{i}", f"c{i + 1}") for i in range(70)]
    parents += [(f"o{i}", f"o{(i + 1) % 23}") for i in range(23)] + [("o3", "p1"), ("p1", "p2"), ("p2", "q"), ("c5", "q")]
    chains = [(f"n{i}", rng.choice([None, 0, 1, 2, 3])) for i in range(n)]
    assert run(spark, chains, parents) == brute(chains, parents)


def test_descendants(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    tree, _, _ = hierarchy(links, nodes)
    assert {tuple(r) for r in descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_links_of_a_deep_ladder_and_a_long_circle():
    """A ladder of 1,000 nodes with two parents each, and a circle of 10,000."""
    ladder = [(f"j{i}", f"j{i - 1}" if i else "top") for i in range(1000)]
    side = [(f"j{i}", f"s{i}") for i in range(1000)]
    ring = [(f"o{i:05}", f"o{(i + 1) % 10_000:05}") for i in range(10_000)] + [("under", "o00007"), ("lost", None)]
    links = ladder + side + ring
    above, last, node, top, names, circle = H._solve_links([a for a, _ in links], [b for _, b in links], list(range(len(links))))
    found = [names[v] for v in node if v >= 0]
    assert len(found) == sum(i + 2 for i in range(1000))
    assert {names[v]: least for v, least in circle.items()} == {f"o{i:05}": "o00000" for i in range(10_000)}
    deepest = max(k for k, v in enumerate(node) if v >= 0 and names[v] == "j999" and names[top[k]] == "top")
    path, k = [], deepest
    while k >= 0:
        path.append(last[k])
        k = above[k]
    assert path[::-1] == list(range(1000))
