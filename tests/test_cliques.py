"""Maximal cliques and communities against plain searches on graphs with planted groups."""

import itertools
import random

import pytest

from bidgraph.operators import cliques, networks


def plain_cliques(edges, least):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []

    def grow(chosen, open_, done):
        if not open_ and not done and len(chosen) >= least:
            found.append(tuple(sorted(chosen)))
        for v in sorted(open_):
            grow([*chosen, v], open_ & near[v], done & near[v])
            open_, done = open_ - {v}, done | {v}

    grow([], set(near), set())
    return sorted(found)


def graph(seed, nodes=36, links=90, planted=(7, 6, 5), hub=True):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(nodes)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(links)}
    for size in planted:
        edges |= set(itertools.combinations(sorted(rng.sample(names, size)), 2))
    if hub:
        edges |= {("n00", n) for n in names[1:]}
    return {e: rng.choice([3.0, 4.0, 7.5]) for e in sorted(edges)}


@pytest.mark.parametrize("most", [3, 1024])
def test_cliques_equal_brute_force_however_branches_are_split(spark, most):
    edges = graph(most)
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a string, b string, weight double")
    got = cliques.maximal_cliques(df, 3, most).collect()
    assert sorted(tuple(r.members) for r in got) == plain_cliques(edges, 3)
    for r in got:
        inside = [edges[e] for e in itertools.combinations(r.members, 2)]
        assert r.size == len(r.members) and abs(r.mean_weight - sum(inside) / len(inside)) < 1e-9


def test_peeling_bounds_later_neighbours(spark):
    edges = graph(9, nodes=60, links=60, planted=(9,))
    df = spark.createDataFrame(list(edges), "a string, b string")
    place = {r.id: r.n for r in cliques.peeled(df).collect()}
    assert sorted(place.values()) == list(range(1, len(place) + 1))
    later = {n: sum(1 for a, b in edges if n in (a, b) and place[b if n == a else a] > place[n]) for n in place}
    assert later["n00"] <= 16 and max(later.values()) <= 16  # twice the eight neighbours inside the planted group


def test_a_complete_graph_is_one_group(spark):
    """More nodes than a number has bits, each linked to all others."""
    names = [f"n{i:02d}" for i in range(80)]
    df = spark.createDataFrame([(a, b, 3.0) for a, b in itertools.combinations(names, 2)], "a string, b string, weight double")
    assert [(r.members, r.size, r.mean_weight) for r in cliques.maximal_cliques(df).collect()] == [(names, 80, 3.0)]


def test_no_links(spark):
    assert cliques.maximal_cliques(spark.createDataFrame([], "a string, b string, weight double")).count() == 0
    assert cliques.maximal_cliques(spark.createDataFrame([("a", "b", 3.0)], "a string, b string, weight double")).count() == 0


def plain_modularity(edges, place):
    m2, total, inside = 2 * sum(edges.values()), {}, 0.0
    for (a, b), w in edges.items():
        for v in (a, b):
            total[place[v]] = total.get(place[v], 0.0) + w
        inside += 2 * w * (place[a] == place[b])
    return inside / m2 - sum(t * t for t in total.values()) / m2**2


def plain_louvain(edges, seed):
    """The best of a few runs of sequential local moves and contraction."""
    best = -1.0
    for run in range(4):
        rng, graph = random.Random(seed * 10 + run), dict(edges)
        names = {v: v for e in edges for v in e}
        while True:
            near, k = {}, {}
            for (a, b), w in graph.items():
                k[a], k[b] = k.get(a, 0.0) + w, k.get(b, 0.0) + w
                if a != b:
                    near.setdefault(a, {})[b] = w
                    near.setdefault(b, {})[a] = w
            m2, at, total, moved = sum(k.values()), {v: v for v in k}, dict(k), True
            order = sorted(k)
            while moved:
                moved = False
                rng.shuffle(order)
                for v in order:
                    own = at[v]
                    total[own] -= k[v]
                    to = {own: 0.0}
                    for u, w in near.get(v, {}).items():
                        to[at[u]] = to.get(at[u], 0.0) + w
                    pick = max(sorted(to), key=lambda c: (to[c] - k[v] * total[c] / m2, c == own))
                    at[v], moved = pick, moved or pick != own
                    total[pick] += k[v]
            names = {v: at[c] for v, c in names.items()}
            joined = {}
            for (a, b), w in graph.items():
                e = tuple(sorted((at[a], at[b])))
                joined[e] = joined.get(e, 0.0) + w
            if len(set(at.values())) == len(at):
                break
            graph = joined
        best = max(best, plain_modularity(edges, names))
    return best


def blocks(seed, groups, size, inner, outer):
    rng = random.Random(seed)
    names = [(g, f"g{g}v{i:02d}") for g in range(groups) for i in range(size)]
    return {(a, b): rng.choice([1.0, 2.0]) for (g, a), (h, b) in itertools.combinations(names, 2) if rng.random() < (inner if g == h else outer)}


GRAPHS = {
    "blocks": blocks(1, 5, 12, 0.5, 0.03),
    "faint blocks": blocks(2, 4, 12, 0.4, 0.1),
    "random": blocks(3, 1, 40, 0.12, 0.0),
    "ring of cliques": {**{(f"r{c}{i}", f"r{c}{j}"): 1.0 for c in range(8) for i, j in itertools.combinations(range(5), 2)}, **{tuple(sorted((f"r{c}0", f"r{(c + 1) % 8}1"))): 1.0 for c in range(8)}},
    "chain": {(f"c{i:02d}", f"c{i + 1:02d}"): 1.0 for i in range(40)},
}


@pytest.mark.parametrize("name", GRAPHS)
def test_communities_are_as_good_as_plain_louvain_and_connected(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a string, b string, weight double")
    place = {r.id: r.community for r in networks.communities(df).collect()}
    assert plain_modularity(edges, place) >= 0.99 * plain_louvain(edges, len(edges))
    for c in set(place.values()):
        members, reached = {v for v in place if place[v] == c}, set()
        todo = [min(members)]
        while todo:
            v = todo.pop()
            reached.add(v)
            todo += [u for e in edges if v in e for u in e if u in members and u not in reached]
        assert reached == members


def test_merging_by_gain_finds_cliques_of_a_ring(spark):
    edges = GRAPHS["ring of cliques"]
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a string, b string, weight double")
    place = {r.id: r.community for r in networks.merged_by_gain(df).collect()}
    assert plain_modularity(edges, place) >= 0.95 * plain_louvain(edges, 1)
