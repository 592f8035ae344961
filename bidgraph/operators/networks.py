"""Centrality, communities, components and dense groups as iterated joins.

Every round is written to the shared folder, so plans stay short and a lost executor costs at most
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidgraph.functions.ranks import numbered
from bidgraph.operators.cliques import maximal_cliques
from bidgraph.plans.storage import discard, materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in either direction from (a, b, weight)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, neighbours, degree_centrality, weighted_degree) over undirected edges."""
    per = materialize(both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"), F.sum("weight").alias("weighted_degree")), "degrees")
    n = per.agg(F.count("*").alias("n"))
    joined = per.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one")
    return joined.select("id", "neighbours", F.when(F.col("n") > 1, F.col("neighbours") / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"), "weighted_degree")


def clustering(edges: DataFrame) -> DataFrame:
    """(id, clustering_coefficient).

    Nodes are numbered by their degree and edges lead to the larger number, so that a node opens at
    most sqrt(2 * edges) wedges a side.  A wedge is looked up among the edges by one number made of
    its ends.
    """
    per = materialize(numbered(degrees(edges).select("id", "neighbours"), [F.col("neighbours"), F.col("id")], "n"), "numbered")
    e = edges.select("a", "b").where("a <> b")
    for end in ("a", "b"):
        e = e.join(per.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
    e = materialize(e.select(F.least("na", "nb").alias("lo"), F.greatest("na", "nb").alias("hi")), "directed")
    nodes = per.count()
    number = "long" if nodes < 3_000_000_000 else "decimal(38,0)"
    pair = lambda x, y: (F.col(x).cast(number) * nodes + F.col(y)).alias("pair")
    wedge = e.select("lo", F.col("hi").alias("x")).join(e.select("lo", F.col("hi").alias("y")), "lo").where("x < y")
    triangles = wedge.select("lo", "x", "y", pair("x", "y")).join(e.select(pair("lo", "hi")), "pair")
    corners = triangles.select(F.explode(F.array("lo", "x", "y")).alias("n")).groupBy("n").agg(F.count("*").alias("t"))
    d = F.col("neighbours")
    return per.join(corners, "n", "left").select("id", F.when(d > 1, 2 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("clustering_coefficient"))


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n) with a number for each node, and undirected edges (a, b, weight) between numbers: what rounds shuffle is a third of the ids."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    names = materialize(numbered(materialize(ends.distinct(), "ids"), [F.col("id")], "n").select("id", "n"), "names")
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        edges = materialize(edges.join(names.withColumnRenamed("id", end), end).select(F.col("n").alias(end), other, "weight"), "coded")
    return names, edges


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank): weighted, on undirected edges, until the L1 change is under n * tolerance."""
    spark = edges.sparkSession
    names, numbers = coded(edges)
    total = materialize(both_ways(numbers).groupBy("src").agg(F.sum("weight").alias("total")), "totals")
    n = total.count()
    if not n:
        return names.select("id", F.lit(0.0).alias("pagerank"))
    links = both_ways(numbers)
    rank = materialize(total.select(F.col("src").alias("id"), F.lit(1.0 / n).alias("pagerank"), "total"), "rank")
    for _ in range(rounds):
        sent = rank.select("id", (F.col("pagerank") / F.col("total")).alias("each"))
        got = links.join(sent, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("each") * F.col("weight")).alias("got"))
        moved = rank.join(got, F.col("id") == F.col("dst"), "left").select("id", F.col("pagerank").alias("old"), ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank"), "total")
        new = materialize(moved, "rank")
        change = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))).alias("c")).first()["c"]
        discard(spark, rank)
        rank = new.select("id", "pagerank", "total")
        if change < n * tolerance:
            break
    discard(spark, numbers, total)
    return names.join(rank.select(F.col("id").alias("n"), "pagerank"), "n").select("id", "pagerank")


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, eigenvector_centrality): weighted power iteration on A + I, of L2 norm 1."""
    spark = edges.sparkSession
    names, numbers = coded(edges)
    links = both_ways(numbers)
    n = names.count()
    if not n:
        return names.select("id", F.lit(0.0).alias("eigenvector_centrality"))
    x = materialize(names.select(F.col("n").alias("id"), F.lit(1.0 / n).alias("v")), "vector")
    for _ in range(rounds):
        got = links.join(x, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("v") * F.col("weight")).alias("got"))
        raw = materialize(x.join(got, F.col("id") == F.col("dst"), "left").select("id", F.col("v").alias("old"), (F.col("v") + F.coalesce("got", F.lit(0.0))).alias("raw")), "raw")
        discard(spark, x)
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("n")).first()["n"] or 1.0
        change = raw.agg(F.sum(F.abs(F.col("raw") / norm - F.col("old"))).alias("c")).first()["c"]
        x = raw.select("id", (F.col("raw") / norm).alias("v"))
        if change < n * tolerance:
            break
    discard(spark, numbers)
    return names.join(x.select(F.col("id").alias("n"), "v"), "n").select("id", F.abs("v").alias("eigenvector_centrality"))


def betweenness(edges: DataFrame, pivots: int = 150, exact_up_to: int = 400) -> DataFrame:
    """(id, betweenness): Brandes by levels, all sources in one frontier; sampled sources beyond ``exact_up_to`` nodes."""
    links = materialize(both_ways(edges).select("src", "dst").distinct(), "links")
    nodes = materialize(links.select(F.col("src").alias("id")).distinct(), "nodes")
    n = nodes.count()
    k = n if n <= exact_up_to else pivots
    sources = nodes.orderBy(F.xxhash64("id"), "id").limit(k)
    levels = [materialize(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")), "level")]
    while True:
        front = levels[-1]
        step = front.join(links, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        # A neighbour of a level is in it, in the one before or in the next, so no older level is looked at.
        seen = front.select("s", "id") if len(levels) == 1 else front.select("s", "id").unionByName(levels[-2].select("s", "id"))
        new = step.join(seen, ["s", "id"], "left_anti").select("s", "id", F.lit(len(levels)).alias("dist"), "sigma")
        new = materialize(new, "level")
        if new.isEmpty():
            break
        levels.append(new)
    delta = levels[-1].select("s", "id", "sigma", F.lit(0.0).alias("delta"))
    total = None
    for upper in reversed(levels[:-1]):
        below = delta.select("s", F.col("id").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        passed = upper.join(links, F.col("id") == F.col("src")).join(below, (upper.s == below.s) & (F.col("dst") == F.col("w"))).groupBy(upper.s.alias("s"), "id").agg(F.sum("share").alias("share"))
        total = delta if total is None else total.unionByName(delta)
        delta = materialize(upper.join(passed, ["s", "id"], "left").select("s", "id", "sigma", (F.coalesce("share", F.lit(0.0)) * F.col("sigma")).alias("delta")), "delta")
    per = total.where("s <> id").groupBy("id").agg(F.sum("delta").alias("b")) if total is not None else nodes.select("id", F.lit(0.0).alias("b"))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(per, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable; labels jump to their label's label every round."""
    one, two = links.columns[:2]
    ends = links.where(F.col(one) != F.col(two)).select(F.col(one).alias("u"), F.col(two).alias("v"))
    around = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "around")
    label = materialize(around.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "label")
    while True:
        near = around.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hooked = materialize(label.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = materialize(hooked.join(jump, F.col("root") == F.col("n2"), "left").select("node", "old", F.least("root", F.coalesce("r2", "root")).alias("root")), "label")
        changed = new.where("root <> old").limit(1).count()
        discard(links.sparkSession, label, hooked)
        label = new.select("node", "root")
        if not changed:
            return label


def communities(edges: DataFrame, rounds: int = 10, levels: int = 5) -> DataFrame:
    """(id, community): well-connected communities of large modularity; a community has the name of one of its nodes.

    Local moves place the nodes; inside each community they are placed anew, starting alone, and
    split into connected parts; the graph of these parts is moved next, starting from the
    communities.  Parts are what later levels move, so a community may still be taken apart.  At the
    end a community falls into its connected parts.  Where moves gave less modularity than connected
    components have, communities are merged by their gains instead; if that gives less too, the
    components are taken.
    """
    graph = materialize(edges.where("weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")), "graph")
    found = connected_parts(leveled_moves(graph, rounds, levels), graph)
    whole = components(graph).select(F.col("node").alias("id"), F.col("root").alias("community"))
    value = lambda membership: modularity(membership, graph).first()["modularity"] or 0.0
    least = value(whole)
    if value(found) >= least:
        return _with_every_end(found, edges)
    found = connected_parts(merged_by_gain(graph), graph)
    return _with_every_end(found if value(found) >= least else whole, edges)


def _with_every_end(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends that have no link of positive weight, or only to themselves, are alone."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    return ends.join(membership, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def inside(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The edges whose ends are in one community."""
    for end in ("a", "b"):
        edges = edges.join(membership.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in")), end)
    return edges.where("a_in = b_in").select("a", "b", "weight")


def connected_parts(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): each community's connected parts, by the smallest id in them."""
    parts = components(inside(edges, membership))
    return materialize(membership.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("community")), "parts")


def contracted(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The graph of communities.  Weights inside one become a loop, which counts twice in its strength as both ends did."""
    for end in ("a", "b"):
        edges = edges.join(membership.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in")), end)
    return materialize(edges.groupBy(F.least("a_in", "b_in").alias("a"), F.greatest("a_in", "b_in").alias("b")).agg(F.sum("weight").alias("weight")), "contracted")


def leveled_moves(edges: DataFrame, rounds: int, levels: int) -> DataFrame:
    """(id, community) by local moves on a graph that is contracted by its refined parts."""
    graph, start, at = edges, None, None
    for _ in range(levels):
        moved = local_moves(graph, rounds, start)
        refined = connected_parts(local_moves(graph, rounds, within=moved), graph)
        up = refined.join(moved.select("id", F.col("community").alias("of")), "id")
        base = up if at is None else at.select(F.col("id").alias("node"), F.col("part").alias("id")).join(up, "id").select(F.col("node").alias("id"), "community", "of")
        at = materialize(base.select("id", F.col("community").alias("part"), F.col("of").alias("community")), "placed")
        nodes, parts = up.count(), up.select("community").distinct().count()
        if parts in (nodes, 1):
            break
        graph = contracted(graph, refined)
        # The community of a part is named by one of its parts, as those are the nodes now.
        of = up.select(F.col("community").alias("id"), "of").distinct()
        named = of.groupBy("of").agg(F.min("id").alias("community"))
        start = materialize(of.join(named, "of").select("id", "community"), "start")
    # The nodes themselves once more, from where the levels left them.
    return local_moves(edges, rounds, at.select("id", "community"))


def merged_by_gain(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, community): neighbours that are each other's best gain of modularity are merged until none gains."""
    graph, at = edges, None
    for _ in range(rounds):
        links = both_ways(graph)
        strength = materialize(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "strength")
        m2 = strength.agg(F.sum("k").alias("m")).first()["m"]
        rated = graph.where("a <> b").join(strength.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(strength.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
        rated = rated.select("a", "b", F.round(F.col("weight") - F.col("ka") * F.col("kb") / m2, 9).alias("gain")).where("gain > 0")
        either = rated.select(F.col("a").alias("x"), F.col("b").alias("y"), "gain").unionByName(rated.select(F.col("b").alias("x"), F.col("a").alias("y"), "gain"))
        best = either.groupBy("x").agg(F.min(F.struct(-F.col("gain"), F.least("x", "y"), F.greatest("x", "y"), "y")).alias("m")).select("x", F.col("m.y").alias("y"))
        mutual = best.join(best.select(F.col("x").alias("y"), F.col("y").alias("back")), "y").where("x = back AND x > y").select(F.col("x").alias("id"), F.col("y").alias("into"))
        step = materialize(strength.select("id").join(mutual, "id", "left").select("id", F.coalesce("into", "id").alias("community")), "merged")
        if at is None:
            at = step
        else:
            at = materialize(at.withColumnRenamed("community", "c").join(step.select(F.col("id").alias("c"), "community"), "c").select("id", "community"), "merged")
        if step.where("id <> community").limit(1).count() == 0:
            break
        graph = contracted(graph, step)
    return at


def local_moves(edges: DataFrame, rounds: int = 10, start: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, community): deterministic local moves by modularity gain; a half of the nodes, by a hash of id and turn, moves at a time.

    Nodes start alone or as ``start`` has them.  With ``within`` (id, community) they move inside
    these communities only; gains are those of the whole graph.
    """
    spark = edges.sparkSession
    links = materialize(both_ways(edges), "links")
    strength = materialize(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "strength")
    m2 = strength.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("m")).first()["m"]
    bonds = links if within is None else materialize(both_ways(inside(edges, within)), "bonds")
    at = strength.select("id", F.col("id").alias("community")) if start is None else strength.select("id").join(start, "id")
    at = materialize(at, "community")
    still = 0
    for turn in range(2 * rounds):
        sums = at.join(strength, "id").groupBy("community").agg(F.sum("k").alias("total"))
        to = bonds.where("src <> dst").join(at, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.sum("weight").alias("inside"))
        mine = at.select(F.col("id").alias("src"), F.col("community").alias("own")).join(strength.select(F.col("id").alias("src"), "k"), "src")
        stay = mine.select("src", F.col("own").alias("community"), F.lit(0.0).alias("inside"))
        options = to.unionByName(stay).groupBy("src", "community").agg(F.sum("inside").alias("inside"))
        rated = options.join(mine, "src").join(sums, "community")
        others = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        rated = rated.withColumn("gain", F.round(F.col("inside") - F.col("k") * others / m2, 9))
        best = rated.groupBy("src").agg(F.min(F.struct(-F.col("gain"), F.when(F.col("community") == F.col("own"), 0).otherwise(1), "community")).alias("b"))
        moves = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        new = materialize(at.join(best, F.col("id") == F.col("src"), "left").select("id", F.col("community").alias("old"), F.when(moves, F.coalesce("b.community", "community")).otherwise(F.col("community")).alias("community")), "community")
        still = 0 if new.where("community <> old").limit(1).count() else still + 1
        discard(spark, at)
        at = new.select("id", "community")
        if still == 3:
            break
    discard(spark, links, strength)
    return at


def community_stats(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, density) of (id, community)."""
    within = edges.join(membership.select(F.col("id").alias("a"), "community"), "a").join(membership.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
    return densities(membership, within.groupBy("community").agg(F.count("*").alias("m")))


def densities(membership: DataFrame, linked: DataFrame) -> DataFrame:
    """(community, size, density) of (id, community), with ``linked``: (community, m), the linked pairs inside each."""
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    n = F.col("size")
    return size.join(linked, "community", "left").select("community", "size", F.when(n > 1, 2 * F.coalesce("m", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("density"))


def linked_inside(ends: DataFrame, met: DataFrame) -> DataFrame:
    """(community, m): the pairs of each community in the company projection, which is not made for it.

    ``ends`` are ``pairs.about`` with communities, ``met`` the pair features of all that met.  Pairs
    that share a person or an address are counted over classes of companies that have the same; to
    them come the pairs that met and share neither.
    """
    placed = ends.where("community IS NOT NULL")
    classes = materialize(placed.groupBy("community", "persons", "addresses").agg(F.min("company").alias("class"), F.count("*").alias("size")), "classes")
    tagged = F.concat(F.transform("persons", lambda p: F.struct(F.lit("person").alias("kind"), p.alias("value"))), F.transform("addresses", lambda p: F.struct(F.lit("address").alias("kind"), p.alias("value"))))
    held = classes.select("community", "class", "size", F.explode(tagged).alias("attr"))
    other = held.select(F.col("community").alias("c"), F.col("class").alias("other"), F.col("size").alias("others"), F.col("attr").alias("b"))
    both = held.join(other, (F.col("community") == F.col("c")) & (F.col("attr") == F.col("b")) & (F.col("class") < F.col("other"))).select("community", "class", "other", "size", "others").distinct()
    own = classes.where((F.size("persons") > 0) | (F.size("addresses") > 0)).select("community", (F.col("size") * (F.col("size") - 1) / 2).cast("long").alias("m"))
    lone = met.where("same_community AND shared_directors = 0 AND shared_addresses = 0").join(placed.select(F.col("company").alias("company_a"), "community"), "company_a").groupBy("community").agg(F.count("*").alias("m"))
    return both.select("community", (F.col("size") * F.col("others")).alias("m")).unionByName(own).unionByName(lone).groupBy("community").agg(F.sum("m").alias("m"))


def modularity(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: weighted modularity of the partition."""
    return _modularity(_weights(membership, edges))


def projection_modularity(membership: DataFrame, met: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """``modularity`` of (id, community) in ``graph.company_projection``, of which only the pairs that met are read.

    Those who share an attribute (attr, company) are counted by community: of n who have it, k of
    them in a community, each of the k has n - 1 links for it, k - 1 of them inside.
    """
    met = met.select(F.col("company_a").alias("a"), F.col("company_b").alias("b"), F.col("shared_tenders").cast("double").alias("weight"))
    parts = _weights(membership, met)
    for members, weight in ((people, 2.0), (places, 1.5)):
        held = members.join(membership.withColumnRenamed("id", "company"), "company").groupBy("attr", "community").agg(F.count("*").alias("k"))
        n = members.groupBy("attr").agg(F.count("*").alias("n"))
        k = F.col("k")
        parts = parts.unionByName(held.join(n, "attr").select(F.col("community").alias("cs"), (k * (F.col("n") - 1) * weight).alias("total"), (k * (k - 1) * weight).alias("inside")))
    return _modularity(parts.groupBy("cs").agg(F.sum("total").alias("total"), F.sum("inside").alias("inside")))


def _weights(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(cs, total, inside): the weights of a community's ends, and of those whose other end is in it too."""
    placed = both_ways(edges).join(membership.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(membership.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    return placed.groupBy("cs").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))


def _modularity(per: DataFrame) -> DataFrame:
    sums = per.agg(F.sum("total").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return sums.select((F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def attribute_stars(members: DataFrame) -> DataFrame:
    """(a, b): each company with the smallest that has an attribute (attr, company) too; what pairs would connect is connected by these."""
    least = members.groupBy("attr").agg(F.min("company").alias("a"))
    return members.join(least, "attr").where("a <> company").select("a", F.col("company").alias("b")).distinct()


def cluster_behaviour(membership: DataFrame, facts: DataFrame, dim: DataFrame) -> DataFrame:
    """(community, cluster_tenders, captured, capture, concentration, entropy) of (company, community)."""
    met = facts.join(membership, "company").groupBy("community", "tender").agg(F.count("*").alias("n")).where("n > 1").select("community", "tender")
    won = met.join(dim.select("tender", "winner"), "tender").join(membership.select(F.col("company").alias("winner"), F.col("community").alias("cw")), "winner", "left")
    inside = won.where("community = cw").groupBy("community", "winner").agg(F.count("*").alias("wins"))
    p = F.col("wins") / F.col("total")
    shares = inside.withColumn("total", F.sum("wins").over(W.partitionBy("community")))
    per = shares.groupBy("community").agg(F.sum("wins").alias("captured"), (F.max("wins") / F.sum("wins")).alias("concentration"), F.sum(-p * F.log(p)).alias("h"), F.count("*").alias("winners"))
    entropy = F.when(F.col("winners") > 1, F.col("h") / F.log("winners")).otherwise(0.0)
    counted = met.groupBy("community").agg(F.count("*").alias("cluster_tenders"))
    out = counted.join(per, "community", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("community", "cluster_tenders", F.coalesce("captured", F.lit(0)).alias("captured"), zero(F.col("captured") / F.col("cluster_tenders")).alias("capture"), zero(F.col("concentration")).alias("concentration"), zero(entropy).alias("entropy"))


def memberships(companies: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community) of every row of (id): the communities of ``edges``; one without links is its own."""
    found = communities(edges)
    alone = companies.select("id").distinct().join(found, "id", "left_anti")
    return materialize(found.unionByName(alone.select("id", F.col("id").alias("community"))), "membership")


def company_centrality(edges: DataFrame, companies: DataFrame, measures=("pagerank", "eigenvector", "betweenness", "clustering")) -> DataFrame:
    """(company, degree_centrality, weighted_degree, ...) of the companies (id), over the graph of all nodes."""
    out = companies.join(degrees(edges).drop("neighbours"), "id")
    for name in measures:
        out = out.join(globals()[name](edges), "id", "left")
    return materialize(out.withColumnRenamed("id", "company"), "centrality")


def company_communities(membership: DataFrame, edges: DataFrame | None, facts: DataFrame, dim: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(company, community_size, ..., cluster_tenders) of (id, community): size, density and bidding of its community; ``stats`` stand in for those of ``edges``."""
    members = membership.withColumnRenamed("id", "company")
    stats = materialize(community_stats(membership, edges) if stats is None else stats, "densities")
    per = stats.join(cluster_behaviour(members, facts, dim), "community", "left")
    names = {"size": "community_size", "density": "community_density", "entropy": "cluster_rotation_entropy", "capture": "cluster_capture_rate", "concentration": "cluster_win_concentration"}
    return materialize(members.join(per, "community").select("company", *[F.col(c).alias(to) for c, to in names.items()], "cluster_tenders"), "communities")


def dense_groups(edges: DataFrame, min_size: int = 3, min_weight: float = 3.0) -> DataFrame:
    """(members, size, mean_weight): maximal cliques on edges of ``min_weight`` or more, the strongest first."""
    strong = materialize(edges.where(F.col("weight") >= min_weight).select("a", "b", "weight"), "strong")
    return maximal_cliques(strong, min_size).orderBy(F.desc("mean_weight"), F.desc("size"), "members")
