"""Grouping a neighbour graph by label propagation under must-link and cannot-link constraints.

A pass visits every node once: it takes the label with the largest weight around it. Nodes are visited by colours of a
proper colouring, in an order drawn from the seed for each pass: no two nodes of a colour are neighbours, so all of a
colour can be visited at once, and the outcome is that of visiting one node after the other. The colouring is the
greedy one in the order of the nodes' hashes, which rounds over all nodes find just as well as one loop does: a node
is coloured when its neighbours with smaller hashes are.

Components of the graph with its must-links don't influence each other. Small ones are settled by a task each, as arrays;
those with more edges than ``ONE_TASK`` all together, colour by colour, with every step a job over all tasks. Both ways give
the same labels.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.operators.graph import connected_components
from kinlight.operators.vectors import NEIGHBOURS, SIMILARITY, knn, medoid, nearest_centroid, unit_mean
from kinlight.plans.lineage import BROADCAST_ROWS, checkpoint_dir, cut, join_spread, remove_folder
from kinlight.plans.numbering import numbered

MAX_PASSES = 30
SEED = 20260827
#: Edges, each way, of a component that one task settles as arrays: about 1 GB at most.
ONE_TASK = 5_000_000
#: Edges that are left to colour up to which one task does so.
COLOURED_AT_ONCE = 500_000
#: Decimals to which weights of labels are compared.
PLACES = 9


def build_edges(neighbours: DataFrame, cannot: DataFrame | None = None) -> DataFrame:
    """The undirected multigraph (src, dst, weight) of a neighbour table: each entry goes both ways, so
    mutual neighbours weigh double. Self loops and pairs in ``cannot(a, b)`` are left out."""
    e = neighbours.filter("src <> dst").select("src", "dst", F.col("similarity").alias("weight"))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if cannot is None:
        return both
    barred = cannot.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    barred = barred.union(cannot.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    return both.join(barred, ["src", "dst"], "left_anti")


def turn_of(colour: int, nth_pass: int, seed: int) -> bytes:
    """What the colours of a pass are sorted by."""
    return hashlib.sha256(f"{seed}:{nth_pass}:{colour}".encode()).digest()


def greedy_colours(around: dict[int, set[int]], rank: dict[int, tuple[int, int]], given: dict[int, set[int]] | None = None) -> dict[int, int]:
    """Each node, in the order of ``rank``, gets the least colour that no neighbour has; ``given`` are colours of
    neighbours outside."""
    colour: dict[int, int] = {}
    for v in sorted(around, key=rank.__getitem__):
        taken = {colour[u] for u in around[v] if u in colour} | (given or {}).get(v, set())
        c = 0
        while c in taken:
            c += 1
        colour[v] = c
    return colour


def merged_labels(label: dict[int, int], must: list[tuple[int, int]]) -> dict[int, int]:
    """Labels with those joined that must-linked nodes have, as the least of them."""
    root = {x: x for x in label.values()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in must:
        if a in label and b in label:
            low, high = sorted((find(label[a]), find(label[b])))
            root[high] = low
    return {v: find(x) for v, x in label.items()}


def propagate(edges: dict[int, dict[int, float]], must: list[tuple[int, int]], rank: dict[int, tuple[int, int]], seed: int, passes: int = MAX_PASSES) -> dict[int, int]:
    """Label propagation on one component: every node takes the label with the largest weight around it, the smaller
    label on ties, colour by colour, until a pass changes nothing. Must-links are merged before and after."""
    around: dict[int, set[int]] = {v: set() for v in rank}
    for v, near in edges.items():
        for u in near:
            around[v].add(u)
            around[u].add(v)
    by_colour: dict[int, list[int]] = {}
    for v, c in greedy_colours(around, rank).items():
        by_colour.setdefault(c, []).append(v)
    label = merged_labels({v: v for v in rank}, must)
    for n in range(passes):
        changed = False
        for c in sorted(by_colour, key=lambda c: turn_of(c, n, seed)):
            for v in by_colour[c]:
                weight: dict[int, float] = {}
                for u, w in edges.get(v, {}).items():
                    weight[label[u]] = weight.get(label[u], 0.0) + w
                best = min(weight, key=lambda x: (-round(weight[x], PLACES), x), default=label[v])
                if best != label[v]:
                    label[v], changed = best, True
        if not changed:
            break
    return merged_labels(label, must)


def _coloured(start: np.ndarray, other: np.ndarray, order: np.ndarray) -> np.ndarray:
    """:func:`greedy_colours` of nodes whose neighbours are ``other[start[v] : start[v + 1]]``."""
    colour = np.full(len(order), -1, np.int32)
    for v in order:
        taken = colour[other[start[v] : start[v + 1]]]
        free = np.ones(len(taken) + 1, bool)
        free[taken[(taken >= 0) & (taken <= len(taken))]] = False
        colour[v] = free.argmax()
    return colour


def propagate_arrays(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, must: list[tuple[int, int]], nodes: np.ndarray, rank: np.ndarray, seed: int, passes: int = MAX_PASSES) -> np.ndarray:
    """:func:`propagate` on arrays: the label of each of ``nodes``, sorted, which have hashes ``rank``, over edges of
    one row a pair."""
    u, v = np.searchsorted(nodes, src).astype(np.int32), np.searchsorted(nodes, dst).astype(np.int32)
    ends = np.unique(np.concatenate([u.astype(np.int64) * len(nodes) + v, v.astype(np.int64) * len(nodes) + u]))
    one, other = np.divmod(ends, len(nodes))
    colour = _coloured(np.searchsorted(one, np.arange(len(nodes) + 1)), other, np.lexsort((nodes, rank)))
    del ends, one, other
    order = np.lexsort((v, u, colour[u]))
    u, v, weight = u[order], v[order], weight[order]
    colours = np.unique(colour)
    part = np.searchsorted(colour[u], np.arange(len(colours) + 1))
    first = merged_labels({n: n for n in nodes.tolist()}, must)
    label = np.searchsorted(nodes, np.array([first[n] for n in nodes.tolist()], np.int64))
    for nth in range(passes):
        changed = False
        for c in sorted(colours.tolist(), key=lambda c: turn_of(c, nth, seed)):
            here = slice(part[c], part[c + 1])
            if here.start == here.stop:
                continue
            pair = u[here].astype(np.int64) * len(nodes) + label[v[here]]
            by = np.argsort(pair, kind="stable")
            pair = pair[by]
            at = np.flatnonzero(np.diff(pair, prepend=-1))
            node, near = np.divmod(pair[at], len(nodes))
            total = np.round(np.add.reduceat(weight[here][by], at), PLACES)
            best = np.lexsort((near, -total, node))
            best = best[np.flatnonzero(np.diff(node[best], prepend=-1))]
            if (label[node[best]] != near[best]).any():
                label[node[best]], changed = near[best], True
        if not changed:
            break
    last = merged_labels(dict(zip(nodes.tolist(), nodes[label].tolist(), strict=True)), must)
    return np.array([last[n] for n in nodes.tolist()], np.int64)


def _rank(node: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def _looked_up(rows: DataFrame, table: DataFrame, n: int, key: str, salt_by: str) -> DataFrame:
    """``rows`` with what a table of ``n`` rows says of their key: two numbers a row are sent to all tasks while they
    are few, and joined on spread keys beyond."""
    return rows.join(F.broadcast(table), key, "left") if n <= BROADCAST_ROWS else join_spread(rows, table, [key], salt_by)


def colours_of(edges: DataFrame, seed: int, one_task: int = COLOURED_AT_ONCE) -> DataFrame:
    """The greedy colouring of ``edges(src, dst)``, both ways: (node, colour). In each round the nodes whose
    uncoloured neighbours all have larger hashes get the least colour that none of their neighbours has; what few edges
    are left in the end is coloured by one task."""
    rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    left = cut(rows.withColumns({"p": F.struct(_rank("u", seed).alias("h"), F.col("u").alias("n")), "q": F.struct(_rank("v", seed).alias("h"), F.col("v").alias("n")), "c": F.lit(None).cast("int")}))
    done = []
    while left.count() > one_task:
        waits = F.max(F.col("c").isNull() & (F.col("q") < F.col("p"))).alias("waits")
        used = F.collect_set("c")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        ready = cut(left.groupBy("u").agg(waits, free.alias("colour")).filter("not waits").select(F.col("u").alias("node"), F.col("colour").cast("int").alias("colour")))
        done.append(ready)
        n = ready.count()
        rest = _looked_up(left, ready.select(F.col("node").alias("u"), F.lit(True).alias("gone")), n, "u", "v").filter("gone is null").drop("gone")
        seen = _looked_up(rest, ready.select(F.col("node").alias("v"), F.col("colour").alias("new")), n, "v", "u")
        left = cut(seen.select("u", "v", "p", "q", F.coalesce("c", "new").alias("c")))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, set[int]] = {}
        given: dict[int, set[int]] = {}
        rank = {}
        for u, v, h, c in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["h"].tolist(), pdf["c"].tolist(), strict=True):
            around.setdefault(u, set())
            rank[u] = (h, u)
            if c == c and c is not None:
                given.setdefault(u, set()).add(int(c))
            else:
                around[u].add(v)
        found = greedy_colours(around, rank, given)
        return pd.DataFrame({"node": list(found), "colour": list(found.values())})

    few = left.select("u", "v", F.col("p.h").alias("h"), "c", F.lit(0).alias("all")).groupBy("all").applyInPandas(finish, "node long, colour int")
    for more in done:
        few = few.unionByName(more)
    return cut(few)


def _by_colours(edges: DataFrame, must: DataFrame | None, seed: int, passes: int, one_task: int) -> DataFrame:
    """Labels (node, label) of components of any size over ``edges(src, dst, weight)``, one row a pair of nodes, with
    their must-links: one job a colour, which reads that colour's edges only."""
    spark = edges.sparkSession
    links = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    colours = colours_of(links, seed, min(one_task, COLOURED_AT_ONCE))
    n = colours.count()
    folder = f"{checkpoint_dir(spark)}/colours-{uuid.uuid4().hex}"
    try:
        coloured = _looked_up(edges, colours.withColumnRenamed("node", "src"), n, "src", "dst")
        coloured.select("src", "dst", "weight", "colour").repartition("colour", F.pmod(F.xxhash64("src"), F.lit(64))).write.partitionBy("colour").parquet(folder)
        present = sorted(r.colour for r in colours.select("colour").distinct().collect())
        stored = spark.read.schema("src long, dst long, weight double, colour int").parquet(folder)
        label = colours.select("node", F.col("node").alias("label"))
        if must is not None:
            bound = connected_components(must.select("a", "b"))
            together = label.select("node").union(bound.select("node")).distinct()
            label = together.join(bound, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
        label = cut(label)
        n = label.count()
        for nth in range(passes):
            changed = False
            for c in sorted(present, key=lambda c: turn_of(c, nth, seed)):
                near = _looked_up(stored.filter(F.col("colour") == c), label.select(F.col("node").alias("dst"), "label"), n, "dst", "src")
                weights = near.groupBy("src", "label").agg(F.round(F.sum("weight"), PLACES).alias("w"))
                best = weights.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("neg"))).alias("m")).select(F.col("src").alias("node"), (-F.col("m.neg")).alias("best"))
                label = cut(label.select("node", "label").join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label"), (F.col("best") != F.col("label")).alias("changed")))
                changed = changed or not label.filter("changed").isEmpty()
            if not changed:
                break
        label = label.select("node", "label")
        if must is None:
            return label
        ends = must.select("a", "b").join(label.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(label.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        joined = connected_components(ends, "x", "y").select(F.col("node").alias("label"), "component")
        return cut(join_spread(label, joined, ["label"], "node").select("node", F.coalesce("component", "label").alias("label")))
    finally:
        remove_folder(spark, folder)


def chinese_whispers(nodes: DataFrame, edges: DataFrame, must: DataFrame | None = None, seed: int = SEED, passes: int = MAX_PASSES, one_task: int = ONE_TASK) -> DataFrame:
    """Labels of all ``nodes(node)`` over ``edges(src, dst, weight)``: (node, label), where a label is its
    group's smallest node. Nodes without edges are groups of their own."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if must is not None:
        must = cut(must.select("a", "b"))
        links = links.union(must)
    parts = cut(connected_components(links))
    pairs = edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    rows = join_spread(pairs, parts.withColumnRenamed("node", "src"), ["src"], "dst", "inner").select("component", "src", "dst", "weight", F.lit(0).alias("kind"))
    if must is not None:
        rows = rows.union(must.join(parts.withColumnRenamed("node", "a"), "a").select("component", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.0).alias("weight"), F.lit(1).alias("kind")))
    rows = cut(rows)
    # at most one in ``one_task`` edges is a component of that size
    large = cut(rows.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > one_task).select("component", F.lit(True).alias("large")))
    marked = rows.join(F.broadcast(large), "component", "left")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, kind = (pdf[c].to_numpy() for c in ("src", "dst", "kind"))
        nodes, at = np.unique(np.concatenate([src, dst]), return_index=True)
        rank = np.concatenate([pdf["p"].to_numpy(), pdf["q"].to_numpy()])[at]
        edge, bound = kind == 0, kind == 1
        must = list(zip(src[bound].tolist(), dst[bound].tolist(), strict=True))
        return pd.DataFrame({"node": nodes, "label": propagate_arrays(src[edge], dst[edge], pdf["weight"].to_numpy()[edge], must, nodes, rank, seed, passes)})

    ranked = marked.filter("large is null").drop("large").withColumns({"p": _rank("src", seed), "q": _rank("dst", seed)})
    settled = ranked.groupBy("component").applyInPandas(settle, "node long, label long")
    if not large.isEmpty():
        rest = marked.filter("large")
        bound = None if must is None else rest.filter("kind = 1").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        settled = settled.unionByName(_by_colours(rest.filter("kind = 0").select("src", "dst", "weight"), bound, seed, passes, one_task))
    settled = cut(settled.distinct())
    names = settled.groupBy("label").agg(F.min("node").alias("name"))
    named = join_spread(settled, names, ["label"], "node", "inner").select("node", F.col("name").alias("label"))
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def compact_labels(labels: DataFrame) -> DataFrame:
    """Number groups from 0 in the order of their first node: (node, label, group_no). Groups are numbered
    by rank of their first nodes, one row a group."""
    firsts, _ = numbered(labels.groupBy("label").agg(F.min("node").alias("first")), ["first"])
    return labels.join(firsts.select("label", F.col("row_no").alias("group_no")), "label")


def map_constraints(links: DataFrame, faces: DataFrame, kind: int) -> DataFrame:
    """Face links of one kind among the faces at hand, smaller id first: (a, b)."""
    ids = faces.select(F.col("face_id").alias("_f"))
    chosen = links.filter(F.col("kind") == kind).select(F.least("face_a", "face_b").alias("a"), F.greatest("face_a", "face_b").alias("b"))
    return chosen.join(ids, F.col("a") == F.col("_f"), "left_semi").join(ids, F.col("b") == F.col("_f"), "left_semi").distinct()


def cluster_faces(vectors: DataFrame, ignored: DataFrame | None = None, links: DataFrame | None = None, least: float = SIMILARITY, k: int = NEIGHBOURS) -> DataFrame:
    """Group faces end to end: drop the ignored, find neighbours, propagate labels. One row per face:
    (face_id, cluster_id, size, medoid_face_id); a cluster is named by its smallest face."""
    kept = vectors if ignored is None else vectors.join(ignored.select("face_id"), "face_id", "left_anti")
    cannot = None if links is None else map_constraints(links, kept, 1)
    must = None if links is None else map_constraints(links, kept, 0)
    edges = cut(build_edges(knn(kept, k, least), cannot))
    labels = cut(chinese_whispers(kept.select(F.col("face_id").alias("node")), edges, must).select(F.col("node").alias("face_id"), F.col("label").alias("cluster_id")))
    members = kept.select("face_id", "vector").join(labels, "face_id")
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    centre = medoid(members, "cluster_id").withColumnRenamed("medoid", "medoid_face_id")
    return labels.join(sizes, "cluster_id").join(centre, "cluster_id").select("face_id", "cluster_id", "size", "medoid_face_id")


def recognise(clusters: DataFrame, vectors: DataFrame, people: DataFrame, least: float = 0.5) -> DataFrame:
    """Known people for clusters by their centroids: (cluster_id, person_id, similarity)."""
    centroids = unit_mean(clusters.join(vectors.select("face_id", "vector"), "face_id"), "cluster_id", zero_as_null=True)
    found = nearest_centroid(centroids.filter("centroid is not null"), people, least, id_col="cluster_id")
    return found.select(F.col("id").alias("cluster_id"), F.col("name").alias("person_id"), "similarity")


def absorb(person: DataFrame, clusters: DataFrame, least: float = 0.5) -> DataFrame:
    """Unnamed clusters whose centroid is as near to the one person's: (cluster_id, similarity)."""
    from kinlight.functions.vectors import dot

    one = person.limit(1).select(F.col("centroid").alias("_c"))
    near = clusters.filter("person_id is null").crossJoin(F.broadcast(one)).withColumn("similarity", dot("centroid", "_c"))
    return near.filter(F.col("similarity") >= least).select("cluster_id", "similarity")
