"""Connected components of an edge table, as rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.plans.lineage import HOT_KEYS, cut


def _toward_minimum(pairs: DataFrame, at_most: int) -> DataFrame:
    """Add to each (u, v) the smallest v of its u: ``m``. The minimum is combined map-side.

    Of ``at_most`` pairs, at most ``HOT_KEYS`` nodes can have over ``at_most / HOT_KEYS``: the minima of those
    hubs are broadcast, so a hub's pairs stay where they are. The pairs of other nodes meet by a shuffle.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_pairs"))
    hub = F.col("_pairs") > at_most // HOT_KEYS
    at_hubs = pairs.join(F.broadcast(least.filter(hub).select("u", "m")), "u", "left")
    rest = at_hubs.filter("m is null").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return at_hubs.filter("m is not null").union(rest)


def _large_star(edges: DataFrame, at_most: int) -> DataFrame:
    """Link each larger neighbour of a node to the smallest in the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    starred = _toward_minimum(both, 2 * at_most)
    return starred.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, at_most: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    starred = _toward_minimum(edges, at_most)
    inner = starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(starred.select("u", F.col("m").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


#: Edges in a checkpointed partition, so that the late rounds of few edges write few files.
EDGES_A_FILE = 250_000


def _settled(edges: DataFrame, at_most: int) -> DataFrame:
    return cut(edges.coalesce(at_most // EDGES_A_FILE + 1))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (``a``, ``b``): one row (node, component) for
    each node on an edge, the component named by its smallest node.

    Alternates a large-star and a small-star contraction until the edge set stays the same; the
    number of rounds grows with the logarithm of the component size. Every round is checkpointed in
    the shared folder, so a lost executor costs one round at most. Self loops keep their node as a
    component of one; edges with a null end are left out; repeated edges change nothing. An empty
    table gives an empty result. No task gets all edges of a hub (see :func:`_toward_minimum`).
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = cut(pairs.distinct())
    current = pairs.filter("u <> v")
    last = _digest(current)
    for _ in range(max_rounds):
        starred = _settled(_large_star(current, last[0]).distinct(), last[0])
        current = _settled(_small_star(starred, last[0]).distinct(), last[0])
        now = _digest(current)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    everyone = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return everyone.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
