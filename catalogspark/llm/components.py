"""Connected components of an edge table by alternating large and small stars, every round a written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.session import written


MOST_HUBS = 10_000
#: Edges below which no node can have too many for one task.
LEAST_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def met(edges: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """edges with the facts (u, m, n) of their u; n is the number of u's edges, total at least half the number of all edges."""
    if total <= LEAST_EDGES:
        return edges.join(facts, "u")
    hub = F.col("n") > max(1, total // MOST_HUBS)
    hubs = F.broadcast(facts.filter(hub))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(facts.filter(~hub), "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node of its component.

    Minima are aggregated before they are joined back. Nodes with more than 1 / MOST_HUBS of all edges, of which there are
    at most 2 * MOST_HUBS, get theirs by broadcast, so that their edges stay where they are; the rest are joined.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = met(both, least, seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, low, 2 * seen[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
