"""Connected components by contraction to least neighbours; all tables stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """links: a, b. Returns v, c for every vertex of a link: c is the least vertex reachable.

    In each round every vertex with a lower neighbour goes to the least one, paths of such steps are followed to their
    ends by doubling, and the links are drawn anew between the ends. A vertex that nothing joins in a round has a lower
    neighbour in the next, so two rounds at least halve the vertices that still have links: rounds grow with the logarithm
    of the vertices, whatever their order, and most_rounds is out of reach. It is an error to come to it."""
    vertices = stash(links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).distinct(), "vertices")
    left = stash(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    labels = None
    for _ in range(most_rounds):
        if not left.limit(1).count():
            break
        ends = _ends(left)
        to = lambda name: ends.select(F.col("v").alias(name), F.col("c").alias(f"{name}_end"))  # noqa: B023, E731
        lo, hi = F.coalesce("lo_end", "lo"), F.coalesce("hi_end", "hi")
        drawn = left.join(to("lo"), "lo", "left").join(to("hi"), "hi", "left").where(lo != hi)
        drawn = stash(drawn.select(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")).distinct(), "links")
        if labels is None:
            labels = ends
        else:
            new = stash(labels.join(to("c"), "c", "left").select("v", F.coalesce("c_end", "c").alias("c")).unionByName(ends), "labels")
            unstash(labels, ends)
            labels = new
        unstash(left)
        left = drawn
    else:
        if left.limit(1).count():
            raise RuntimeError(f"components: links are left after {most_rounds} rounds")
    unstash(left)
    if labels is None:
        return vertices.select("v", F.col("v").alias("c"))
    out = stash(vertices.join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("c")), "components")
    unstash(vertices, labels)
    return out


def _ends(links: DataFrame) -> DataFrame:
    """v, c for every vertex with a lower neighbour: c is where the steps to the least neighbour end."""
    steps = stash(links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("c")), "steps")
    while True:
        far = steps.join(steps.select(F.col("v").alias("c"), F.col("c").alias("far")), "c", "left")
        new = stash(far.select("v", F.coalesce("far", "c").alias("c"), F.col("far").isNotNull().alias("moved")), "steps")
        moved = new.where("moved").limit(1).count()
        path, new = new._quillon_path, new.drop("moved")
        new._quillon_path = path
        unstash(steps)
        steps = new
        if not moved:
            return steps
