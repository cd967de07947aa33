"""Connected components over a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vigil.llm.shared import Work


def components(links: DataFrame, work: Work | None = None) -> DataFrame:
    """links: a, b (long). node, label for every node with a link; the label is the component's smallest node.

    Each round sends every neighbour of a node to the smallest of them; larger ones first, then the others. The
    number of rounds grows with the logarithm of the longest chain. A hub's links are aggregated before they are
    shuffled and joined as a skewed key, never gathered. Every round is one job, written to the shared folder, and the round
    before it is deleted.
    """
    work = work or Work(links.sparkSession, "components")
    edges = work.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        # The rounds are over when nothing has moved; every node hangs on its component's smallest then.
        seen = Observation()
        state = F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("sum")
        done, edges = edges, work.write(small.filter("u <> v").distinct().observe(seen, *state), "edges")
        work.drop(done)
        if seen.get == before or seen.get["n"] == 0:
            break
        before = seen.get
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    out = work.write(labels.union(roots), "labels")
    work.drop(edges)
    return out
