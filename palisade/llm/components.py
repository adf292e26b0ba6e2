"""Connected components of a large link table."""

from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import cleaned, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for all nodes of ``links`` (a, b: long).

    Large-star and small-star steps in turn: each round points nodes to the smallest node among their neighbours, so a
    chain halves and a star is done at once. Only minima are aggregated (with partial sums); a hub's links are never
    brought together in one list. Every round is stored and its helpers are removed; a few numbers go to the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    spark = links.sparkSession
    for _ in range(most_rounds):
        with cleaned(spark):
            # large star: every larger neighbour of u points to the smallest node around u
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = stored(large.distinct(), "large")
            # small star: u and its smaller neighbours point to the smallest of them
            low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small", outer=True)
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            break
        before = state
        # done when every node has one link and no root is a child
        if state.n == state.nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components: not settled")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
