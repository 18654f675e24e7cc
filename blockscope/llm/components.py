"""Connected components of a link table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import stored

_ROUNDS = 100


def _neighbours_and_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both, both.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour or itself."""
    both, least = _neighbours_and_least(edges)
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return (
        moved.unionByName(least.select("a", F.col("least").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has a link; the root is the least node it reaches.

    Rounds grow with the logarithm of the number of nodes.  Only link rows move, each
    round is written to the shared folder, and nothing is gathered on the driver but
    three numbers a round.  No link gives no rows.  Self links and repeated links are harmless.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    # from the larger node to the smaller
    edges = stored(
        links.select(high.alias("a"), low.alias("b")).where(F.col("a") != F.col("b")).distinct(),
        "links",
    )
    seen = None
    for _ in range(_ROUNDS):
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s"),
        ).first()
        if state.n == 0 or state == seen:
            break
        seen = state
        edges = stored(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
