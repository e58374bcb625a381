"""Connected components of an edge table, as rounds of joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, salted_join


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) + 1


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round offers to a node, and to its present parent, the smallest grandparent among the node's
    neighbours, and halves paths to the root, so that rounds grow with the logarithm of the longest
    chain. Every round is written to the shared folder. Minimums are taken by partial aggregates, so a
    root with many children costs no task more than its share.

    Empty input gives no rows; repeated edges and loops change nothing. Raises if ``max_rounds`` pass
    without a fixed point, rather than return a partial answer.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = scratch.keep(both)
    degrees = scratch.keep(links.groupBy("b").agg(F.count("*").alias("n")))
    nodes, n_links = degrees.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    state = scratch.keep(
        links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("f"))
    )
    for _ in range(max_rounds):
        # the root of a large component is the parent of very many nodes, a star's centre the neighbour
        up = state.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        children = state.groupBy("f").agg(F.count("*").alias("n"))
        grand = scratch.keep(salted_join(state, up, "f", _salt("node"), children, nodes))
        met = salted_join(links, grand.select(F.col("node").alias("b"), "gf"), "b", _salt("a"), degrees, n_links)
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("gf").alias("m"))
        offered = grand.join(near, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("x"), F.least("m", "gf", "f").alias("c"), F.col("f").alias("old")),
                    F.struct(F.col("f").alias("x"), F.col("m").alias("c"), F.lit(None).cast("bigint").alias("old")),
                )
            ).alias("o")
        )
        new = offered.groupBy("o.x").agg(F.min("o.c").alias("c"), F.min("o.old").alias("old"))
        state = scratch.keep(new.select(F.col("x").alias("node"), F.least("c", "old").alias("f"), "old"))
        if state.filter(F.col("f") != F.col("old")).limit(1).count() == 0:
            return state.select("node", F.col("f").alias("root"))
        state = state.select("node", "f")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
