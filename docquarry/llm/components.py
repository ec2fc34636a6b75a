"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import remove, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(v, m): m is the smallest node that v reaches; only nodes other than m itself have a row.

    ``edges``: columns a, b (long, not null). Each step is a grouped minimum and a join, so a node with very many edges is
    pre-aggregated and its join can be split. Steps are written to the shared folder, each removed when the next one is there;
    their number grows with the logarithm of the longest path. No edges, no rows; repeated edges and loops count for nothing.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), folder, f"{name}-0"
    )
    state, step = _state(now), 0
    while state[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = (
            large.join(low, "v").select(F.explode(F.array(F.struct("m", "least"), F.struct(F.col("v").alias("m"), "least"))).alias("e"))
            .select(F.col("e.m").alias("v"), F.col("e.least").alias("m"))
            .where("v <> m")
            .distinct()
        )
        step += 1
        now = written(small, folder, f"{name}-{step}")
        after = _state(now)
        remove(edges.sparkSession, f"{folder}/{name}-{step - 1}")  # superseded: the next step reads what was written last
        if after == state:
            break
        state = after
    return now
