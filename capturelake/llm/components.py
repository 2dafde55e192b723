"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.session import work_dir

from .bitmaps import bitmap_of, flag_by


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root of columns a and b; root is the smallest node of the component.

    Large-star and small-star rounds: neighbours are attached to the smallest
    node known until nothing changes.  Each round is a written table, minima
    combine before the shuffle, and the edges of a hub that is the smallest
    node around stay where they lie.
    """
    spark = edges.sparkSession
    where = work_dir(spark, "components")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.parquet(f"{where}/{name}")

    def sides(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select(
            "col.*"
        )

    # a is the larger end
    now = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "start"
    )
    state, k = None, 0
    while True:
        both = sides(now)
        # nodes that have a smaller neighbour; a hub that is the smallest of its own keeps its edges where they lie
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), f"least{k}")
        keys = bitmap_of(least.select(F.xxhash64("a").alias("key")))
        flagged = flag_by(both.where("b > a"), F.xxhash64("a"), keys, "moves")
        stay = flagged.where(~F.col("moves")).select(F.col("b").alias("a"), F.col("a").alias("b"))
        moved = flagged.where("moves").join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
        large = stored(stay.union(moved).where("a != b").distinct(), f"large{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = stored(small.where("a != b").distinct(), f"small{k}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, k = new, k + 1
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
