"""Keyed merges over immutable snapshots.

Every operator returns new frames; nothing is updated in place.  Winners per
key are taken with ``row_number() = 1``, for which Spark keeps one row per
key and task before the shuffle, so a hot key never reaches one task whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(*parts: Column | str) -> Column:
    """sha256 over the natural key, so that reruns make the same ids.

    Parts are joined with ``|``; a backslash or ``|`` inside a part is escaped
    and a null is ``\\N``, so different keys never join to one string.
    """

    def part(p: Column | str) -> Column:
        text = (F.col(p) if isinstance(p, str) else p).cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.sha2(F.concat_ws("|", *[part(p) for p in parts]), 256)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    return top_per_key(df, keys, [F.desc(c) for c in order_cols])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first of an order, else the one whose other columns are smallest, so that reruns agree."""
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    return top_per_key(df, keys, [*(order or []), *rest]) if order or rest else df.distinct()


def insert_ignore(
    existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Rows of ``new`` that an insert with "on conflict do nothing" adds."""
    return first_per_key(new, keys, order).join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def merge_rows(*frames: DataFrame) -> DataFrame:
    """One row out of one-row frames with different columns, without a join."""
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def insert_counts(new: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: offered, inserted and skipped."""
    both = merge_rows(counted(new, "offered"), counted(inserted, "inserted"))
    return both.withColumn("skipped", F.col("offered") - F.col("inserted"))


def upsert(
    existing: DataFrame,
    new: DataFrame,
    keys: list[str],
    cols: list[str],
    order: list[Column] | None = None,
) -> DataFrame:
    """Snapshot after "on conflict do update": only ``cols`` take new values; null keys are equal."""
    fresh = first_per_key(new, keys, order).withColumn("_new", F.lit(True)).alias("n")
    old = existing.withColumn("_old", F.lit(True)).alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    joined = old.join(fresh, same, "full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in cols:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in new.columns:
            out.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def lww_merge(local: DataFrame, incoming: DataFrame, key: list[str], updated: str = "updated_at") -> DataFrame:
    """Last writer wins; on a tie the incoming row does."""
    both = local.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return top_per_key(both, key, [F.desc(updated), F.desc("_side")]).drop("_side")


def run_ranks(key: int, name: str):
    """The function that adds to sorted batches each row's place in its run of equal keys; all is local, so that tasks need no import of this package."""

    def ranks(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            ends = pc.run_end_encode(keys).run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            rank = np.arange(len(keys), dtype=np.int64) - np.repeat(starts, ends - starts)
            if last is not None and keys[0].as_py() == last[0]:
                rank[: ends[0]] += seen
            last, seen = [keys[-1].as_py()], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:key], pa.array(rank)], [*batch.schema.names[:key], name])

    return ranks


def ranked_children(
    df: DataFrame, key: str, order: list[Column], path: str, position: str = "position", parts: int | None = None
) -> DataFrame:
    """Rows with their position, from 0, among the rows of their key.

    The rows are dealt by ranges of key and order, so that a hot key fills many
    tasks, and written once below ``path``, in the session's shared folder, with
    their place in their key's run.  Only a part's first run can go on from the
    part before, so what is added to it is one number a part.  ``order`` should
    be total; rows that tie in it stand in any order.
    """
    spark = df.sparkSession
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, F.asc(key), *order).sortWithinPartitions(F.asc(key), *order)
    run, taken = F.col(key).cast("string"), {c.lower() for c in df.columns}
    rank, part, place = (next(n for n in (("_" * k) + name for k in range(1, len(taken) + 2)) if n not in taken) for name in ("rank", "part", "place"))
    told = dealt.select("*", run.alias(rank))
    ranked = told.mapInArrow(run_ranks(len(df.columns), rank), T.StructType([*df.schema.fields, T.StructField(rank, T.LongType())]))
    ranked.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)).write.parquet(path)
    rows = spark.read.parquet(path)
    ends = rows.groupBy(part).agg(F.min_by(run, place), F.max_by(run, place), F.max_by(rank, place))
    before, last, seen = [0] * count, [], 0
    for own, first, final, ranked_last in sorted(ends.collect(), key=lambda r: r[0]):
        before[own] = seen if last == [first] else 0
        # a part of one run goes on with the run it is in
        last, seen = [final], ranked_last + 1 + (before[own] if first == final else 0)
    # a place is the row's number in its part, with the part above the 33rd bit
    first_run = F.col(rank) == F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    earlier = F.when(first_run, F.get(F.lit(before), F.col(part))).otherwise(F.lit(0))
    return rows.select(*df.columns, (F.col(rank) + earlier).cast("bigint").alias(position))


def group_ordered(df: DataFrame, key: str, order_cols: list[Column], value: list[str], name: str) -> DataFrame:
    """One ordered array of structs per key, for keys whose children fit one row.

    The sort keys lead the collected struct, so the array sorts after the
    aggregation and the shuffle needs no order.  ``ranked_children`` gives the
    same as rows with positions, for keys with any number of children.
    """
    lead = [c.alias(f"_k{i}") for i, c in enumerate(order_cols)]
    packed = F.struct(*lead, F.struct(*value).alias("v"))
    # no member is null, so this is the order of array_sort, which makes its order anew at every comparison
    collected = F.sort_array(F.collect_list(packed))
    return df.groupBy(key).agg(F.transform(collected, lambda x: x["v"]).alias(name))
