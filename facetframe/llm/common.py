"""What the operators share: row identity, running totals over the cluster, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..session import cut_lineage, shared_folder

#: A word of the contracts: a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many rows of a few short columns a table is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 50_000


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row; columns that have no hash go in as JSON."""
    parts = [F.to_json(F.struct(col(f.name))) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType,
                                                                         T.VariantType))
             else col(f.name) for f in df.schema.fields]
    return F.xxhash64(*[F.struct(p.isNull(), p) for p in parts])


def small(df: DataFrame) -> DataFrame:
    """Mark a checkpointed or written table for broadcast if its row count is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; smaller than a checkpoint for wide data."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, groups: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``totals`` entry name: value, the sum of value over the rows before in its group.

    The rows are range-partitioned by group and order, summed inside each partition, and moved by the totals
    of the partitions before. No task holds a whole group. ``df`` must be cheap to read twice and its order
    columns must tell different rows apart wherever the sums differ. Null groups are groups of their own.
    """
    keys = [col(g) for g in groups] + [col(o) for o in order]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    within = (Window.partitionBy("__part", *[col(g) for g in groups]).orderBy(*[col(o) for o in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumns({name: F.coalesce(F.sum(col(v)).over(within), F.lit(0))
                                for name, v in totals.items()})
    parts = ranged.groupBy("__part", *[col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(
        *[F.sum(col(v)).alias(f"__t{i}") for i, v in enumerate(totals.values())])
    before = (Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__part")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("__part").alias("__of"), *[f"__g{i}" for i in range(len(groups))],
                           *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}")
                             for i in range(len(totals))])
    same = F.col("__part") == F.col("__of")
    for i, g in enumerate(groups):
        same = same & col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(offsets, same)
    return joined.select(*[col(c) for c in df.columns],
                         *[(col(name) + F.col(f"__o{i}")).alias(name) for i, name in enumerate(totals)])


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """The rows packed in one struct, with the key (id, hash of the row) that decisions are joined by."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), col(id_col).alias("__id"),
                     row_hash(df).alias("__hash"))


def emit(df: DataFrame, id_col: str, decisions: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``decisions`` (__id, __hash, __times) names, each that many times.

    Rows that are equal in all columns share one entry; its count is their sum. Only one shuffle moves rows.
    """
    d = decisions.where("__times > 0").select(F.col("__id").alias("__did"), F.col("__hash").alias("__dhash"), "__times")
    rows = keyed(df, id_col)
    met = rows.join(d, (F.col("__hash") == F.col("__dhash")) & F.col("__id").eqNullSafe(F.col("__did")))
    once = met.groupBy("__hash", "__id").agg(F.first("__row").alias("__row"), F.first("__times").alias("__times"))
    several = once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return several.select("__row.*")
