"""Sample ids: universe, intersection, ordinals, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heritas.errors import DataError, SampleMismatch

ID = ["fid", "iid"]
SEPARATOR = "\x1f"


def key(df: DataFrame):
    return F.concat(F.col("fid").cast("string"), F.lit(SEPARATOR), F.col("iid").cast("string"))


def unique_ids(df: DataFrame) -> DataFrame:
    """Distinct ids of a table; both parts must be there."""
    return df.select(*ID).where("fid IS NOT NULL AND iid IS NOT NULL AND fid <> '' AND iid <> ''").dropDuplicates(ID)


def check_unique(df: DataFrame) -> DataFrame:
    again = df.groupBy(*ID).count().where("count > 1").limit(1).collect()
    if again:
        raise DataError(f"sample {again[0]['fid']} {again[0]['iid']} repeats")
    return df


def intersect(universe: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids that all tables have.  Left-semi joins: nothing multiplies."""
    return reduce(lambda a, b: a.join(unique_ids(b), ID, "left_semi"), others, unique_ids(universe))


def finalize(ids: DataFrame) -> DataFrame:
    """fid, iid, sample_idx: ordinals by the bytes of the joined id.

    The ordinal needs a total order.  A range sort gives each partition its
    part of it; ordinals are its offset and the place inside."""
    ordered = ids.withColumn("_key", key(ids)).repartitionByRange("_key").sortWithinPartitions("_key")
    placed = ordered.withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").select(*ID, (F.col("_before") + F.col("_at") - 1).cast("long").alias("sample_idx"))


def require_samples(samples: DataFrame) -> DataFrame:
    if not samples.limit(1).count():
        raise SampleMismatch("the tables have no sample in common")
    return samples


def excluded_count(tables: list[DataFrame]) -> DataFrame:
    """One row: how many ids of the largest table aren't common to all."""
    sizes = [unique_ids(t).agg(F.count("*").alias("n")) for t in tables]
    most = reduce(lambda a, b: a.union(b), sizes).agg(F.max("n").alias("most"))
    common = intersect(*tables).agg(F.count("*").alias("common"))
    return most.withColumn("common", common.scalar()).select("most", "common", (F.col("most") - F.col("common")).alias("excluded"))


def reindex(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of table for the samples that it has, with their ordinals."""
    return samples.join(table, ID, "inner")


def projection(raw: DataFrame, samples: DataFrame) -> DataFrame:
    """raw (fid, iid, raw_idx) with each sample's target ordinal, -1 if dropped."""
    return raw.join(samples, ID, "left").withColumn("target", F.coalesce("sample_idx", F.lit(-1)))
