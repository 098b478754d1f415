"""Incremental work over folders of Parquet blocks (Structured Streaming).

The batch operators' sums are associative, so a stream of new loci or draws
adds its batches' partial sums to what is stored: each micro-batch writes its
own part under its batch id, and reading adds the parts up.  A batch that is
retried overwrites its own part, so results count every block once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heritas.operators import diagnose, grm


def _parts(stream: DataFrame, out: str, checkpoint: str, make) -> StreamingQuery:
    def batch(df: DataFrame, at: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{out}/batch={at}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_grm(spark: SparkSession, folder: str, out: str, checkpoint: str, name: str = "OSH", kind: str = "add") -> StreamingQuery:
    """Tiles of the relationship matrix of blocks (snp_idx, dosage) that arrive."""
    blocks = spark.readStream.schema("snp_idx long, dosage array<double>").parquet(folder)
    return _parts(blocks, out, checkpoint, lambda df: grm.tiles(df, name, kind))


def read_tiles(spark: SparkSession, out: str) -> DataFrame:
    """bi, bj, values: the sums of all batches' tiles."""
    return grm.sum_tiles(spark.read.parquet(out).select("bi", "bj", "values"))


def stream_moments(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Counts, means and squared deviations of draws (chain, draw, param, value)."""
    draws = spark.readStream.schema("chain int, draw long, param string, value double").parquet(folder)
    return _parts(draws, out, checkpoint, lambda df: df.groupBy("chain", "param").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("s")))


def read_moments(spark: SparkSession, out: str) -> DataFrame:
    """chain, param, n, mean, sd of all batches together (merged as Welford's)."""
    one = spark.read.parquet(out).groupBy("chain", "param").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("s").alias("inside"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("n") * F.col("mean") * F.col("mean"))
    return one.select("chain", "param", "n", "mean", F.when(F.col("n") > 1, F.sqrt((F.col("inside") + between) / (F.col("n") - 1))).otherwise(0.0).alias("sd"))


def stream_diagnostics(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """After each batch of draws: the diagnostics of the draws of this batch and
    the batches before it, which are kept beside the results, so that a batch that
    is run again gives the same."""
    draws = spark.readStream.schema("chain int, draw long, param string, value double").parquet(folder)

    def batch(df: DataFrame, at: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}.draws/batch={at}")
        kept = spark.read.parquet(f"{out}.draws").where(F.col("batch") <= at).drop("batch")
        diagnose.summary(kept).write.mode("overwrite").parquet(f"{out}/batch={at}")

    return draws.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
