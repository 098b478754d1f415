"""Variants: chromosome islands, monomorphic loci, matching, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heritas.errors import DataError


def chromosome_islands(variants: DataFrame) -> DataFrame:
    """island, chrom, first_snp, end_snp (exclusive), n_snps: runs of loci with
    one chromosome.  A run's border needs its neighbour alone: rows whose
    predecessor differs are few, so only they meet in one sorted list."""
    snp, chrom = F.col("snp_idx"), F.col("chrom")
    before = variants.select((snp + 1).alias("snp_idx"), chrom.alias("_before"))
    heads = variants.join(before, "snp_idx", "left").where(F.col("_before").isNull() | (F.col("_before") != chrom)).select("chrom", F.col("snp_idx").alias("first_snp"))
    end = variants.agg((F.max("snp_idx") + 1).alias("_end")).scalar()
    order = Window.orderBy("first_snp")
    runs = heads.withColumn("_end", end).select((F.row_number().over(order) - 1).alias("island"), "chrom", "first_snp", F.coalesce(F.lead("first_snp").over(order), "_end").alias("end_snp"))
    return runs.withColumn("n_snps", F.col("end_snp") - F.col("first_snp"))


def loco_groups(variants: DataFrame) -> DataFrame:
    """Islands for leave-one-chromosome-out; a chromosome in two runs is an error."""
    runs = chromosome_islands(variants)
    again = runs.groupBy("chrom").count().where("count > 1").limit(1).collect()
    if again:
        raise DataError(f"chromosome {again[0]['chrom']} isn't contiguous")
    return runs


def monomorphic(moments: DataFrame) -> DataFrame:
    return moments.where("is_monomorphic").select("snp_idx")


def match(target: DataFrame, model: DataFrame) -> DataFrame:
    """target (snp_idx, snp_id, a1, a2) with match_type keep, reverse or skip and
    the model's column.  Ids decide, then alleles without case; of a model's
    repeated ids the first counts."""
    first = model.groupBy("snp_id").agg(F.min_by(F.struct("model_idx", F.upper(F.substring("a1", 1, 1)).alias("m1"), F.upper(F.substring("a2", 1, 1)).alias("m2")), "model_idx").alias("m"))
    both = target.join(first, "snp_id", "left")
    a1, a2 = F.upper(F.substring("a1", 1, 1)), F.upper(F.substring("a2", 1, 1))
    kind = F.when(F.col("m").isNull(), "skip").when((a1 == F.col("m.m1")) & (a2 == F.col("m.m2")), "keep").when((a1 == F.col("m.m2")) & (a2 == F.col("m.m1")), "reverse").otherwise("skip")
    return both.withColumn("match_type", kind).withColumn("model_idx", F.when(F.col("match_type") != "skip", F.col("m.model_idx"))).drop("m")


def check_targets(target: DataFrame) -> DataFrame:
    again = target.groupBy("snp_id").count().where("count > 1").limit(1).collect()
    if again:
        raise DataError(f"variant {again[0]['snp_id']} repeats")
    return target


def align(matched: DataFrame, model: DataFrame, dosage: str = "dosage") -> DataFrame:
    """Model columns with the target's dosages, flipped where alleles are
    swapped; NULL where the target lacks the variant."""
    g = F.col(dosage)
    flipped = F.when(F.col("match_type") == "reverse", F.transform(g, lambda x: 2 - x)).otherwise(g)
    found = matched.where("match_type <> 'skip'").select("model_idx", flipped.alias(dosage))
    return model.join(found, "model_idx", "left")
