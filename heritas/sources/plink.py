"""PLINK files: a Python data source for .bed, readers for .bim and .fam, and a writer."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from heritas.errors import ColumnCountError, EmptyFile, FileFormatError, FileNotFound, FileOpenError, InvalidArgument, ParseError

MAGIC = b"\x6c\x1b\x01"
#: Dosage of A1 of the codes 00, 01 (missing), 10, 11.
CODES = np.array([2, -1, 1, 0], np.int8)
#: Of each byte: the dosages of its four samples, low bits first.
TABLE = np.stack([CODES[(np.arange(256) >> (2 * i)) & 3] for i in range(4)], axis=1)
#: Loci of a partition, and of an Arrow batch.
PARTITION_LOCI, BATCH_LOCI = 10_000, 128


def bed_path(path: str) -> str:
    path = path if path.endswith(".bed") else path + ".bed"
    if not os.path.exists(path):
        raise FileNotFound(f"{path} doesn't exist")
    return path


def check_file(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFound(f"{path} doesn't exist")
    if os.path.isdir(path):
        raise FileOpenError(f"{path} is a folder")
    if os.path.getsize(path) == 0:
        raise EmptyFile(f"{path} is empty")
    return path


def count_lines(path: str) -> int:
    n, last = 0, b"\n"
    with open(check_file(path), "rb") as f:
        while block := f.read(1 << 20):
            n, last = n + block.count(b"\n"), block[-1:]
    return n + (last != b"\n")


@dataclass
class BedInfo:
    path: str
    samples: int
    loci: int

    @property
    def stride(self) -> int:
        return -(-self.samples // 4)


def bed_info(path: str) -> BedInfo:
    """Sizes from the .fam and .bim beside a .bed; a longer .bed is accepted."""
    path = bed_path(path)
    stem = path.removesuffix(".bed")
    info = BedInfo(path, count_lines(stem + ".fam"), count_lines(stem + ".bim"))
    if os.path.getsize(path) < 3 + info.loci * info.stride:
        raise FileFormatError(f"{path} is too short for {info.loci} loci of {info.samples} samples")
    with open(path, "rb") as f:
        if f.read(3) != MAGIC:
            raise FileFormatError(f"{path} doesn't begin with the SNP-major magic bytes")
    return info


def decode(raw: bytes, samples: int, keep: np.ndarray | None = None) -> np.ndarray:
    """Dosages (loci x samples, -1: missing) of packed loci."""
    stride = -(-samples // 4)
    rows = TABLE[np.frombuffer(raw, np.uint8).reshape(-1, stride)].reshape(-1, 4 * stride)[:, :samples]
    return rows if keep is None else np.where(keep >= 0, rows[:, np.maximum(keep, 0)], -1)


class LociRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BedReader(DataSourceReader):
    """Reads loci from start to end; comparisons of snp_idx with numbers, pushed
    down by Spark, narrow the range, so that a chromosome's scan reads its own
    bytes only."""

    def pushFilters(self, filters):
        for f in filters:
            where, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if where == ("snp_idx",) and isinstance(value, int):
                if isinstance(f, EqualTo):
                    self.start, self.end = max(self.start, value), min(self.end, value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.start = max(self.start, value)
                elif isinstance(f, GreaterThan):
                    self.start = max(self.start, value + 1)
                elif isinstance(f, LessThanOrEqual):
                    self.end = min(self.end, value + 1)
                elif isinstance(f, LessThan):
                    self.end = min(self.end, value)
                else:
                    yield f
                continue
            yield f

    def __init__(self, options: dict):
        self.info = bed_info(options["path"])
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", self.info.loci))
        if not (0 <= self.start < self.end <= self.info.loci or self.start == self.end == self.info.loci == 0):
            raise InvalidArgument(f"range {self.start}:{self.end} isn't within 0:{self.info.loci}")
        self.step = int(options.get("partitionLoci", PARTITION_LOCI))
        keep = options.get("keep")
        self.keep = None if keep is None else np.array([int(x) for x in keep.split(",") if x], np.int64)
        if self.keep is not None and (self.keep >= self.info.samples).any():
            raise InvalidArgument("a kept sample isn't in the file")

    def partitions(self):
        return [LociRange(i, min(i + self.step, self.end)) for i in range(self.start, self.end, self.step)] or [LociRange(0, 0)]

    def read(self, partition):
        stride, n = self.info.stride, self.info.samples
        with open(self.info.path, "rb") as f:
            for at in range(partition.start, partition.end, BATCH_LOCI):
                end = min(at + BATCH_LOCI, partition.end)
                f.seek(3 + at * stride)
                g = decode(f.read((end - at) * stride), n, self.keep)
                flat = pa.array(g.ravel().astype(np.float64), pa.float64(), mask=g.ravel() < 0)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * g.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), rows], names=["snp_idx", "dosage"])


class BedSource(DataSource):
    """spark.read.format("bed").option("path", ...): snp_idx, dosage.

    Options: start, end (loci), keep (comma-separated file positions of the
    samples in target order, -1 for a sample that the file lacks),
    partitionLoci.  A path must be readable by all executors."""

    @classmethod
    def name(cls):
        return "bed"

    def schema(self):
        return "snp_idx long, dosage array<double>"

    def reader(self, schema):
        return BedReader(dict(self.options))


def read_bed(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bed_info(path)
    loci = spark.conf.get("heritas.bed.partitionLoci", None)
    if loci:
        options.setdefault("partitionLoci", loci)
    return spark.read.format("bed").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """line_idx, value of a text file.  zipWithIndex numbers lines across
    splits with one cheap count a split."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    return spark.createDataFrame(rows, "line_idx long, value string")


def _tokens(value):
    """Split at tabs if there are any, else at spaces; repeats collapse."""
    line = F.rtrim(F.regexp_replace(value, "\r$", ""))
    return F.when(line.contains("\t"), F.split(line, "\t+")).otherwise(F.split(line, " +"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """snp_idx, chrom, snp_id, pos, a1, a2 (first letters)."""
    check_file(path)
    t = _numbered(spark, path).withColumn("t", _tokens(F.col("value")))
    bad = t.where((F.size("t") != 6) | F.try_element_at("t", F.lit(4)).try_cast("int").isNull()).limit(1).collect()
    if bad:
        kind = ColumnCountError if len(bad[0]["t"]) != 6 else ParseError
        raise kind(f"{path}, line {bad[0]['line_idx'] + 1}: {bad[0]['value']!r}")
    return t.select(F.col("line_idx").alias("snp_idx"), F.col("t")[0].alias("chrom"), F.col("t")[1].alias("snp_id"), F.try_element_at("t", F.lit(4)).try_cast("int").alias("pos"), F.substring(F.col("t")[4], 1, 1).alias("a1"), F.substring(F.col("t")[5], 1, 1).alias("a2"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """raw_idx, fid, iid; blank lines are skipped."""
    check_file(path)
    rows = spark.read.text(path).where(F.trim("value") != "").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    t = spark.createDataFrame(rows, "raw_idx long, value string")
    line = F.regexp_replace("value", "\r$", "")
    parts = F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, " "))
    out = t.select("raw_idx", parts[0].alias("fid"), F.try_element_at(parts, F.lit(2)).alias("iid"))
    bad = out.where("fid = '' OR iid IS NULL OR iid = ''").limit(1).collect()
    if bad:
        raise ColumnCountError(f"{path}: a line has no family or sample id")
    return out


def write_plink(prefix: str, genotypes: np.ndarray, samples: list[tuple[str, str]], variants: list[tuple[str, str, int, str, str]]) -> None:
    """A trio of files from dosages (loci x samples, NaN or -1: missing)."""
    g = np.where(np.isnan(np.asarray(genotypes, float)), -1, genotypes).astype(int)
    code = np.select([g == 2, g < 0, g == 1], [0, 1, 2], 3).astype(np.uint8)
    pad = np.zeros((len(code), -(-code.shape[1] // 4) * 4), np.uint8)
    pad[:, : code.shape[1]] = code
    four = pad.reshape(len(code), -1, 4)
    with open(prefix + ".bed", "wb") as f:
        f.write(MAGIC + (four[..., 0] | four[..., 1] << 2 | four[..., 2] << 4 | four[..., 3] << 6).astype(np.uint8).tobytes())
    with open(prefix + ".fam", "w") as f:
        f.writelines(f"{a} {b} 0 0 0 -9\n" for a, b in samples)
    with open(prefix + ".bim", "w") as f:
        f.writelines(f"{c} {i} 0 {p} {x} {y}\n" for c, i, p, x, y in variants)
