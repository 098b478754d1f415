"""Text tables: phenotypes and covariates, variant effects, parameters, sinks."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heritas.errors import ColumnCountError, DataError, HeaderError, InvalidArgument, ParseError
from heritas.operators.design import drop_missing
from heritas.operators.samples import check_unique
from heritas.sources.plink import check_file

#: Header names that an effects file must have; Dom is optional.
EFFECT_COLUMNS = {"ID": "snp_id", "A1": "a1", "A2": "a2", "A1Freq": "a1_freq", "Add": "add"}
EFFECT_OPTIONAL = {"Chrom": "chrom", "Position": "pos", "Dom": "dom"}


def delimiter(header: str) -> str:
    return "\t" if "\t" in header else "," if "," in header else " "


def _header(path: str) -> str:
    with open(check_file(path), encoding="utf-8") as f:
        return f.readline().rstrip("\r\n")


def _rows(spark: SparkSession, path: str, columns: list[str], sep: str) -> DataFrame:
    """All rows below the header as strings; a row of another width is an error."""
    head = sep.join(columns)
    text = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.col("value") != "")
    cells = F.split("value", {"\t": "\t", ",": ",", " ": " "}[sep], -1)
    rows = text.where(F.col("value") != head).withColumn("t", cells)
    if text.where(F.col("value") == head).limit(2).count() > 1:
        raise HeaderError(f"{path}: the header repeats")
    bad = rows.where(F.size("t") != len(columns)).limit(1).collect()
    if bad:
        raise ColumnCountError(f"{path}: {len(bad[0]['t'])} columns instead of {len(columns)}: {bad[0]['value'][:80]!r}")
    return rows.select(*[F.col("t")[i].alias(c) for i, c in enumerate(columns)])


def read_frame(spark: SparkSession, path: str, kind: str = "double", missing: str = "skip", extra_missing: tuple[str, ...] = ()) -> DataFrame:
    """fid, iid and the file's columns, all of one kind (double or string)."""
    if kind not in ("double", "string"):
        raise InvalidArgument(f"kind {kind!r} is neither double nor string")
    line = _header(path)
    sep = delimiter(line)
    names = line.split(sep)
    if names[:2] != ["FID", "IID"] or len(names) < 3:
        raise HeaderError(f"{path}: the header must be FID, IID and at least one column")
    rows = _rows(spark, path, names, sep)
    data = names[2:]
    full = drop_missing(rows, data, missing, extra_missing)
    if full.where("FID = '' OR IID = ''").limit(1).count():
        raise DataError(f"{path}: an id is empty")
    if kind == "double":
        full = drop_missing(rows, data, "default", extra_missing) if missing == "default" else full
        number = {c: F.when(F.col(c) == "", F.lit(0.0)).otherwise(F.col(c).try_cast("double")) if missing == "default" else F.col(c).try_cast("double") for c in data}
        bad = full.select(*[number[c].alias(c) for c in data]).where(sum((F.col(c).isNull().cast("int") for c in data), F.lit(0)) > 0)
        if bad.limit(1).count():
            raise ParseError(f"{path}: a token isn't a number")
        full = full.select("FID", "IID", *[number[c].alias(c) for c in data])
    return check_unique(full.withColumnRenamed("FID", "fid").withColumnRenamed("IID", "iid"))


def distinct_names(header: list[str]) -> list[str]:
    """Columns after Dom repeat names (pi_k, PIP): those get a dom_ prefix."""
    out, seen = [], set()
    for c in header:
        c = f"dom_{c}" if c in seen else c
        seen.add(c)
        out.append(c)
    return out


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """model_idx, snp_id, chrom, pos, a1, a2, a1_freq, add, dom; rows with a
    number that isn't finite are left out."""
    line = _header(path)
    names = distinct_names(line.split("\t"))
    lack = [c for c in EFFECT_COLUMNS if c not in names]
    if lack:
        raise HeaderError(f"{path}: no column {', '.join(lack)}")
    text = spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    rows = spark.createDataFrame(text, "line long, value string").where("line > 0 AND value <> ''").withColumn("t", F.split(F.regexp_replace("value", "\r$", ""), "\t", -1))
    if rows.where(F.size("t") < len(names)).limit(1).count():
        raise ColumnCountError(f"{path}: a row is too short")
    known = EFFECT_COLUMNS | EFFECT_OPTIONAL
    cell = {known[c]: F.col("t")[names.index(c)] for c in known if c in names}
    number = {"a1_freq": "double", "add": "double", "dom": "double", "pos": "int"}
    cols = [(v.try_cast(number[k]) if k in number else F.substring(v, 1, 1) if k in ("a1", "a2") else v).alias(k) for k, v in cell.items()]
    out = rows.select((F.col("line") - 1).alias("model_idx"), *cols)
    for c in ("a1_freq", "add", *(["dom"] if "dom" in cell else [])):
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return out if "dom" in cell else out.withColumn("dom", F.lit(None).cast("double"))


def read_params(path: str) -> tuple[float, dict[str, float], dict[str, dict[str, float]]]:
    """(intercept, continuous, categorical) of a parameter file: a small file,
    read on the driver.  Terms are split at their first underscore."""
    continuous: dict[str, float] = {}
    categorical: dict[str, dict[str, float]] = {}
    intercept = None
    with open(check_file(path), encoding="utf-8") as f:
        if f.readline().rstrip("\r\n").split("\t")[:2] != ["term", "mean"]:
            raise HeaderError(f"{path}: the header must begin with term, mean")
        for line in f:
            cells = line.rstrip("\r\n").split("\t")
            try:
                term, mean = cells[0], float(cells[1])
            except (IndexError, ValueError):
                continue  # malformed rows don't count
            if term[:1] in ("σ", "δ", "π") or term == VARIANCE_TERMS["add"][1] or term.startswith("sigma_random"):
                continue  # variances and proportions, not effects
            name, mark, level = term.partition("_")
            if term == "Intercept":
                intercept = mean
            elif mark:
                categorical.setdefault(name, {})[level] = mean
            else:
                continuous[term] = mean
    if intercept is None:
        raise DataError(f"{path}: no Intercept")
    return intercept, continuous, categorical


# ---- sinks ----------------------------------------------------------------


def _number(c: str, how: str):
    """Significant digits without zeros at their end."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(how, F.col(c)), r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(F.col(c).isNull() | F.isnan(c), F.lit("NA")).otherwise(text)


def write_lines(df: DataFrame, path: str, header: list[str], order: str) -> None:
    """Tab-separated text with a header, in order.  Spark sorts and formats; tasks
    write sorted pieces beside the file and then put them at their places in it, where
    executors see its folder (shared).  Elsewhere rows stream through the driver."""
    rows = df.orderBy(order).drop(order)
    head = ("\t".join(header) + "\n").encode()
    if not shared(df.sparkSession, path):
        with open(path, "wb") as f:
            f.write(head)
            for r in rows.toLocalIterator(prefetchPartitions=True):
                f.write(("\t".join(str(x) for x in r) + "\n").encode())
        return
    pieces = tempfile.mkdtemp(prefix="pieces-", dir=os.path.dirname(os.path.abspath(path)))
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in rows.columns])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = os.path.join(pieces, f"{task.partitionId()}-{task.taskAttemptId()}")
        with open(own, "wb") as f:
            for b in batches:
                f.writelines(x.encode() + b"\n" for x in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([own]), pa.array([os.path.getsize(own)], pa.int64())], names=["part", "piece", "size"])

    done, at = [], len(head)
    for r in sorted(rows.select(line.alias("line")).mapInArrow(write, "part long, piece string, size long").collect()):
        done.append((r["piece"], at))
        at += r["size"]
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(at)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                with open(done[k][0], "rb") as piece, open(path, "r+b") as f:
                    f.seek(done[k][1])
                    shutil.copyfileobj(piece, f, 1 << 20)
            yield b

    df.sparkSession.range(len(done), numPartitions=max(1, min(len(done), 64))).mapInArrow(place, "id long").agg(F.count("*")).first()
    shutil.rmtree(pieces)


def shared(spark: SparkSession, path: str) -> bool:
    """Whether driver and executors see a path: all on one machine, or below
    spark.checkpoint.dir."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").rstrip("/")
    return spark.sparkContext.master.startswith("local") or bool(base) and os.path.abspath(path).startswith(base + "/")


def gwas_rows(results: DataFrame, variants: DataFrame) -> DataFrame:
    """snp_idx and the columns of an association file."""
    both = results.drop("chrom").join(variants, "snp_idx")
    return both.select("snp_idx", F.col("chrom").alias("CHR"), F.col("snp_id").alias("SNP"), F.col("pos").alias("BP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), _number("a1_freq", "%.6g").alias("A1FREQ"), _number("beta", "%.6g").alias("BETA"), _number("se", "%.6g").alias("SE"), _number("p", "%.6e").alias("P"))


def write_gwas(results: DataFrame, variants: DataFrame, path: str) -> None:
    rows = gwas_rows(results, variants)
    write_lines(rows, path, rows.columns[1:], "snp_idx")


def write_effects(effects: DataFrame, variants: DataFrame, frequencies: DataFrame, path: str) -> None:
    """effects: snp_idx, effect, mean, sd, pve, pip and, for models of several
    classes, pi_0, pi_1, ...  Loci that the variants lack have NA for what is theirs."""
    shares = [c for c in effects.columns if c.startswith("pi_")]

    def of(kind: str, name: str) -> tuple[DataFrame, list[str]]:
        own = {name: "mean", f"{name}SE": "sd", f"{name}PVE": "pve"} | {f"{name}_{c}": c for c in shares} | {f"{name}PIP": "pip"}
        return effects.where(F.col("effect") == kind).select("snp_idx", *[F.col(c).alias(n) for n, c in own.items()]), list(own)

    (add, numbers), (dom, more) = of("add", "Add"), of("dom", "Dom")
    both = add.join(variants, "snp_idx", "left").join(frequencies, "snp_idx", "left")
    if dom.limit(1).count():
        both, numbers = both.join(dom, "snp_idx", "left"), numbers + more
    what = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(n) for n, c in (("ID", "snp_id"), ("Chrom", "chrom"), ("Position", "pos"), ("A1", "a1"), ("A2", "a2"))]
    rows = both.select("snp_idx", (F.col("snp_idx") + 1).alias("Index"), *what, _number("a1_freq", "%.6g").alias("A1Freq"), *[_number(c, "%.6g").alias(c) for c in numbers])
    header = [re.sub(r"^(?:Add|Dom)_(pi_\d+)$", r"\1", re.sub(r"^(?:Add|Dom)PIP$", "PIP", c)) for c in rows.columns[1:]]
    write_lines(rows, path, header, "snp_idx")


#: Terms of variances and proportions in parameter files, by effect.
VARIANCE_TERMS = {"add": ("σ²_add", "h²"), "dom": ("σ²_dom", "δ²"), "residual": "σ²_e", "proportion": "π[{}]"}


def genetic_terms(summary: dict[str, tuple[float, float]], kinds: list[str]) -> list[tuple[str, float, float]]:
    """term, mean, stddev of random effects' variances, of each effect's variance,
    heritability and class proportions, and of the residual variance, from the
    summaries of a chain's scalars."""
    rows = [(n, *v) for n, v in summary.items() if n.startswith("sigma_random")]
    for kind in kinds:
        variance, share = VARIANCE_TERMS[kind]
        rows += [(variance, *summary[f"sigma_{kind}"]), (share, *summary[f"h2_{kind}"])]
        k = 0
        while f"pi_{kind}[{k}]" in summary:
            rows.append((VARIANCE_TERMS["proportion"].format(k), *summary[f"pi_{kind}[{k}]"]))
            k += 1
    return [*rows, (VARIANCE_TERMS["residual"], *summary["sigma_e"])]


def write_params(rows: list[tuple[str, float, float]], path: str) -> None:
    """term, mean, stddev; reference levels belong in it with mean 0."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("term\tmean\tstddev\n")
        f.writelines(f"{t}\t{m:.6g}\t{s:.6g}\n" for t, m, s in rows)


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as tab-separated text, NA where there is nothing to say."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(rows.columns) + "\n")
        f.writelines("\t".join("NA" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) + "\n" for r in rows.collect())


def write_prediction(scored: DataFrame, path: str, terms: list[str], order: str = "sample_idx") -> None:
    rows = scored.select(order, F.col("fid").alias("FID"), F.col("iid").alias("IID"), *[F.format_string("%.6f", F.col(c)).alias(c) for c in ("prediction", *terms)])
    write_lines(rows, path, rows.columns[1:], order)


def write_simulation(phenotype: DataFrame, causal: DataFrame, prefix: str) -> None:
    rows = phenotype.select("sample_idx", F.col("fid").alias("FID"), F.col("iid").alias("IID"), F.format_string("%.6f", "phenotype").alias("phenotype"))
    write_lines(rows, prefix + ".phen", rows.columns[1:], "sample_idx")
    rows = causal.select("snp_idx", F.col("snp_id").alias("SNP"), F.format_string("%.6g", "additive_effect").alias("additive_effect"), F.format_string("%.6g", "dominance_effect").alias("dominance_effect"), "add_class", "dom_class")
    write_lines(rows, prefix + ".causal", rows.columns[1:], "snp_idx")
