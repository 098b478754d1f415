"""Helpers shared by the operators: shared work folder, tables, chunking."""

from __future__ import annotations

import contextlib
import getpass
import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python.  Documents can be 100 kB and more,
#: so that the default of 10,000 rows isn't a memory bound.
ARROW_ROWS = 400


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a session of one machine that names none, as in tests, gets a local one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = f"file:///tmp/checkpoints/{getpass.getuser()}"
        spark.conf.set("spark.checkpoint.dir", told)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(told)
    return told


def prepare(spark: SparkSession) -> None:
    """Session settings that bound memory of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared_dir(spark)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for plans that run inside: rows that are
    large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


_OPEN = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[Callable[..., None]]:
    """Tables stored inside are removed at the end, but those that the function
    it gives is called with; they belong to the scope outside, if there is one."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    held, kept = [], []
    scopes.append(held)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        scopes.pop()
        paths = {t._heritas_path for t in kept}
        drop_stored(*[t for t in held if t._heritas_path not in paths])
        if scopes:
            scopes[-1].extend(t for t in held if t._heritas_path in paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it: cuts the lineage,
    survives lost executors, and later passes read it instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/heritas-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._heritas_path = path
    for held in _OPEN.__dict__.get("scopes", [])[-1:]:
        held.append(out)
    return out


def drop_stored(*tables: DataFrame | None) -> None:
    """Remove tables of stored() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_heritas_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def batches_by_size(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Of batches of ids and texts: ids and texts (null: empty) of at most so
    many characters together, or one text."""
    for b in batches:
        texts, at = [t or "" for t in b.column(1).to_pylist()], 0
        while at < len(texts):
            stop, held = at + 1, len(texts[at])
            while stop < len(texts) and held + len(texts[stop]) <= most:
                held += len(texts[stop])
                stop += 1
            yield b.column(0).slice(at, stop - at), texts[at:stop]
            at = stop


_TWO_SPACES = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<!\s) (?!\s)")


def space_chunks(text: str) -> list[str]:
    """Cut before single spaces: [first, rest...], where each of rest follows a
    space that was cut away.  No pre-token of the GPT-2 family of patterns
    crosses such a cut, because a piece takes a space only as its first
    character and white-space runs stay whole; so a text's ids are those of
    first and of " " + each of rest, one after another."""
    if _TWO_SPACES.search(text) is None and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")
    return _LONE_SPACE.split(text)
