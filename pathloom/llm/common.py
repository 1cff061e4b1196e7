"""What the operators of this subpackage share: the shared folder, written
tables, checked broadcasts and Arrow batch helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many rows of a few longs; beyond, Spark shuffles.
BROADCAST_ROWS = 2_000_000
#: Texts handed to Python at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors see (spark.checkpoint.dir).
    Where that is unset, a temporary folder becomes it on a single machine; on a
    cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/pathloom-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a folder that Python code opens directly."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"Python code needs spark.checkpoint.dir on a mounted file system, not {uri}")
    return uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost
    executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like materialize, as a table bucketed by key: a join on it reads df without a shuffle."""
    spark = df.sparkSession
    known = f"pathloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(known)
    return spark.table(known)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if df (already written) has few enough rows."""
    return F.broadcast(df) if df.count() <= rows else df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker, which Spark keeps, gives back the memory it has freed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return go


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str, rows: int = BATCH_ROWS
) -> DataFrame:
    """mapInArrow whose state is made once a task by make() and whose batches
    have at most `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield from fn(b.slice(i, rows))

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over columns of any name, dots and all: they travel under numbers."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    if isinstance(schema, str):
        return plain.mapInArrow(tidied(run), schema)
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(tidied(run), numbered).toDF(*schema.names)


def field(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def with_fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = "_" + stem
    return stem


def name_of(df: DataFrame, name: str) -> str:
    """The column of df called so, whatever its case; an error names what is missing."""
    for c in df.columns:
        if c == name:
            return c
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"the input has no column {name}: {df.columns}")


#: Bytes of text of a side table that are sent to every task at once.
SIDE_BYTES = 16 << 20


def side_slices(df: DataFrame, text: str, limit: int = SIDE_BYTES) -> Iterator[list]:
    """Rows of a side table, at most about `limit` bytes of text at a time: one
    slice for a small table, several passes over the large one for a big table."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // limit)
    if n <= 1:
        yield df.collect()
        return
    for i in range(n):
        yield df.where(F.pmod(F.xxhash64(text), F.lit(n)) == i).collect()
