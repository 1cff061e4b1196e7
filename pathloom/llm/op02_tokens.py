"""Token ids as Parquet list columns that can be read in parts.

Rows are ordered by key within a file. Row groups and pages have a set size, the
column and offset indexes of the pages are written, keys and counts are delta
encoded, tokens and categories dictionary encoded (tokens delta encoded on
request). A reader of the metadata touches no token page, and a reader of some
keys touches only pages that may hold them.

Defined results: a null text has null tokens and a null count, an empty text an
empty list and 0; repeated rows and null keys are written as they come (null
keys first); an empty table is an empty dataset. Extra columns, whatever their
names, are ignored, unless named as metadata; one called token_ids or n_tokens is an error.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import bpe
from pathloom.llm.common import field, map_batches, name_of, shared_dir, table

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2000
#: Words whose ids a task remembers before it starts afresh.
REMEMBERED = 500_000


class _Known(dict):
    """Number of a word, in order of arrival; ids of word k are pool[ends[k]:ends[k + 1]]."""

    def __init__(self, encode):
        self.encode, self.pool, self.ends = encode, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.pool.extend(self.encode(word.encode()))
        self.ends.append(len(self.pool))
        return n


def lister(ranks: dict[bytes, int]):
    """texts -> words of each (-1 for a null one), the ids of all, where those of each start."""
    split, encode = bpe.splitter(), bpe.encoder(ranks)
    known = _Known(encode)

    def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal known
        number, codes, sizes = known.__getitem__, [], []
        for t in texts:
            words = split(t) if t else []
            sizes.append(-1 if t is None else len(words))
            codes.append(np.fromiter(map(number, words), np.int64, len(words)))
        sizes = np.array(sizes, np.int64)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        at = np.frombuffer(known.ends, np.int64)
        first = at[code]
        n = at[code + 1] - first
        upto = np.concatenate([[0], np.cumsum(n)])
        tokens = np.frombuffer(known.pool, np.int32)[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])] if len(code) else np.zeros(0, np.int32)
        starts = upto[np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])].astype(np.int32)
        del at
        if len(known) > REMEMBERED:
            known = _Known(encode)
        return sizes, tokens, starts

    return read


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", metadata: Iterable[str] = (), vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """key, metadata, n_tokens, token_ids of every row."""
    key, text = name_of(df, key), name_of(df, text)
    metadata = [name_of(df, m) for m in metadata]
    if {"token_ids", "n_tokens"} & {x.lower() for x in [key, *metadata]}:
        raise ValueError("token_ids and n_tokens are the output's names")
    ranks = bpe.read_ranks(vocabulary)
    width = 1 + len(metadata)

    def make():
        read = lister(ranks)

        def fn(b: pa.RecordBatch):
            sizes, tokens, starts = read(b.column(width).to_pylist())
            null = sizes < 0
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens, pa.int32()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(np.diff(starts), mask=null), lists], [*b.schema.names[:width], "n_tokens", "token_ids"])

        return fn

    some = df.select(*[field(df, c) for c in (key, *metadata, text)])
    schema = T.StructType([*some.schema.fields[:width], T.StructField("n_tokens", T.IntegerType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return map_batches(some, make, schema, rows=200)


def write(tokens: DataFrame, path: str, key: str = "doc_id", delta: bool = False) -> None:
    """delta: tokens delta encoded rather than by dictionary."""
    (
        tokens.sortWithinPartitions(field(tokens, key))
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option(f"parquet.enable.dictionary#{key}", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#token_ids.list.element", str(not delta).lower())
        .parquet(path)
    )


class TokenSet:
    """A written dataset."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.df, self.key = spark.read.parquet(path), key

    def metadata(self) -> DataFrame:
        return self.df.drop("token_ids")

    def of(self, keys: list) -> DataFrame:
        """Rows with these keys; the filter reaches row groups and page indexes."""
        return self.df.where(field(self.df, self.key).isin(keys))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/tokens"
    write(tokenize(table(spark, sf_dir, "documents"), metadata=["lang", "source"]), path)
    return TokenSet(spark, path).df
