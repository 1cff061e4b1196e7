"""Exact top-k search, term at a time.

Every row of the query table is a query; every document with a word in common
is scored by BM25. Weights are rounded to whole numbers once for each posting,
so sums are exact and ties are real: they go to the lower id. A task scatters
the weighted postings of a query's words into an array of scores by document,
selects by partition, and keeps its best k; the tasks' lists are then merged.

Words are maximal runs of letters, digits and underscores, lower-cased.

Defined results: null and empty texts match nothing (and nulls don't count as
documents), repeated documents take a place each, repeated queries are each
answered, null ids come last among ties; either table may be empty. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import field, name_of, side_slices, table

K = 10
K1, B, SCALE = 1.2, 0.75, 1e6
BLOCK = 4000
WORD = re.compile(r"\w+")


def _blocks(batches: Iterator[pa.RecordBatch], vocab: dict[str, int]):
    """keys, words by document, and (document, term) of each known word, a block at a time."""
    get = vocab.get
    for big in batches:
        for i in range(0, big.num_rows, BLOCK):
            b = big.slice(i, BLOCK)
            sizes, ids = [], []
            for t in b.column(1).to_pylist():
                w = WORD.findall(t.lower()) if t else []
                sizes.append(len(w) if t is not None else -1)
                ids.append(np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)))
            sizes = np.array(sizes, np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
            on = flat >= 0
            yield b.column(0), sizes, doc[on], flat[on]


def statistics(docs: DataFrame, vocab: dict[str, int]) -> tuple[int, int, np.ndarray]:
    """Documents, their words, and documents by term, over the whole table."""
    terms = len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(terms + 2, np.int64), 0, 0
        for _, sizes, doc, term in _blocks(batches, vocab):
            df[:terms] += np.bincount(np.unique(doc * terms + term) % terms if len(doc) else [], minlength=terms).astype(np.int64)
            df[terms] += (sizes >= 0).sum()
            df[terms + 1] += np.maximum(sizes, 0).sum()
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], ["term", "n"])

    got = docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(terms + 2, np.int64)
    for r in got:
        df[r.term] = r.n
    return int(df[terms]), int(df[terms + 1]), df[:terms]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive scores and of all that tie with the last."""
    on = np.flatnonzero(scores)
    if len(on) > k:
        s = scores[on]
        on = on[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return on


def search(df: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """query, rank, key, score: the k best documents of each query."""
    key, text = name_of(df, key), name_of(df, text)
    query, query_text = name_of(queries, query), name_of(queries, query_text)
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(field(df, key).alias("key"), field(df, text).alias("text"))
    out = None
    for rows in side_slices(queries.select(field(queries, query).alias("query"), field(queries, query_text).alias("text")), "text"):
        counted = [Counter(WORD.findall((r[1] or "").lower())) for r in rows]
        vocab: dict[str, int] = {}
        for c in counted:
            for w in c:
                vocab.setdefault(w, len(vocab))
        sparse = [sorted((vocab[w], n) for w, n in c.items()) for c in counted]
        n, words, df_ = statistics(docs, vocab)
        mean = words / n if n and words else 1.0
        idf = np.array([math.log(1 + (n - x + 0.5) / (x + 0.5)) for x in df_.tolist()])

        def run(batches: Iterator[pa.RecordBatch], vocab=vocab, sparse=sparse, idf=idf, mean=mean) -> Iterator[pa.RecordBatch]:
            terms = max(1, len(vocab))
            held: list[list] = [[] for _ in sparse]
            order = lambda x: (-x[0], x[1] is None, x[1])
            for keys, sizes, doc, term in _blocks(batches, vocab):
                u, tf = np.unique(term * len(sizes) + doc, return_counts=True)
                t, d = u // max(1, len(sizes)), u % max(1, len(sizes))
                w = np.rint(SCALE * idf[t] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * sizes[d] / mean))).astype(np.int64)
                edge = np.searchsorted(t, np.arange(terms + 1))
                names = keys.to_pylist()
                for q, row in enumerate(sparse):
                    scores = np.zeros(len(sizes), np.int64)
                    for x, times in row:
                        a, b = edge[x], edge[x + 1]
                        scores[d[a:b]] += times * w[a:b]
                    on = best(scores, k)
                    if len(on):
                        both = held[q] + [(s, names[i]) for s, i in zip(scores[on].tolist(), on.tolist())]
                        held[q] = sorted(both, key=order)[:k]
            q, s, keys_ = [], [], []
            for i, h in enumerate(held):
                for score, name in h:
                    q.append(i), s.append(score), keys_.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(keys_, docs_type), pa.array(s, pa.int64())], ["q", "key", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        docs_type = to_arrow_type(df.schema[key].dataType)
        found = docs.mapInArrow(run, f"q bigint, key {kind}, score bigint")
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key")))).where(F.col("rank") <= k)
        spark = df.sparkSession
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"q bigint, query {queries.schema[query].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "q").select(F.col("query").alias(query), "rank", F.col("key").alias(key), "score")
        out = part if out is None else out.unionByName(part)
    return out


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents where text is not null),
n as (select count(*) as n, sum(len(w))::double / count(*) as mean from d),
q as (select item_id, w, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as w from benchmark) group by 1, 2),
p as (select r, doc_id, dl, w, count(*) as tf from (select r, doc_id, len(w) as dl, unnest(w) as w from d) where w in (select w from q) group by 1, 2, 3, 4),
f as (select w, count(*) as df from p group by 1),
s as (select p.r, p.doc_id, p.w, cast(round({SCALE} * ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * (tf * {K1 + 1}::double) / (tf + {K1}::double * ({1 - B}::double + {B}::double * dl / n.mean))) as bigint) as score
      from p join f using (w) cross join n),
t as (select q.item_id, s.r, s.doc_id, sum(q.times * s.score)::bigint as score from q join s using (w) group by 1, 2, 3)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from t) where rank <= {K}
"""
