"""Benchmark decontamination by an FM-index of each training shard.

Phrases are all runs of N words of the benchmark's items (the whole item, if it
is shorter but has at least LEAST words). A shard is a run of documents of a
task; words that no phrase has, and runs of the others too short for a phrase,
become separators, which loses no match. Over the rest stands an FM-index: BWT
in a wavelet matrix, ranks by bit counts, every STEP-th suffix position and each
run's start sampled. All phrases are searched backwards together, their
occurrences located, and overlapping or touching spans merged. A benchmark too
big to be sent at once is searched in slices: each pass leaves the texts as they
are and hands its hits on in a column; the last one merges all.

Words are maximal runs of letters, digits and underscores, lower-cased. Offsets
count characters of the whole text.

Defined results: null and empty texts and items have no spans; repeated rows
give theirs each; null ids are carried; either table may be empty. Extra columns,
whatever their names, are ignored by find_spans and kept by cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pathloom.llm.common import SIDE_BYTES, field, map_arrow, name_of, side_slices, table, with_fresh

N = 8
LEAST = 5
STEP = 16
#: Words in a shard, about.
SHARD_WORDS = 2_000_000
WORD = re.compile(r"\w+")


class WaveletMatrix:
    """Symbols of an integer sequence: access and rank, many at a time."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = ((seq >> shift) & 1).astype(bool)
            words = np.zeros((len(bits) + 63) // 64 * 8 + 8, np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words[: len(packed)] = packed
            words = words.view(np.uint64)
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64)])
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, words, upto, zeros))
            seq = np.concatenate([seq[~bits], seq[bits]])

    @staticmethod
    def _ones(words, upto, i):
        w = i >> 6
        return upto[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] is among the first i[k] symbols."""
        lo, hi = np.zeros_like(i), i
        for shift, words, upto, zeros in self.levels:
            a, b = self._ones(words, upto, lo), self._ones(words, upto, hi)
            one = ((c >> shift) & 1).astype(bool)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for shift, words, upto, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self._ones(words, upto, i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + a, i - a)
        return c


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; every 0 is a separator of its own, in order of place."""
    n = len(seq)
    sep = seq == 0
    rank = seq + int(sep.sum())
    rank[sep] = np.arange(int(sep.sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Of a sequence of symbols 1..top with separators 0; it starts with one."""

    def __init__(self, seq: np.ndarray, top: int, step: int = STEP):
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.wm = WaveletMatrix(bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        kept = (sa % step == 0) | (bwt == 0)
        self.sampled, self.n = kept, len(seq)
        self.sample_at = np.cumsum(kept) - 1
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: which have matches, and their rows."""
        which = np.arange(len(phrases))
        sp, ep = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, j]
            sp, ep = self.before[c] + self.wm.rank(c, sp), self.before[c] + self.wm.rank(c, ep)
            on = sp < ep
            which, sp, ep = which[on], sp[on], ep[on]
        return which, sp, ep

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_at[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.wm.access(at)
            at = self.before[c] + self.wm.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The phrases of some benchmark items, by length."""

    def __init__(self, items: list[tuple], n: int = N, least: int = LEAST):
        self.vocab: dict[str, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            w = WORD.findall((text or "").lower())
            if len(w) < least:
                continue
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            m = min(n, len(ids))
            for i in range(len(ids) - m + 1):
                found.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
        self.by_length = [(m, np.array(list(p), dtype=np.int64), [sorted(x, key=lambda v: (v is None, v)) for x in p.values()]) for m, p in sorted(found.items())]
        self.shortest = min(found, default=0)

    def occurrences(self, docs: list[np.ndarray]) -> dict[int, list[tuple[int, int, list]]]:
        """By number of document: first word, words and items of each occurrence."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        # a separator before each document, so that no run spans two
        seq = np.concatenate([np.concatenate([[0], d]) for d in docs] + [[0]]).astype(np.int64)
        first = np.cumsum(np.concatenate([[0], sizes[:-1] + 1])) + 1
        edge = np.flatnonzero(seq == 0)
        run = np.diff(edge) - 1
        keep = np.flatnonzero(run >= self.shortest)
        if not len(keep):
            return {}
        lengths = run[keep] + 1
        starts = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(edge[keep] - starts[:-1], lengths) + np.arange(starts[-1])
        index = FMIndex(seq[where], len(self.vocab))
        out: dict[int, list] = {}
        for m, phrases, items in self.by_length:
            which, sp, ep = index.search(phrases)
            count = ep - sp
            if not len(which):
                continue
            ends = np.cumsum(count)
            rows = np.repeat(sp - (ends - count), count) + np.arange(ends[-1])
            at = where[index.locate(rows)]
            doc = np.searchsorted(first, at, side="right") - 1
            for d, w, p in zip(doc.tolist(), (at - first[doc]).tolist(), np.repeat(which, count).tolist()):
                out.setdefault(d, []).append((w, m, items[p]))
        return out


def joined(hits: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """Word spans of hits: those that overlap or touch are one."""
    out: list = []
    for w, m, items in sorted(hits, key=lambda h: h[:2]):
        if out and w <= out[-1][1]:
            out[-1][1] = max(out[-1][1], w + m)
            out[-1][2].update(items)
        else:
            out.append([w, w + m, set(items)])
    return [(a, b - a, sorted(i, key=lambda v: (v is None, v))) for a, b, i in out]


def merged(text: str, hits: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """Character spans of hits."""
    bounds = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else _bounds(text)
    return [(bounds[w][0], bounds[w + m - 1][1], items) for w, m, items in joined(hits)]


def _bounds(text: str) -> list[tuple[int, int]]:
    """Words of a text whose lower case is longer: offsets of the text itself."""
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def shards(batches: Iterator[pa.RecordBatch], where: int, phrases: Phrases, shard_words: int, carried: int | None) -> Iterator[tuple[pa.Table, list, dict]]:
    """Runs of rows with their texts and, by row, their hits with those carried along."""
    held, texts, ids, total = [], [], [], 0
    get = phrases.vocab.get

    def done():
        hits = phrases.occurrences(ids) if phrases.by_length else {}
        rows = pa.Table.from_batches(held)
        for d, old in enumerate(rows.column(carried).to_pylist() if carried is not None else ()):
            if old:
                hits.setdefault(d, []).extend((h["w"], h["m"], h["items"]) for h in old)
        return rows, texts, hits

    for big in batches:
        for i in range(0, big.num_rows, 500):
            b = big.slice(i, 500)
            held.append(b)
            for t in b.column(where).to_pylist():
                w = WORD.findall(t.lower()) if t else []
                texts.append(t)
                ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
                total += len(w)
            if total >= shard_words:
                yield done()
                held, texts, ids, total = [], [], [], 0
    if held:
        yield done()


def _all_but_last(df: DataFrame, benchmark: DataFrame, where: int, item: str, item_text: str, n: int, shard_words: int, side_bytes: int) -> tuple[DataFrame, int | None, Phrases]:
    """df with the hits of all slices but the last, the number of their column
    (None for a single slice), and the last slice's phrases."""
    item, item_text = name_of(benchmark, item), name_of(benchmark, item_text)
    item_type = benchmark.schema[item].dataType
    hits_type = T.ArrayType(T.StructType().add("w", T.IntegerType()).add("m", T.IntegerType()).add("items", T.ArrayType(item_type)))
    carried, phrases = None, None
    for rows in side_slices(benchmark.select(field(benchmark, item).alias("item"), field(benchmark, item_text).alias("text")), "text", side_bytes):
        if phrases is not None:

            def run(batches: Iterator[pa.RecordBatch], phrases=phrases, carried=carried) -> Iterator[pa.RecordBatch]:
                for held, _, hits in shards(batches, where, phrases, shard_words, carried):
                    base = 0
                    for b in held.to_batches():
                        found = [[{"w": w, "m": m, "items": i} for w, m, i in joined(hits.get(d, ()))] for d in range(base, base + b.num_rows)]
                        base += b.num_rows
                        cols, names = b.columns[:carried], b.schema.names[:carried]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, to_arrow_type(hits_type))], [*names, hits_name])

            if carried is None:
                hits_name = with_fresh(df, "hits")
                df = map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(hits_name, hits_type)]))
                carried = len(df.columns) - 1
            else:
                df = map_arrow(df, run, df.schema)
        phrases = Phrases([tuple(r) for r in rows], n)
    return df, carried, phrases


def find_spans(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, shard_words: int = SHARD_WORDS, side_bytes: int = SIDE_BYTES
) -> DataFrame:
    """key, start, end, items: one row for each merged span of a document."""
    key, text = name_of(df, key), name_of(df, text)
    kind = df.schema[key].dataType.simpleString()
    items_type = T.ArrayType(benchmark.schema[name_of(benchmark, item)].dataType)
    df, carried, phrases = _all_but_last(df.select(field(df, key).alias("key"), field(df, text).alias("text")), benchmark, 1, item, item_text, n, shard_words, side_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts, hits in shards(batches, 1, phrases, shard_words, carried):
            spans = {d: merged(texts[d], hits[d]) for d in sorted(hits)}
            at = [d for d in spans for _ in spans[d]]
            start, end, items = zip(*[s for d in spans for s in spans[d]]) if at else ((), (), ())
            cols = [held.column(0).take(pa.array(at, pa.int64())).combine_chunks(), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            cols[0] = pa.concat_arrays(cols[0].chunks) if isinstance(cols[0], pa.ChunkedArray) else cols[0]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(items, to_arrow_type(items_type))], ["key", "start", "end", "items"])

    return map_arrow(df, run, f"key {kind}, start int, end int, items {items_type.simpleString()}").withColumnRenamed("key", key)


def cut(
    df: DataFrame, benchmark: DataFrame, text: str = "text", chars: str | None = None, item: str = "item_id", item_text: str = "text", n: int = N, shard_words: int = SHARD_WORDS, side_bytes: int = SIDE_BYTES
) -> DataFrame:
    """df without the spans; `chars` names a column that holds the text's length."""
    where = df.columns.index(name_of(df, text))
    count = df.columns.index(chars) if chars in df.columns else None
    schema = df.schema
    df, carried, phrases = _all_but_last(df, benchmark, where, item, item_text, n, shard_words, side_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts, hits in shards(batches, where, phrases, shard_words, carried):
            for d, found in hits.items():
                t, at, parts = texts[d], 0, []
                for a, b, _ in merged(t, found):
                    parts.append(t[at:a])
                    at = b
                texts[d] = "".join(parts) + t[at:]
            base = 0
            for b in held.to_batches():
                cols = list(b.columns[:carried])
                own = range(base, base + b.num_rows)
                if hits:
                    cols[where] = pa.array(texts[base : base + b.num_rows], cols[where].type)
                    if count is not None:
                        was = cols[count].to_pylist()
                        cols[count] = pa.array([len(texts[d]) if d in hits else x for d, x in zip(own, was)], cols[count].type)
                base += b.num_rows
                yield pa.RecordBatch.from_arrays(cols, b.schema.names[:carried])

    return map_arrow(df, run, schema)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut(docs, table(spark, sf_dir, "benchmark"), chars="n_chars")
